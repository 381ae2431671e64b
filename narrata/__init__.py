"""Narrative text analytics on Spark: corpus statistics, language models, relations, ontologies, tables, answers."""

__version__ = "0.1.0"
