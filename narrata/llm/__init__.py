"""Training-data operators: quality, mixing, licences, deduplication, archives, token stores.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
