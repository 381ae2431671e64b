"""A query for each family of the grammar, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import grammar as G
from . import ORACLE, QUERIES, load

_CLOSED = " ".join("WHEN lower(w) IN ({}) THEN '{}'".format(", ".join(f"'{w}'" for w in ws.split()), k) for k, ws in G.CLOSED.items())
_OPEN = " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{k}'" for k, p in G.OPEN)
CLASSES = f"""s AS (SELECT doc_id, unnest(string_split_regex(text, '{G.STOPS}')) AS s FROM documents),
c AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(s, '{G.TOKEN.replace("'", "''")}'), lambda w: CASE {_CLOSED} {_OPEN} ELSE '{G.NOUN}' END), ''), '{G.PIECE}')) AS classes FROM s)"""


def _family(family: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return G.matched(G.class_strings(load(spark, sf, "documents")), family)

    return run


for _f in G.FAMILIES:
    _rules = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, unnest(regexp_extract_all(classes, '{G.expanded(rule)}')) AS m FROM c" for f, name, rule in G.RULES if f == _f)
    QUERIES[f"grammar_{_f}"] = _family(_f)
    ORACLE[f"grammar_{_f}"] = f"WITH {CLASSES}, f AS ({_rules}) SELECT doc_id, rule, count(*) AS n, sum(length(m))::BIGINT AS words FROM f WHERE m <> '' GROUP BY doc_id, rule"
