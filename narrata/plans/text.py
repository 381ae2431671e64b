"""Text structure and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import corpus as C
from ..operators import text as T
from . import load, query
from .corpus import known_words, words

LINES = "l AS (SELECT doc_id, unnest(range(len(a))) AS line, unnest(a) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"
FLAGS = f"""{LINES}, f AS (SELECT *, trim(s) = '' AS is_blank, regexp_matches(s, '^[ \\t]+[^ \\t]') AS is_indented, length(s) < 40 AS is_short,
regexp_matches(upper(trim(s)), '{T.SECTION}') OR (regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[a-z]')) AS is_header, regexp_matches(s, '^[ \\t]*[0-9]+[.)]') AS is_numbered FROM l)"""
TOKENS = "tok AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}'']+') AS a FROM documents))"


@query(f"""WITH {FLAGS} SELECT doc_id, count(*) AS n_lines, {', '.join(f"sum({c}::INT)::BIGINT AS {c.replace('is_', 'n_')}" for c in ('is_blank', 'is_indented', 'is_short', 'is_header', 'is_numbered'))} FROM f GROUP BY doc_id""")
def paragraph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return T.paragraph_stats(load(spark, sf, "documents"))


@query(f"WITH {FLAGS} SELECT doc_id, min(line)::INTEGER AS start_line FROM f WHERE NOT is_blank AND NOT is_short AND NOT is_header AND NOT is_numbered GROUP BY doc_id")
def text_start(spark: SparkSession, sf: str) -> DataFrame:
    return T.text_start(load(spark, sf, "documents"))


@query(f"WITH {FLAGS} SELECT doc_id, line::INTEGER AS line, s FROM f WHERE is_header AND NOT is_blank AND is_short")
def section_headers(spark: SparkSession, sf: str) -> DataFrame:
    return T.line_flags(T.lines(load(spark, sf, "documents"))).filter("is_header and not is_blank and is_short").select("doc_id", "line", "s")


MULTI = f"""{TOKENS}, g2 AS (SELECT doc_id, pos, lower(w) || ' ' || lower(lead(w) OVER d) AS gram FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
g3 AS (SELECT doc_id, pos, lower(w) || ' ' || lower(lead(w) OVER d) || ' ' || lower(lead(w, 2) OVER d) AS gram FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT gram FROM (SELECT * FROM g2 UNION ALL SELECT * FROM g3) WHERE gram IS NOT NULL GROUP BY gram HAVING count(DISTINCT doc_id) >= 40),
f AS (SELECT doc_id, pos, gram, 2 AS n FROM g2 WHERE gram IN (SELECT gram FROM e) UNION ALL SELECT doc_id, pos, gram, 3 FROM g3 WHERE gram IN (SELECT gram FROM e)),
m AS MATERIALIZED (SELECT doc_id, pos::INTEGER AS pos, arg_max(gram, n) AS entry, max(n)::INTEGER AS n FROM f GROUP BY doc_id, pos)"""
#: A cover from left to right: from each row on to the first that begins where it ends or later.
COVER = """nx AS MATERIALIZED (SELECT m.doc_id, m.pos, g.pos AS nxt FROM m ASOF LEFT JOIN m g ON m.doc_id = g.doc_id AND m.pos + m.n <= g.pos),
cv AS (SELECT doc_id, min(pos) AS pos FROM m GROUP BY doc_id UNION ALL SELECT nx.doc_id, nx.nxt FROM cv JOIN nx ON cv.doc_id = nx.doc_id AND cv.pos = nx.pos WHERE nxt IS NOT NULL)"""


@query(f"WITH {MULTI} SELECT * FROM m")
def multiword_longest(spark: SparkSession, sf: str) -> DataFrame:
    return _multiword(spark, sf)[0]


def _multiword(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """Entries are the phrases of two or three words that 40 documents have; also whether rows stand in order."""
    docs = load(spark, sf, "documents")
    entries = T.frequent_grams(docs, C.TOKEN, 3, 40)
    return T.longest_of(docs, C.TOKEN, entries), all(near for _, near in entries[1:])


@query(f"WITH RECURSIVE {MULTI}, {COVER} SELECT m.* FROM m JOIN cv USING (doc_id, pos)")
def multiword_cover(spark: SparkSession, sf: str) -> DataFrame:
    found, in_order = _multiword(spark, sf)
    return T.greedy_in_order(found) if in_order else T.greedy(found)


_CLASSES = "CASE WHEN regexp_matches(w, '[0-9]') THEN '--unk_digit--' WHEN regexp_matches(w, '[^A-Za-z0-9\\s]') THEN '--unk_punct--' WHEN regexp_matches(w, '[A-Z]') THEN '--unk_upper--' " + " ".join(
    f"WHEN regexp_matches(w, '{p}') THEN '--unk_{n}--'" for n, p in (("noun", S.NOUN_SUFFIX), ("verb", S.VERB_SUFFIX), ("adj", S.ADJ_SUFFIX), ("adv", S.ADV_SUFFIX))
) + " ELSE '--unk--' END"


@query(f"WITH {TOKENS} SELECT c AS class, count(*) AS n FROM (SELECT {_CLASSES} AS c FROM tok) GROUP BY c")
def unk_class(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy(S.unknown_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"))


_KIND = "CASE " + " ".join("WHEN regexp_full_match(w, '{}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in S.KINDS) + " END"


@query(f"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '{S.TOKEN_PATTERN.replace("'", "''")}')) AS w FROM documents) SELECT doc_id, {_KIND} AS kind, count(*) AS n FROM k GROUP BY 1, 2""")
def token_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = C.tokens(load(spark, sf, "documents"), S.TOKEN_PATTERN)
    return t.groupBy("doc_id", S.token_kind(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


_RULES = ", ".join(f"({i}, '{s}', '{o}', {m}, {k})".lower() for i, (s, o, m, k) in enumerate(T.STEM_RULES))
#: Each step applies the first rule that fits; a word ends where none does or its rule says so.
STEMS = f"""{TOKENS}, rl(seq, suf, oth, more, fresh) AS (VALUES {_RULES}), wd AS MATERIALIZED (SELECT DISTINCT lower(w) AS word FROM tok),
sm AS (SELECT word, word AS cur, true AS intact, word IN ({', '.join(f"'{w}'" for w in sorted(T.PROTECTED))}) AS done, 0 AS k FROM wd
UNION ALL SELECT word, new, false, fin, k + 1 FROM (SELECT sm.word, sm.k, arg_min(substr(cur, 1, length(cur) - length(suf)) || oth, seq) AS new, arg_min(suf = oth OR NOT more, seq) AS fin
FROM sm JOIN rl ON ends_with(cur, suf) AND (intact OR NOT fresh) AND length(cur) - length(suf) + length(oth) >= 3 WHERE NOT done GROUP BY sm.word, sm.k)),
stems AS MATERIALIZED (SELECT word, arg_max(cur, k) AS stem FROM sm GROUP BY word)"""


@query(f"WITH RECURSIVE {STEMS} SELECT * FROM stems")
def stem_words(spark: SparkSession, sf: str) -> DataFrame:
    return T.stems(words(spark, sf).select(F.lower("w").alias("word")))


_KNOWN = f"{TOKENS}, k AS (SELECT lower(w) AS word FROM tok WHERE length(w) <= 32 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5), v AS (SELECT DISTINCT lower(w) AS word FROM tok)"


@query(f"""WITH {_KNOWN}, p(prefix) AS (VALUES ('re'), ('un'), ('in'), ('th'), ('on'), ('over'))
SELECT v.word, prefix, substr(v.word, length(prefix) + 1) AS rest FROM v JOIN p ON starts_with(v.word, prefix) AND length(v.word) > length(prefix) + 2 WHERE substr(v.word, length(prefix) + 1) IN (SELECT word FROM k)""")
def prefix_strip(spark: SparkSession, sf: str) -> DataFrame:
    toks = words(spark, sf)
    prefixes = spark.createDataFrame([(p,) for p in ("re", "un", "in", "th", "on", "over")], "prefix string")
    return T.strip_prefix(toks.select(F.lower("w").alias("word")).distinct(), prefixes, known_words(toks))


@query(f"WITH RECURSIVE {STEMS}, kn AS (SELECT lower(w) AS word FROM tok WHERE length(w) <= 32 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5) SELECT word, stem FROM stems WHERE stem <> word AND stem IN (SELECT word FROM kn)")
def disincline(spark: SparkSession, sf: str) -> DataFrame:
    """Stems that are known words of their own."""
    toks = words(spark, sf)
    known = known_words(toks).withColumnRenamed("word", "stem")
    return T.stems(toks.select(F.lower("w").alias("word"))).filter("stem <> word").join(known, "stem", "left_semi").select("word", "stem")


@query(f"""WITH {TOKENS}, c AS (SELECT doc_id, pos, w, string_agg(w, ' ') OVER (d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b, string_agg(w, ' ') OVER (d ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS a FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INTEGER AS pos, w, coalesce(b, '') AS before, coalesce(a, '') AS after FROM c WHERE lower(w) = 'from'""")
def kwic(spark: SparkSession, sf: str) -> DataFrame:
    return T.concordance(words(spark, sf), "from")


@query("SELECT page_id, replace(url_encode(url), '+', '%20') AS enc, url_decode(replace(url_encode(url), '+', '%20')) = url AS same FROM pages")
def url_codec(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages")
    return p.select("page_id", S.url_encoded(F.col("url")).alias("enc"), (S.url_decoded(S.url_encoded(F.col("url"))) == F.col("url")).alias("same"))


@query("SELECT p_partkey, lower(list_extract(string_split_regex(regexp_replace(p_name, '[0-9]+$', ''), '[ _]+'), -1)) AS category FROM part")
def category_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", S.category(F.col("p_name")).alias("category"))


_NUMBERS = ", ".join(f"('{x}', {i})" for names in (S.CARDINALS, S.ORDINALS) for i, x in enumerate(names))


@query(f"WITH {TOKENS}, n(w, v) AS (VALUES {_NUMBERS}) SELECT doc_id, v AS value, count(*) AS n FROM tok JOIN n ON lower(tok.w) = n.w GROUP BY 1, 2")
def number_words(spark: SparkSession, sf: str) -> DataFrame:
    t = words(spark, sf).select("doc_id", S.number_word(F.col("w")).alias("value")).filter("value is not null")
    return t.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


_TIMES = " ".join("WHEN lower(w) IN ({}) THEN '{}'".format(", ".join(f"'{w}'" for w in ws.split()), k) for k, ws in S.TIME_WORDS.items())


@query(f"WITH {TOKENS}, k AS (SELECT doc_id, CASE {_TIMES} END AS kind FROM tok) SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2")
def time_words(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).select("doc_id", S.time_word(F.col("w")).alias("kind")).filter("kind is not null").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN ord(c) > 127 THEN '\\u' || lpad(to_hex(ord(c)), greatest(4, length(to_hex(ord(c))))::INTEGER, '0') ELSE c END), '')) AS digest FROM documents""")
def code_points(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in ASCII alone, by their digests."""
    return load(spark, sf, "documents").select("doc_id", F.md5(S.code_points(F.col("text"))).alias("digest"))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) AS w FROM documents) SELECT doc_id, sum(CASE WHEN regexp_full_match(w, '[A-Za-z''-]+') THEN 1 ELSE 0 END)::BIGINT AS latin, count(*) AS n FROM x GROUP BY doc_id""")
def filter_non_latin(spark: SparkSession, sf: str) -> DataFrame:
    t = C.tokens(load(spark, sf, "documents"), "[^\\s]+")
    return t.groupBy("doc_id").agg(F.sum(S.latin_only(F.col("w")).cast("long")).alias("latin"), F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT doc_id, pos::INTEGER AS pos, w FROM tok WHERE regexp_matches(w, '(?i)^tion') ORDER BY doc_id, pos LIMIT 31")
def search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).filter(F.col("w").rlike("(?i)^tion")).orderBy("doc_id", "pos").limit(31)
