"""Tagging and language models. Conversation turns are the sentences; a tag is the last letter class of a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import unknown_class
from ..operators import hmm as H
from ..operators import lm as L
from ..operators.graph import cut
from . import load, query
from .text import _CLASSES

SENT = "s AS (SELECT conv_id * 100 + turn AS sent, regexp_extract_all(lower(text), '[a-z]+') AS a FROM conversations)"
TAGGED = f"""{SENT}, g AS (SELECT sent, unnest(range(len(a))) AS pos, unnest(a) AS word FROM s),
tg AS (SELECT *, CASE WHEN regexp_matches(word, '(ing|tion)$') THEN 'N' WHEN regexp_matches(word, '(ed|er|en)$') THEN 'V' WHEN length(word) <= 3 THEN 'D' ELSE 'X' END AS tag FROM g)"""
TRANS = f"""{TAGGED}, tr AS (SELECT prev, tag, count(*) AS n FROM (SELECT coalesce(lag(tag) OVER (PARTITION BY sent ORDER BY pos), '--s--') AS prev, tag FROM tg UNION ALL SELECT arg_max(tag, pos), '--s--' FROM tg GROUP BY sent) GROUP BY 1, 2)"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sent"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("words"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    t = sentences(spark, sf).select("sent", F.posexplode("words").alias("pos", "word"))
    w = F.col("word")
    return t.withColumn("tag", F.when(w.rlike("(ing|tion)$"), "N").when(w.rlike("(ed|er|en)$"), "V").when(F.length(w) <= 3, "D").otherwise("X"))


@query(f"WITH {TAGGED} SELECT word FROM tg GROUP BY word HAVING count(*) >= 2")
def hmm_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return H.vocabulary(tagged(spark, sf))


@query(f"WITH {TAGGED}, v AS (SELECT word FROM tg GROUP BY word HAVING count(*) >= 2), x AS (SELECT tag, CASE WHEN v.word IS NULL THEN {_CLASSES.replace('(w,', '(tg.word,')} ELSE tg.word END AS word FROM tg LEFT JOIN v ON tg.word = v.word) SELECT tag, word, count(*) AS n FROM x GROUP BY 1, 2")
def hmm_emission(spark: SparkSession, sf: str) -> DataFrame:
    t = tagged(spark, sf)
    return H.emissions(H.with_unknown(t, H.vocabulary(t), unknown_class))


@query(f"WITH {TRANS} SELECT * FROM tr")
def hmm_transition(spark: SparkSession, sf: str) -> DataFrame:
    return H.transitions(tagged(spark, sf))


@query(f"""WITH {TRANS}, st AS (SELECT tag FROM tr UNION SELECT prev FROM tr), k AS (SELECT count(*) AS k FROM st), c AS (SELECT prev, sum(n) AS ctx FROM tr GROUP BY 1)
SELECT c.prev, st.tag, (coalesce(tr.n, 0) + 0.001::DOUBLE) / (ctx + 0.001::DOUBLE * k) AS p FROM c CROSS JOIN st CROSS JOIN k LEFT JOIN tr ON tr.prev = c.prev AND tr.tag = st.tag""")
def hmm_transition_prob(spark: SparkSession, sf: str) -> DataFrame:
    return H.transition_probabilities(H.transitions(tagged(spark, sf)))


@query(f"""WITH {TAGGED}, e AS (SELECT tag, word, count(*) AS n FROM tg GROUP BY 1, 2), c AS (SELECT tag, sum(n) AS ctx FROM e GROUP BY 1), v AS (SELECT count(DISTINCT word) AS words FROM e)
SELECT tag, word, (n + 0.001::DOUBLE) / (ctx + 0.001::DOUBLE * words) AS p FROM e JOIN c USING (tag) CROSS JOIN v""")
def hmm_emission_prob(spark: SparkSession, sf: str) -> DataFrame:
    return H.emission_probabilities(H.emissions(tagged(spark, sf)))


@query(f"""WITH {TAGGED}, t3 AS (SELECT coalesce(lag(tag, 2) OVER w, '--s--') AS t2, coalesce(lag(tag) OVER w, '--s--') AS t1, tag FROM tg WINDOW w AS (PARTITION BY sent ORDER BY pos)), c AS (SELECT t2, t1, tag, count(*) AS n FROM t3 GROUP BY ALL)
SELECT *, (1 + sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t2, t1))::BIGINT AS lambda FROM c""")
def hmm_trigram(spark: SparkSession, sf: str) -> DataFrame:
    return H.trigram_transitions(tagged(spark, sf))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with their folds; the first of ten is held out, the others train."""
    return H.folds(sentences(spark, sf).select("sent"), "sent", 10)


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    t, fold = tagged(spark, sf), cut(_split(spark, sf))
    train = cut(t.join(fold.filter("fold > 0").select("sent"), "sent", "left_semi"))
    vocab = cut(H.vocabulary(train))
    known = H.with_unknown(train, vocab, unknown_class)
    read = H.with_unknown(t, vocab, unknown_class).groupBy("sent").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return H.decode(read, H.transition_probabilities(H.transitions(train)), H.emissions(known))


#: The model of nine folds, and every sentence's best path position by position: the best way to each state, with its tags.
VITERBI = f"""{TAGGED}, fold AS (SELECT sent, (row_number() OVER (ORDER BY sent) - 1) // greatest(count(*) OVER () // 10, 1) AS fold FROM s),
tn AS MATERIALIZED (SELECT tg.* FROM tg JOIN fold USING (sent) WHERE fold > 0), voc AS MATERIALIZED (SELECT word FROM tn GROUP BY word HAVING count(*) >= 2),
rd AS MATERIALIZED (SELECT sent, pos, tag, CASE WHEN voc.word IS NULL THEN {_CLASSES.replace('(w,', '(tg.word,')} ELSE tg.word END AS word FROM tg LEFT JOIN voc ON tg.word = voc.word),
em AS MATERIALIZED (SELECT rd.tag, word, count(*) AS n FROM rd JOIN fold USING (sent) WHERE fold > 0 GROUP BY 1, 2), ct AS MATERIALIZED (SELECT tag, sum(n) AS ctx, (SELECT count(DISTINCT word) FROM em) AS nw FROM em GROUP BY 1),
lo AS MATERIALIZED (SELECT w.word, ct.tag, ln((coalesce(em.n, 0) + 0.001::DOUBLE) / (ctx + 0.001::DOUBLE * nw)) AS e FROM (SELECT DISTINCT word FROM rd) w CROSS JOIN ct LEFT JOIN em ON em.word = w.word AND em.tag = ct.tag),
tr AS MATERIALIZED (SELECT prev, tag, count(*) AS n FROM (SELECT coalesce(lag(tag) OVER (PARTITION BY sent ORDER BY pos), '--s--') AS prev, tag FROM tn UNION ALL SELECT arg_max(tag, pos), '--s--' FROM tn GROUP BY sent) GROUP BY 1, 2),
st AS (SELECT tag FROM tr UNION SELECT prev FROM tr), cx AS (SELECT prev, sum(n) AS ctx FROM tr GROUP BY 1),
tp AS MATERIALIZED (SELECT cx.prev, st.tag, ln((coalesce(tr.n, 0) + 0.001::DOUBLE) / (ctx + 0.001::DOUBLE * (SELECT count(*) FROM st))) AS p FROM cx CROSS JOIN st LEFT JOIN tr ON tr.prev = cx.prev AND tr.tag = st.tag),
vt AS (SELECT rd.sent, 0::BIGINT AS pos, lo.tag, tp.p + lo.e AS score, [lo.tag] AS path FROM rd JOIN lo USING (word) JOIN tp ON tp.prev = '--s--' AND tp.tag = lo.tag WHERE rd.pos = 0
UNION ALL SELECT sent, pos, tag, score, path FROM (SELECT vt.sent, rd.pos, lo.tag, max(vt.score + tp.p) + any_value(lo.e) AS score, list_append(arg_max(vt.path, vt.score + tp.p), lo.tag) AS path
FROM vt JOIN rd ON rd.sent = vt.sent AND rd.pos = vt.pos + 1 JOIN lo ON lo.word = rd.word JOIN tp ON tp.prev = vt.tag AND tp.tag = lo.tag GROUP BY vt.sent, rd.pos, lo.tag)),
lastpos AS (SELECT sent, max(pos) AS pos FROM rd GROUP BY 1),
dec AS (SELECT vt.sent, arg_max(path, score + tp.p) AS tags FROM vt JOIN lastpos USING (sent, pos) JOIN tp ON tp.prev = vt.tag AND tp.tag = '--s--' GROUP BY vt.sent)"""
HELD = f"""{VITERBI}, pr AS (SELECT rd.tag AS gold, tags[rd.pos + 1] AS tag FROM rd JOIN dec USING (sent) JOIN fold USING (sent) WHERE fold = 0)"""


@query(f"WITH RECURSIVE {VITERBI} SELECT sent, tags FROM dec")
def hmm_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    """All sentences, tagged by a model of nine folds; words outside its vocabulary stand for their class."""
    return _decoded(spark, sf)


def _held(spark: SparkSession, sf: str) -> DataFrame:
    said = _decoded(spark, sf).select("sent", F.posexplode("tags").alias("pos", "tag")).join(_split(spark, sf).filter("fold = 0").select("sent"), "sent", "left_semi")
    return tagged(spark, sf).select("sent", "pos", F.col("tag").alias("gold")).join(said, ["sent", "pos"])


@query(f"""WITH RECURSIVE {HELD}, gd AS (SELECT gold AS tag, count(*) AS n_gold, sum((gold = tag)::INT)::BIGINT AS n_right FROM pr GROUP BY 1), b AS (SELECT tag, count(*) AS n_said FROM pr GROUP BY 1)
SELECT gd.tag, n_gold, coalesce(n_said, 0) AS n_said, n_right, n_right / n_gold AS recall FROM gd LEFT JOIN b ON gd.tag = b.tag""")
def hmm_eval(spark: SparkSession, sf: str) -> DataFrame:
    """On the held-out fold."""
    return H.accuracy(_held(spark, sf))


@query(f"WITH RECURSIVE {HELD} SELECT gold, tag, count(*) AS n FROM pr GROUP BY 1, 2")
def hmm_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return H.confusion(_held(spark, sf))


@query(f"WITH {SENT}, n AS (SELECT sent, row_number() OVER (ORDER BY sent) - 1 AS i, count(*) OVER () // 10 AS k FROM s) SELECT sent, (i // greatest(k, 1))::BIGINT AS fold FROM n")
def hmm_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return H.folds(sentences(spark, sf).select("sent"), "sent", 10)


ORDER = 3
COUNTS = f"""{SENT}, x AS (SELECT list_concat(list_concat(['<s>'], a), ['</s>']) AS w FROM s), o AS (SELECT unnest([1, 2, 3]) AS n),
i AS (SELECT n, w, unnest(range(1, len(w) - n + 2)) AS i FROM x, o WHERE len(w) >= n), raw AS MATERIALIZED (SELECT n, array_to_string(w[i:i+n-1], ' ') AS gram, count(*) AS raw FROM i GROUP BY 1, 2),
r AS MATERIALIZED (SELECT *, regexp_extract(gram, '[^ ]+$') AS word, CASE WHEN n = 1 THEN '' ELSE regexp_replace(gram, ' [^ ]+$', '') END AS context FROM raw)"""
ADJ = f"""{COUNTS}, lf AS (SELECT n - 1 AS n, substr(gram, instr(gram, ' ') + 1) AS gram, count(DISTINCT split_part(gram, ' ', 1)) AS lefts FROM r WHERE n > 1 GROUP BY 1, 2),
adj AS MATERIALIZED (SELECT r.n, r.gram, context, word, raw, (CASE WHEN r.n = 1 AND r.gram = '<s>' THEN 0 WHEN r.n = 3 OR split_part(r.gram, ' ', 1) = '<s>' THEN raw ELSE coalesce(lefts, 0) END)::BIGINT AS adj FROM r LEFT JOIN lf ON r.n = lf.n AND r.gram = lf.gram)"""
DISC = f"""{ADJ}, nn AS (SELECT n, {', '.join(f'sum(CASE WHEN adj = {k} THEN 1 ELSE 0 END)::DOUBLE AS n{k}' for k in (1, 2, 3, 4))} FROM adj GROUP BY n),
dd AS (SELECT *, {', '.join(f'{j}.0::DOUBLE - {j + 1}.0::DOUBLE * (n1 / (n1 + 2 * n2)) * n{j + 1} / nullif(n{j}, 0) AS e{j}' for j in (1, 2, 3))} FROM nn),
disc AS MATERIALIZED (SELECT n, {', '.join(f'CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AND e1 BETWEEN 0 AND 1 AND e2 BETWEEN 0 AND 2 AND e3 BETWEEN 0 AND 3 THEN e{j} ELSE {0.5 * j}::DOUBLE END AS d{j}' for j in (1, 2, 3))} FROM dd)"""
UNI = f"""{DISC}, a AS MATERIALIZED (SELECT adj.*, CASE WHEN adj = 1 THEN d1 WHEN adj = 2 THEN d2 ELSE d3 END AS d FROM adj JOIN disc USING (n) WHERE adj > 0),
c AS (SELECT n, context, sum(adj) AS total, sum(d) AS taken FROM a GROUP BY 1, 2), u AS MATERIALIZED (SELECT a.n, gram, a.context, word, (adj - d) / total AS p, taken / total AS gamma FROM a JOIN c ON a.n = c.n AND a.context = c.context)"""
PROB = f"""{UNI}, v AS (SELECT count(*) + 1 AS v FROM adj WHERE n = 1 AND word <> '<s>'), p1 AS MATERIALIZED (SELECT n, gram, p + gamma / v AS prob FROM u, v WHERE n = 1),
p2 AS MATERIALIZED (SELECT u.n, u.gram, p + gamma * p1.prob AS prob FROM u JOIN p1 ON p1.gram = substr(u.gram, instr(u.gram, ' ') + 1) WHERE u.n = 2),
p3 AS MATERIALIZED (SELECT u.n, u.gram, p + gamma * p2.prob AS prob FROM u JOIN p2 ON p2.gram = substr(u.gram, instr(u.gram, ' ') + 1) WHERE u.n = 3)"""


@query(f"WITH {COUNTS} SELECT n::INTEGER AS n, gram, raw FROM r")
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.counts(sentences(spark, sf), ORDER).select("n", "gram", "raw")


@query(f"WITH {ADJ} SELECT n::INTEGER AS n, gram, adj FROM adj")
def lm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return L.adjusted(L.counts(sentences(spark, sf), ORDER), ORDER).select("n", "gram", "adj")


def _adj(spark: SparkSession, sf: str) -> DataFrame:
    """Counted once: discounts, probabilities and weights read the same table."""
    return cut(L.adjusted(L.counts(sentences(spark, sf), ORDER), ORDER))


@query(f"WITH {DISC} SELECT n::INTEGER AS n, d1, d2, d3 FROM disc")
def kn_discounts(spark: SparkSession, sf: str) -> DataFrame:
    return L.discounts(_adj(spark, sf))


@query(f"WITH {UNI} SELECT DISTINCT context, gamma FROM u WHERE n > 1")
def kn_gamma(spark: SparkSession, sf: str) -> DataFrame:
    a = _adj(spark, sf)
    return L.backoffs(a, L.discounts(a))


@query(f"WITH {PROB} SELECT n::INTEGER AS n, gram, round(prob, 9) AS prob FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)")
def kn_prob(spark: SparkSession, sf: str) -> DataFrame:
    a = _adj(spark, sf)
    return L.probabilities(a, L.discounts(a), ORDER).withColumn("prob", F.round("prob", 9))


@query(f"""WITH {PROB}, bk AS (SELECT DISTINCT context, gamma FROM u WHERE n > 1), q AS (SELECT item_id AS sent, list_concat(list_concat(['<s>'], regexp_extract_all(lower(text), '[a-z]+')), ['</s>']) AS w FROM benchmark),
k AS (SELECT sent, w, unnest(range(2, len(w) + 1)) AS i FROM q),
m AS (SELECT k.sent, x1.prob AS q1, x2.prob AS q2, x3.prob AS q3, b2.gamma AS b2, b3.gamma AS b3 FROM k LEFT JOIN p1 x1 ON x1.gram = w[i] LEFT JOIN p2 x2 ON x2.gram = array_to_string(w[i-1:i], ' ')
LEFT JOIN p3 x3 ON i >= 3 AND x3.gram = array_to_string(w[i-2:i], ' ') LEFT JOIN bk b2 ON b2.context = w[i-1] LEFT JOIN bk b3 ON i >= 3 AND b3.context = array_to_string(w[i-2:i-1], ' ')),
f AS (SELECT sent, coalesce(q3, coalesce(q2, q1 * coalesce(b2, 1)) * coalesce(b3, 1)) AS p FROM m)
SELECT sent, round(sum(log10(p)), 6) AS log10, sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END)::BIGINT AS oov, count(*) AS n FROM f GROUP BY sent""")
def lm_score(spark: SparkSession, sf: str) -> DataFrame:
    a = _adj(spark, sf)
    d = cut(L.discounts(a))
    q = load(spark, sf, "benchmark").select(F.col("item_id").alias("sent"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("words"))
    return L.score(q, L.probabilities(a, d, ORDER), L.backoffs(a, d), ORDER).withColumn("log10", F.round("log10", 6))


@query(f"WITH {ADJ} SELECT n::INTEGER AS n, count(*) AS kept FROM adj WHERE n = 1 OR raw > (CASE WHEN n = 2 THEN 1 ELSE 2 END) GROUP BY n")
def lm_prune(spark: SparkSession, sf: str) -> DataFrame:
    return L.prune(_adj(spark, sf), [0, 1, 2]).groupBy("n").agg(F.count("*").alias("kept"))


@query(f"""WITH {COUNTS}, vw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), z AS (SELECT n, gram, unnest(string_split(gram, ' ')) AS word FROM r),
ok AS (SELECT n, gram FROM z LEFT JOIN vw USING (word) GROUP BY n, gram HAVING count(vw.word) = n) SELECT n::INTEGER AS n, count(*) AS kept FROM ok GROUP BY n""")
def lm_filter(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return L.restrict(L.counts(sentences(spark, sf), ORDER), words).groupBy("n").agg(F.count("*").alias("kept"))


_ASKED = "ph AS (SELECT item_id AS sent, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), sv AS (SELECT DISTINCT sent, unnest(w) AS word FROM ph)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("sent"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("words"))


_SINGLE = f"""{COUNTS}, {_ASKED}, z AS MATERIALIZED (SELECT DISTINCT n, gram, unnest(string_split(gram, ' ')) AS word FROM r), zm AS (SELECT n, gram, count(*) AS m FROM z GROUP BY 1, 2),
h AS (SELECT sent, n, gram, count(*) AS k FROM z JOIN sv USING (word) GROUP BY 1, 2, 3), kept AS (SELECT sent, n, gram FROM h JOIN zm USING (n, gram) WHERE k = m)"""


@query(f"WITH {_SINGLE} SELECT sent, n::INTEGER AS n, count(*) AS kept FROM kept GROUP BY 1, 2")
def lm_filter_multiple(spark: SparkSession, sf: str) -> DataFrame:
    """For each sentence the model that its own words need."""
    v = _asked(spark, sf).select("sent", F.explode("words").alias("word"))
    return L.sentences_to_any(sentences(spark, sf), ORDER, v).groupBy("sent", "n").agg(F.count("*").alias("kept"))


@query(f"WITH {_SINGLE} SELECT n::INTEGER AS n, count(DISTINCT gram) AS kept FROM kept GROUP BY 1")
def lm_filter_union(spark: SparkSession, sf: str) -> DataFrame:
    """One model that serves every sentence."""
    v = _asked(spark, sf).select("sent", F.explode("words").alias("word"))
    return L.sentences_to_any(sentences(spark, sf), ORDER, v).select("n", "gram").distinct().groupBy("n").agg(F.count("*").alias("kept"))


@query(f"""WITH {COUNTS}, {_ASKED}, pi AS (SELECT w, unnest(range(1, len(w) + 1)) AS b FROM ph), ps AS (SELECT DISTINCT array_to_string(w[b:b + k - 1], ' ') AS gram FROM pi, (SELECT unnest([1, 2, 3]) AS k) WHERE b + k - 1 <= len(w))
SELECT n::INTEGER AS n, count(*) AS kept FROM r WHERE gram IN (SELECT gram FROM ps) GROUP BY n""")
def lm_filter_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return L.restrict_to_phrases(L.counts(sentences(spark, sf), ORDER), _asked(spark, sf)).groupBy("n").agg(F.count("*").alias("kept"))
