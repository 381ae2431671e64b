"""Question answering: candidate relations are pruned, matched part by part, scored and ranked.

Relations are rows: rel_id, source, subject, verb, object, prep, prep_object (words), negation, in_question. Questions
have the same columns and q_id. Candidates are found by an equi-join on the verb or a synonym of it, never pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each part is worth, and the least total of a candidate.
WORTH = {"subject": 8, "verb": 8, "object": 8, "prep": 2, "prep_object": 4}
LEAST = 14
NO_MATCH = 100_000
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "who")
BE = ("am", "is", "are", "was", "were", "be")


def switched(rel: DataFrame) -> DataFrame:
    """For forms of to be a copy with subject and object swapped."""
    swap = rel.filter(F.col("verb").isin(*BE) & F.col("object").isNotNull()).withColumns({"subject": F.col("object"), "object": F.col("subject")})
    return rel.withColumn("swapped", F.lit(False)).unionByName(swap.withColumn("swapped", F.lit(True)))


def candidates(questions: DataFrame, rel: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Question and relation pairs whose verbs are equal or synonyms, without questions and other polarity."""
    verbs = questions.select("q_id", "verb").withColumn("how", F.lit("exact")).select("q_id", F.col("verb").alias("v"), "how")
    syn = questions.select("q_id", "verb").join(synonyms, F.col("verb") == F.col("word")).select("q_id", F.col("synonym").alias("v"), F.lit("synonym").alias("how"))
    keys = verbs.unionByName(syn).groupBy("q_id", "v").agg(F.min("how").alias("how"))
    q = questions.select("q_id", *[F.col(c).alias(f"q_{c}") for c in (*WORTH, "negation")])
    c = keys.join(rel.filter(~F.col("in_question")), F.col("v") == F.col("verb")).join(q, "q_id")
    return c.filter(F.col("negation") == F.col("q_negation"))


def score_part(question: Column, answer: Column, synonym: Column, worth: int) -> Column:
    """Exact gets the worth, a synonym three quarters, a pronoun nothing, another word its negative; no part asked, nothing."""
    return (
        F.when(question.isNull() | (question == "?"), 0).when(answer.isNull(), 0).when(F.lower(answer).isin(*PRONOUNS), 0)
        .when(F.lower(question) == F.lower(answer), worth).when(synonym, worth * 3 // 4).otherwise(-worth)
    )


def scored(pairs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds s_<part> and total; keeps totals above the threshold with a matched subject or a subject asked for."""
    out = pairs
    for part in ("subject", "object", "prep_object"):
        s = synonyms.select(F.col("word").alias(f"q_{part}"), F.col("synonym").alias(part), F.lit(True).alias(f"_syn_{part}")).distinct()
        out = out.join(s, [f"q_{part}", part], "left")
    part = lambda p: score_part(F.col(f"q_{p}"), F.col(p), F.coalesce(F.col(f"_syn_{p}"), F.lit(False)), WORTH[p])
    out = out.withColumns({
        "s_subject": part("subject"), "s_object": part("object"), "s_prep_object": part("prep_object"),
        "s_verb": F.when(F.col("how") == "exact", WORTH["verb"]).otherwise(WORTH["verb"] * 3 // 4),
        "s_prep": F.when(F.col("q_prep").isNotNull() & (F.col("q_prep") == F.col("prep")), WORTH["prep"]).otherwise(0),
    })
    return out.withColumn("total", F.col("s_subject") + F.col("s_verb") + F.col("s_object") + F.col("s_prep") + F.col("s_prep_object")).drop(*[f"_syn_{p}" for p in ("subject", "object", "prep_object")])


def matched(pairs: DataFrame, least: int = LEAST) -> DataFrame:
    return pairs.filter((F.col("total") > least) & (F.col("s_verb") > 0) & ((F.col("s_subject") > 0) | (F.col("q_subject") == "?")))


def with_identical(answers: DataFrame, order: str) -> DataFrame:
    """Number of equal answers to the question, and how many came earlier."""
    w = Window.partitionBy("q_id", F.lower("answer"))
    return answers.withColumns({"identical": F.count("*").over(w), "earlier": F.row_number().over(w.orderBy(order)) - 1})


def type_check(wants: Column, object_class: Column) -> Column:
    """1 where the question word and the answer's class agree, else a fraction of no match."""
    person, place, time = object_class == "person", object_class == "place", object_class == "time"
    return (
        F.when(wants == "who", F.when(person, 1).when(place | time, NO_MATCH).otherwise(NO_MATCH // 2))
        .when(wants == "where", F.when(place, 1).when(person | time, NO_MATCH).otherwise(NO_MATCH // 2))
        .when(wants == "when", F.when(time, 1).when(person | place, NO_MATCH).otherwise(NO_MATCH // 2)).otherwise(1)
    )


def best(answers: DataFrame, order: str) -> DataFrame:
    """Answers with a confidence under no match and a good score; the most frequent gains 4, the most confident 6; the
    highest remain, each text once."""
    a = with_identical(answers.filter((F.col("total") >= LEAST) & (F.col("confidence") < NO_MATCH)), order)
    w = Window.partitionBy("q_id")
    a = a.withColumn("most", F.max("identical").over(w)).withColumn("sure", F.min("confidence").over(w))
    a = a.withColumn("final", F.col("total") + F.when((F.col("identical") == F.col("most")) & (F.col("most") > 1), 4).otherwise(0) + F.when(F.col("confidence") == F.col("sure"), 6).otherwise(0))
    a = a.withColumn("_top", F.max("final").over(w)).filter(F.col("final") == F.col("_top")).drop("_top", "most", "sure")
    first = Window.partitionBy("q_id", F.lower("answer")).orderBy(order)
    return a.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def divided(scores: DataFrame, group: list[str], score: str) -> DataFrame:
    """With several matching subjects each gets its share."""
    n = scores.groupBy(*group).agg(F.count("*").alias("_n"))
    return scores.join(n, group).withColumn(score, F.expr(f"{score} div _n")).drop("_n")


def nouns_as_verbs(rel: DataFrame, nouns: DataFrame) -> DataFrame:
    """"is a runner" also says "runs": a relation with the noun's verb for each such object."""
    j = rel.filter(F.col("verb").isin(*BE)).join(nouns, F.col("object") == F.col("noun"))
    return j.select(*[c for c in rel.columns if c not in ("verb", "object")], F.col("noun_verb").alias("verb"), F.lit(None).cast("string").alias("object")).select(*rel.columns)


def two_step(first: DataFrame, second: DataFrame) -> DataFrame:
    """Subquery: the answers of the relative clause become the subjects of the main one."""
    a = first.select("q_id", F.lower("answer").alias("_via"))
    return second.join(a, (second["q_id"] == a["q_id"]) & (F.lower("subject") == F.col("_via"))).drop(a["q_id"]).drop("_via")


def transformed(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """Rewrites: for each rule whose verb is the question's, a copy with the rule's verb, its preposition, and subject
    and object exchanged where the rule says so. Originals stay."""
    j = questions.join(rules.select(F.col("verb").alias("_v"), "new_verb", "new_prep", "swap"), F.col("verb") == F.col("_v"))
    new = j.select(
        "q_id", F.when(F.col("swap"), F.col("object")).otherwise(F.col("subject")).alias("subject"), F.col("new_verb").alias("verb"),
        F.when(F.col("swap"), F.col("subject")).otherwise(F.col("object")).alias("object"), F.coalesce("new_prep", "prep").alias("prep"), "prep_object", "negation",
    )
    return questions.unionByName(new.select(*questions.columns))


def infobox(questions: DataFrame, facts: DataFrame, properties: dict[str, str], score: int = 1000) -> DataFrame:
    """Answers that a subject's fact sheet has outright: properties maps question verbs to fact names."""
    p = F.create_map(*[F.lit(x) for kv in properties.items() for x in kv])
    q = questions.withColumn("_p", p[F.col("verb")]).filter("_p is not null")
    return q.join(facts, (F.lower("subject") == F.lower("entity")) & (F.col("_p") == F.col("property"))).select("q_id", F.col("value").alias("answer"), F.lit(score).alias("total"), F.lit(1).alias("confidence"))


def parent_group(answers: DataFrame, classes: DataFrame) -> DataFrame:
    """Keeps answers whose super-classes hold the class that the question asks for, where it asks for one."""
    ok = answers.join(classes.select(F.lower("node").alias("_n"), F.lower("super").alias("_s")), (F.lower("answer") == F.col("_n")) & (F.lower("wanted") == F.col("_s")), "left_semi")
    return ok.unionByName(answers.filter("wanted is null"))


def constrained(answers: DataFrame) -> DataFrame:
    """Distinct final answers in any case, the best score of each."""
    return answers.groupBy("q_id", F.lower("answer").alias("answer")).agg(F.max("final").alias("final"))


def staged_answers(*stages: DataFrame) -> DataFrame:
    """Answers of the first stage that has any, for each question: facts, then best matches, then tables, then proximity."""
    out = None
    for s in stages:
        s = s.select("q_id", "answer", "total")
        out = s if out is None else out.unionByName(s.join(out.select("q_id").distinct(), "q_id", "left_anti"))
    return out


def semantic_check(answers: DataFrame, associations: DataFrame, synonyms: DataFrame) -> DataFrame:
    """confidence: a quarter of no match where a word of the answer's types (answer, word) is the wanted word, half where
    it is a synonym of it, else no match."""
    j = answers.join(associations.select(F.lower("answer").alias("_a"), F.lower("word").alias("_w")), F.lower("answer") == F.col("_a"), "left")
    s = synonyms.select(F.lower("word").alias("_q"), F.lower("synonym").alias("_v"), F.lit(True).alias("_syn")).distinct()
    j = j.join(s, (F.lower("wanted") == F.col("_q")) & (F.col("_w") == F.col("_v")), "left")
    c = F.min(F.when(F.col("_w") == F.lower("wanted"), NO_MATCH // 4).when(F.col("_syn"), NO_MATCH // 2).otherwise(NO_MATCH))
    return j.groupBy(*answers.columns).agg(c.alias("confidence"))


def music_answers(questions: DataFrame, releases: DataFrame) -> DataFrame:
    """Answers from a release table: questions name what they want (artist, label, title) and give another field's value;
    the most frequent values win, ties included."""
    fields = ("artist", "label", "title")
    given = releases.select("release_id", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("g"))
    hits = questions.join(given, (F.col("given") == F.col("g.f")) & (F.lower("value") == F.lower("g.v"))).select("q_id", "wanted", "release_id").distinct()
    wanted = F.when(F.col("wanted") == "artist", F.col("artist")).when(F.col("wanted") == "label", F.col("label")).otherwise(F.col("title"))
    found = hits.join(releases, "release_id").select("q_id", wanted.alias("answer")).filter("answer is not null")
    n = found.groupBy("q_id", "answer").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("q_id").agg(F.max("n").alias("n")), ["q_id", "n"]).select("q_id", "answer", "n")


def identical_particulars(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Objects of two sources that are one: equal normalised keys."""
    norm = lambda d, p: d.select(F.col("id").alias(p), *[F.regexp_replace(F.lower(k), "[^a-z0-9]+", " ").alias(k) for k in keys])
    return norm(a, "a").join(norm(b, "b"), keys).select("a", "b")
