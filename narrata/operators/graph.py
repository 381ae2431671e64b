"""Ontologies: merging, ranks and closures by fixpoint, preferences, word associations, hypernym paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNRANKED = 100


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a loop's table: a checkpoint in the shared folder, or none where no folder is set (tests)."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    import tempfile

    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="narrata-graph-"))
    return df.checkpoint()


def merge_sources(*edges: DataFrame) -> DataFrame:
    """(key, super_classes) of triples (s, p, o): superClassOf is turned around."""
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    inverse = F.col("p") == "superClassOf"
    e = every.filter(F.col("p").isin("subClassOf", "superClassOf")).select(F.when(inverse, F.col("o")).otherwise(F.col("s")).alias("key"), F.when(inverse, F.col("s")).otherwise(F.col("o")).alias("super"))
    return e.groupBy("key").agg(F.array_sort(F.collect_set("super")).alias("super_classes"))


def ranks(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, rank): 0 without a resolvable parent, else the first (least) resolvable parent's rank + 1; cycles stay unranked.

    One join a level; a node is looked at again only until it has its rank.
    """
    parent = edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").groupBy("child").agg(F.min("parent").alias("parent"))
    todo = cut(nodes.join(parent, F.col("node") == F.col("child"), "left").select("node", "parent"))
    done = cut(todo.filter("parent is null").select("node", F.lit(0).alias("rank")))
    level, rest = done, todo.filter("parent is not null")
    for k in range(1, most):
        level = cut(rest.join(level.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.lit(k).alias("rank")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    else:
        raise RuntimeError(f"classes lie more than {most} levels deep")
    return nodes.join(done, "node", "left").select("node", F.coalesce("rank", F.lit(UNRANKED)).alias("rank"))


def closure(start: DataFrame, edges: DataFrame, stop: list[str], most: int = 1000) -> DataFrame:
    """(node, super, distance): all super-classes, breadth first, each once; stop-list classes are not passed."""
    seen = cut(start.join(edges, F.col("node") == F.col("child")).filter(~F.col("parent").isin(*stop)).groupBy("node", F.col("parent").alias("super")).agg(F.lit(1).alias("distance")))
    frontier = seen
    for k in range(2, most):
        step = frontier.join(edges, F.col("super") == F.col("child")).filter(~F.col("parent").isin(*stop)).select("node", F.col("parent").alias("super")).distinct()
        frontier = cut(step.join(seen, ["node", "super"], "left_anti").withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    else:
        raise RuntimeError(f"super-classes lie more than {most} steps away")
    return seen


def hypernym_path(start: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, path): follow the first pointer upwards."""
    first = edges.groupBy("child").agg(F.min("parent").alias("up"))
    now = start.select("node", F.col("node").alias("at"), F.array("node").alias("path"), F.lit(True).alias("open"))
    for _ in range(most):
        now = now.join(first, F.col("at") == F.col("child"), "left").drop("child")
        go = F.col("open") & F.col("up").isNotNull() & ~F.array_contains("path", F.col("up"))
        now = cut(now.select("node", F.when(go, F.col("up")).otherwise(F.col("at")).alias("at"), F.when(go, F.concat("path", F.array("up"))).otherwise(F.col("path")).alias("path"), go.alias("open")))
        if now.filter("open").isEmpty():
            break
    else:
        raise RuntimeError(f"a path has more than {most} steps")
    return now.select("node", F.array_join("path", ">").alias("path"))


def prefer(types: DataFrame, group: list[str], confidence: str, rank: str) -> DataFrame:
    """Marks the types of least confidence value, and among these those of least rank."""
    w = Window.partitionBy(*group).orderBy(confidence, rank)
    return types.withColumn("preferred", F.rank().over(w) == 1)


def category_rank(uri: Column, table: list[tuple[str, int]], otherwise: int = UNRANKED) -> Column:
    out = F.when(F.lit(False), 0)
    for prefix, rank in table:
        out = out.when(uri.startswith(prefix), rank)
    return out.otherwise(otherwise)


def known_types(types: DataFrame, canonical: DataFrame) -> DataFrame:
    """Known classes under their canonical names, the least confidence value of each."""
    return types.join(canonical, "type").groupBy("entity", "canonical").agg(F.min("confidence").alias("confidence"))


def word_associations(types: DataFrame) -> DataFrame:
    """(type, word, confidence): a type's words; of several words the last counts double; later writes overwrite."""
    w = F.split(F.lower("label"), "[ _]+")
    e = types.select("type", "seq", "confidence", w.alias("w"))
    single = e.filter(F.size("w") == 1).select("type", F.get("w", 0).alias("word"), "confidence", "seq")
    several = e.filter(F.size("w") > 1).select("type", F.element_at("w", -1).alias("word"), (F.col("confidence") * 2).alias("confidence"), "seq")
    return single.unionByName(several).groupBy("type", "word").agg(F.max_by("confidence", "seq").alias("confidence"))


def synonyms(base: DataFrame, override: DataFrame, thesaurus: DataFrame, removed: DataFrame) -> DataFrame:
    """(word, synonym): all sources together without the removed pairs."""
    return base.unionByName(override).unionByName(thesaurus).distinct().join(removed, ["word", "synonym"], "left_anti")


def coordinates(edges: DataFrame) -> DataFrame:
    """(node, sister): terms with a common parent. The result has a row for each pair, as the operation is defined; a
    parent of more than 10,000 children is an error of the hierarchy, and raised as one."""
    sizes = edges.groupBy("parent").agg(F.count("*").alias("n"))
    small = sizes.filter(F.when(F.col("n") <= 10_000, True).otherwise(F.raise_error(F.lit("a class has too many children to pair")).cast("boolean")))
    edges = edges.join(small.select("parent"), "parent")
    a, b = edges.alias("a"), edges.alias("b")
    return a.join(b, F.col("a.parent") == F.col("b.parent")).filter(F.col("a.child") != F.col("b.child")).select(F.col("a.child").alias("node"), F.col("b.child").alias("sister")).distinct()


def identified(entities: DataFrame, ontology: DataFrame, acronyms: DataFrame, absent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, new negatives): entities looked up by name, then by what their acronym stands for; known negatives aren't tried."""
    todo = entities.join(absent, "name", "left_anti")
    direct = todo.join(ontology, "name").select("name", "class", F.lit("name").alias("by"))
    rest = todo.join(direct.select("name").distinct(), "name", "left_anti")
    long = rest.join(acronyms, F.col("name") == F.col("acronym")).join(ontology.withColumnRenamed("name", "meaning"), "meaning").select("name", "class", F.lit("acronym").alias("by"))
    found = direct.unionByName(long)
    return found, todo.select("name").distinct().join(found.select("name"), "name", "left_anti")


def extended(names: DataFrame, ontology: DataFrame) -> DataFrame:
    """Longest first: a name with its prepositional extensions ('a of b of c'), cut from the right until one is known."""
    parts = F.split("name", " of ")
    cuts = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), " of ").alias("cut")))).alias("c"))
    j = cuts.join(ontology.withColumnRenamed("name", "_n"), F.col("c.cut") == F.col("_n"))
    return j.groupBy("name").agg(F.max_by("class", "c.k").alias("class"), F.max_by("c.cut", "c.k").alias("matched"))


def isa_from_text(sentences: DataFrame) -> DataFrame:
    """(entity, class) from 'X is a/an/the ... Y' at the beginning of an article's first sentence."""
    m = "^([A-Z][\\w ]*?) (?:is|was) (?:a|an|the) (?:[a-z]+ )*?([a-z]+)(?:[ ]?[,.]| who| that| which| of| in| from)"
    return sentences.select(F.regexp_extract("text", m, 1).alias("entity"), F.regexp_extract("text", m, 2).alias("class")).filter("entity <> ''")


def hyponyms(edges: DataFrame) -> DataFrame:
    """(node, below): the terms right below each."""
    return edges.select(F.col("parent").alias("node"), F.col("child").alias("below")).distinct()


def antonyms(pairs: DataFrame, similar: DataFrame) -> DataFrame:
    """(word, antonym): pairs in both directions, and those of words that are similar to one of a pair."""
    both = pairs.select("word", "antonym").union(pairs.select("antonym", "word")).distinct()
    more = similar.select("word", F.col("synonym").alias("_s")).join(both.select(F.col("word").alias("_s"), "antonym"), "_s").select("word", "antonym")
    return both.unionByName(more).distinct()


def familiarity(senses: DataFrame) -> DataFrame:
    """(word, senses, familiar): how many senses a word has, in six steps from extremely rare (0) to extremely familiar."""
    n = senses.groupBy("word").agg(F.count_distinct("sense").alias("senses"))
    s = F.col("senses")
    return n.withColumn("familiar", F.when(s <= 1, 1).when(s == 2, 2).when(s <= 4, 3).when(s <= 8, 4).when(s <= 16, 5).otherwise(6))


def properties(triples: DataFrame, subject: str, property_: str, alias: str = "alias") -> DataFrame:
    """Values of a property of the subjects that a name stands for, by their own name or an alias."""
    ids = triples.filter(F.col("p").isin("name", alias) & (F.lower("o") == subject.lower())).select("s").distinct()
    return triples.filter(F.col("p") == property_).join(ids, "s").select("s", F.col("o").alias("value"))
