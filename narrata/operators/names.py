"""Names: structs of parts, compatibility as boolean columns, merging, and linkage within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import number_word
from .graph import cut

PARTS = ("hon", "first", "middle", "last", "suffix", "any")
FEMALE = ("mrs", "miss", "ms", "lady")
MALE = ("mr", "sir", "lord")


def name(prefix: str) -> dict[str, Column]:
    return {p: F.col(f"{prefix}.{p}") for p in PARTS} | {"nick": F.col(f"{prefix}.nick")}


def part_match(a: Column, b: Column, missing: bool = True) -> Column:
    """Equal, an initial of the other, or a number word of the same value; ``missing`` where either is null."""
    la, lb = F.lower(a), F.lower(b)
    initial = ((F.length(la) == 1) | (F.length(lb) == 1)) & (F.substring(la, 1, 1) == F.substring(lb, 1, 1))
    number = F.coalesce(F.coalesce(number_word(la).cast("string"), la) == F.coalesce(number_word(lb).cast("string"), lb), F.lit(False))
    return F.when(a.isNull() | b.isNull(), F.lit(missing)).otherwise((la == lb) | initial | number)


def _honorifics(a: Column, b: Column) -> Column:
    """Mrs and Miss differ; male and female honorifics differ."""
    la, lb = F.lower(a), F.lower(b)
    clash = ((la == "mrs") & (lb == "miss")) | ((la == "miss") & (lb == "mrs")) | (la.isin(*MALE) & lb.isin(*FEMALE)) | (la.isin(*FEMALE) & lb.isin(*MALE))
    return ~F.coalesce(clash, F.lit(False))


def like(a: str, b: str) -> Column:
    """Names that may mean one person."""
    x, y = name(a), name(b)
    first = part_match(x["first"], y["first"]) | F.coalesce((x["nick"] == y["nick"]) & (x["nick"] > 0), F.lit(False))
    plain = first & part_match(x["middle"], y["middle"]) & part_match(x["last"], y["last"]) & part_match(x["suffix"], y["suffix"]) & _honorifics(x["hon"], y["hon"])
    loose = lambda p, q: p["any"].isNotNull() & (F.length(p["any"]) > 1) & ((F.lower(p["any"]) == F.lower(q["first"])) | (F.lower(p["any"]) == F.lower(q["last"])))
    single = F.coalesce(loose(x, y), F.lit(False)) | F.coalesce(loose(y, x), F.lit(False)) | F.coalesce(F.lower(x["any"]) == F.lower(y["any"]), F.lit(False))
    return F.when(x["any"].isNull() & y["any"].isNull(), plain).otherwise(single)


def confident(a: str, b: str) -> Column:
    """Stricter: last names are given and equal, first names are given and match."""
    x, y = name(a), name(b)
    return like(a, b) & F.coalesce(F.lower(x["last"]) == F.lower(y["last"]), F.lit(False)) & part_match(x["first"], y["first"], False)


def merged(a: str, b: str) -> Column:
    """Missing parts filled in, initials written out."""
    x, y = name(a), name(b)
    best = lambda p: F.when(F.length(x[p]) == 1, F.when(F.length(y[p]) > 1, y[p]).otherwise(x[p])).otherwise(F.coalesce(x[p], y[p]))
    return F.struct(*[best(p).alias(p) for p in PARTS], F.coalesce(x["nick"], y["nick"]).alias("nick"))


def neuter(a: str) -> Column:
    """Not a person: no honorific, and neither first nor last name."""
    x = name(a)
    return x["hon"].isNull() & x["first"].isNull() & x["last"].isNull()


def kinds_paired(left: DataFrame, right: DataFrame, blocks: list[str], keep: Column, **more: Column) -> DataFrame:
    """(blocks, x, y, more): different names of a block that ``keep``, a condition on x and y, holds for; copies of a name are judged once."""
    a, b = (df.select(*blocks, F.col("n").alias(n)).distinct() for df, n in ((left, "x"), (right, "y")))
    return a.join(b, blocks).filter(keep).select(*blocks, "x", "y", *[c.alias(n) for n, c in more.items()])


def _named(kinds: DataFrame, names: DataFrame, blocks: list[str], kind: str, id: str) -> DataFrame:
    """Each kind (column ``kind``) with the ids of all names that are equal to it, in place of it."""
    n = names.select(*[F.col(c).alias(f"_{c}") for c in blocks], F.col("id").alias(id), F.col("n").alias("_n"))
    on = F.col(kind).eqNullSafe(F.col("_n"))
    for c in blocks:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return kinds.join(n, on).drop(kind, "_n", *[f"_{c}" for c in blocks])


def paired(left: DataFrame, right: DataFrame, blocks: list[str], keep: Column, **more: Column) -> DataFrame:
    """(a, b, more): all pairs of names that share a block and that ``keep`` holds for; both sides have id, name struct ``n``
    and the block columns."""
    p = _named(kinds_paired(left, right, blocks, keep, **more), right, blocks, "y", "b")
    return _named(p, left, blocks, "x", "a").select("a", "b", *more)


def link(left: DataFrame, right: DataFrame, blocks: list[str]) -> DataFrame:
    """Pairs of like names that share a block."""
    return paired(left, right, blocks, like("x", "y"), sure=confident("x", "y"))


def components(left: DataFrame, right: DataFrame, blocks: list[str]) -> DataFrame:
    """(node, root): the least id of all names that confident links connect; ids are strings, different on the two sides.

    Equal names have equal links, so links are drawn between kinds, each under its least id (``rep``); an id that has
    several names connects their kinds. Least ids spread by rounds of joins."""
    pairs = cut(kinds_paired(left, right, blocks, confident("x", "y")))
    sides = {"x": left, "y": right}
    member = {k: cut(_named(pairs.select(*blocks, k, F.col(k).alias("kind")).distinct(), df, blocks, k, "node").filter("node is not null")) for k, df in sides.items()}
    reps = {k: m.groupBy(*blocks, "kind").agg(F.min("node").alias("id")).withColumnRenamed("kind", "n") for k, m in member.items()}
    e = _named(_named(pairs, reps["x"], blocks, "x", "u"), reps["y"], blocks, "y", "v").select("u", "v")
    of = None
    for k, m in member.items():
        m = _named(m, reps[k], blocks, "kind", "rep").select("node", "rep")
        of = m if of is None else of.unionByName(m)
    of = cut(of)
    first = of.groupBy("node").agg(F.min("rep").alias("first"))
    e = e.unionByName(of.join(first, "node").filter("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v")))
    d = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = cut(d.groupBy(F.col("u").alias("rep")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        near = d.join(now.select(F.col("rep").alias("v"), "root"), "v").groupBy(F.col("u").alias("rep")).agg(F.min("root").alias("other"))
        new = cut(now.join(near, "rep", "left").select("rep", F.least("root", "other").alias("root"), (F.col("other") < F.col("root")).alias("moved")))
        if new.filter("moved").isEmpty():
            return first.join(new.select(F.col("rep").alias("first"), "root"), "first").select("node", "root")
        now = new.select("rep", "root")


def ambiguous(names: DataFrame) -> DataFrame:
    """Last names with more than one first name."""
    return names.groupBy(F.lower("n.last").alias("last")).agg(F.count_distinct(F.lower("n.first")).alias("n_first")).filter("n_first > 1")


def parsed(tagged: DataFrame) -> DataFrame:
    """Names from tagged words (name_id, pos, w, tag): the first word of each slot, a second middle name behind the first,
    and the gender that the honorific says. Tags are the parts' names."""
    first = lambda p: F.min_by(F.when(F.col("tag") == p, F.col("w")), F.when(F.col("tag") == p, F.col("pos"))).alias(p)
    middles = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("tag") == "middle", F.struct("pos", "w")))), lambda x: x["w"]), " ")
    n = tagged.groupBy("name_id").agg(*[first(p) for p in PARTS if p != "middle"], middles.alias("middle"))
    hon = F.regexp_replace(F.lower("hon"), "[.]$", "")
    gender = F.when(hon.isin(*MALE), "male").when(hon.isin(*FEMALE), "female")
    return n.select("name_id", F.struct(*[F.when(F.col(p) != "", F.col(p)).alias(p) for p in PARTS], F.lit(0).alias("nick")).alias("n"), gender.alias("gender"))


#: Phrases between two names of one thing.
ALSO = "(?:also known as|known as|better known as|formerly known as|also called|called|nicknamed|aka|a[.]k[.]a[.])"


def equivalences(sentences: DataFrame) -> DataFrame:
    """(name, other) from 'X, known as Y' and its kin; names are runs of capitalised words."""
    run = "([A-Z][\\w.]*(?: [A-Z][\\w.]*)*)"
    m = f"{run},? (?:is |was )?{ALSO} (?:the )?{run}"
    return sentences.select(F.regexp_extract("text", m, 1).alias("name"), F.regexp_replace(F.regexp_extract("text", m, 2), "[.]$", "").alias("other")).filter("name <> ''").distinct()
