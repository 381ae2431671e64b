"""Writers: tables partitioned by bucket, CSV, cross tables, annotated pages."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only under a local master without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        where = "file://" + tempfile.mkdtemp(prefix="narrata-out-")
    return where.rstrip("/")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = 32, mode: str = "overwrite") -> None:
    """Parquet in folders by a hash of ``key``: readers of one document open one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, key: str, value: object, buckets: int = 32) -> DataFrame:
    """The rows of one key: its bucket is computed first, so that the partition filter is a literal."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast("long")), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).filter((F.col("bucket") == bucket) & (F.col(key) == value))


def insert_batch(df: DataFrame, path: str) -> None:
    """Append a batch; a batch that fails leaves nothing that readers see."""
    df.write.mode("append").parquet(path)


def table_as_select(spark: SparkSession, df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """CREATE TABLE AS SELECT at a path of the shared folder."""
    name, view = name or f"t_{uuid.uuid4().hex}", f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT * FROM {view}")
    return spark.table(name)


def in_memory(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Kept in the executors' memory where the planner's size of it is within ``most`` bytes; else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.cache() if size <= most else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    out = df.groupBy(a).pivot(b, values).count()
    return out.select(a, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{b}_{v}") for v in values])


def pages_by_width(tokens: DataFrame, line: int = 60, lines: int = 40) -> DataFrame:
    """(doc_id, pos, page, line): words wrapped to lines and lines to pages. Wrapping isn't associative, so documents go
    through Python one at a time."""

    def layout(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        used, row, rows = 0, 0, []
        for w in pdf["w"]:
            if used and used + 1 + len(w) > line:
                row, used = row + 1, 0
            used += len(w) + (1 if used else 0)
            rows.append(row)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "page": [r // lines for r in rows], "line": [r % lines for r in rows]})

    return tokens.select("doc_id", "pos", "w").groupBy("doc_id").applyInPandas(layout, "doc_id long, pos int, page int, line int")


def html_page(tokens: DataFrame) -> DataFrame:
    """An annotated span for each word, joined by document in order."""
    span = F.concat(F.lit('<span id="'), F.col("pos").cast("string"), F.lit('">'), F.replace(F.replace("w", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</span>"))
    s = tokens.select("doc_id", F.struct("pos", span.alias("h")).alias("x"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), " ").alias("html"))


