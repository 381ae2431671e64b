"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIVE = 5  # words in a shingle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent (tests, a laptop) a temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        where = getattr(spark.sparkContext, "_narrata_shared", None)
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="narrata-")
            spark.sparkContext._narrata_shared = where
            spark.sparkContext.setCheckpointDir(where)
    if "://" not in where:  # Spark's readers and Python's must mean the same file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        where = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
        where = where if "://" in where else where.replace(":", "://", 1)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._narrata_path = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a staging folder whose rows no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame) -> None:
    if path := getattr(df, "_narrata_path", None):
        drop_folder(df.sparkSession, path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(df: DataFrame) -> None:
    """Texts are long: where the session has Spark's defaults for what goes to Python at once (10,000 rows, 64 MB), it gets
    2,000 rows and 16 MB. This changes the caller's session, as plans take the settings from it when they run."""
    conf = df.sparkSession.conf
    for key, default, wanted in ((BATCH, "10000", "2000"), (BATCH_BYTES, "67108864b", "16m")):
        if conf.get(key, default) == default:
            conf.set(key, wanted)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns cast to the given types; other columns, whatever their names, stay out of the plan."""
    short_batches(df)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


class Memo(dict):
    """A bounded table of computed values that Python workers keep between tasks."""

    every: list[Memo] = []

    def __init__(self, make=None, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit
        Memo.every.append(self)

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value

    def claim(self) -> Memo:
        """Workers outlive operators: when one begins, what others remembered goes, and its memory back to the system."""
        others = [m for m in Memo.every if m is not self and m]
        for m in others:
            m.clear()
        if others:
            release()
        return self


def forget() -> None:
    """At the beginning of work that needs no remembered values: drop them all."""
    if any(Memo.every):
        for m in Memo.every:
            m.clear()
        release()


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int = 400, chars: int = 1_500_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows and about so many bytes of text, however long single texts are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + chars, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def apart(name: str) -> Column:
    """A key as it is, but not known to the planner as what its rows are partitioned by.

    A join against aggregates of the same key then shuffles both sides, and adaptive execution can split a key with
    very many rows, which it can't where the aggregation runs in the join's own stage.
    """
    return F.greatest(name, name).alias(name)


def whole_rows(df: DataFrame) -> DataFrame:
    """``row``: all columns of ``df`` as one, so that columns beside it can have any name; ``select("row.*")`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def partitions_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Shuffle partitions for rows about as large as ``df``: the session's number, or more for large inputs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 55  # else Spark has no figure for what it reads
    return max(parallelism(df.sparkSession), -(-size // each) if known else 0)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
