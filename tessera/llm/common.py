"""Shared helpers of the training-data operators: staging, batch size, ordered ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Shuffle files of a finished staging write are not needed any more: the staged table replaces them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given Parquet tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read, not a re-run, and the shuffle files behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(StructType(df.schema.fields)).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Arrow batches of whole texts, bounded by bytes, so that very long texts come a few at a time and a
    Python worker's memory stays small; ``rows`` bounds batches of short texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def splitters(keys: DataFrame, weight: str, order: list[str], n: int, oversample: int = 16) -> list[tuple]:
    """``n - 1`` boundaries cutting ``keys`` into ranges of about equal total ``weight``.

    A key is drawn with probability proportional to its weight (one hash of the key decides, so a
    re-run draws the same), about ``n * oversample`` keys in all, whatever the table's size: that
    bounded sample is all that reaches the driver.
    """
    total = keys.agg(F.sum(weight).cast("double")).first()[0] or 0.0
    if total <= 0 or n < 2:
        return []
    want = float(n * oversample)
    u = (F.xxhash64(F.lit(7919), *order).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    rate = F.col(weight) * F.lit(want / total)
    # a key heavier than one step counts once per step it spans
    copies = F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)
    drawn = keys.select(*order, copies.cast("long").alias("__copies")).where("__copies > 0").collect()
    flat = sorted((tuple(r[:-1]) for r in drawn for _ in range(r["__copies"])))
    step = len(flat) / n
    cuts = [flat[int(i * step)] for i in range(1, n)] if flat else []
    return sorted(set(cuts))


def range_of(order: list[str], cuts: list[tuple]) -> Column:
    """Index of the range a key falls in: how many boundaries are at or below it (binary search over
    literal arrays, as a native expression)."""
    if not cuts:
        return F.lit(0)
    arrays = [F.lit([c[i] for c in cuts]) for i in range(len(order))]
    n = len(cuts)

    def at_or_below(i: Column) -> Column:  # cuts[i - 1] <= key, column by column
        found = F.lit(True)
        for name, arr in reversed(list(zip(order, arrays, strict=True))):
            cut = F.element_at(arr, i)
            found = (cut < F.col(name)) | ((cut == F.col(name)) & found)
        return found

    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda pos, step: F.when((pos + step <= n) & at_or_below(F.least(pos + step, F.lit(n))), pos + step).otherwise(pos),
    )


def offsets(df: DataFrame, range_col: str, measures: list[str]) -> list[tuple]:
    """Per range: (range, total of each measure), in order. One small row per range."""
    return sorted(
        tuple(r) for r in df.groupBy(range_col).agg(*[F.sum(m).cast("long").alias(m) for m in measures]).collect()
    )


def running(range_col: str, order: list[str]) -> object:
    """Rows of one range up to and including the current one."""
    return Window.partitionBy(range_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
