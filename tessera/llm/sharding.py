"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of those keys gives quantile
boundaries that cut the order into many small ranges; each range is summed exactly, so every record
knows how many bytes and rows lie before it, and a range that a shard boundary falls into is
subdivided at the record where the boundary lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import offsets, range_of, running, splitters, stage, table, unstage

#: Sampled ranges for each shard; more of them once a range would hold more rows than ROWS_A_RANGE.
RANGES_A_SHARD = 16
ROWS_A_RANGE = 1_000_000
#: A run of equal texts up to this share of a shard is never cut.
GROUP_SHARE = 0.01
_LEAST = -(2**63)


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards hold nearly the same number of bytes (size: UTF-8 bytes of the text,
    none for a null, plus 8). ``slot`` counts a shard's records from 0 in key order. Equal texts are
    neighbours in that order and stay in one shard unless they fill more than a hundredth of one. A
    null text is placed as an empty one, a null doc_id before all others; repeated rows get slots of
    their own; an empty table gives no rows. Extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k"),
        ),
        "shard-keys",
    )
    order = ["h", "k"]
    n_rows = keys.count()
    cuts = splitters(keys, "size", order, max(n_shards * RANGES_A_SHARD, n_rows // ROWS_A_RANGE))
    heads = [h for h, _ in cuts]
    # a boundary inside a group of equal texts counts only where the group spans several boundaries
    cuts = sorted({(h, k if heads.count(h) > 1 else _LEAST) for h, k in cuts}) if len(set(heads)) < len(heads) else [(h, _LEAST) for h in heads]
    ranged = stage(keys.withColumn("r", range_of(order, cuts)).withColumn("one", F.lit(1)), "shard-ranges")
    unstage(keys)
    bytes_before, rows_before, total, rows = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1), 0, 0
    found = {r: (b, n) for r, b, n in offsets(ranged, "r", ["size", "one"])}
    for r in range(len(cuts) + 1):
        bytes_before[r], rows_before[r] = total, rows
        b, n = found.get(r, (0, 0))
        total, rows = total + b, rows + n
    upto = running("r", order)
    group = Window.partitionBy("r", "h")
    at = F.element_at(F.lit(bytes_before), F.col("r") + 1)
    placed = (
        ranged.withColumn("row", F.element_at(F.lit(rows_before), F.col("r") + 1) + F.count(F.lit(1)).over(upto) - 1)
        .withColumn("start", at + F.sum("size").over(upto) - F.col("size"))
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_size", F.sum("size").over(group))
    )
    whole = F.col("group_size") <= F.lit(GROUP_SHARE * total / n_shards)
    middle = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    number = F.least(F.lit(n_shards - 1), F.floor(middle * F.lit(n_shards / max(total, 1)))).cast("int")
    placed = stage(placed.select("doc_id", "size", "text_crc32", number.alias("shard"), "row"), "shard-rows")
    unstage(ranged)
    first = dict(map(tuple, placed.groupBy("shard").agg(F.min("row")).collect()))
    starts = F.lit([first.get(i, 0) for i in range(n_shards)])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.element_at(starts, F.col("shard") + 1)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of sharding all documents into 24 shards."""
    return shard(table(spark, sf_dir, "documents"))
