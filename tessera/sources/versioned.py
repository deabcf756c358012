"""Versioned-data tables derived from the given Parquet tables by arithmetic on keys.

Each function reads only the columns it needs, so that projections reach the scan.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; on a local master without one, one of our own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file node a document: path (lang/source/id), context, hash, size."""
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")), F.col("doc_id").cast("string")).alias("path"),
        F.col("doc_id").alias("context"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    )


#: How three snapshots differ, as SQL on the orders table; both engines read them.
SNAPSHOTS = {
    "base": ("o_orderkey % 11 <> 0", "o_orderpriority || '/' || cast(o_orderkey as string)", "o_custkey"),
    "source": (
        "o_orderkey % 7 <> 0",
        "case when o_orderkey % 13 = 0 then 'moved/' else '' end || o_orderpriority || '/' || cast(o_orderkey as string)",
        "o_custkey + case when o_orderkey % 5 = 0 then 1 else 0 end",
    ),
    "target": (
        "o_orderkey % 17 <> 1",
        "o_orderpriority || '/' || cast(o_orderkey as string)",
        "o_custkey + case when o_orderkey % 20 = 0 then 1 when o_orderkey % 10 = 0 then 2 else 0 end",
    ),
}


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One of three snapshots of a tree with a file an order: path, context, hash."""
    kept, path, content = SNAPSHOTS[side]
    return table(spark, sf_dir, "orders").where(kept).selectExpr(f"{path} as path", "o_orderkey as context", f"sha2(cast({content} as string), 256) as hash")


def snapshot_sql(side: str) -> str:
    kept, path, content = SNAPSHOTS[side]
    return f"select {path} as path, o_orderkey as context, sha256(cast({content} as string)) as hash from orders where {kept}"


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision chains: branch (a user), revision (an event), number from 1, parent_self, ts, kind, props."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("branch"),
        F.col("event_id").alias("revision"),
        F.row_number().over(order).cast("long").alias("number"),
        F.lag("event_id").over(order).alias("parent_self"),
        "ts",
        F.col("event_type").alias("kind"),
        "props",
    )


CHAINS_SQL = """chains as (select user_id as branch, event_id as revision,
  row_number() over (partition by user_id order by ts, event_id) as number,
  lag(event_id) over (partition by user_id order by ts, event_id) as parent_self,
  ts, event_type as kind, props from events)"""
