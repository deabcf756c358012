"""Revision chains: listing, search, cursors, bisection and graph closure.

A chain has branch, revision, number, parent_self, ts, kind and props. Windows are partitioned by branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(chain: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` revisions of every branch, newest first by ``pos``."""
    pos = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("number"))).cast("long")
    return chain.select("branch", "revision", "number", pos.alias("pos")).where(F.col("pos") <= limit)


def file_history(chain: DataFrame, added: str) -> DataFrame:
    """Per branch the revisions from the newest back to the last of kind ``added``, that one included."""
    newer = Window.partitionBy("branch").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(F.col("kind") == added, 1).otherwise(0)).over(newer), F.lit(0))
    return chain.withColumn("seen", seen).where("seen = 0").select("branch", "revision", "number", "kind")


def collapse(chain: DataFrame) -> DataFrame:
    """Rows whose kind differs from that of the row before in their branch."""
    before = F.lag("kind").over(Window.partitionBy("branch").orderBy("number"))
    return chain.withColumn("before", before).where(~F.col("kind").eqNullSafe(F.col("before"))).select("branch", "revision", "number", "kind")


def segments(chain: DataFrame, step: int = 10) -> DataFrame:
    """Segment B of a branch holds the numbers in (B - step, B]."""
    return (
        chain.groupBy("branch", (F.ceil(F.col("number") / step) * step).cast("long").alias("segment"))
        .agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"))
    )


def cursors(chain: DataFrame) -> DataFrame:
    """Each revision and the one numbered exactly one more, where there is one."""
    nxt = chain.select("branch", (F.col("number") - 1).alias("number"), F.col("revision").alias("forward"))
    return chain.select("branch", "revision", "number").join(nxt, ["branch", "number"], "left")


def bisect(chain: DataFrame) -> DataFrame:
    """One bisection step a branch between its first and last revision: steps, the target, whether it is done."""
    ends = chain.groupBy("branch").agg(F.max("number").alias("last"), F.min("number").alias("first"))
    step = ends.select("branch", (F.col("last") - F.col("first")).alias("steps"), "last").where("steps > 0")
    step = step.withColumn("number", F.col("last") - F.expr("steps div 2"))
    return step.join(chain.select("branch", "number", "revision"), ["branch", "number"]).select(
        "branch", "steps", F.col("revision").alias("target"), (F.col("steps") <= 1).alias("done")
    )


def newest_with(chain: DataFrame, key: str, value: str) -> DataFrame:
    """Per branch the newest revision whose metadata ``key`` is ``value``."""
    hit = chain.where(F.get_json_object("props", f"$.{key}") == value)
    return hit.groupBy("branch").agg(F.max("number").alias("number"), F.max_by("revision", "number").alias("revision"))


def prefixes(chain: DataFrame, digits: int = 4) -> DataFrame:
    """Per prefix of a revision's hash: how many revisions have it, and the one it names where it is the only one."""
    key = F.substring(F.sha2(F.col("revision").cast("string"), 256), 1, digits)
    return chain.groupBy(key.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("revision").alias("least")).select(
        "prefix", "n", F.when(F.col("n") == 1, F.col("least")).alias("revision")
    )


def branch_points(chain: DataFrame) -> DataFrame:
    """Every branch b leaves branch b - 1 at the middle of that chain: the common revision, and how many
    revisions each has alone."""
    size = chain.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    parent = size.select((F.col("branch") + 1).alias("branch"), F.expr("n div 2").alias("number"), (F.col("n") - F.expr("n div 2")).alias("behind"))
    base = chain.select((F.col("branch") + 1).alias("branch"), "number", F.col("revision").alias("base"))
    return size.join(parent, "branch").join(base, ["branch", "number"], "left").select("branch", "base", F.col("n").alias("ahead"), "behind")


def closure(edges: DataFrame, max_depth: int = 0) -> DataFrame:
    """(source, target, depth): all targets reachable from each source, at their smallest depth.

    One level a round: new pairs only are joined on. Every level is written by ``checkpoint`` to the shared
    folder, which cuts the lineage.
    """
    step = edges.select("source", "target").distinct().cache()
    found = step.withColumn("depth", F.lit(1).cast("long")).checkpoint()
    front, depth = found, 1
    while (not max_depth or depth < max_depth) and not front.isEmpty():
        depth += 1
        via = step.select(F.col("source").alias("target"), F.col("target").alias("next"))
        met = front.join(via, "target").select("source", F.col("next").alias("target")).distinct()
        front = met.join(found, ["source", "target"], "left_anti").withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        found = found.unionByName(front)
    step.unpersist()
    return found
