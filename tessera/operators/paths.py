"""Sets and lists of paths: covering sets, orders, information on files, clone sets, deleted files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.values import subtree_key

from .trees import ancestors, pair_moves


def covering_set(paths: DataFrame) -> DataFrame:
    """The fewest paths whose subtrees hold all given ones; no rows where the root is among them (everything).

    Each path is looked for among the directories above it by an equal join.
    """
    once = paths.select("path").distinct()
    above = once.select("path", F.explode(ancestors(F.col("path"))).alias("up"))
    held = above.join(once.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    root = once.where("path = ''").select(F.lit(True).alias("root")).limit(1)
    return once.join(held, "path", "left_anti").join(root, F.lit(True), "left_anti")


def in_subtree_order(paths: DataFrame) -> DataFrame:
    """Paths with their place (from 0) in the order that puts each before its own subtree.

    Places come from a sort by ranges, with the number of rows before each range added; no task sees all paths.
    """
    ordered = paths.select("path", subtree_key(F.col("path")).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    numbered = ordered.select("path", F.monotonically_increasing_id().alias("at")).checkpoint()
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.select("path", part.alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within")).join(F.broadcast(before), "part").select(
        "path", (F.col("before") + F.col("within")).alias("place")
    )


def file_info(tree: DataFrame, asked: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """``asked`` (path) with size and hash in a revision and, where ``local`` is given, in the working tree."""
    out = asked.join(tree.select("path", "size", "hash"), "path", "left")
    if local is None:
        return out
    return out.join(local.select("path", F.col("size").alias("local_size"), F.col("hash").alias("local_hash")), "path", "left")


def clone_set(tree: DataFrame, view: DataFrame, needed: DataFrame) -> DataFrame:
    """What a clone writes: files of the view and those that files of the view depend on (``needed``: path)."""
    wanted = view.select("path").union(needed.select("path")).distinct()
    return tree.join(wanted, "path", "left_semi")


def union_changes(staged: DataFrame, scanned: DataFrame) -> DataFrame:
    """Staged and scanned changes (action, path, from_path, context, base_hash, hash) as one list: the scan's row where
    both have a path, deleted and added files of equal context joined into moves."""
    return pair_moves(staged.join(scanned.select("path"), "path", "left_anti").select(*scanned.columns).unionByName(scanned))


def deleted_in(touched: DataFrame, asked: DataFrame, depth: int = 10) -> DataFrame:
    """``asked`` (path, number) with the newest revision before it, at most ``depth`` numbers back, that still had the
    path. ``touched``: path, number, exists."""
    seen = touched.where("exists").select("path", F.col("number").alias("at"))
    near = asked.join(seen, "path").where((F.col("at") < F.col("number")) & (F.col("at") >= F.col("number") - depth))
    newest = near.groupBy("path", "number").agg(F.max("at").alias("last"))
    return asked.join(newest, ["path", "number"], "left")
