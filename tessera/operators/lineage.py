"""Branches, merges, links, layers and locks: what two lines of history share, and what one state turns into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_base(reach: DataFrame, tips: DataFrame, floor: int = 0) -> DataFrame:
    """Per pair of ``tips`` (mine, theirs): the highest-numbered revision above ``floor`` that both reach.

    ``reach`` (source, target) goes through both parents and holds each revision itself; numbers are ids.
    Pairs without a common revision have a null base.
    """
    near = reach.where(F.col("target") > floor)
    mine = tips.join(near.withColumnRenamed("source", "mine"), "mine")
    common = mine.join(near.withColumnRenamed("source", "theirs"), ["theirs", "target"])
    best = common.groupBy("mine", "theirs").agg(F.max("target").alias("base"))
    return tips.join(best, ["mine", "theirs"], "left")


def closes_cycle(closure: DataFrame, added: DataFrame) -> DataFrame:
    """``added`` edges (source, target), and whether the target already leads back to the source."""
    back = closure.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("found"))
    joined = added.join(back, ["source", "target"], "left")
    return joined.select("source", "target", (F.coalesce("found", F.lit(False)) | (F.col("source") == F.col("target"))).alias("cycle"))


def add_dependencies(edges: DataFrame, added: DataFrame) -> DataFrame:
    """Edges (source, target, tags) with the tags of ``added`` merged in, sorted and without repeats."""
    both = edges.unionByName(added).select("source", "target", F.explode_outer("tags").alias("tag"))
    return both.groupBy("source", "target").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def drop_tags(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """Edges without the tags that ``dropped`` (source, target, tags) names; an edge without tags left goes."""
    gone = dropped.select("source", "target", F.col("tags").alias("gone"))
    left = F.array_except("tags", F.coalesce("gone", F.array().cast("array<string>")))
    return edges.join(gone, ["source", "target"], "left").select("source", "target", left.alias("tags")).where(F.size("tags") > 0)


def weave(chain: DataFrame, file: str = "kind") -> DataFrame:
    """Each revision with the one before it that touched the same file of its branch."""
    before = F.lag("revision").over(Window.partitionBy("branch", file).orderBy("number"))
    return chain.select("branch", file, "revision", before.alias("previous"))


def last_modified(chain: DataFrame, file: str = "kind") -> DataFrame:
    """Per file of a branch: the newest revision that touched it, with its number."""
    return chain.groupBy("branch", file).agg(F.max("number").alias("number"), F.max_by("revision", "number").alias("revision"))


def nearest_match(main: DataFrame, layer: DataFrame) -> DataFrame:
    """Per pair: the newest revision of ``main`` whose value some revision of ``layer`` has, and the newest of those.

    Both have pair, revision, number, value. Each side is cut to its newest revision of a value first, so
    that a common value makes one row a pair.
    """
    newest = lambda side, name: side.where("value is not null").groupBy("pair", "value").agg(
        F.max("number").alias(f"{name}_number"), F.max_by("revision", "number").alias(name)
    )
    met = newest(main, "main").join(newest(layer, "layer"), ["pair", "value"])
    best = F.max_by(F.struct("value", "main", "layer"), "main_number")
    return met.groupBy("pair").agg(best.alias("m")).select("pair", "m.value", "m.main", "m.layer")


def shared_branch(stacks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (mine, theirs): the first branch of my stack that is in theirs. ``stacks``: branch, pos, member.

    Stacks that come from an explode are taken for as small as its input, hence the merge hints.
    """
    mine = pairs.join(stacks.select(F.col("branch").alias("mine"), "pos", "member").hint("merge"), "mine")
    both = mine.join(stacks.select(F.col("branch").alias("theirs"), "member").hint("merge"), ["theirs", "member"])
    return both.groupBy("mine", "theirs").agg(F.min_by("member", "pos").alias("shared"), F.min("pos").alias("pos"))


def link_pins(base: DataFrame, current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links (mount, pin) that moved since ``base``: by the current side, the incoming one, both alike, or in conflict."""
    side = lambda df, name: df.select("mount", F.col("pin").alias(name))
    all_three = side(base, "base").join(side(current, "current"), "mount").join(side(incoming, "incoming"), "mount")
    moved_here, moved_there = F.col("current") != F.col("base"), F.col("incoming") != F.col("base")
    who = (
        F.when(moved_here & moved_there, F.when(F.col("current") == F.col("incoming"), "same").otherwise("conflict"))
        .when(moved_here, "current")
        .when(moved_there, "incoming")
    )
    return all_three.select("mount", who.alias("moved_by"), "incoming").where("moved_by is not null")


def set_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members (key) that come or go between two multisets, with how many of each; one shuffle of counts."""
    both = new.select("key", F.lit(1).alias("d")).unionByName(old.select("key", F.lit(-1).alias("d")))
    net = both.groupBy("key").agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select("key", F.when(F.col("d") > 0, "added").otherwise("dropped").alias("change"), F.abs("d").alias("n"))


def acquire(locks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All-or-nothing lock requests, one batch an owner: how many resources it wants, holds already, and whether it gets them.

    ``locks`` and ``wanted`` have resource and owner; a batch fails where another owner holds any of its resources.
    """
    held = locks.select("resource", F.col("owner").alias("holder"))
    joined = wanted.distinct().join(held, "resource", "left")
    other = F.max(F.coalesce(F.col("holder") != F.col("owner"), F.lit(False)))
    return joined.groupBy("owner").agg(
        F.count(F.lit(1)).alias("wanted"), F.count(F.when(F.col("holder") == F.col("owner"), 1)).alias("held"), (~other).alias("granted")
    )


def put_metadata(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata (owner, key, value) after ``changes`` of the same shape: a new value replaces, a null one removes."""
    new = changes.select("owner", "key", F.col("value").alias("new"), F.lit(True).alias("changed"))
    joined = rows.join(new, ["owner", "key"], "full")
    return joined.select("owner", "key", F.when(F.col("changed"), F.col("new")).otherwise(F.col("value")).alias("value")).where("value is not null")
