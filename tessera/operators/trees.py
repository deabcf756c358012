"""Snapshots of a tree: scans, diffs, merges and directory roll-ups, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scan(tree: DataFrame, prefix: str = "", max_depth: int = 0) -> DataFrame:
    """Files under ``prefix``, at most ``max_depth`` levels below it (0: any)."""
    under = tree.where(F.startswith(F.col("path"), F.lit(prefix)))
    if not max_depth:
        return under
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    return under.where(F.size(F.split(rest, "/")) <= max_depth)


def ancestors(path: Column) -> Column:
    """Every directory above a path, the topmost first; the root (empty) is left out."""
    parts = F.split(path, "/")
    return F.transform(
        F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def resolve(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path) with the node found under that path, compared without case."""
    nodes = tree.select(F.lower("path").alias("key"), F.col("path").alias("found"), "hash")
    return wanted.select("path", F.lower("path").alias("key")).join(nodes, "key", "left").select("path", "found", "hash")


def diff(base: DataFrame, target: DataFrame, moves: bool = True) -> DataFrame:
    """Changes from ``base`` to ``target``: action (Add, Delete, Keep, Move), path, from_path, context, base_hash, hash.

    Unchanged files give no row. With ``moves``, deleted and added files of equal context become a move, first
    with first in path order; a null or zero context names no file, so it joins none.
    """
    b = base.select("path", F.col("context").alias("b_context"), F.col("hash").alias("base_hash"), F.lit(True).alias("in_b"))
    t = target.select("path", F.col("context").alias("t_context"), "hash", F.lit(True).alias("in_t"))
    changed = (
        b.join(t, "path", "full")
        .where(F.col("in_b").isNull() | F.col("in_t").isNull() | ~F.col("base_hash").eqNullSafe(F.col("hash")))
        .select(
            F.when(F.col("in_b").isNull(), "Add").when(F.col("in_t").isNull(), "Delete").otherwise("Keep").alias("action"),
            "path",
            F.col("path").alias("from_path"),
            F.coalesce("t_context", "b_context").alias("context"),
            "base_hash",
            "hash",
        )
    )
    return pair_moves(changed) if moves else changed


def pair_moves(changed: DataFrame) -> DataFrame:
    """Changes with deleted and added files of equal context joined into moves."""
    named = F.coalesce(~F.col("context").cast("string").rlike("^0*$"), F.lit(False))
    may_move = named & F.col("action").isin("Add", "Delete")
    turn = F.row_number().over(Window.partitionBy("context", "action").orderBy("path"))
    ranked = changed.where(may_move).withColumn("turn", turn)
    # a key is one context and turn, so two rows at most meet in a group
    paired = ranked.groupBy("context", "turn").agg(
        F.max(F.when(F.col("action") == "Add", F.col("path"))).alias("added"),
        F.max(F.when(F.col("action") == "Delete", F.col("path"))).alias("deleted"),
        F.max("base_hash").alias("base_hash"),
        F.max("hash").alias("hash"),
    )
    moved = paired.select(
        F.when(F.col("added").isNull(), "Delete").when(F.col("deleted").isNull(), "Add").otherwise("Move").alias("action"),
        F.coalesce("added", "deleted").alias("path"),
        F.coalesce("deleted", "added").alias("from_path"),
        "context",
        "base_hash",
        "hash",
    )
    return moved.unionByName(changed.where(~may_move))


def node_diff(base: DataFrame, target: DataFrame, under: str = "") -> DataFrame:
    """Changes between trees of nodes (path, kind, mode, context, hash), paths being compared without case.

    Files that differ in address or mode are kept files with a change; a name that differs in case only is a
    move; directories are shown where their mode or the case of their name differs; a file where a directory was,
    or the reverse, is deleted and added. ``under`` keeps a subtree. Columns: action, path, from_path, kind, base_hash, hash.
    """
    side = lambda df, n: df.where(below(F.col("path"), under) if under else F.lit(True)).select(
        F.lower("path").alias("key"), F.struct("path", "kind", "mode", "context", "hash").alias(n)
    )
    both = side(base, "b").join(side(target, "t"), "key", "full")
    was_file, is_file = F.col("b.kind") == "file", F.col("t.kind") == "file"
    renamed = F.col("b.path") != F.col("t.path")
    differs = ~F.col("b.hash").eqNullSafe(F.col("t.hash")) | ~F.col("b.context").eqNullSafe(F.col("t.context"))
    other_mode = ~F.col("b.mode").eqNullSafe(F.col("t.mode"))
    row = lambda action, to: F.struct(
        F.lit(action).alias("action"),
        (F.col("b.path") if action == "Delete" else F.col("t.path")).alias("path"),
        (F.col("t.path") if action == "Add" else F.col("b.path")).alias("from_path"),
        F.col(f"{to}.kind").alias("kind"),
        (F.lit(None).cast("string") if action == "Add" else F.col("b.hash")).alias("base_hash"),
        (F.lit(None).cast("string") if action == "Delete" else F.col("t.hash")).alias("hash"),
    )
    shown = F.when(was_file & is_file, differs | other_mode | renamed).otherwise(other_mode | renamed)
    rows = (
        F.when(F.col("b").isNull(), F.array(row("Add", "t")))
        .when(F.col("t").isNull(), F.array(row("Delete", "b")))
        .when(was_file != is_file, F.array(row("Delete", "b"), row("Add", "t")))
        .when(shown & renamed, F.array(row("Move", "t")))
        .when(shown, F.array(row("Keep", "t")))
    )
    return both.select(F.inline(rows))


def below(path: Column, top: str) -> Column:
    return (path == top) | F.startswith(path, F.lit(f"{top}/"))

def diff3(base: DataFrame, source: DataFrame, target: DataFrame, scope: str = "source", include_same: bool = True) -> DataFrame:
    """Outcome of every source change against the target: change, conflict or same.

    Source changes are joined into moves, target changes are not. A move whose old path the target deleted is a
    conflict; a pure rename takes up the target's modification; both deleting a file is the same change; else files
    conflict where their contents differ. Scope ``full`` adds the changes that only the target made (``target``);
    without ``include_same`` changes that both made alike are left out.
    """
    s, t = diff(base, source), diff(base, target, moves=False)
    old = t.select(F.col("path").alias("from_path"), F.col("action").alias("old_action"), F.col("hash").alias("old_hash"))
    new = t.select("path", F.col("action").alias("new_action"), F.col("hash").alias("new_hash"))
    met = s.join(old, "from_path", "left").join(new, "path", "left")
    move = F.col("action") == "Move"
    outcome = (
        F.when(F.col("old_action").isNull() & F.col("new_action").isNull(), "change")
        .when(move & F.col("new_action").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("hash")), "conflict")
        .when(move & (F.col("old_action") == "Delete"), "conflict")
        .when(move, F.when(F.col("old_action").isNull() | (F.col("base_hash") == F.col("hash")), "change").otherwise("conflict"))
        .when(F.col("hash").eqNullSafe(F.col("old_hash")), "same")
        .otherwise("conflict")
    )
    out = met.select("action", "path", "from_path", "hash", F.col("old_action").alias("target_action"), outcome.alias("outcome"))
    if not include_same:
        out = out.where("outcome <> 'same'")
    if scope == "source":
        return out
    alone = t.join(s.select("from_path"), t["path"] == s["from_path"], "left_anti")
    return out.unionByName(
        alone.select("action", "path", "from_path", "hash", F.col("action").alias("target_action"), F.lit("target").alias("outcome"))
    )


def apply_changes(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """``tree`` (path, hash) after ``changes`` (action, path, from_path, hash); absent paths are ignored."""
    gone = changes.where(F.col("action").isin("Delete", "Move", "Keep")).select(F.col("from_path").alias("path"))
    put = changes.where("action <> 'Delete'").select("path", "hash")
    return tree.select("path", "hash").join(gone.unionByName(put.select("path")), "path", "left_anti").unionByName(put)


def invert(changes: DataFrame) -> DataFrame:
    """The changes that take ``changes`` back."""
    action = F.when(F.col("action") == "Add", "Delete").when(F.col("action") == "Delete", "Add").otherwise(F.col("action"))
    return changes.select(
        action.alias("action"), F.col("from_path").alias("path"), F.col("path").alias("from_path"), "context", F.col("hash").alias("base_hash"), F.col("base_hash").alias("hash")
    )


def rollup(tree: DataFrame) -> DataFrame:
    """Per directory (root: empty): files, size, depth, and a sum of file hashes that does not depend on order.

    Sums combine before the shuffle, so a directory of any width is one row a task.
    """
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "hash"), 256), 1, 8), 16, 10).cast("decimal(20,0)")
    files = tree.select("size", part.alias("part"), F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("dir"))
    return files.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), (F.sum("part") % (1 << 48)).cast("long").alias("content")
    ).withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))))


def collisions(names: DataFrame, name: str) -> DataFrame:
    """Names that differ by case only, or not at all: the folded name and how many rows have it."""
    return names.groupBy(F.lower(name).alias("folded")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def directory_hashes(tree: DataFrame) -> DataFrame:
    """Per directory (root: empty): a hash over its children in order of their name keys, size and number of files.

    Bottom up, a level a round. A child counts with its name key, hash and size; children are hashed by the first
    two digits of their keys first and those hashes then, so that a directory of any width is 256 groups.
    """
    key = F.sha2(F.lower(F.substring_index("path", "/", -1)), 256)
    depth = F.size(F.split("path", "/"))
    deepest = tree.agg(F.max(depth)).first()[0] or 0
    above = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    files = tree.select("path", "hash", "size", F.lit(1).cast("long").alias("files"), depth.alias("depth"))
    out, level = None, None
    for d in range(deepest, 0, -1):
        here = files.where(F.col("depth") == d).drop("depth")
        here = here if level is None else here.unionByName(level)
        child = F.concat_ws(":", key, "hash", F.col("size").cast("string"))
        rows = here.select(above.alias("dir"), F.substring(key, 1, 2).alias("part"), child.alias("child"), "size", "files")
        parts = rows.groupBy("dir", "part").agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("child")), "|"), 256).alias("h"), F.sum("size").alias("size"), F.sum("files").alias("files")
        )
        inner = F.array_join(F.array_sort(F.collect_list(F.concat("part", "h"))), ",")
        dirs = parts.groupBy("dir").agg(F.sha2(inner, 256).alias("hash"), F.sum("size").alias("size"), F.sum("files").alias("files"))
        level = dirs.select(F.col("dir").alias("path"), "hash", "size", "files")
        out = dirs if out is None else out.unionByName(dirs)
    return out if out is not None else files.selectExpr("path as dir", "hash", "size", "files")
