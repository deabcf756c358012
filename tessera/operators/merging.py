"""What becomes of a tree and its staged changes: merges and their resolution, picks and reverts, syncs, staging, commits.

Trees have path and hash; staged rows have path, action, from_path, hash and, in a merge, state (clean, open,
mine, theirs, merged). Each operator is a join or two; rows with one path meet only each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .trees import apply_changes, below, diff, diff3, invert

_STAGED = ["path", "action", "from_path", "hash", "state"]


def start_merge(base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Staged rows of merging ``source`` into ``target``: changes are clean, conflicts open, with the target's hash
    (``mine``) beside the source's (``hash``)."""
    found = diff3(base, source, target, include_same=False)
    mine = target.select(F.col("path").alias("from_path"), F.col("hash").alias("mine"))
    state = F.when(F.col("outcome") == "conflict", "open").otherwise("clean")
    return found.join(mine, "from_path", "left").select("path", "action", "from_path", "hash", state.alias("state"), "mine")


def resolve(staged: DataFrame, paths: DataFrame, side: str) -> DataFrame:
    """Open conflicts at ``paths`` settled as ``mine`` or ``theirs``; ``mine`` puts back the target's content."""
    asked = staged.join(paths.select("path", F.lit(True).alias("asked")), "path", "left")
    hit = F.coalesce("asked", F.lit(False)) & (F.col("state") == "open")
    return asked.withColumn("state", F.when(hit, side).otherwise(F.col("state"))).drop("asked").select(*staged.columns)


def unresolve(staged: DataFrame, paths: DataFrame) -> DataFrame:
    """Settled conflicts at ``paths`` opened again."""
    asked = staged.join(paths.select("path", F.lit(True).alias("asked")), "path", "left")
    hit = F.coalesce("asked", F.lit(False)) & F.col("state").isin("mine", "theirs", "merged")
    return asked.withColumn("state", F.when(hit, "open").otherwise(F.col("state"))).drop("asked").select(*staged.columns)


def finish_merge(target: DataFrame, staged: DataFrame) -> DataFrame:
    """The target's tree (path, hash) with clean changes and conflicts settled as theirs; others stay mine."""
    return apply_changes(target, staged.where(F.col("state").isin("clean", "theirs")))


def restart(staged: DataFrame, fresh: DataFrame, under: str) -> DataFrame:
    """``staged`` with the rows of a subtree replaced by those of a merge made anew."""
    return staged.where(~below(F.col("path"), under)).unionByName(fresh.where(below(F.col("path"), under)).select(*staged.columns))


def merge_metadata(staged: DataFrame, source: DataFrame) -> DataFrame:
    """Metadata hashes (path, meta) after a merge: the source's replaces that of paths it has."""
    theirs = source.select("path", F.col("meta").alias("theirs"))
    return staged.join(theirs, "path", "left").select("path", F.coalesce("theirs", "meta").alias("meta"))


def cherry_pick(parent: DataFrame, picked: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of the changes from a revision's parent to it, on the current tree; same changes are shown."""
    return diff3(parent, picked, current)


def revert(parent: DataFrame, reverted: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of taking a revision back on the current tree: the revision is the base, its parent the source."""
    return diff3(reverted, parent, current)


def fast_forward(pointers: DataFrame, requests: DataFrame) -> DataFrame:
    """Branch pointers (branch, latest) after requests (branch, expected, latest): moved where the expected tip is
    still the tip. Columns: branch, latest, moved."""
    asked = requests.select("branch", "expected", F.col("latest").alias("wanted"))
    joined = pointers.join(asked, "branch", "left")
    ok = F.coalesce(F.col("latest") == F.col("expected"), F.lit(False))
    return joined.select("branch", F.when(ok, F.col("wanted")).otherwise(F.col("latest")).alias("latest"), ok.alias("moved"))


def sync(current: DataFrame, wanted: DataFrame, local: DataFrame) -> DataFrame:
    """What a sync does to each path that changes between two revisions: update, same (the local file already is
    what is wanted) or conflict (it is neither). ``local`` (path, hash) has the working files that differ from ``current``."""
    changes = diff(current, wanted, moves=False)
    here = local.select("path", F.col("hash").alias("local_hash"), F.lit(True).alias("dirty"))
    what = (
        F.when(F.col("dirty").isNull(), "update").when(F.col("local_hash").eqNullSafe(F.col("hash")), "same").otherwise("conflict")
    )
    return changes.join(here, "path", "left").select("path", "action", "hash", what.alias("outcome"))


def sync_target(branches: DataFrame) -> DataFrame:
    """Which tip a sync without a revision takes. ``branches``: branch, ahead, behind, at_local_tip, force.

    In step or behind: the remote tip; ahead: the local one, with force the remote; diverged: with force the remote,
    else the local one where the current revision isn't it, else the remote, which starts a merge.
    """
    ahead, behind, force = F.col("ahead") > 0, F.col("behind") > 0, F.col("force")
    pick = F.when(~ahead | force, "remote").when(~behind, "local").when(~F.col("at_local_tip"), "local").otherwise("remote")
    return branches.select("branch", pick.alias("target"), (ahead & behind & ~force & F.col("at_local_tip")).alias("merges"))


def stage(staged: DataFrame, changes: DataFrame) -> DataFrame:
    """Staged rows with ``changes`` put in: one row a path, the new one; a delete of what was only staged as added
    leaves no row."""
    new = changes.select("path", F.struct("action", "from_path", "hash").alias("n"))
    old = staged.select("path", F.struct("action", "from_path", "hash").alias("o"))
    both = old.join(new, "path", "full")
    gone = F.coalesce((F.col("o.action") == "Add") & (F.col("n.action") == "Delete"), F.lit(False))
    still_added = F.coalesce((F.col("o.action") == "Add") & (F.col("n.action") == "Keep"), F.lit(False))
    row = F.coalesce("n", "o")
    action = F.when(still_added, "Add").otherwise(row["action"])
    return both.where(~gone).select("path", action.alias("action"), row["from_path"].alias("from_path"), row["hash"].alias("hash"))


def stage_move(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """Staged moves (from_path, path) of files that are in the tree and whose new path is free."""
    files = tree.select(F.col("path").alias("from_path"), "hash")
    free = moves.join(tree.select("path"), "path", "left_anti")
    return free.join(files, "from_path").select("path", F.lit("Move").alias("action"), "from_path", "hash")


def unstage(staged: DataFrame, paths: DataFrame) -> DataFrame:
    """Staged rows without those at, or moved from, any of ``paths`` or their subtrees (asked by equal joins on the
    directories above)."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = staged.select("path", F.explode(up).alias("above")).join(paths.select(F.col("path").alias("above")), "above").select("path").distinct()
    return staged.join(hit, "path", "left_anti")


def reset(working: DataFrame, revision: DataFrame, paths: DataFrame) -> DataFrame:
    """The working tree (path, hash) with ``paths`` as in a revision: put back where it has them, else gone."""
    asked = paths.select("path").distinct()
    return working.join(asked, "path", "left_anti").select("path", "hash").unionByName(revision.join(asked, "path", "left_semi").select("path", "hash"))


def last_merged(merges: DataFrame, stacks: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (branch, other) with the newest revision of ``other`` that was merged into ``branch``; null where the
    other isn't another branch in its stack. ``merges``: branch, number, other, revision."""
    held = asked.join(stacks.select("branch", F.col("member").alias("other")).distinct(), ["branch", "other"]).where("branch <> other")
    newest = held.join(merges, ["branch", "other"]).groupBy("branch", "other").agg(F.max_by("revision", "number").alias("revision"))
    return asked.join(newest, ["branch", "other"], "left")


def mark_dirty(tree: DataFrame, working: DataFrame) -> DataFrame:
    """Files (path, size, mtime, hash) of a revision against the working ones: path and dirty action.

    A file is modified where its size differs, or its time and its content do; equal times are trusted.
    """
    here = working.select("path", F.struct("size", "mtime", "hash").alias("w"))
    both = tree.select("path", F.struct("size", "mtime", "hash").alias("t")).join(here, "path", "full")
    changed = (F.col("w.size") != F.col("t.size")) | ((F.col("w.mtime") != F.col("t.mtime")) & (F.col("w.hash") != F.col("t.hash")))
    action = F.when(F.col("t").isNull(), "Add").when(F.col("w").isNull(), "Delete").when(changed, "Keep")
    return both.select("path", action.alias("action")).where("action is not null")


def rebase(staged: DataFrame, current: DataFrame) -> DataFrame:
    """Staged rows with an explicit action put on a new current tree: an added path that is there now is kept as a
    change, changes and deletes of paths that are gone are dropped."""
    named = staged.where("action is not null")
    there = named.join(current.select("path", F.lit(True).alias("there")), "path", "left")
    action = F.when((F.col("action") == "Add") & F.col("there"), "Keep").otherwise(F.col("action"))
    lost = F.col("action").isin("Keep", "Delete") & F.col("there").isNull()
    return there.where(~lost).select("path", action.alias("action"), "from_path", "hash")


def tree_add(tree: DataFrame, added: DataFrame) -> DataFrame:
    """A tree with new files whose paths are free, compared without case; the others are refused."""
    taken = tree.select(F.lower("path").alias("key"))
    once = added.withColumn("key", F.lower("path")).dropDuplicates(["key"]).join(taken, "key", "left_anti")
    return tree.select("path", "hash").unionByName(once.select("path", "hash"))


def tree_delete(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """A tree without the given paths and what lies below them."""
    return unstage(tree, paths)


def tree_modify(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """A tree with new content at given paths; paths that it lacks are ignored."""
    new = changes.select("path", F.col("hash").alias("new"))
    return tree.join(new, "path", "left").select("path", F.coalesce("new", "hash").alias("hash"))


def commit(revision: Column, parent: Column, tree: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, delta) of a new revision: the tree with staged changes, and a row a change."""
    nodes = apply_changes(tree, staged).select(revision.alias("revision"), "path", "hash")
    delta = staged.select(revision.alias("revision"), parent.alias("parent"), "action", "path", "from_path")
    return nodes, delta


def amend(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Tips with another message or committer: a new revision of the same number and parents; ``changes`` (revision,
    message, committer) that change nothing are refused (amended false)."""
    new = changes.select("revision", F.col("message").alias("m"), F.col("committer").alias("c"))
    joined = revisions.join(new, "revision")
    message, committer = F.coalesce("m", "message"), F.coalesce("c", "committer")
    same = message.eqNullSafe(F.col("message")) & committer.eqNullSafe(F.col("committer"))
    named = F.sha2(F.concat_ws("|", F.col("revision").cast(StringType()), message, committer), 256)
    return joined.select("revision", "number", "parent_self", message.alias("message"), committer.alias("committer"), F.when(~same, named).alias("new_revision"), (~same).alias("amended"))


def delta_listing(delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changes of a revision (revision, parent, action, path, from_path) with size and hash: deleted paths are looked
    up in the self parent and have size 0. ``nodes``: revision, path, size, hash."""
    own = nodes.select("revision", "path", "size", "hash")
    old = nodes.select(F.col("revision").alias("parent"), "path", F.col("hash").alias("old_hash"))
    joined = delta.join(own, ["revision", "path"], "left").join(old, ["parent", "path"], "left")
    gone = F.col("action") == "Delete"
    return joined.select(
        "revision", "action", "path", F.when(gone, F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"), F.when(gone, F.col("old_hash")).otherwise(F.col("hash")).alias("hash")
    )


def already_merged(conflicts: DataFrame, touched: DataFrame, merged: DataFrame) -> DataFrame:
    """Conflicts (path) with what earlier merges make of them. ``touched``: path, side (source, target), number of the
    side's last change; ``merged``: path, side, number up to which that side was merged into the other.

    A side whose last change was merged already says nothing new: the other side's change stays, and where both
    were, there is no conflict.
    """
    last = touched.groupBy("path").pivot("side", ["source", "target"]).agg(F.max("number"))
    upto = merged.groupBy("path").pivot("side", ["source", "target"]).agg(F.max("number"))
    joined = conflicts.join(last.select("path", F.col("source").alias("s"), F.col("target").alias("t")), "path", "left")
    joined = joined.join(upto.select("path", F.col("source").alias("sm"), F.col("target").alias("tm")), "path", "left")
    old_s, old_t = F.coalesce(F.col("s") <= F.col("sm"), F.lit(False)), F.coalesce(F.col("t") <= F.col("tm"), F.lit(False))
    outcome = F.when(old_s & old_t, "none").when(old_s, "target").when(old_t, "source").otherwise("conflict")
    return joined.select("path", outcome.alias("outcome"))


def reverse_changes(changes: DataFrame) -> DataFrame:
    """A change list (pos, ...) taken back: actions inverted, last first."""
    back = invert(changes)
    place = changes.select(F.col("from_path").alias("path"), F.col("path").alias("from_path"), (-F.col("pos")).alias("pos"))
    return back.join(place, ["path", "from_path"])


def merge_carry(carried: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (p0, p1) of parents with the path set carried for them, whichever comes first. ``carried``: p0, p1, paths."""
    key = lambda: F.array_sort(F.array("p0", "p1"))
    return pairs.withColumn("key", key()).join(carried.select(key().alias("key"), "paths"), "key", "left").select("p0", "p1", "paths")
