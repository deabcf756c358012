"""Catalogue state: keys and values, branches, locks, links, layers, metadata and instances.

State is a table; a change is a join of the table with the rows that ask for it, so all rows of a batch are done
at once. Logs keep every version; the latest one of a key is an aggregate, not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import ancestors


#: The parts of a lock that each shape of query names.
LOCK_SHAPES = {
    "hash": ("hash",),
    "hash_repository": ("hash", "repository"),
    "hash_repository_branch": ("hash", "repository", "branch"),
    "owner": ("owner",),
    "owner_repository": ("owner", "repository"),
    "owner_repository_branch": ("owner", "repository", "branch"),
    "repository": ("repository",),
    "repository_branch": ("repository", "branch"),
    "repository_branch_path": ("repository", "branch", "path"),
}
#: Fixed value: the longest name of a branch, in bytes.
LONGEST_NAME = 1000
#: Rows that one task of a join should make.
TASK_ROWS = 4_000_000


# ---------------------------------------------------------------- keys and values


def latest_values(log: DataFrame, *keys: str) -> DataFrame:
    """Live rows of a log (keys, version, value): the newest value of each key; a null one deletes."""
    newest = log.groupBy(*keys).agg(F.max_by(F.struct("version", "value"), "version").alias("v"))
    return newest.select(*keys, "v.version", "v.value").where("value is not null")


def load(log: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """``asked`` (keys) with their value, null where there is none. Only asked keys are aggregated."""
    wanted = asked.select(*keys).distinct()
    return asked.join(latest_values(log.join(wanted, list(keys), "left_semi"), *keys), list(keys), "left")


def compare_and_swap(state: DataFrame, requests: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(new state, answers) of requests (keys, seq, expected, value), one a key at a time: the first of a key is
    tried, later ones of the batch find the table changed and fail.

    A request succeeds where the key has the expected value or is absent; a null value deletes. Answers have the
    value found (``previous``).
    """
    first = requests.groupBy(*keys).agg(F.min("seq").alias("first"))
    held = state.select(*keys, F.col("value").alias("previous"))
    tried = requests.join(first, list(keys)).join(held, list(keys), "left")
    ok = (F.col("seq") == F.col("first")) & (F.col("previous").isNull() | F.coalesce(F.col("previous") == F.col("expected"), F.lit(False)))
    answers = tried.select(*keys, "seq", "previous", ok.alias("swapped"), "value")
    won = answers.where("swapped")
    after = state.select(*keys, "value").join(won.select(*keys), list(keys), "left_anti").unionByName(won.select(*keys, "value").where("value is not null"))
    return after, answers.select(*keys, "seq", "previous", "swapped")


def put(state: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``state`` with ``rows`` of its columns put in place of those of equal keys."""
    return state.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*state.columns))


def drop(state: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    return state.join(rows.select(*keys), list(keys), "left_anti")


# ---------------------------------------------------------------- branches


def valid_name(name: Column) -> Column:
    """Whether a branch may have a name: 1 to 1000 bytes, and not an identifier other than zero."""
    size = F.octet_length(name)
    return size.between(1, LONGEST_NAME) & ~(name.rlike("^[0-9a-fA-F]{32}$") & ~name.rlike("^0{32}$"))


def create_branches(branches: DataFrame, new: DataFrame) -> DataFrame:
    """Branches (branch, name, creator, latest, protected, deleted) with new ones whose names are valid and free among
    live branches; of several new ones of a name the first by id is taken."""
    taken = branches.where("not deleted").select("name")
    fit = new.where(valid_name(F.col("name"))).join(taken, "name", "left_anti")
    first = fit.groupBy("name").agg(F.min_by(F.struct("branch", "creator", "latest"), "branch").alias("b"))
    rows = first.select("b.branch", "name", "b.creator", "b.latest", F.lit(False).alias("protected"), F.lit(False).alias("deleted"))
    return branches.unionByName(rows)


def archive_branches(branches: DataFrame, asked: DataFrame, current: DataFrame, default: int) -> DataFrame:
    """``asked`` (branch) with what becomes of it: archived, or refused as current, protected, default or missing.
    An archived branch keeps its tip and metadata and gives its name free."""
    at = asked.join(branches.select("branch", "protected", "deleted", F.lit(True).alias("known")), "branch", "left")
    at = at.join(current.select("branch", F.lit(True).alias("in_use")).distinct(), "branch", "left")
    outcome = (
        F.when(F.col("known").isNull() | F.col("deleted"), "missing").when(F.col("in_use"), "current").when(F.col("protected"), "protected").when(F.col("branch") == default, "default").otherwise("archived")
    )
    return at.select("branch", outcome.alias("outcome"))


def set_protection(branches: DataFrame, asked: DataFrame, on: bool) -> DataFrame:
    """Live branches of ``asked`` protected or not; others as they are."""
    hit = branches.join(asked.select("branch", F.lit(True).alias("hit")), "branch", "left")
    flag = F.when(F.col("hit") & ~F.col("deleted"), F.lit(on)).otherwise(F.col("protected"))
    return hit.withColumn("protected", flag).select(*branches.columns)


def reset_branches(branches: DataFrame, asked: DataFrame, line: DataFrame, points: DataFrame, staged: DataFrame) -> DataFrame:
    """``asked`` (branch, revision) with what becomes of it: moved where the revision is on the branch (``line``:
    branch, revision) or its branch point (``points``: the same) and nothing is staged, else why not."""
    fit = line.select("branch", "revision").union(points.select("branch", "revision")).distinct().withColumn("fits", F.lit(True))
    at = asked.join(fit, ["branch", "revision"], "left").join(staged.select("branch", F.lit(True).alias("busy")).distinct(), "branch", "left")
    outcome = F.when(F.col("busy"), "staged").when(F.col("fits").isNull(), "not on branch").otherwise("moved")
    return at.join(branches.select("branch", "latest"), "branch").select(
        "branch", F.when(outcome == "moved", F.col("revision")).otherwise(F.col("latest")).alias("latest"), outcome.alias("outcome")
    )


def get_branches(branches: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (pos, id, name) with the branch found: by id live or deleted, by name live only.

    Live branches may share a name, so the rows can be far more than the inputs; the counts of each name say among how
    many tasks they are dealt.
    """
    by_id = asked.where("id is not null").join(branches.select(F.col("branch").alias("id"), F.col("branch").alias("found")), "id", "left")
    live = branches.where("not deleted").select("name", F.col("branch").alias("found"))
    named = asked.where("id is null")
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(live.groupBy("name").agg(F.count(F.lit(1)).alias("m")), "name", "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    total, most = sizes.agg(F.sum(n + m + n * m), F.max(n * m)).first()
    parts, salts = 1 + min(2 * (total or 0) // TASK_ROWS, 20_000), 1 + min(2 * (most or 0) // TASK_ROWS, 64)
    salted = named.withColumn("salt", F.pmod(F.hash("pos"), F.lit(salts))).repartition(parts, "name", "salt")
    spread = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, "name", "salt")
    by_name = salted.join(spread.hint("merge"), ["name", "salt"], "left")
    return by_id.select("pos", "found").unionByName(by_name.select("pos", "found"))


def list_branches(branches: DataFrame, tombstones: DataFrame, creator: str | None = None, deleted: bool = False) -> DataFrame:
    """Live branches, of one creator if asked, and with ``deleted`` the tombstones whose ids aren't live."""
    live = branches.where("not deleted").select("branch", "name", "creator", F.lit(False).alias("deleted"))
    rows = live
    if deleted:
        rows = rows.unionByName(tombstones.join(live.select("branch"), "branch", "left_anti").select("branch", "name", "creator", F.lit(True).alias("deleted")).dropDuplicates(["branch"]))
    return rows.where(F.col("creator") == creator) if creator is not None else rows


def branch_info(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per branch on either side: both tips, and the name of the side whose metadata was created later (local on a tie)."""
    side = lambda df, n: df.select("branch", F.struct("name", "latest", "created").alias(n))
    both = side(local, "l").join(side(remote, "r"), "branch", "full")
    newer = F.coalesce(F.col("r.created") > F.col("l.created"), F.col("l").isNull())
    return both.select(
        "branch", F.when(newer, F.col("r.name")).otherwise(F.col("l.name")).alias("name"), F.col("l.latest").alias("local"), F.col("r.latest").alias("remote")
    )


# ---------------------------------------------------------------- locks


def query_locks(locks: DataFrame, shape: str, **wanted: object) -> DataFrame:
    """Locks that one of the nine shapes of query asks for, by path."""
    out = locks
    for part in LOCK_SHAPES[shape]:
        out = out.where(F.col(part) == F.lit(wanted[part]))
    return out.orderBy("path")


def release(locks: DataFrame, asked: DataFrame, validate: bool = True) -> DataFrame:
    """``asked`` (resource, owner) with what becomes of each: released, not found, or not owned (unless owners aren't
    validated)."""
    held = asked.join(locks.select("resource", F.col("owner").alias("holder")), "resource", "left")
    outcome = F.when(F.col("holder").isNull(), "not found").when(F.lit(validate) & (F.col("holder") != F.col("owner")), "not owned").otherwise("released")
    return held.select("resource", "owner", outcome.alias("outcome"))


# ---------------------------------------------------------------- links, layers, instances


def link_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links (mount, signature, branch) that both revisions have under one mount, with another signature or branch."""
    a = old.select("mount", F.col("signature").alias("old_signature"), F.col("branch").alias("old_branch"))
    return a.join(new, "mount").where("signature <> old_signature or branch <> old_branch").select("mount", "old_signature", "signature", "old_branch", "branch")


def through_links(paths: DataFrame, links: DataFrame, hops: int = 8) -> DataFrame:
    """Paths (repository, path) led through links (repository, mount, target, source) to where their content lies:
    repository, path, at, rest, hops. ``at`` is null where more than ``hops`` links follow one another."""
    at = paths.select("repository", "path", F.col("repository").alias("at"), F.col("path").alias("rest"), F.lit(0).alias("hops"))
    side = links.select(F.col("repository").alias("at"), "mount", "target", F.col("source").alias("to"))
    done = None
    for _ in range(hops + 1):
        ups = at.select("*", F.explode(F.concat(ancestors(F.col("rest")), F.array("rest"))).alias("mount"))
        best = ups.join(side, ["at", "mount"]).groupBy("repository", "path").agg(F.max_by(F.struct("mount", "target", "to"), F.length("mount")).alias("m"))
        met = at.join(best, ["repository", "path"], "left").checkpoint()
        end = met.where("m is null").select("repository", "path", "at", "rest", "hops")
        done = end if done is None else done.unionByName(end)
        tail = F.substring(F.col("rest"), F.length("m.mount") + 2, F.lit(2147483647))
        inner = F.concat_ws("/", F.when(F.col("m.to") != "", F.col("m.to")), F.when(tail != "", tail))
        at = met.where("m is not null").select("repository", "path", F.col("m.target").alias("at"), inner.alias("rest"), (F.col("hops") + 1).alias("hops"))
        if at.isEmpty():
            return done
    return done.unionByName(at.select("repository", "path", F.lit(None).cast(at.schema["at"].dataType).alias("at"), "rest", "hops"))


def same_branch(instances: DataFrame) -> DataFrame:
    """Per instance (instance, branch): how many others are on its branch, and the least of them. One row a branch meets
    each instance, never instance with instance."""
    rows = instances.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.min("instance").alias("first"))
    second = instances.join(rows, "branch").where("instance <> first").groupBy("branch").agg(F.min("instance").alias("second"))
    joined = instances.join(rows, "branch").join(second, "branch", "left")
    return joined.select("instance", "branch", (F.col("n") - 1).alias("others"), F.when(F.col("instance") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"))


# ---------------------------------------------------------------- metadata


def get_metadata(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (owner, key) with its value (null: none)."""
    return asked.join(rows.select("owner", "key", "value"), ["owner", "key"], "left")


def list_metadata(rows: DataFrame) -> DataFrame:
    """Metadata (owner, pos, key, value) in stored order, the place counted from 0 within an owner."""
    by_owner = rows.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "value"))).alias("m"))
    return by_owner.select("owner", F.posexplode("m").alias("place", "e")).select("owner", "place", "e.key", "e.value")


def clear_metadata(rows: DataFrame, owners: DataFrame) -> DataFrame:
    return rows.join(owners.select("owner"), "owner", "left_anti")


def file_metadata(rows: DataFrame, asked: DataFrame, parents: DataFrame) -> DataFrame:
    """``asked`` (revision, path, key) with the value there, or in the parent revision where the path has none (it was
    deleted). ``rows``: revision, path, key, value; ``parents``: revision, parent."""
    own = asked.join(rows, ["revision", "path", "key"], "left")
    old = rows.select(F.col("revision").alias("parent"), "path", "key", F.col("value").alias("old"))
    there = rows.select("revision", "path", F.lit(True).alias("has")).distinct()
    out = own.join(parents, "revision", "left").join(old, ["parent", "path", "key"], "left").join(there, ["revision", "path"], "left")
    return out.select("revision", "path", "key", F.when(F.col("has"), F.col("value")).otherwise(F.col("old")).alias("value"))


def decoded_value(value: Column, kind: Column) -> Column:
    """Text as the stored form (hexadecimal) of its kind, null where it isn't one: numeric (64 bits, little end first),
    boolean, hash (64 digits), context (32 digits), string."""
    number = F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("decimal(38,0)"))
    small = F.when((number >= 0) & (number <= F.lit(str(2**64 - 1)).cast("decimal(38,0)")), number)
    digits = F.lpad(F.conv(small.cast("string"), 10, 16), 16, "0")
    turned = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    lowered = F.lower(value)
    return (
        F.when(kind == "numeric", F.lower(turned))
        .when(kind == "boolean", F.when(lowered.isin("true", "1", "yes", "on"), "01").when(lowered.isin("false", "0", "no", "off"), "00"))
        .when(kind == "hash", F.when(value.rlike("^[0-9a-fA-F]{64}$"), lowered))
        .when(kind == "context", F.when(value.rlike("^[0-9a-fA-F]{32}$"), lowered))
        .otherwise(F.lower(F.hex(value.cast("binary"))))
    )
