"""Queries over merges, picks, syncs, staging and commits, each with DuckDB SQL, on the three snapshots of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import merging, texts, trees
from tessera.sources.versioned import snapshot, snapshot_sql, table

from .queries import _DIFF3, _diff3, _diff_sql, _query

_MERGE = f"""{_DIFF3}, mt as (select * from ({snapshot_sql("target")}) x),
  staged as (select d.path, d.action, d.from_path, d.hash, case when outcome = 'conflict' then 'open' else 'clean' end as state, m.hash as mine
  from d3 d left join mt m on m.path = d.from_path where outcome <> 'same')"""
_PICKED = "select path from ({0}) x where context % 2 = 0"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.start_merge(*[snapshot(spark, sf_dir, s) for s in ("base", "source", "target")])


def _even(spark: SparkSession, sf_dir: str, side: str = "source") -> DataFrame:
    return snapshot(spark, sf_dir, side).where("context % 2 = 0").select("path")


@_query(f"with {_MERGE} select * from staged")
def merge_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir)


def _resolved_sql(side: str) -> str:
    return f"""select path, action, from_path, hash, case when state = 'open' and path in ({_PICKED.format(snapshot_sql("source"))}) then '{side}' else state end as state, mine from staged"""


@_query(f"with {_MERGE} {_resolved_sql('mine')}")
def resolve_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.resolve(_staged(spark, sf_dir), _even(spark, sf_dir), "mine")


@_query(f"with {_MERGE} {_resolved_sql('theirs')}")
def resolve_theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.resolve(_staged(spark, sf_dir), _even(spark, sf_dir), "theirs")


@_query(f"with {_MERGE}, r as ({_resolved_sql('theirs')}) select path, action, from_path, hash, case when state = 'theirs' and path like '1-%' then 'open' else state end as state, mine from r")
def unresolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = resolve_theirs(spark, sf_dir)
    return merging.unresolve(settled, settled.where("path like '1-%'").select("path"))


@_query(f"""with {_MERGE}, r as ({_resolved_sql('theirs')}), ok as (select * from r where state in ('clean', 'theirs'))
  select path, hash from mt where path not in (select from_path from ok where action <> 'Add') and path not in (select path from ok where action <> 'Delete')
  union all select path, hash from ok where action <> 'Delete'""")
def merge_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.finish_merge(snapshot(spark, sf_dir, "target"), resolve_theirs(spark, sf_dir))


@_query(f"with {_MERGE}, r as ({_resolved_sql('mine')}) select * from r where path not like 'moved/%' union all select * from staged where path like 'moved/%'")
def merge_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything in the subtree ``moved`` is merged anew."""
    return merging.restart(resolve_mine(spark, sf_dir), _staged(spark, sf_dir), "moved")


@_query(f"select s.path, coalesce(t.hash, s.hash) as meta from ({snapshot_sql('target')}) s left join (select * from ({snapshot_sql('source')}) x where context % 3 = 0) t on t.path = s.path")
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = lambda side: snapshot(spark, sf_dir, side).select("path", "context", F.col("hash").alias("meta"))
    return merging.merge_metadata(meta("target"), meta("source").where("context % 3 = 0"))


@_query(f"with {_DIFF3} select * from d3")
def cherry_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change from ``base`` to ``source`` picked onto ``target``."""
    return merging.cherry_pick(*[snapshot(spark, sf_dir, s) for s in ("base", "source", "target")])


@_query(f"""with {_diff_sql("s", "source", "base")}, {_diff_sql("t", "source", "target", False)},
  d as (select s.action, s.path, s.from_path, s.hash, o.action as target_action, case when o.action is null and n.action is null then 'change'
  when s.action = 'Move' then case when n.action is not null and n.hash is distinct from s.hash then 'conflict'
    when o.action = 'Delete' then 'conflict' when o.action is null or s.base_hash = s.hash then 'change' else 'conflict' end
  when s.hash is not distinct from o.hash then 'same' else 'conflict' end as outcome
  from s left join t o on s.from_path = o.path left join t n on s.path = n.path) select * from d""")
def revert_on_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change from ``base`` to ``source`` taken back on ``target``."""
    return merging.revert(*[snapshot(spark, sf_dir, s) for s in ("base", "source", "target")])


@_query("""select c_custkey as branch, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then c_nationkey + 100 else c_nationkey end as latest, c_custkey % 3 = 0 and c_custkey % 2 = 0 as moved from customer""")
def fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third branch asks to move; odd ones expect a tip that it isn't."""
    c = table(spark, sf_dir, "customer")
    return merging.fast_forward(
        c.selectExpr("c_custkey as branch", "c_nationkey as latest"),
        c.where("c_custkey % 3 = 0").selectExpr("c_custkey as branch", "c_nationkey + c_custkey % 2 as expected", "c_nationkey + 100 as latest"),
    )


_LOCAL = f"select path, case when context % 3 = 0 then hash else sha256(path) end as hash, context from ({snapshot_sql('target')}) x where context % 4 = 1"


@_query(f"""with {_diff_sql("t", "base", "target", False)}, l as ({_LOCAL}) select t.path, t.action, t.hash,
  case when l.path is null then 'update' when l.hash is not distinct from t.hash then 'same' else 'conflict' end as outcome from t left join l on l.path = t.path""")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = snapshot(spark, sf_dir, "target").where("context % 4 = 1").selectExpr("path", "if(context % 3 = 0, hash, sha2(path, 256)) as hash")
    return merging.sync(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "target"), local)


@_query("""with b as (select c_custkey as branch, c_custkey % 3 as ahead, c_custkey // 3 % 3 as behind, c_custkey % 2 = 0 as at_tip, c_custkey % 5 = 0 as force from customer)
  select branch, case when ahead = 0 or force then 'remote' when behind = 0 or not at_tip then 'local' else 'remote' end as target, ahead > 0 and behind > 0 and at_tip and not force as merges from b""")
def sync_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as branch", "c_custkey % 3 as ahead", "c_custkey div 3 % 3 as behind", "c_custkey % 2 = 0 as at_local_tip", "c_custkey % 5 = 0 as force"
    )
    return merging.sync_target(b)


_BASIC = "action, from_path, hash"


def _changes(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return trees.diff(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, side), moves=False).select("path", "action", "from_path", "hash")


@_query(f"""with {_diff_sql("s", "base", "source", False)}, {_diff_sql("t", "base", "target", False)}
  select coalesce(n.path, o.path) as path, case when o.action = 'Add' and n.action = 'Keep' then 'Add' else coalesce(n.action, o.action) end as action,
  coalesce(n.path, o.path) as from_path, case when n.path is null then o.hash else n.hash end as hash
  from s o full join t n on o.path = n.path where not coalesce(o.action = 'Add' and n.action = 'Delete', false)""")
def stage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's changes staged over the source's."""
    return merging.stage(_changes(spark, sf_dir, "source"), _changes(spark, sf_dir, "target"))


@_query(f"""with b as ({snapshot_sql("base")}), m as (select path as from_path, case when context % 2 = 0 then 'new/' || path else path end as path from b)
  select m.path, 'Move' as action, m.from_path, b.hash from m join b on b.path = m.from_path where m.path not in (select path from b)""")
def stage_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = snapshot(spark, sf_dir, "base")
    return merging.stage_move(base, base.selectExpr("path as from_path", "if(context % 2 = 0, concat('new/', path), path) as path"))


@_query(f"with {_diff_sql('s', 'base', 'source', False)} select path, {_BASIC} from s where path not like 'moved/1-%' and path not like '3-MEDIUM/%' and path <> '5-LOW/7'")
def unstage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _changes(spark, sf_dir, "source")
    gone = spark.createDataFrame([("moved/1-URGENT",), ("3-MEDIUM",), ("5-LOW/7",)], "path string")
    return merging.unstage(staged, gone)


@_query(f"""with w as ({snapshot_sql("source")}), r as ({snapshot_sql("base")}), p as (select path from w where context % 3 = 0 union select path from r where context % 7 = 0)
  select path, hash from w where path not in (select path from p) union all select path, hash from r where path in (select path from p)""")
def reset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    working, revision = snapshot(spark, sf_dir, "source"), snapshot(spark, sf_dir, "base")
    return merging.reset(working, revision, working.where("context % 3 = 0").select("path").union(revision.where("context % 7 = 0").select("path")))


@_query("""with m as (select c_custkey % 50 as branch, c_custkey as number, c_custkey % 7 as other, c_custkey * 10 as revision from customer),
  a as (select distinct c_custkey % 50 as branch, c_custkey % 7 as other from customer)
  select a.branch, a.other, case when a.other % 2 = 0 and a.branch <> a.other then (select max(m.number) * 10 from m where m.branch = a.branch and m.other = a.other) end as revision from a""")
def last_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even branches are in every stack."""
    c = table(spark, sf_dir, "customer")
    merges = c.selectExpr("c_custkey % 50 as branch", "c_custkey as number", "c_custkey % 7 as other", "c_custkey * 10 as revision")
    asked = merges.select("branch", "other").distinct()
    return merging.last_merged(merges, asked.where("other % 2 = 0").selectExpr("branch", "other as member"), asked)


_FILES = "select path, length(path) + context % 5 as size, context % 10 as mtime, hash from ({0}) x"


@_query(f"""with t as ({_FILES.format(snapshot_sql("base"))}), w as ({_FILES.format(snapshot_sql("target"))}), w2 as (select path, size + case when size % 4 = 0 then 1 else 0 end as size, mtime + case when size % 3 = 0 then 1 else 0 end as mtime, hash from w)
  select * from (select coalesce(t.path, w2.path) as path, case when t.path is null then 'Add' when w2.path is null then 'Delete'
  when t.size <> w2.size or (t.mtime <> w2.mtime and t.hash <> w2.hash) then 'Keep' end as action from t full join w2 on t.path = w2.path) where action is not null""")
def dirty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working files against a revision's, by size, time and content."""
    files = lambda side: snapshot(spark, sf_dir, side).selectExpr("path", "length(path) + context % 5 as size", "context % 10 as mtime", "hash")
    working = files("target").selectExpr("path", "size + if(size % 4 = 0, 1, 0) as size", "mtime + if(size % 3 = 0, 1, 0) as mtime", "hash")
    return merging.mark_dirty(files("base"), working)


@_query(f"""with {_diff_sql("s", "base", "source", False)}, c as ({snapshot_sql("target")}), n as (select path, case when path like '%3' then null else action end as action, from_path, hash from s)
  select n.path, case when n.action = 'Add' and c.path is not null then 'Keep' else n.action end as action, n.from_path, n.hash from n left join c on c.path = n.path
  where n.action is not null and not (n.action in ('Keep', 'Delete') and c.path is null)""")
def rebase_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _changes(spark, sf_dir, "source").withColumn("action", F.when(~F.col("path").like("%3"), F.col("action")))
    return merging.rebase(staged, snapshot(spark, sf_dir, "target"))


@_query(f"""with b as ({snapshot_sql("base")}), a as (select upper(path) as path, hash, context from ({snapshot_sql("source")}) x)
  select path, hash from b union all select path, hash from a where lower(path) not in (select lower(path) from b)""")
def tree_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.tree_add(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "source").selectExpr("upper(path) as path", "hash"))


@_query(f"select path, context, hash from ({snapshot_sql('source')}) x where path not like 'moved/%' and path not like '2-HIGH/%'")
def tree_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.tree_delete(snapshot(spark, sf_dir, "source"), spark.createDataFrame([("moved",), ("2-HIGH",)], "path string"))


@_query(f"select b.path, coalesce(t.hash, b.hash) as hash from ({snapshot_sql('base')}) b left join (select * from ({snapshot_sql('target')}) x where context % 2 = 0) t on t.path = b.path")
def tree_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.tree_modify(snapshot(spark, sf_dir, "base").select("path", "hash"), snapshot(spark, sf_dir, "target").where("context % 2 = 0"))


@_query(f"""with {_DIFF3}, ok as (select * from d3 where outcome = 'change') select 'r2' as revision, path, hash from ({snapshot_sql("target")}) x
  where path not in (select from_path from ok where action <> 'Add') and path not in (select path from ok where action <> 'Delete')
  union all select 'r2', path, hash from ok where action <> 'Delete'""")
def commit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _diff3(spark, sf_dir).where("outcome = 'change'")
    return merging.commit(F.lit("r2"), F.lit("r1"), snapshot(spark, sf_dir, "target"), staged)[0]


@_query(f"with {_DIFF3} select 'r2' as revision, 'r1' as parent, action, path, from_path from d3 where outcome = 'change'")
def commit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _diff3(spark, sf_dir).where("outcome = 'change'")
    return merging.commit(F.lit("r2"), F.lit("r1"), snapshot(spark, sf_dir, "target"), staged)[1]


@_query(f"""with {_diff_sql("s", "base", "source", False)} select 'r2' as revision, s.action, s.path, case when s.action = 'Delete' then 0 else length(n.path) end as size,
  case when s.action = 'Delete' then s.base_hash else n.hash end as hash from s left join ({snapshot_sql("source")}) n on n.path = s.path""")
def delta_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lambda side, name: snapshot(spark, sf_dir, side).select(F.lit(name).alias("revision"), "path", F.length("path").alias("size"), "hash")
    delta = _changes(spark, sf_dir, "source").select(F.lit("r2").alias("revision"), F.lit("r1").alias("parent"), "action", "path", "from_path")
    return merging.delta_listing(delta, nodes("base", "r1").unionByName(nodes("source", "r2")))


@_query("""with c as (select c_custkey as revision, c_custkey + 1 as number, c_custkey - 1 as parent_self, c_mktsegment as message, 'me' as committer from customer),
  n as (select c_custkey as revision, case when c_custkey % 3 = 0 then 'new' when c_custkey % 3 = 1 then c_mktsegment end as m, case when c_custkey % 5 = 0 then 'you' end as k from customer where c_custkey % 2 = 0),
  j as (select c.revision, number, parent_self, coalesce(m, message) as message, coalesce(k, committer) as committer, coalesce(m, message) = message and coalesce(k, committer) = committer as same from c join n using (revision))
  select revision, number, parent_self, message, committer, case when not same then sha256(revision || '|' || message || '|' || committer) end as new_revision, not same as amended from j""")
def amend_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    tips = c.selectExpr("c_custkey as revision", "c_custkey + 1 as number", "c_custkey - 1 as parent_self", "c_mktsegment as message", "'me' as committer")
    changes = c.where("c_custkey % 2 = 0").selectExpr(
        "c_custkey as revision", "case when c_custkey % 3 = 0 then 'new' when c_custkey % 3 = 1 then c_mktsegment end as message", "case when c_custkey % 5 = 0 then 'you' end as committer"
    )
    return merging.amend(tips, changes)


@_query("""with t as (select p_partkey as path, p_size % 9 as s, p_size % 7 as t, p_partkey % 8 as sm, p_partkey % 5 as tm from part)
  select path, case when s <= sm and t <= tm then 'none' when s <= sm then 'target' when t <= tm then 'source' else 'conflict' end as outcome from t""")
def merged_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = lambda side, n: part.selectExpr("p_partkey as path", f"'{side}' as side", f"{n} as number")
    touched = rows("source", "p_size % 9").unionByName(rows("target", "p_size % 7"))
    merged = rows("source", "p_partkey % 8").unionByName(rows("target", "p_partkey % 5"))
    return merging.already_merged(part.selectExpr("p_partkey as path"), touched, merged)


@_query(f"""with {_diff_sql("s", "base", "source")} select -length(path) as pos, case action when 'Add' then 'Delete' when 'Delete' then 'Add' else action end as action,
  from_path as path, path as from_path, context, hash as base_hash, base_hash as hash from s""")
def reverse_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = trees.diff(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "source"))
    return merging.reverse_changes(changes.withColumn("pos", F.length("path")))


@_query("""with c as (select p_partkey as p0, p_partkey % 17 - 40 as p1, p_name as paths from part where p_partkey % 2 = 0), w as (select p_partkey % 17 - 40 as p0, p_partkey as p1 from part)
  select w.p0, w.p1, c.paths from w left join c on c.p0 = w.p1 and c.p1 = w.p0""")
def merge_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    carried = part.where("p_partkey % 2 = 0").selectExpr("p_partkey as p0", "p_partkey % 17 - 40 as p1", "p_name as paths")
    return merging.merge_carry(carried, part.selectExpr("p_partkey % 17 - 40 as p0", "p_partkey as p1"))


_NODES = """nodes as (select path, case when context % 9 = 0 then 'directory' else 'file' end as kind, context % 4 as mode, context, hash from ({0}) x)"""
_NODES_B = f"b as (select case when context % 6 = 0 then upper(path) else path end as path, case when context % 9 = 0 then 'directory' else 'file' end as kind, context % 4 as mode, context, hash from ({snapshot_sql('base')}) x)"
_NODES_T = f"t as (select path, case when context % 18 = 0 then 'directory' else 'file' end as kind, context % 4 + case when context % 8 = 0 then 1 else 0 end as mode, context, hash from ({snapshot_sql('target')}) x)"


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = snapshot(spark, sf_dir, "base").selectExpr(
        "if(context % 6 = 0, upper(path), path) as path", "if(context % 9 = 0, 'directory', 'file') as kind", "context % 4 as mode", "context", "hash"
    )
    t = snapshot(spark, sf_dir, "target").selectExpr("path", "if(context % 18 = 0, 'directory', 'file') as kind", "context % 4 + if(context % 8 = 0, 1, 0) as mode", "context", "hash")
    return b, t


_NODE_DIFF = f"""with {_NODES_B}, {_NODES_T}, j as (select b.path as bp, b.kind as bk, b.mode as bm, b.context as bc, b.hash as bh, t.path as tp, t.kind as tk, t.mode as tm, t.context as tc, t.hash as th
  from b full join t on lower(b.path) = lower(t.path)), d as (
  select 'Add' as action, tp as path, tp as from_path, tk as kind, null as base_hash, th as hash from j where bp is null or (tp is not null and (bk = 'file') <> (tk = 'file'))
  union all select 'Delete', bp, bp, bk, bh, null from j where tp is null or (bp is not null and (bk = 'file') <> (tk = 'file'))
  union all select case when bp <> tp then 'Move' else 'Keep' end, tp, bp, tk, bh, th from j where bp is not null and tp is not null and (bk = 'file') = (tk = 'file')
    and (bm <> tm or bp <> tp or (bk = 'file' and (bh <> th or bc <> tc))))"""


@_query(f"{_NODE_DIFF} select * from d")
def node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and directories with modes; names compared without case."""
    return trees.node_diff(*_nodes(spark, sf_dir))


@_query(f"{_NODE_DIFF} select * from d where path like '5-LOW/%'")
def node_diff_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, t = _nodes(spark, sf_dir)
    keep = lambda df: df.withColumn("path", F.regexp_replace("path", "^5-low/", "5-LOW/"))
    return trees.node_diff(keep(b), keep(t), "5-LOW")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, which come to Python in batches bounded by rows and bytes, so that a worker holds a few texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return table(spark, sf_dir, "documents")


@_query()
def unified_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch of each document against itself with sentences on lines of their own and one word replaced."""
    docs = _texts(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"([.!?]) ", "$1\n").alias("old"))
    return docs.select("doc_id", texts.patch(F.col("old"), F.regexp_replace("old", r"(?m)^(\w+) and ", "$1 or ")).alias("patch"))


@_query()
def text_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document merged from two edits of its sentences; tests hold the merge against known results and git."""
    docs = _texts(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"([.!?]) ", "$1\n").alias("o"))
    mine, theirs = F.regexp_replace("o", r"(?m)^([A-M])", "_$1"), F.regexp_replace("o", r"(?m)^([G-Z])", "$1_")
    return docs.select("doc_id", texts.merged(F.col("o"), mine, theirs).alias("m")).select("doc_id", "m.text", "m.conflict")


@_query(r"""select page_id, not regexp_matches(html, '(^|\n)(\|{7}|<{7}|>{7}) ') as clean, true as diffable, false as utf16, length(html) as n from pages""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select(
        "page_id", (~texts.is_conflicted(F.col("html"))).alias("clean"), texts.is_diffable(raw).alias("diffable"), texts.is_utf16(raw).alias("utf16"), F.length(texts.decoded(raw)).alias("n")
    )
