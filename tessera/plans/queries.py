"""Queries over versioned data, by name, and the DuckDB SQL that each equals.

Every query runs over its whole tables. SQL is written apart from the operators; only the derivation of
snapshots and chains from the given tables is shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import content, filters, history, trees
from tessera.sources.versioned import CHAINS_SQL, chains, document_tree, ensure_checkpoints, snapshot, snapshot_sql, table
from tessera.streaming import notifications

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Rules of the filter query, in order; the last match that changes something wins.
RULES = ["# by language and name", "/de", "!de/src1/*", "*7", "!en/src0/177"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- trees

_TREE = """tree as (select coalesce(lang,'-')||'/'||coalesce(source,'-')||'/'||doc_id as path, coalesce(lang,'-') as d1,
  coalesce(lang,'-')||'/'||coalesce(source,'-') as d2, doc_id as context, sha256(coalesce(text,'')) as hash,
  cast(strlen(coalesce(text,'')) as bigint) as size from documents)"""


def _diff_sql(name: str, old: str, new: str, moves: bool = True) -> str:
    """CTEs that end in ``name``: action, path, from_path, context, base_hash, hash."""
    raw = f"""{name}_raw as (select case when b.path is null then 'Add' when t.path is null then 'Delete' else 'Keep' end as action,
  coalesce(b.path, t.path) as path, coalesce(b.path, t.path) as from_path, coalesce(t.context, b.context) as context,
  b.hash as base_hash, t.hash as hash
  from ({snapshot_sql(old)}) b full join ({snapshot_sql(new)}) t on b.path = t.path
  where b.path is null or t.path is null or b.hash <> t.hash)"""
    if not moves:
        return f"{raw}, {name} as (select * from {name}_raw)"
    return f"""{raw}, {name}_pairs as (select a.context, a.path, d.path as from_path, d.base_hash, a.hash
  from {name}_raw a join {name}_raw d on a.context = d.context and a.action = 'Add' and d.action = 'Delete'),
{name} as (select 'Move' as action, path, from_path, context, base_hash, hash from {name}_pairs
  union all select * from {name}_raw where action = 'Keep' or context not in (select context from {name}_pairs))"""


_DIFF3 = f"""{_diff_sql("s", "base", "source")}, {_diff_sql("t", "base", "target", False)},
d3 as (select s.action, s.path, s.from_path, s.hash, o.action as target_action, case
  when o.action is null and n.action is null then 'change'
  when s.action = 'Move' then case when n.action is not null and n.hash is distinct from s.hash then 'conflict'
    when o.action = 'Delete' then 'conflict' when o.action is null or s.base_hash = s.hash then 'change' else 'conflict' end
  when s.hash is not distinct from o.hash then 'same' else 'conflict' end as outcome
  from s left join t o on s.from_path = o.path left join t n on s.path = n.path)"""


@_query(f"with {_diff_sql('s', 'base', 'source')} select * from s")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.diff(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "source"))


@_query(f"with {_diff_sql('s', 'base', 'source', False)} select * from s")
def tree_diff_no_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.diff(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "source"), moves=False)


def _diff3(spark: SparkSession, sf_dir: str, scope: str = "source") -> DataFrame:
    return trees.diff3(*[snapshot(spark, sf_dir, s) for s in ("base", "source", "target")], scope=scope)


@_query(f"with {_DIFF3} select * from d3")
def diff3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff3(spark, sf_dir)


@_query(f"""with {_DIFF3} select * from d3 union all
  select action, path, from_path, hash, action, 'target' from t where path not in (select from_path from s)""")
def diff3_full_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff3(spark, sf_dir, "full")


@_query(f"with {_DIFF3} select * from d3 where outcome = 'conflict'")
def diff3_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff3(spark, sf_dir).where("outcome = 'conflict'")


@_query(f"""with {_DIFF3}, ok as (select * from d3 where outcome = 'change')
  select path, hash from ({snapshot_sql("target")}) x where path not in (select from_path from ok where action <> 'Add')
    and path not in (select path from ok where action <> 'Delete')
  union all select path, hash from ok where action <> 'Delete'""")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.apply_changes(snapshot(spark, sf_dir, "target"), _diff3(spark, sf_dir).where("outcome = 'change'"))


@_query(f"select path, hash from ({snapshot_sql('base')}) b")
def revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = snapshot(spark, sf_dir, "source")
    return trees.apply_changes(head, trees.invert(trees.diff(snapshot(spark, sf_dir, "base"), head)))


@_query(f"select path, hash from ({snapshot_sql('target')}) b")
def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, old = snapshot(spark, sf_dir, "source"), snapshot(spark, sf_dir, "target")
    return trees.apply_changes(head, trees.diff(head, old))


@_query(f"with {_diff_sql('s', 'base', 'source')} select action, count(*) as n from s group by action")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_diff(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@_query(f"with {_TREE} select path, context, hash, size from tree where path like 'en/%'")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.scan(document_tree(spark, sf_dir), "en/", 2)


@_query(f"with {_TREE} select distinct dir, depth from (select d1 as dir, 1 as depth from tree union all select d2, 2 from tree)")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = document_tree(spark, sf_dir).select(F.explode(trees.ancestors(F.col("path"))).alias("dir")).distinct()
    return dirs.select("dir", F.size(F.split("dir", "/")).alias("depth"))


@_query(f"with {_TREE} select upper(path) as path, path as found, hash from tree")
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = document_tree(spark, sf_dir)
    return trees.resolve(tree, tree.select(F.upper("path").alias("path")))


@_query(f"""with {_TREE}, f as (select *, ('0x' || substr(sha256(path || '|' || hash), 1, 8))::bigint as part from tree)
  select dir, count(*) as files, cast(sum(size) as bigint) as size, cast(sum(part) % 281474976710656 as bigint) as content, depth from (
    select '' as dir, 0 as depth, * from f union all select d1, 1, * from f union all select d2, 2, * from f) group by dir, depth""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.rollup(document_tree(spark, sf_dir))


def _level_sql(name: str, rows: str) -> str:
    """CTEs that end in ``name``: dir, hash, size, files of the directories that hold ``rows`` (dir, n, hash, size, files)."""
    return f"""{name}_rows as (select dir, sha256(lower(n)) as k, hash, size, files from ({rows}) x),
  {name}_parts as (select dir, substr(k, 1, 2) as part, sha256(string_agg(k || ':' || hash || ':' || size, '|' order by k || ':' || hash || ':' || size)) as h, sum(size) as size, sum(files) as files from {name}_rows group by 1, 2),
  {name} as (select dir, sha256(string_agg(part || h, ',' order by part || h)) as hash, cast(sum(size) as bigint) as size, cast(sum(files) as bigint) as files from {name}_parts group by 1)"""


@_query(f"""with {_TREE}, {_level_sql("low", "select d2 as dir, string_split(path, '/')[-1] as n, hash, size, 1 as files from tree")},
  {_level_sql("mid", "select string_split(dir, '/')[1] as dir, string_split(dir, '/')[2] as n, hash, size, files from low")},
  {_level_sql("top", "select '' as dir, dir as n, hash, size, files from mid")} select * from low union all select * from mid union all select * from top""")
def dir_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.directory_hashes(document_tree(spark, sf_dir))


@_query(f"with {_diff_sql('s', 'base', 'source', False)}, {_diff_sql('t', 'base', 'target', False)} select exists (select 1 from s join t on t.path = s.path where s.hash is distinct from t.hash) as diverged")
def link_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two branches of a link have content in conflict."""
    base = snapshot(spark, sf_dir, "base")
    s, t = (trees.diff(base, snapshot(spark, sf_dir, side), moves=False) for side in ("source", "target"))
    met = s.join(t.select("path", F.col("hash").alias("other")), "path").where(~F.col("hash").eqNullSafe(F.col("other")))
    return met.agg((F.count(F.lit(1)) > 0).alias("diverged"))


@_query(f"""with w as (select path, case when context % 3 = 0 then sha256(path) else hash end as hash from ({snapshot_sql("target")}) x), {_diff_sql("t", "base", "target", False)}
  select t.path, t.action, case when t.action = 'Delete' then w.path is null else w.hash is not distinct from t.hash end as still from t left join w on w.path = t.path""")
def dirty_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded changes held against the files as they are now."""
    changes = trees.diff(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, "target"), moves=False)
    now = snapshot(spark, sf_dir, "target").selectExpr("path", "if(context % 3 = 0, sha2(path, 256), hash) as now", "true as there")
    same = F.when(F.col("action") == "Delete", F.col("there").isNull()).otherwise(F.col("now").eqNullSafe(F.col("hash")))
    return changes.join(now, "path", "left").select("path", "action", same.alias("still"))


@_query("select lower(p_name) as folded, count(*) as n from part group by 1 having count(*) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.collisions(table(spark, sf_dir, "part"), "p_name")


_ADMITS = """tree_rules as (select *, case when d2 = 'en/src0' then false when lower(d2) like '%7' then true else d1 = 'de' and d2 <> 'de/src1' end as dir_out,
  case when path = 'en/src0/177' then false when path like '%7' then true else d1 = 'de' and d2 <> 'de/src1' end as file_out from tree)"""


@_query(f"with {_TREE}, {_ADMITS} select path, not dir_out and not file_out as included from tree_rules")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tree(spark, sf_dir).select("path", filters.admits(F.col("path"), filters.parse(RULES)).alias("included"))


@_query(f"""with {_TREE}, {_ADMITS}, m as (select path, (select not (dir_out or file_out) from tree_rules r where r.path = tree.path) as seen, d2 <> 'fr/src2' as viewed from tree)
  select path, seen, viewed, seen and viewed as whole from m""")
def filter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the ignore rules, by the view rules, by both."""
    ignore, view, p = filters.parse(RULES), filters.parse(["/fr/src2/**", "fr/src2"]), F.col("path")
    by = lambda mode: filters.admits_by_mode(p, ignore, view, mode)
    return document_tree(spark, sf_dir).select("path", by(filters.IGNORE).alias("seen"), by(filters.VIEW).alias("viewed"), by(filters.FULL).alias("whole"))


@_query(f"""with {_TREE}, {_ADMITS} select path, case when dir_out or file_out then 0 else 1 end as reason from tree_rules where dir_out or file_out or d2 = 'fr/src2'""")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reasons(document_tree(spark, sf_dir), filters.parse(RULES), filters.parse(["/fr/src2/**", "fr/src2"]))


@_query(f"with {_TREE} select distinct d2 as dir, d1 = 'de' or d2 = 'en/src1' as proven from tree")
def subtree_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = document_tree(spark, sf_dir).select(values.parent(F.col("path")).alias("dir")).distinct()
    return dirs.select("dir", filters.excludes_subtree(F.col("dir"), filters.parse(["/de", "en/src1/**", "*.tmp"])).alias("proven"))


# ---------------------------------------------------------------- history


@_query(f"""with {CHAINS_SQL} select branch, revision, number, pos from (select *,
  row_number() over (partition by branch order by number desc) as pos from chains) where pos <= 100""")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL} select branch, revision, number, kind from chains c where number >=
  coalesce((select max(number) from chains a where a.branch = c.branch and a.kind = 'signup'), 0)""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.file_history(chains(spark, sf_dir), "signup")


@_query(f"""with {CHAINS_SQL} select c.branch, c.revision, c.number, c.kind from chains c
  left join chains p on p.branch = c.branch and p.number = c.number - 1 where p.kind is distinct from c.kind""")
def latest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.collapse(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL} select branch, ((number + 9) // 10) * 10 as segment, min(number) as first, max(number) as last,
  count(*) as n from chains group by 1, 2""")
def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.segments(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL} select branch, number, revision, lead(revision) over (partition by branch order by number) as forward from chains""")
def forward_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cursors(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL}, e as (select branch, max(number) as last from chains group by 1 having count(*) > 1)
  select e.branch, last - 1 as steps, revision as target, last - 1 <= 1 as done from e join chains c
  on c.branch = e.branch and c.number = last - (last - 1) // 2""")
def bisect_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.bisect(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL}, h as (select * from chains where json_extract_string(props, '$.k') = '7')
  select branch, number, revision from h where number = (select max(number) from h x where x.branch = h.branch)""")
def find_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest_with(chains(spark, sf_dir), "k", "7")


@_query("""select prefix, count(*) as n, case when count(*) = 1 then min(event_id) end as revision from
  (select substr(sha256(cast(event_id as string)), 1, 4) as prefix, event_id from events) group by prefix""")
def find_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.prefixes(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL}, z as (select branch, count(*) as n from chains group by 1)
  select z.branch, c.revision as base, z.n as ahead, p.n - p.n // 2 as behind from z join z p on p.branch = z.branch - 1
  left join chains c on c.branch = p.branch and c.number = p.n // 2""")
def branch_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.branch_points(chains(spark, sf_dir))


_EDGES = """edges as (select s_suppkey as source, s_suppkey // 2 as target from supplier where s_suppkey > 1
  union select s_suppkey, s_suppkey // 3 from supplier where s_suppkey > 2)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    half = s.where("k > 1").selectExpr("k as source", "k div 2 as target")
    return half.union(s.where("k > 2").selectExpr("k as source", "k div 3 as target"))


_CLOSURE = f"""with recursive {_EDGES}, walk as (select source, target, 1 as depth from edges
  union select w.source, e.target, w.depth + 1 from walk w join edges e on e.source = w.target),
  found as (select source, target, min(depth) as depth from walk group by 1, 2)"""


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoints(spark)
    return history.closure(_edges(spark, sf_dir))


@_query(f"{_CLOSURE} select * from found")
def dep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies reachable from each node, at their least depth."""
    return _closure(spark, sf_dir)


@_query(f"{_CLOSURE} select target, count(*) as dependents, count(*) filter (depth = 1) as direct from found group by target")
def dep_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closure(spark, sf_dir).groupBy("target").agg(
        F.count(F.lit(1)).alias("dependents"), F.count(F.when(F.col("depth") == 1, 1)).alias("direct")
    )


# ---------------------------------------------------------------- content

_CHUNKS = """chunks as (select doc_id, unnest(range(0, length(text), 256)) as pos, text from documents),
  parts as (select doc_id, pos // 256 as seq, pos as "offset", length(substr(text, pos + 1, 256)) as n,
  sha256(substr(text, pos + 1, 256)) as hash from chunks)"""


@_query("select doc_id, sha256(text) as hash, cast(strlen(text) as bigint) as size from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


@_query(f"with {_CHUNKS} select * from parts")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.chunks(table(spark, sf_dir, "documents"))


@_query(f"""with {_CHUNKS} select count(*) as chunks, count(distinct hash) as distinct_chunks, cast(sum(n) as bigint) as chars,
  cast((select sum(n) from (select max(n) as n from parts group by hash)) as bigint) as stored_chars from parts""")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.dedup_stats(content.chunks(table(spark, sf_dir, "documents")))


@_query(f"with {_CHUNKS} select doc_id, count(*) as fragments, cast(sum(n) as bigint) as size from parts group by doc_id having count(*) > 1")
def fragment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need a list: content in one chunk has none."""
    parts = content.chunks(table(spark, sf_dir, "documents"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fragments"), F.sum("n").alias("size")).where("fragments > 1")


@_query(f"""with {_CHUNKS}, old as (select distinct p.hash from parts p join labels l on p.doc_id = l.doc_id)
  select hash, count(*) as n from parts where hash not in (select hash from old) group by hash""")
def missing_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a store holding the labelled documents lacks."""
    docs = table(spark, sf_dir, "documents")
    held = content.chunks(docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")).select("hash")
    return content.chunks(docs).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).join(held, "hash", "left_anti")


@_query("""with k as (select doc_id, lang, source, sha256(coalesce(text, '')) as h from documents)
  select doc_id, case when exists (select 1 from k b where b.h = a.h and b.lang is not distinct from a.lang and b.source = a.source and b.doc_id < a.doc_id) then 'full'
  when exists (select 1 from k b where b.h = a.h and b.lang = a.lang and b.doc_id < a.doc_id) then 'partition'
  when exists (select 1 from k b where b.h = a.h and b.doc_id < a.doc_id) then 'hash' else 'none' end as level from k a""")
def match_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.match_level(table(spark, sf_dir, "documents"))


@_query("select doc_id, n_chars = length(text) as ok from documents")
def verify_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") == F.length("text")).alias("ok"))


@_query(r"""select doc_id, cast(len(string_split(text, chr(10))) as bigint) as n_lines,
  cast(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '<<<<<<< ') or starts_with(x, '>>>>>>> ') or starts_with(x, '||||||| '))) as bigint) as n_markers,
  contains(text, chr(0)) as is_binary,
  sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g')) as normal_hash from documents""")
def text_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.inspect(table(spark, sf_dir, "documents"))


@_query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
  c as (select doc_id, line, count(*) as n from l group by 1, 2),
  j as (select coalesce(a.doc_id, b.doc_id + 1) as doc_id, coalesce(a.n, 0) - coalesce(b.n, 0) as d
    from c a full join c b on a.doc_id = b.doc_id + 1 and a.line = b.line)
  select doc_id, cast(sum(greatest(d, 0)) as bigint) as added, cast(sum(greatest(-d, 0)) as bigint) as dropped from j
  where doc_id in (select doc_id from documents) group by doc_id""")
def line_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.line_changes(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- catalogue and maintenance

_STORE = "store as (select doc_id % 16 as bucket, doc_id as key, n_chars as size, (doc_id * 7919) % 1000 as last_access from documents)"
_EVICT = f"""{_STORE}, r as (select *, rank() over (partition by bucket order by last_access) as k, count(*) over (partition by bucket) * 20 // 100 as quota from store),
  gone as (select bucket, key, size, last_access from r where k <= quota)"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id % 16 as bucket", "doc_id as key", "n_chars as size", "(doc_id * 7919) % 1000 as last_access"
    )


@_query(f"with {_EVICT} select * from gone")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.evict(_store(spark, sf_dir))


@_query(f"""with {_EVICT}, t as (select bucket, sum(size) as total, sum(size) filter (key not in (select key from gone)) as live from store group by 1)
  select bucket, cast(total as bigint) as total, cast(coalesce(live, 0) as bigint) as live, coalesce(live, 0) < total * 0.8 as repack from t""")
def compact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return content.compaction(store, content.evict(store))


@_query("""select props as resource, user_id as owner, event_type = 'signup' as locked, ts as since from (select *,
  row_number() over (partition by props order by ts desc, event_id desc) as k from events where event_type in ('signup', 'error')) where k = 1""")
def lock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.lock_state(table(spark, sf_dir, "events"), "signup", "error")


@_query("""select user_id as owner, count(*) as locks from (select *,
  row_number() over (partition by props order by ts desc, event_id desc) as k from events where event_type in ('signup', 'error'))
  where k = 1 and event_type = 'signup' group by 1""")
def lock_query_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lock_status(spark, sf_dir).where("locked").groupBy("owner").agg(F.count(F.lit(1)).alias("locks"))


@_query("""select json_extract_string(props, '$.k') as value, regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$') as is_number,
  count(*) as n from events group by 1, 2""")
def metadata_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy(value.alias("value"), value.rlike("^[0-9]+$").alias("is_number")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- events


@_query("select event_type, count(*) as n, count(distinct user_id) as users from events group by 1")
def notification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@_query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notifications.tumbling(table(spark, sf_dir, "events"))


@_query("""with g as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as new from events
  window w as (partition by user_id order by ts, event_id)),
  s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
  select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notifications.sessions(table(spark, sf_dir, "events"))
