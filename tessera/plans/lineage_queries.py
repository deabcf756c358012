"""Queries over branches, merges, links, layers, locks, metadata and paths, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import chunking, lineage, trees
from tessera.sources.versioned import CHAINS_SQL, chains, document_tree, table

from .queries import _CLOSURE, _EDGES, _TREE, _closure, _diff_sql, _edges, _query, lock_status, tree_diff

_SELF = "select cast(s_suppkey as bigint) as k from supplier"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))


@_query(f"""{_CLOSURE}, reach as (select source, target from found union all select k, k from ({_SELF}))
  select t.k as mine, t.k - 1 as theirs, max(x.target) as base from ({_SELF}) t
  left join (select a.source, a.target from reach a join reach b on b.source = a.source - 1 and b.target = a.target) x on x.source = t.k
  where t.k > 1 group by t.k""")
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision against the one numbered one less, through both parents."""
    nodes = _nodes(spark, sf_dir)
    reach = _closure(spark, sf_dir).select("source", "target").unionByName(nodes.select(F.col("k").alias("source"), F.col("k").alias("target")))
    return lineage.merge_base(reach, nodes.where("k > 1").selectExpr("k as mine", "k - 1 as theirs"))


@_query(f"""{_CLOSURE}, added as (select k % 7 + 1 as source, k as target from ({_SELF}))
  select a.source, a.target, a.source = a.target or f.source is not null as cycle from added a
  left join found f on f.source = a.target and f.target = a.source""")
def dep_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.closes_cycle(_closure(spark, sf_dir), _nodes(spark, sf_dir).selectExpr("k % 7 + 1 as source", "k as target"))


_TAGGED = f"""with {_EDGES}, t as (select source, target, unnest(['a', 'b']) as tag from edges
  union select source, target, unnest(['b', 'c']) from edges where source % 2 = 0)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).distinct()
    tags = lambda *names: F.array(*[F.lit(x) for x in names])
    return lineage.add_dependencies(edges.withColumn("tags", tags("a", "b")), edges.where("source % 2 = 0").withColumn("tags", tags("b", "c")))


@_query(f"{_TAGGED} select source, target, string_agg(tag, ',' order by tag) as tags from t group by 1, 2")
def dep_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).withColumn("tags", F.array_join("tags", ","))


@_query(f"""{_TAGGED} select source, target, string_agg(tag, ',' order by tag) as tags from t
  where not (source % 3 = 0 and tag in ('a', 'b')) group by 1, 2""")
def dep_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _tagged(spark, sf_dir)
    gone = edges.where("source % 3 = 0").select("source", "target", F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return lineage.drop_tags(edges, gone).withColumn("tags", F.array_join("tags", ","))


@_query(f"with {CHAINS_SQL} select branch, kind, revision, lag(revision) over (partition by branch, kind order by number) as previous from chains")
def weave_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.weave(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL} select branch, kind, number, revision from chains c
  where number = (select max(number) from chains d where d.branch = c.branch and d.kind = c.kind)""")
def last_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.last_modified(chains(spark, sf_dir))


@_query(f"""with {CHAINS_SQL}, m as (select branch as pair, props as value, number, revision from chains),
  l as (select branch + 1 as pair, props as value, number, revision from chains),
  best as (select m.pair, max(m.number) as number from m join l on l.pair = m.pair and l.value = m.value group by 1)
  select m.pair, m.value, m.revision as main, (select max_by(l.revision, l.number) from l where l.pair = m.pair and l.value = m.value) as layer
  from m join best on best.pair = m.pair and best.number = m.number""")
def layer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch against the branch one below, matched on equal metadata."""
    rows = chains(spark, sf_dir).select(F.col("branch").alias("pair"), "revision", "number", F.col("props").alias("value"))
    return lineage.nearest_match(rows, rows.withColumn("pair", F.col("pair") + 1))


_STACKS = """stacks as (select c_custkey as branch, i as pos, c_custkey // cast(power(2, i) as bigint) as member
  from customer, range(0, 40) r(i) where c_custkey // cast(power(2, i) as bigint) > 0)"""


@_query(f"""with {_STACKS}, met as (select a.branch as mine, b.branch as theirs, a.member as shared, a.pos from stacks a
  join stacks b on b.branch = a.branch - 1 and b.member = a.member)
  select mine, theirs, shared, pos from met x where pos = (select min(pos) from met y where y.mine = x.mine)""")
def shared_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch and the one below it; a branch's stack is itself, half of it, a quarter, and so on."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    stacks = keys.select(F.col("k").alias("branch"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("pos"))
    stacks = stacks.withColumn("member", F.expr("shiftright(branch, cast(pos as int))")).where("member > 0")
    return lineage.shared_branch(stacks, keys.selectExpr("k as mine", "k - 1 as theirs"))


_PINS = "p_size", "p_size + case when p_partkey % 3 = 0 then 1 else 0 end", "p_size + case when p_partkey % 4 = 0 then 1 + p_partkey % 8 // 4 else 0 end"


@_query(f"""with p as (select p_partkey as mount, {_PINS[0]} as base, {_PINS[1]} as here, {_PINS[2]} as incoming from part)
  select mount, incoming, case when here = base then 'incoming' when incoming = base then 'current' when here = incoming then 'same' else 'conflict' end as moved_by
  from p where here <> base or incoming <> base""")
def link_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [table(spark, sf_dir, "part").selectExpr("p_partkey as mount", f"{x.replace('//', 'div')} as pin") for x in _PINS]
    return lineage.link_pins(*sides)


@_query("""select key, case when d > 0 then 'added' else 'dropped' end as change, abs(d) as n from (
  select user_id as key, count(*) filter (event_type = 'purchase') - count(*) filter (event_type = 'click') as d from events group by 1) where d <> 0""")
def set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type")
    return lineage.set_changes(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"))


@_query("""with held as (select props as resource, user_id as holder from (select *,
  row_number() over (partition by props order by ts desc, event_id desc) as k from events where event_type in ('signup', 'error')) where k = 1 and event_type = 'signup'),
  wanted as (select distinct user_id as owner, props as resource from events where event_type = 'click')
  select owner, count(*) as wanted, count(*) filter (holder = owner) as held, count(*) filter (holder <> owner) = 0 as granted
  from wanted left join held using (resource) group by owner""")
def lock_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("props").alias("resource"), F.col("user_id").alias("owner"))
    return lineage.acquire(lock_status(spark, sf_dir).where("locked"), wanted)


@_query("""select c_custkey as owner, 'segment' as key, case when c_custkey % 3 = 0 then 'new' else c_mktsegment end as value from customer
  where c_custkey % 5 <> 0 or c_custkey % 3 = 0 union all select c_custkey, 'note', 'new' from customer where c_custkey % 4 = 0""")
def metadata_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third value is replaced, every other fifth removed, every fourth owner gets a second key."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as owner", "'segment' as key", "c_mktsegment as value")
    changed = rows.where("owner % 3 = 0 or owner % 5 = 0").selectExpr("owner", "key", "if(owner % 3 = 0, 'new', null) as value")
    more = rows.where("owner % 4 = 0").selectExpr("owner", "'note' as key", "'new' as value")
    return lineage.put_metadata(rows, changed.unionByName(more))


@_query(f"""with {_TREE} select dir, count(*) as files, count(distinct d2) as dirs from (select d1 as dir, d2 from tree) group by dir""")
def subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    rows = document_tree(spark, sf_dir).groupBy(values.root(path).alias("dir"), values.parent(path).alias("d2")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("dir").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("dirs"))


@_query(f"""with {_TREE}, mounts as (select distinct d1 as mount from tree where d1 <> 'fr' union select d2 from tree where d1 = 'en')
  select path, coalesce((select mount from mounts where mount = d2), (select mount from mounts where mount = d1)) as mount from tree""")
def stage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path and the longest mount it lies under: an equal join on the directories above it."""
    tree = document_tree(spark, sf_dir).select("path")
    above = tree.select("path", F.explode(trees.ancestors(F.col("path"))).alias("mount"))
    dirs = above.select("mount").distinct()
    mounts = dirs.where("instr(mount, '/') = 0 and mount <> 'fr' or mount like 'en/%'")
    best = above.join(mounts, "mount").groupBy("path").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    return tree.join(best, "path", "left")


@_query(f"""with {_TREE} select path, d2 as parent, string_split(path, '/')[-1] as name, d1 as root,
  case when d1 = 'en' then 'moved/english' || substr(path, 3) else path end as moved, d1 = 'de' as below from tree""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return document_tree(spark, sf_dir).select(
        "path", values.parent(p).alias("parent"), values.name(p).alias("name"), values.root(p).alias("root"), values.moved(p, "en", "moved/english").alias("moved"), values.below(p, "de").alias("below")
    )


@_query(r"select page_id, regexp_replace(regexp_replace(url, '/+$', ''), '^.*?://', '') as address from pages")
def url_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", values.remote_url(F.col("url")).alias("address"))


@_query(r"select doc_id, sha256(regexp_replace(text, '[ \t\r]+', ' ', 'g')) as blank_hash, (n_chars + 63) // 64 * 64 as size_bucket from documents")
def blank_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(values.collapse_blanks(F.col("text")), 256).alias("blank_hash"), values.bucket(F.col("n_chars"), 64).alias("size_bucket"))


@_query(f"""with {_diff_sql('s', 'base', 'source')} select case action when 'Add' then 'A' when 'Delete' then 'D' when 'Move' then 'V' else 'M' end as letter,
  count(*) as n from s group by 1""")
def action_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_diff(spark, sf_dir).groupBy(values.action_letter(F.col("action")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@_query()
def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks of all documents; a rolling hash has no SQL form, tests hold it against a plain loop."""
    return chunking.content_chunks(table(spark, sf_dir, "documents"))
