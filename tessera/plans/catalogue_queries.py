"""Queries over keys and values, branches, locks, links, metadata, instances and node flags, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import flags, values
from tessera.operators import catalogue
from tessera.sources.versioned import document_tree, ensure_checkpoints, table

from .queries import _TREE, _query

# A key a user; each event writes a version, an error deletes.
_KV = """kv as (select user_id as key, event_type as key_type, event_id as version, case when event_type = 'error' then null else props end as value from events),
  live as (select key, max(version) as version from kv group by 1), now as (select l.key, l.version, k.value from live l join kv k on k.key = l.key and k.version = l.version where k.value is not null)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as version", "case when event_type = 'error' then null else props end as value")


@_query(f"with {_KV} select * from now")
def kv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.latest_values(_log(spark, sf_dir), "key")


@_query(f"with {_KV}, a as (select cast(c_custkey as bigint) as key from customer) select a.key, n.version, n.value from a left join now n on n.key = a.key")
def kv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as key")
    return catalogue.load(_log(spark, sf_dir), asked, "key")


_CAS = f"""{_KV}, r as (select c_custkey % 400 as key, c_custkey as seq, case when c_custkey % 3 = 0 then (select value from now where now.key = c_custkey % 400) else 'x' end as expected,
  case when c_custkey % 7 = 0 then null else 'new' || c_custkey end as value from customer), f as (select key, min(seq) as first from r group by 1),
  ans as (select r.key, r.seq, n.value as previous, r.seq = f.first and (n.value is null or coalesce(n.value = r.expected, false)) as swapped, r.value from r join f on f.key = r.key left join now n on n.key = r.key)"""


def _cas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    state = kv_list(spark, sf_dir).select("key", "value")
    asked = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey % 400 as bigint) as key", "c_custkey as seq", "case when c_custkey % 7 = 0 then null else concat('new', c_custkey) end as value")
    held = state.select("key", F.col("value").alias("held"))
    requests = asked.join(held, "key", "left").withColumn("expected", F.when(F.col("seq") % 3 == 0, F.col("held")).otherwise(F.lit("x"))).drop("held")
    return catalogue.compare_and_swap(state, requests, "key")


@_query(f"with {_CAS} select key, seq, previous, swapped from ans")
def compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cas(spark, sf_dir)[1]


@_query(f"""with {_CAS} select key, value from now where key not in (select key from ans where swapped)
  union all select key, value from ans where swapped and value is not null""")
def swapped_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cas(spark, sf_dir)[0]


@_query("""select c_custkey as key, case when c_custkey % 2 = 0 then 'put' else c_name end as value from customer where c_custkey % 6 <> 0
  union all select -c_custkey, 'put' from customer where c_custkey % 2 = 0 and c_custkey % 6 <> 0""")
def put_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links or layers: rows added and moved, then some removed."""
    state = table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as value")
    moved = state.where("key % 2 = 0").selectExpr("key", "'put' as value")
    after = catalogue.put(catalogue.put(state, moved, "key"), moved.selectExpr("-key as key", "value"), "key")
    return catalogue.drop(after, after.where("key % 6 = 0"), "key")


# Branches: one a customer, named by its nation and number; every fourth is protected, every fifth was deleted.
_BRANCHES = """br as (select cast(c_custkey as bigint) as branch, 'b' || c_custkey % 70 || '-' || c_nationkey as name, c_mktsegment as creator, c_custkey * 3 as latest,
  c_custkey % 4 = 0 as protected, c_custkey % 5 = 0 as deleted from customer)"""


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as bigint) as branch", "concat('b', c_custkey % 70, '-', c_nationkey) as name", "c_mktsegment as creator", "c_custkey * 3 as latest", "c_custkey % 4 = 0 as protected", "c_custkey % 5 = 0 as deleted"
    )


_FRESH = """fresh as (select c_custkey + 1000000 as branch, case when c_custkey % 9 = 0 then '' when c_custkey % 9 = 1 then lpad(c_custkey::varchar, 32, 'a') when c_custkey % 9 = 2 then repeat('0', 32)
  else 'b' || c_custkey % 80 || '-' || c_nationkey end as name, c_mktsegment as creator, c_custkey as latest from customer)"""
_VALID = "strlen(name) between 1 and 1000 and not (regexp_matches(name, '^[0-9a-fA-F]{32}$') and not regexp_matches(name, '^0{32}$'))"


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey + 1000000 as bigint) as branch",
        "case when c_custkey % 9 = 0 then '' when c_custkey % 9 = 1 then lpad(c_custkey, 32, 'a') when c_custkey % 9 = 2 then repeat('0', 32) else concat('b', c_custkey % 80, '-', c_nationkey) end as name",
        "c_mktsegment as creator", "c_custkey as latest",
    )


@_query(f"with {_FRESH} select branch, {_VALID} as valid from fresh")
def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select("branch", catalogue.valid_name(F.col("name")).alias("valid"))


@_query(f"""with {_BRANCHES}, {_FRESH}, ok as (select *, row_number() over (partition by name order by branch) as k from fresh where {_VALID} and name not in (select name from br where not deleted))
  select * from br union all select branch, name, creator, latest, false, false from ok where k = 1""")
def branch_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.create_branches(_branches(spark, sf_dir), _fresh(spark, sf_dir))


@_query(f"""with {_BRANCHES}, a as (select c_custkey * 2 as branch from customer)
  select a.branch, case when b.branch is null or b.deleted then 'missing' when a.branch % 14 = 0 then 'current' when b.protected then 'protected' when a.branch = 6 then 'default' else 'archived' end as outcome
  from a left join br b on b.branch = a.branch""")
def branch_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _branches(spark, sf_dir)
    asked = b.select((F.col("branch") * 2).alias("branch"))
    return catalogue.archive_branches(b, asked, asked.where("branch % 14 = 0"), 6)


@_query(f"""with {_BRANCHES} select branch, name, creator, latest, case when branch % 3 = 0 and not deleted then true when branch % 7 = 0 and not deleted then false else protected end as protected, deleted from br""")
def branch_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh loses its protection, then every third gets it."""
    b = _branches(spark, sf_dir)
    return catalogue.set_protection(catalogue.set_protection(b, b.where("branch % 7 = 0"), False), b.where("branch % 3 = 0"), True)


@_query(f"""with {_BRANCHES}, a as (select branch, branch * 3 - branch % 5 as revision from br), o as (select a.*, case when branch % 11 = 0 then 'staged' when branch % 5 <= 2 or branch % 5 = 4 then 'moved' else 'not on branch' end as outcome from a)
  select o.branch, case when outcome = 'moved' then o.revision else br.latest end as latest, outcome from o join br on br.branch = o.branch""")
def branch_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch has its three newest revisions, and one four below its tip as its branch point."""
    b = _branches(spark, sf_dir)
    line = b.select("branch", F.explode(F.sequence(F.col("latest") - 2, F.col("latest"))).alias("revision"))
    asked = b.selectExpr("branch", "branch * 3 - branch % 5 as revision")
    return catalogue.reset_branches(b, asked, line, b.selectExpr("branch", "latest - 4 as revision"), b.where("branch % 11 = 0"))


@_query(f"""with {_BRANCHES}, a as (select c_custkey as pos, case when c_custkey % 2 = 0 then cast(c_custkey + 5 as bigint) end as id, 'b' || c_custkey % 70 || '-' || c_nationkey as name from customer)
  select a.pos, b.branch as found from a left join br b on b.branch = a.id where a.id is not null
  union all select a.pos, b.branch from a left join br b on b.name = a.name and not b.deleted where a.id is null""")
def branch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as pos", "case when c_custkey % 2 = 0 then cast(c_custkey + 5 as bigint) end as id", "concat('b', c_custkey % 70, '-', c_nationkey) as name"
    )
    return catalogue.get_branches(_branches(spark, sf_dir), asked)


@_query(f"""with {_BRANCHES} select branch, name, creator, deleted from br where creator = 'BUILDING'""")
def branch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and deleted branches of one creator."""
    b = _branches(spark, sf_dir)
    return catalogue.list_branches(b, b.where("deleted or branch % 3 = 0"), "BUILDING", deleted=True)


@_query(f"""with {_BRANCHES}, l as (select branch, name, latest, branch % 5 as created from br where branch % 3 <> 0), r as (select branch, name || '!' as name, latest + 1 as latest, branch % 4 as created from br where branch % 7 <> 0)
  select coalesce(l.branch, r.branch) as branch, case when coalesce(r.created > l.created, l.branch is null) then r.name else l.name end as name, l.latest as local, r.latest as remote from l full join r on l.branch = r.branch""")
def branch_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _branches(spark, sf_dir)
    local = b.where("branch % 3 <> 0").selectExpr("branch", "name", "latest", "branch % 5 as created")
    return catalogue.branch_info(local, b.where("branch % 7 <> 0").selectExpr("branch", "concat(name, '!') as name", "latest + 1 as latest", "branch % 4 as created"))


# Locks: one a part, over 4 repositories, 3 branches and 9 owners.
_LOCKS = "locks as (select 'h' || p_partkey % 60 as hash, 'r' || p_partkey % 4 as repository, 'b' || p_partkey % 3 as branch, 'o' || p_size % 9 as owner, p_brand || '/' || p_partkey as path from part)"
_ASK = {"hash": "h7", "repository": "r3", "branch": "b1", "owner": "o4"}


@_query(f"""with {_LOCKS}, one as (select path as p from locks where repository = 'r3' and branch = 'b1' order by path limit 1)
  {" union all ".join(f"select '{shape}' as shape, path, owner from locks where " + " and ".join(f"{part} = '{_ASK[part]}'" if part in _ASK else f"{part} = (select p from one)" for part in parts) for shape, parts in catalogue.LOCK_SHAPES.items())}""")
def lock_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine shapes of query."""
    locks = table(spark, sf_dir, "part").selectExpr(
        "concat('h', p_partkey % 60) as hash", "concat('r', p_partkey % 4) as repository", "concat('b', p_partkey % 3) as branch", "concat('o', p_size % 9) as owner", "concat(p_brand, '/', p_partkey) as path"
    )
    path = locks.where("repository = 'r3' and branch = 'b1'").agg(F.min("path")).first()[0]
    out = None
    for shape in catalogue.LOCK_SHAPES:
        found = catalogue.query_locks(locks, shape, **_ASK, path=path).select(F.lit(shape).alias("shape"), "path", "owner")
        out = found if out is None else out.unionByName(found)
    return out


@_query("""with l as (select p_partkey as resource, p_size % 9 as owner from part where p_partkey % 3 <> 0)
  select p_partkey as resource, p_partkey % 9 as owner, case when l.owner is null then 'not found' when l.owner <> p_partkey % 9 then 'not owned' else 'released' end as outcome from part left join l on l.resource = p_partkey""")
def lock_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return catalogue.release(part.where("p_partkey % 3 <> 0").selectExpr("p_partkey as resource", "p_size % 9 as owner"), part.selectExpr("p_partkey as resource", "p_partkey % 9 as owner"))


@_query("""select p_partkey as mount, p_size as old_signature, p_size + case when p_partkey % 3 = 0 then 1 else 0 end as signature, p_brand as old_branch, case when p_partkey % 5 = 0 then 'x' else p_brand end as branch
  from part where p_partkey % 2 = 0 and (p_partkey % 3 = 0 or p_partkey % 5 = 0)""")
def link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.selectExpr("p_partkey as mount", "p_size as signature", "p_brand as branch")
    return catalogue.link_changes(old, part.where("p_partkey % 2 = 0").selectExpr("p_partkey as mount", "p_size + if(p_partkey % 3 = 0, 1, 0) as signature", "if(p_partkey % 5 = 0, 'x', p_brand) as branch"))


@_query(f"""with {_TREE} select 0 as repository, path, case d1 when 'en' then 3 when 'de' then 2 when 'fr' then null else 0 end as at,
  case d1 when 'en' then 'deep/x' || substr(path, 3) when 'de' then 'top' || substr(path, 3) when 'fr' then substr(path, 4) else path end as rest, case d1 when 'en' then 2 when 'de' then 1 when 'fr' then 9 else 0 end as hops from tree""")
def link_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through a link, through two of them, and into a link that leads back to itself."""
    ensure_checkpoints(spark)
    links = spark.createDataFrame([(0, "en", 1, "a"), (1, "a", 3, "deep/x"), (0, "de", 2, "top"), (0, "fr", 9, ""), (9, "src0", 9, "src0")], "repository int, mount string, target int, source string")
    chain = [(0, "fr", 10, "f"), *((9 + i, "f", 10 + i, "f") for i in range(1, 8)), (17, "f", 18, "")]
    links = links.where("mount not in ('fr', 'src0')").unionByName(spark.createDataFrame(chain, links.schema))
    return catalogue.through_links(document_tree(spark, sf_dir).select(F.lit(0).alias("repository"), "path"), links)


@_query("""with i as (select c_custkey as instance, c_nationkey as branch from customer), b as (select branch, count(*) as n from i group by 1)
  select i.instance, i.branch, b.n - 1 as others, (select min(x.instance) from i x where x.branch = i.branch and x.instance <> i.instance) as other from i join b on b.branch = i.branch""")
def instances_on_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.same_branch(table(spark, sf_dir, "customer").selectExpr("c_custkey as instance", "c_nationkey as branch"))


# Metadata of orders: three keys each, stored in an order of their own.
_META = "meta as (select o_orderkey as owner, 'priority' as key, o_orderkey % 3 as pos, o_orderpriority as value from orders union all select o_orderkey, 'status', (o_orderkey + 1) % 3, o_orderstatus from orders union all select o_orderkey, 'customer', (o_orderkey + 2) % 3, cast(o_custkey as string) from orders)"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (
        o.selectExpr("o_orderkey as owner", "'priority' as key", "o_orderkey % 3 as pos", "o_orderpriority as value")
        .unionByName(o.selectExpr("o_orderkey as owner", "'status' as key", "(o_orderkey + 1) % 3 as pos", "o_orderstatus as value"))
        .unionByName(o.selectExpr("o_orderkey as owner", "'customer' as key", "(o_orderkey + 2) % 3 as pos", "cast(o_custkey as string) as value"))
    )


@_query(f"with {_META} select o_orderkey as owner, k.key, m.value from orders, (values ('status'), ('none')) k(key) left join meta m on m.owner = o_orderkey and m.key = k.key")
def metadata_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.array(F.lit("status"), F.lit("none")))
    return catalogue.get_metadata(_meta(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), keys.alias("key")))


@_query(f"with {_META} select owner, cast(row_number() over (partition by owner order by pos) - 1 as bigint) as place, key, value from meta where owner % 4 <> 0")
def metadata_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In stored order, after every fourth owner's was cleared."""
    rows = _meta(spark, sf_dir)
    return catalogue.list_metadata(catalogue.clear_metadata(rows, rows.where("owner % 4 = 0").select("owner").distinct()))


@_query("""with r as (select o_orderkey % 50 as revision, o_orderkey as path, 'k' as key, o_orderpriority as value from orders)
  select case when path % 2 = 0 then revision else revision + 50 end as revision, path, 'k' as key, value from r""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the paths are asked for in a later revision that has deleted them."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 50 as revision", "o_orderkey as path", "'k' as key", "o_orderpriority as value")
    asked = rows.selectExpr("if(path % 2 = 0, revision, revision + 50) as revision", "path", "key")
    return catalogue.file_metadata(rows, asked, spark.range(50, 100).selectExpr("id as revision", "id - 50 as parent"))


_TEXTS = """texts as (select c_custkey as k, case c_custkey % 6 when 0 then 'numeric' when 1 then 'boolean' when 2 then 'hash' when 3 then 'context' when 4 then 'string' else 'boolean' end as kind,
  case c_custkey % 12 when 0 then c_custkey::varchar when 1 then 'Yes' when 2 then sha256(c_name) when 3 then substr(sha256(c_name), 1, 32) when 4 then c_name when 5 then 'off'
  when 6 then '18446744073709551616' when 7 then '2' when 8 then 'abc' when 9 then c_name when 10 then '' else 'TRUE' end as value from customer)"""


@_query(f"""with {_TEXTS} select k, kind, case kind when 'numeric' then case when length(value) < 12 then
    array_to_string(list_reverse(regexp_extract_all(printf('%016x', try_cast(value as bigint)), '..')), '') end
  when 'boolean' then case when lower(value) in ('true', '1', 'yes', 'on') then '01' when lower(value) in ('false', '0', 'no', 'off') then '00' end
  when 'hash' then case when length(value) = 64 then value end when 'context' then case when length(value) = 32 then value end else lower(hex(value)) end as stored from texts""")
def metadata_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as k", "element_at(array('numeric', 'boolean', 'hash', 'context', 'string', 'boolean'), cast(c_custkey % 6 + 1 as int)) as kind",
        "element_at(array(cast(c_custkey as string), 'Yes', sha2(c_name, 256), substr(sha2(c_name, 256), 1, 32), c_name, 'off', '18446744073709551616', '2', 'abc', c_name, '', 'TRUE'), cast(c_custkey % 12 + 1 as int)) as value",
    )
    return t.select("k", "kind", catalogue.decoded_value(F.col("value"), F.col("kind")).alias("stored"))


# ---------------------------------------------------------------- flags

_FLAGS = "n as (select p_partkey as node, cast(p_partkey * 7919 % 32768 as integer) as f from part)"
_HAS = lambda mask: f"(f & {mask}) = {mask}"
_ACTION = " ".join(f"when {_HAS(flags.STAGED_ACTION[a])} then '{a}'" for a in ("Delete", "Add", "Move", "Copy"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as node", "cast(p_partkey * 7919L % 32768 as int) as f")


@_query(f"""with {_FLAGS} select node, {_HAS(16)} as staged, {_HAS(8)} as dirty, (f & {8 | flags.STAGED_BITS}) <> 0 as changed,
  case when {_HAS(1)} then 'file' when {_HAS(2)} then 'link' else 'directory' end as kind, case {_ACTION} else 'Keep' end as action,
  case when {_HAS(16)} then case {_ACTION} when {_HAS(flags.STAGED_ACTION["Modify"])} then 'Modify' end end as staged_action,
  {_HAS(flags.STAGED_MERGE_CONFLICT)} and not {_HAS(flags.STAGED_MERGE_RESOLVED)} as unresolved from n""")
def node_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    return _nodes(spark, sf_dir).select(
        "node", flags.is_staged(f).alias("staged"), flags.is_dirty(f).alias("dirty"), flags.is_changed(f).alias("changed"), flags.kind(f).alias("kind"),
        flags.action(f).alias("action"), flags.staged_action(f).alias("staged_action"), flags.is_unresolved(f).alias("unresolved"),
    )


_TO_CHANGE = " | ".join(
    f"case when {_HAS(mask)} then {bits} else 0 end"
    for mask, bits in (
        (16, 128), (8, 256), (flags.STAGED_MERGE, 2), (flags.STAGED_MERGE_CONFLICT, 6), (flags.STAGED_MERGE_RESOLVED, 14), (flags.STAGED_MERGE_MINE, 38), (flags.STAGED_MERGE_THEIRS, 70),
    )
)
_UNSTAGED, _CLEAN = f"(f & ~{16 | flags.MERGE_BITS})", "(f & ~8)"


@_query(f"""with {_FLAGS} select node, (case when not ({_HAS(flags.STAGED_ACTION["Delete"])} or {_HAS(flags.STAGED_ACTION["Add"])} or {_HAS(flags.STAGED_ACTION["Move"])} or {_HAS(flags.STAGED_ACTION["Copy"])}) and node % 2 = 0 then 1 else 0 end) | {_TO_CHANGE} as change,
  case when {_HAS(8)} then {_UNSTAGED} else {_UNSTAGED} & ~{flags.ACTION_BITS} end as unstaged, case when {_HAS(16)} then {_CLEAN} else {_CLEAN} & ~{flags.ACTION_BITS} end as clean,
  case when {_HAS(flags.STAGED_MERGE_CONFLICT)} then f | {flags.STAGED_MERGE_RESOLVED | flags.STAGED_MERGE_MINE} else f end as mine,
  case when {_HAS(flags.STAGED_MERGE_CONFLICT)} then f & ~{(flags.STAGED_MERGE_RESOLVED | flags.STAGED_MERGE_MINE | flags.STAGED_MERGE_THEIRS) & ~flags.STAGED_MERGE_CONFLICT} else f end as opened from n""")
def node_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    return _nodes(spark, sf_dir).select(
        "node", flags.change_flags(f, flags.action(f), F.col("node") % 2 != 0).alias("change"), flags.clear_staged(f).alias("unstaged"), flags.clear_dirty(f).alias("clean"),
        flags.resolve(f, "mine").alias("mine"), flags.unresolve(f).alias("opened"),
    )


@_query(f"""with {_TREE}, t as (select *, cast(context * 7919 % 32768 as integer) as f from tree)
  select d2 as dir, count(*) filter ({_HAS(16)} and {_HAS(1)}) as staged_files, count(*) filter ({_HAS(8)}) as dirty from t group by 1""")
def staged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged files and dirty nodes of each directory."""
    f = F.expr("cast(context * 7919 % 32768 as int)")
    return document_tree(spark, sf_dir).groupBy(values.parent(F.col("path")).alias("dir")).agg(
        F.count(F.when(flags.is_staged(f) & (flags.kind(f) == "file"), 1)).alias("staged_files"), F.count(F.when(flags.is_dirty(f), 1)).alias("dirty")
    )


@_query(f"""with {_TREE} select path, context from tree where (cast(context * 7919 % 32768 as integer) & 8) = 8""")
def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tree(spark, sf_dir).where(flags.is_dirty(F.expr("cast(context * 7919 % 32768 as int)"))).select("path", "context")


_FRAG = """fr as (select p_partkey as k, case when p_partkey % 11 = 0 then 4194304 else cast(p_partkey % 1024 as integer) end as f, p_size * 7 % 50 as payload, case when p_partkey % 13 = 0 then 300000 when p_partkey % 3 = 0 then p_size * 7 % 50 else p_size end as content from part)"""


@_query(f"""with {_FRAG} select k, case when f & ~{flags.KNOWN_FRAGMENT_BITS} <> 0 then 'unknown bits' when f & 768 <> 0 then 'obliteration' when bit_count(f & 254) > 1 then 'several compressions'
  when f & 254 & ~14 <> 0 then 'reserved compression' when f & 254 <> 0 and f & 1 = 1 then 'compressed list' when payload = 0 then 'no payload' when payload > content then 'payload beyond content'
  when f & 254 <> 0 and content > 262144 then 'too large to compress' when f & 254 = 0 and f & 1 = 0 and payload <> content then 'sizes differ' end as fault,
  case when f & 254 = 0 then 'not_compressed' when f & 2 = 2 then 'lz4' when f & 4 = 4 then 'oodle2' when f & 8 = 8 then 'zstd' else 'unknown' end as compression,
  least(k % 4 + 1, 3) as next_level, greatest(k % 4 - 1, 0) as previous_level from fr""")
def fragment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as k", "if(p_partkey % 11 = 0, 4194304, cast(p_partkey % 1024 as int)) as f", "p_size * 7 % 50 as payload",
        "case when p_partkey % 13 = 0 then 300000 when p_partkey % 3 = 0 then p_size * 7 % 50 else p_size end as content",
    )
    level = F.col("k") % 4
    return rows.select(
        "k", flags.fragment_fault(F.col("f"), F.col("payload"), F.col("content")).alias("fault"), flags.compression(F.col("f")).alias("compression"),
        flags.next_level(level).alias("next_level"), flags.next_level(level, -1).alias("previous_level"),
    )
