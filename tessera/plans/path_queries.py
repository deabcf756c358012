"""Queries over paths, hashes and file information, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import paths, specifiers, trees
from tessera.sources.versioned import document_tree, ensure_checkpoints, snapshot, snapshot_sql, table

from .ancestry_queries import _LINE, _REV, revisions
from .queries import _TREE, _diff_sql, _query

_COVERS = lambda a, b: f"({a} = '' or {a} = {b} or starts_with({b}, {a} || '/'))"


@_query(f"""with p as (select c_custkey as k, 'd' || c_custkey % 4 || case when c_custkey % 3 = 0 then '/x' else '' end as a, case when c_custkey % 11 = 0 then '' else 'd' || c_custkey % 5 || '/x/y' end as b from customer)
  select k, {_COVERS('a', 'b')} as covers, {_COVERS('a', 'b')} or {_COVERS('b', 'a')} as overlaps, case when a = '' then b when b = '' then a else a || '/' || b end as joined from p""")
def path_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as k", "concat('d', c_custkey % 4, if(c_custkey % 3 = 0, '/x', '')) as a", "if(c_custkey % 11 = 0, '', concat('d', c_custkey % 5, '/x/y')) as b"
    )
    a, b = F.col("a"), F.col("b")
    return p.select("k", values.covers(a, b).alias("covers"), values.overlaps(a, b).alias("overlaps"), values.join_path(a, b).alias("joined"))


@_query(f"""with {_TREE}, p as (select distinct case when context % 7 = 0 then d2 when context % 501 = 0 then d1 else path end as path from tree where context % 2 = 0)
  select path from p where not exists (select 1 from p q where starts_with(p.path, q.path || '/'))""")
def covering_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = document_tree(spark, sf_dir).where("context % 2 = 0")
    mixed = F.when(F.col("context") % 7 == 0, values.parent(F.col("path"))).when(F.col("context") % 501 == 0, values.root(F.col("path"))).otherwise(F.col("path"))
    return paths.covering_set(tree.select(mixed.alias("path")))


@_query(f"""with {_TREE}, p as (select path || case when context % 3 = 0 then '.c' when context % 3 = 1 then '/c' else '' end as path from tree)
  select path, row_number() over (order by string_split(path, '/')) - 1 as place from p""")
def subtree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoints(spark)
    ended = F.concat("path", F.when(F.col("context") % 3 == 0, ".c").when(F.col("context") % 3 == 1, "/c").otherwise(""))
    return paths.in_subtree_order(document_tree(spark, sf_dir).select(ended.alias("path")))


@_query(f"""with {_TREE} select context as k, case context % 6 when 0 then path when 1 then d1 || '/' || context when 2 then '../' || d1 when 3 then '/' || d1 when 4 then d2 else '../../' || context end as path from tree""")
def clean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = document_tree(spark, sf_dir)
    d1, d2, k = values.root(F.col("path")), values.parent(F.col("path")), F.col("context").cast("string")
    raw = (
        F.when(F.col("context") % 6 == 0, F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("//"))))
        .when(F.col("context") % 6 == 1, F.concat(d2, F.lit("\\..\\"), k))
        .when(F.col("context") % 6 == 2, F.concat(F.lit("../"), d1, F.lit("/x/..")))
        .when(F.col("context") % 6 == 3, F.concat(F.lit("/../"), d1))
        .when(F.col("context") % 6 == 4, F.concat(d2, F.lit("/.")))
        .otherwise(F.concat(F.lit("../a/../../"), k))
    )
    return tree.select(F.col("context").alias("k"), values.clean_path(raw).alias("path"))


@_query(f"""with {_diff_sql("s", "base", "source", False)}, {_diff_sql("t", "base", "target", False)}, u as (select action, path, from_path, context, base_hash, hash from s where path not in (select path from t) union all select action, path, from_path, context, base_hash, hash from t),
  pairs as (select a.context, a.path, d.path as from_path, d.base_hash, a.hash from u a join u d on a.context = d.context and a.action = 'Add' and d.action = 'Delete')
  select 'Move' as action, path, from_path, context, base_hash, hash from pairs union all select * from u where action = 'Keep' or context not in (select context from pairs)""")
def union_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged changes with scanned ones over them."""
    change = lambda side: trees.diff(snapshot(spark, sf_dir, "base"), snapshot(spark, sf_dir, side), moves=False)
    return paths.union_changes(change("source"), change("target"))


@_query(f"""with {_TREE}, l as (select path, size + 1 as size, hash from tree where context % 3 = 0), a as (select case when context % 4 = 0 then path || '?' else path end as path from tree where context % 2 = 0)
  select a.path, t.size, t.hash, l.size as local_size, l.hash as local_hash from a left join tree t on t.path = a.path left join l on l.path = a.path""")
def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = document_tree(spark, sf_dir)
    asked = tree.where("context % 2 = 0").selectExpr("if(context % 4 = 0, concat(path, '?'), path) as path")
    return paths.file_info(tree, asked, tree.where("context % 3 = 0").selectExpr("path", "size + 1 as size", "hash"))


@_query(f"with {_TREE} select path, context, hash, size from tree where d1 = 'en' or context in (select context // 2 from tree where d1 = 'en' and context % 5 = 0)")
def clone_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English files, and for every fifth of them the one of half its number."""
    tree = document_tree(spark, sf_dir)
    view = tree.where("path like 'en/%'")
    needed = tree.join(view.where("context % 5 = 0").selectExpr("context div 2 as context").distinct(), "context", "left_semi")
    return paths.clone_set(tree, view, needed)


@_query("""with t as (select user_id as path, event_id as number, event_type <> 'error' as exists_ from events), a as (select path, number from t where not exists_)
  select a.path, a.number, (select max(t.number) from t where t.path = a.path and t.number < a.number and t.number >= a.number - 1000 and t.exists_) as last from a""")
def deleted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "events").selectExpr("user_id as path", "event_id as number", "event_type <> 'error' as exists")
    return paths.deleted_in(touched, touched.where("not exists").select("path", "number"), 1000)


@_query("""select p_partkey as k, sha256('s|find|' || length(p_name) || ':' || p_name || '|' || length(p_brand) || ':' || p_brand) as key from part""")
def function_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), values.function_key("s", "find", F.col("p_name"), F.col("p_brand")).alias("key"))


@_query("select min(p_partkey) as k, count(*) as n from part group by lower(p_name)")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are equal without case have one key."""
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(values.name_key(mixed).alias("key")).agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("n")).drop("key")


_SPECS = ("2@150", "@LATEST", "1@LATEST~2", "0@147~3", "@99999")


@_query(f"""{_LINE}, h as (select *, sha256(cast(revision as varchar)) as hash from rev), one as (select '2@150' as spec, revision from h where branch = 2 and number = 150
  union all (select '@LATEST', revision from h where branch = 0 order by number desc limit 1)
  union all select '1@LATEST~2', l.revision from line l where depth = 2 and tip = (select max(revision) from h where branch = 1)
  union all select '0@147~3', l.revision from line l where depth = 3 and tip = 147)
  select one.spec, one.revision, h.hash from one join h on h.revision = one.revision""")
def revision_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = revisions(spark, sf_dir).withColumn("hash", F.sha2(F.col("revision").cast("string"), 256))
    out = None
    for spec in _SPECS:
        found = specifiers.resolve(rev, spec, 0).select(F.lit(spec).alias("spec"), "revision", "hash")
        out = found if out is None else out.unionByName(found)
    return out


@_query(f"""with {_REV}, h as (select *, sha256(cast(revision as varchar)) as hash from rev), p as (select distinct substr(hash, 1, 2) as prefix from h)
  select p.prefix, (select h.revision from h where starts_with(h.hash, p.prefix) order by h.branch <> 1, h.number desc limit 1) as revision from p""")
def prefix_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision that each prefix of two digits names on branch 1, else elsewhere."""
    rev = revisions(spark, sf_dir).withColumn("hash", F.sha2(F.col("revision").cast("string"), 256))
    best = F.max_by("revision", F.struct((F.col("branch") == 1).alias("own"), "number"))
    return rev.groupBy(F.substring("hash", 1, 2).alias("prefix")).agg(best.alias("revision"))
