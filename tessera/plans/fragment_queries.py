"""Queries over stored fragments: lists, range reads, validation, verification, copies, deletion and garbage, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import content, fragments
from tessera.sources.versioned import table

from .queries import _CHUNKS, _query

_LISTS = f"""{_CHUNKS}, sized as (select doc_id as name, "offset", hash, n as size from parts), lists as (select * from sized where name in (select name from sized group by 1 having count(*) > 1))"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.chunks(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("name"), "offset", "hash", F.col("n").alias("size"))


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct chunk with its text."""
    docs = table(spark, sf_dir, "documents")
    pieces = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?s).{1,256}"), F.lit(0))).alias("data"))
    return pieces.distinct().select(F.sha2("data", 256).alias("hash"), "data")


@_query(f"with {_LISTS} select * from lists")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.references(_parts(spark, sf_dir))


@_query(f"""with {_LISTS}, p as (select *, row_number() over (partition by name order by "offset") - 1 as place, count(*) over (partition by name) as n from lists),
  g as (select name, place // 16 as g, min("offset") as "offset", cast(sum(size) as bigint) as size, sha256(string_agg(hash, ',' order by "offset", hash)) as hash from p where n > 16 group by 1, 2)
  select 0 as level, cast(name as varchar) as name, "offset", hash, size from p where n <= 16 union all select 0, g.hash, p."offset", p.hash, p.size from p join g on g.name = p.name and g.g = p.place // 16
  union all select 1, cast(name as varchar), "offset", hash, size from g""")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of more than 16 references become lists of lists."""
    return fragments.nested(fragments.references(_parts(spark, sf_dir)).withColumn("name", F.col("name").cast("string")), 16)


_ASKED = "asked as (select doc_id as request, doc_id as name, (doc_id % 5) * 200 as low, (doc_id % 5) * 200 + doc_id % 700 as high, text from documents)"


@_query(f"with {_ASKED} select request, case when high > low then substr(text, low + 1, high - low) else '' end as data from asked")
def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each document put together from its chunks."""
    asked = table(spark, sf_dir, "documents").selectExpr("doc_id as request", "doc_id as name", "doc_id % 5 * 200 as low", "doc_id % 5 * 200 + doc_id % 700 as high")
    return fragments.read_ranges(_parts(spark, sf_dir), _data(spark, sf_dir), asked)


@_query("select doc_id as request, text as data from documents")
def read_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contents put together again."""
    asked = table(spark, sf_dir, "documents").selectExpr("doc_id as request", "doc_id as name", "0 as low", "2147483647 as high")
    return fragments.read_ranges(_parts(spark, sf_dir), _data(spark, sf_dir), asked)


@_query(f"with {_CHUNKS} select doc_id as name, seq as place, substr(text, pos + 1, 256) as data from (select doc_id, pos, pos // 256 as seq, text from chunks) x where doc_id % 3 = 0")
def read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("name"))
    return fragments.stream(_parts(spark, sf_dir), _data(spark, sf_dir), asked)


@_query(f"""with {_CHUNKS}, k as (select doc_id as key, hash as value from parts where seq = 0 and doc_id % 2 = 0)
  select d.doc_id as key, k.value as hash, case when k.value is not null then substr(d.text, 1, 256) end as data from documents d left join k on k.key = d.doc_id""")
def read_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _parts(spark, sf_dir).where("offset = 0 and name % 2 = 0").select(F.col("name").alias("key"), F.col("hash").alias("value"))
    return fragments.resolved(keys, _data(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")))


@_query("""with l as (select o_custkey as name, o_orderkey as pos, o_orderkey * (case when o_custkey % 3 = 0 then 1 else 10 end) % 5000 as "offset" from orders),
  b as (select *, lag("offset") over (partition by name order by pos) as before from l), s as (select name, count(*) as n, max(case when "offset" <= before then 1 else 0 end) as back, max_by("offset", pos) as last from b group by 1)
  select name, case when n < 2 then 'fewer than two' when back = 1 then 'not growing' when last >= c_nationkey * 200 then 'outside content' end as fault from s join customer on c_custkey = name""")
def list_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").selectExpr("o_custkey as name", "o_orderkey as pos", "o_orderkey * if(o_custkey % 3 = 0, 1, 10) % 5000 as offset")
    return fragments.list_faults(lists, table(spark, sf_dir, "customer").selectExpr("c_custkey as name", "0 as first", "c_nationkey * 200 as size"))


@_query(f"with {_CHUNKS} select distinct hash, sha256(substr(text, pos + 1, 256) || '!') as found from (select pos, text, sha256(substr(text, pos + 1, 256)) as hash from chunks) x where hash like '7%'")
def rehash_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose hash starts with 7 were damaged."""
    damaged = F.when(F.startswith("hash", F.lit("7")), F.concat("data", F.lit("!"))).otherwise(F.col("data"))
    return fragments.rehash_faults(_data(spark, sf_dir).select("hash", damaged.alias("data")))


@_query("select p_size as pack, p_brand as hash, count(distinct p_partkey % 3) as places from part group by 1, 2 having count(distinct p_partkey % 3) > 1")
def offset_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.offset_faults(table(spark, sf_dir, "part").selectExpr("p_size as pack", "p_brand as hash", "p_partkey % 3 as at"))


_NODES = """nodes as (select p_partkey as node, case when p_partkey > 1 then case when p_partkey % 50 = 0 then -p_partkey when p_partkey < 4 then -1 else p_partkey // 4 end end as parent, case when p_partkey % 9 = 0 then upper(p_brand) else p_brand end as name,
  case when p_partkey % 40 = 0 then 'wrong' else sha256(lower(p_brand)) end as name_hash, p_type as hash from part)"""


@_query(f"""with {_NODES} select node, 'no parent' as fault from nodes where parent is not null and (parent < 1)
  union all select node, 'no content' from nodes where hash like 'PROMO%' union all select node, 'name hash' from nodes where name_hash = 'wrong'
  union all select node, 'same name' from nodes n where exists (select 1 from nodes m where m.node <> n.node and m.parent is not distinct from n.parent and lower(m.name) = lower(n.name))""")
def verify_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    nodes = part.selectExpr(
        "p_partkey as node", "case when p_partkey > 1 then case when p_partkey % 50 = 0 then -p_partkey when p_partkey < 4 then -1 else p_partkey div 4 end end as parent",
        "if(p_partkey % 9 = 0, upper(p_brand), p_brand) as name", "if(p_partkey % 40 = 0, 'wrong', sha2(lower(p_brand), 256)) as name_hash", "p_type as hash",
    )
    return fragments.verify_tree(nodes, part.where("p_type not like 'PROMO%'").selectExpr("p_type as hash").distinct())




@_query("""with store as (select distinct p_size % 4 as partition, p_brand as hash, p_partkey % 6 as context from part), a as (select distinct p_size % 7 as partition, case when p_partkey % 5 = 0 then 'none' else p_brand end as hash, p_partkey % 8 as context from part)
  select * from store union select * from a where hash in (select hash from store)""")
def copy_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    store = part.selectExpr("p_size % 4 as partition", "p_brand as hash", "p_partkey % 6 as context").distinct()
    return fragments.copy_associations(store, part.selectExpr("p_size % 7 as partition", "if(p_partkey % 5 = 0, 'none', p_brand) as hash", "p_partkey % 8 as context"))


_OBLITERATE = """store as (select p_partkey as partition, p_brand || p_size % 5 as hash, p_partkey % 6 as context, cast(p_size as bigint) as size, p_partkey % 17 = 0 as obliterated from part),
  m as (select *, context % 2 = 0 and hash like '%1_' as hit from store)"""


def _obliterated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    store = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as partition", "concat(p_brand, p_size % 5) as hash", "p_partkey % 6 as context", "cast(p_size as bigint) as size", "p_partkey % 17 = 0 as obliterated"
    )
    return fragments.obliterate(store, store.where("context % 2 = 0 and hash like '%1_'").select("hash", "context"))


@_query(f"with {_OBLITERATE} select partition, hash, context, case when hit then 0 else size end as size, hit or obliterated as obliterated from m")
def obliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obliterated(spark, sf_dir)[0]


@_query(f"""with {_OBLITERATE}, h as (select hash, count(*) filter (hit and not obliterated) as n, count(*) filter (not hit and not obliterated) as kept from m group by 1)
  select cast(sum(n) as bigint) as fragments, count(*) filter (n > 0 and kept = 0) as payloads from h""")
def obliterate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obliterated(spark, sf_dir)[1]


@_query("""with p as (select p_size as pack, p_partkey as "at", p_name as hash, p_size + p_partkey % 3 as size from part), l as (select distinct p_name as hash from part where p_partkey % 2 = 0),
  o as (select pack, hash, min("at") as "at", max(size) as size from p where hash in (select hash from l) group by 1, 2)
  select pack, hash, size, cast(coalesce(sum(size) over (partition by pack order by "at" rows between unbounded preceding and 1 preceding), 0) as bigint) as new_at from o""")
def repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    packed = part.selectExpr("p_size as pack", "p_partkey as at", "p_name as hash", "p_size + p_partkey % 3 as size")
    return fragments.repack(packed, part.where("p_partkey % 2 = 0").selectExpr("p_name as hash").distinct())


@_query("""with s as (select o_custkey % 16 as bucket, o_orderkey as key, o_orderkey * 7919 % 1000 as last_access, o_orderkey % 4 <> 0 as durable from orders),
  q as (select bucket, count(*) - 40960000::bigint * 80 // (100 * 256 * 16 * 1000) as quota from s group by 1), d as (select s.*, rank() over (partition by s.bucket order by last_access) as k from s where durable)
  select d.bucket, d.key, d.last_access from d join q on q.bucket = d.bucket where d.k <= q.quota""")
def evict_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all buckets; rows that no other store holds stay."""
    store = table(spark, sf_dir, "orders").selectExpr("o_custkey % 16 as bucket", "o_orderkey as key", "o_orderkey * 7919 % 1000 as last_access", "o_orderkey % 4 <> 0 as durable")
    return fragments.evict_durable(store, 40960000, 0, 16000)


@_query("""with s as (select o_orderkey as key, o_custkey as size, o_orderkey * 7919 % 1000 as last_access from orders), u as (select last_access, sum(sum(size)) over (order by last_access desc) as upto from s group by 1)
  select s.key, (select sum(size) from s) < 5000 or u.upto <= 5000 * 60 // 100 as kept from s join u on u.last_access = s.last_access""")
def collect_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "orders").selectExpr("o_orderkey as key", "o_custkey as size", "o_orderkey * 7919 % 1000 as last_access")
    return fragments.collect_garbage(store, 5000, 60)


@_query("""with t as (select sha256(p_name) as hash, p_name as data, p_partkey as k from part), one as (select hash, case when k % 2 = 0 then data else 'bad' end as data from t where k % 3 <> 0), two as (select hash, data from t where k % 5 <> 0),
  every as (select hash, 0 as tier, data from one union all select hash, 1, data from two)
  select hash, min(tier) as tier, min_by(data, tier) as data from every where sha256(data) = hash group by 1""")
def tiered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest tier with sound content."""
    t = table(spark, sf_dir, "part").selectExpr("sha2(p_name, 256) as hash", "p_name as data", "p_partkey as k")
    return fragments.tiered([t.where("k % 3 <> 0").selectExpr("hash", "if(k % 2 = 0, data, 'bad') as data"), t.where("k % 5 <> 0").select("hash", "data")])
