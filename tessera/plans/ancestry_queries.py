"""Queries over first-parent lines, merge bases, searches, pages and pointers, each with DuckDB SQL.

The history is a revision a customer: its first parent is half its number, every fifth has a third of it as
second parent; its branch is its number modulo 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ancestry, history
from tessera.sources.versioned import ensure_checkpoints, table

from .queries import _EDGES, _edges, _query

_REV = """rev as (select cast(c_custkey as bigint) as revision, cast(c_custkey as bigint) as number,
  case when c_custkey > 1 then c_custkey // 2 end as parent_self, case when c_custkey % 5 = 0 then c_custkey // 3 end as parent_other,
  c_custkey % 3 as branch, c_custkey % 100 as ts from customer)"""
_LINE = f"""with recursive {_REV}, line as (select revision as tip, revision, cast(0 as bigint) as depth from rev
  union all select l.tip, r.parent_self, l.depth + 1 from line l join rev r on r.revision = l.revision where r.parent_self is not null)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoints(spark)
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as bigint) as revision", "cast(c_custkey as bigint) as number", "case when c_custkey > 1 then c_custkey div 2 end as parent_self",
        "case when c_custkey % 5 = 0 then c_custkey div 3 end as parent_other", "cast(c_custkey % 3 as bigint) as branch", "cast(c_custkey % 100 as bigint) as ts",
    )


def _line(spark: SparkSession, sf_dir: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    rev = revisions(spark, sf_dir)
    return rev, ancestry.lines(rev, rev.select(F.col("revision").alias("tip")), limit)


@_query(f"{_LINE} select tip, revision, depth from line")
def first_parent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, sf_dir)[1]


@_query(f"{_LINE} select tip, revision, depth from line where depth < 5")
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, sf_dir, 5)[1]


_PAIRS = "pairs as (select revision as mine, revision - 1 as theirs from rev where revision > 1)"
_MEET = f"""{_LINE}, {_PAIRS}, met as (select p.mine, p.theirs, a.revision as base, a.depth as ahead, b.depth as behind,
  row_number() over (partition by p.mine order by a.depth) as k from pairs p join line a on a.tip = p.mine
  join line b on b.tip = p.theirs and b.revision = a.revision), first as (select * from met where k = 1)"""


def _meeting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rev, line = _line(spark, sf_dir)
    return line, ancestry.meeting(line, rev.where("revision > 1").selectExpr("revision as mine", "revision - 1 as theirs"))


@_query(f"{_MEET} select mine, theirs, base, ahead, behind from first")
def lines_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of neighbours meet, and how far each is ahead."""
    return _meeting(spark, sf_dir)[1]


@_query(f"""{_MEET} select f.mine, f.theirs, 'mine' as side, l.revision, l.depth from first f join line l on l.tip = f.mine and l.depth < f.ahead
  union all select f.mine, f.theirs, 'theirs', l.revision, l.depth from first f join line l on l.tip = f.theirs and l.depth < f.behind""")
def exclusive_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.exclusive(*_meeting(spark, sf_dir))


@_query(f"""{_MEET} select mine as branch, ahead, behind, case when ahead = 0 and behind = 0 then 'equal' when ahead = 0 then 'behind'
  when behind = 0 then 'ahead' else 'diverged' end as status from first""")
def revision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a local tip stands to a remote one."""
    met = _meeting(spark, sf_dir)[1]
    a, b = F.col("ahead") == 0, F.col("behind") == 0
    return met.select(F.col("mine").alias("branch"), "ahead", "behind", F.when(a & b, "equal").when(a, "behind").when(b, "ahead").otherwise("diverged").alias("status"))


@_query(f"""{_LINE}, w as (select l.tip as newer, greatest(l.tip // 3, 1) as older, l.* from line l where depth < 4)
  select newer, older, case when bool_or(revision = older) then 'reached' when not bool_or(revision < older) and count(*) >= 4 then 'exhausted' else 'diverged' end as state
  from w group by 1, 2""")
def line_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a third of a revision is on its line, within four revisions."""
    rev, line = _line(spark, sf_dir, 4)
    return ancestry.on_line(line, rev, rev.selectExpr("revision as newer", "greatest(revision div 3, 1) as older"), 4)


_REACH = f"""with recursive {_REV}, {_PAIRS}, up as (select revision as source, parent_self as target from rev where parent_self is not null
  union select revision, parent_other from rev where parent_other is not null),
  reach as (select revision as root, revision as target from rev union select r.root, u.target from reach r join up u on u.source = r.target)"""


@_query(f"""{_REACH}, best as (select p.mine, p.theirs, max(a.target) as base from pairs p join reach a on a.root = p.mine
  join reach b on b.root = p.theirs and b.target = a.target group by 1, 2)
  select mine, theirs, case when mine % 4 = 0 then greatest(base, mine // 2) else base end as base from best""")
def rooted_merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest revision that neighbours both reach, with half the revision as floor for every fourth."""
    rev = revisions(spark, sf_dir)
    pairs = rev.where("revision > 1").selectExpr("revision as mine", "revision - 1 as theirs", "case when revision % 4 = 0 then revision div 2 end as floor")
    return ancestry.merge_bases(rev, pairs)


@_query(f"""{_LINE}, c as (select l.*, r.number, r.branch, r.ts, max(case when r.ts < 10 then 1 else 0 end) over w as old,
  max(case when r.branch <> t.branch then 1 else 0 end) over w as crossed, case when r.branch <> t.branch then 1 else 0 end as other
  from line l join rev r on r.revision = l.revision join rev t on t.revision = l.tip window w as (partition by l.tip order by l.depth))
  select tip, revision, number, branch, depth from c where depth < 6 and old = 0 and (crossed = 0 or crossed = 1 and other = 1
  and depth = (select min(depth) from c x where x.tip = c.tip and x.other = 1))""")
def history_of_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of six at most, ended by a date and by the first row of another branch."""
    rev, line = _line(spark, sf_dir)
    return ancestry.history(line, rev, 6, F.lit(10), only_branch=True)


@_query(f"""{_LINE}, stop as (select tip, depth from line where revision = tip // 8), own as (select l.* from line l left join stop s on s.tip = l.tip
  where s.depth is null or l.depth < s.depth)
  select tip, revision, depth, (select count(*) from own o where o.tip = own.tip) > 2 as has_more from own where depth < 2""")
def branch_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev, line = _line(spark, sf_dir)
    return ancestry.branch_page(line, rev.selectExpr("revision as tip", "revision div 8 as point"), 2)


@_query(f"""{_LINE} select l.tip, l.revision, l.revision as number, l.depth, f.revision as forward from line l
  left join rev f on f.number = l.tip + 1 and f.parent_self = l.tip where l.revision > (cast(ceil(l.tip / 50.0) as bigint) - 1) * 50 and l.depth < 100""")
def revision_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev, line = _line(spark, sf_dir)
    return ancestry.segment_page(line, rev, 50)


@_query(f"""with {_REV} select branch, cast(ceil(number / 20.0) * 20 as bigint) as key, revision from rev
  where parent_self is not null and parent_self // 20 <> number // 20""")
def step_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.skip_pointers(revisions(spark, sf_dir), 20)


@_query(f"""{_LINE}, r as (select a.tip as "end", a.revision as start, a.depth as steps from line a where a.revision in (1, 2, 3) and a.depth > 0)
  select r.start, r."end", r.steps, t.revision as target, r.steps <= 1 as done from r join line t on t.tip = r."end" and t.depth = r.steps // 2""")
def bisect_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev, line = _line(spark, sf_dir)
    starts = F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))
    return ancestry.bisect(line, rev.select(F.col("revision").alias("end"), starts.alias("start")))


@_query(f"""{_LINE}, s as (select l.tip, min(case when l.revision % 7 = 0 then l.depth end) as hit, min(case when l.revision % 7 <> 0 and l.revision < 20 then l.depth end) as stop,
  count(*) as n, max(case when l.revision % 7 = 0 then l.revision end) as newest from line l group by 1),
  t as (select *, case when least(coalesce(hit, n), coalesce(stop, n)) >= 3 and n > 3 then 'limit' when stop is not null and coalesce(hit, n) > stop then 'aborted'
  when hit is not null then 'found' else 'none' end as state from s)
  select tip, case when state = 'found' then newest end as revision, state from t""")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest multiple of 7, given up below 20 or after three revisions."""
    rev, line = _line(spark, sf_dir)
    return ancestry.search(line, rev, F.col("number") % 7 == 0, F.col("number") < 20, 3)


@_query(f"{_LINE}, a as (select revision as tip, revision % 4 as n from rev) select a.tip, a.n, l.revision from a left join line l on l.tip = a.tip and l.depth = a.n")
def nth_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev, line = _line(spark, sf_dir, 5)
    return ancestry.up(line, rev.selectExpr("revision as tip", "revision % 4 as n"))


@_query(f"""{_LINE}, s as (select l.tip, max(case when l.revision = l.tip // 4 then l.revision end) as revision from line l group by 1)
  select tip, revision, case when revision is null then case when tip = 1 then 'none' when tip < 4 then 'none' else 'aborted' end else 'found' end as state from s""")
def find_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each tip's number on its line, given up once below."""
    rev, line = _line(spark, sf_dir)
    return ancestry.search(line, rev, F.col("number") == F.expr("tip div 4"), F.col("number") < F.expr("tip div 4"))


@_query(f"with {_REV}, {_PAIRS} select mine, theirs, greatest(mine, theirs) + 1 as number from pairs")
def next_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = revisions(spark, sf_dir)
    return ancestry.next_number(rev, rev.where("revision > 1").selectExpr("revision as mine", "revision - 1 as theirs"))


@_query(f"""{_LINE}, p as (select revision as tip, greatest(revision // 6, 1) as other from rev)
  select p.tip, p.other, bool_or(coalesce(r.parent_self = p.other, false) or coalesce(r.parent_other = p.other, false) or r.revision = p.other) as merged
  from p join line l on l.tip = p.tip join rev r on r.revision = l.revision group by 1, 2""")
def merge_precondition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev, line = _line(spark, sf_dir)
    return ancestry.merged_already(rev, line, rev.selectExpr("revision as tip", "greatest(revision div 6, 1) as other"))


# A branch a customer; its stack is itself left out, half of it, a quarter and so on; its point on each is that member's number plus its place.
_STACK = """stacks as (select cast(c_custkey as bigint) as branch, i as pos, c_custkey // cast(power(2, i + 1) as bigint) as member,
  c_custkey // cast(power(2, i + 1) as bigint) * 2 as point from customer, range(0, 40) r(i) where c_custkey // cast(power(2, i + 1) as bigint) > 0)"""
_SHARED = f"""{_STACK}, bp as (select c_custkey as source, c_custkey as source_revision, c_custkey // 2 + c_custkey % 3 as target, c_custkey // 2 + c_custkey % 3 as target_revision from customer),
  every as (select bp.*, s.member as shared, s.point as source_point, bp.target_revision as target_point, -1 as rank, 0 as tie, s.pos as turn from bp join stacks s on s.branch = bp.source and s.member = bp.target
  union all select bp.*, t.member, bp.source_revision, t.point, t.pos, 0, 0 from bp join stacks t on t.branch = bp.target and t.member = bp.source
  union all select bp.*, t.member, s.point, t.point, t.pos, 1, s.pos from bp join stacks t on t.branch = bp.target join stacks s on s.branch = bp.source and s.member = t.member),
  ranked as (select *, row_number() over (partition by source, target order by rank, tie, turn) as k from every),
  shared as (select bp.*, r.shared, r.source_point, r.target_point from bp left join ranked r on r.source = bp.source and r.target = bp.target and r.k = 1)"""


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("branch"))
    grown = keys.select("branch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("pos"))
    return grown.withColumn("member", F.expr("shiftright(branch, cast(pos + 1 as int))")).where("member > 0").withColumn("point", F.col("member") * 2)


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as bigint) as source", "cast(c_custkey as bigint) as source_revision", "c_custkey div 2 + c_custkey % 3 as target", "c_custkey div 2 + c_custkey % 3 as target_revision"
    )
    return ancestry.shared_points(_stacks(spark, sf_dir), pairs)


@_query(f"with {_SHARED} select * from shared")
def shared_branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir)


@_query(f"""{_LINE}, {_SHARED}, w as (select s.*, greatest(source_point, target_point) as newer, least(source_point, target_point) as older from shared s),
  met as (select w.newer, w.older, max(a.revision) as base from (select distinct newer, older from w) w join line a on a.tip = w.newer join line b on b.tip = w.older and b.revision = a.revision group by 1, 2)
  select w.source, w.source_revision, w.target, w.target_revision, w.shared, w.source_point, w.target_point, w.newer, w.older, met.base from w left join met on met.newer = w.newer and met.older = w.older""")
def branch_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-way base of pairs of branches, from the points on the branch that they share."""
    return ancestry.base_of_points(revisions(spark, sf_dir), _shared(spark, sf_dir))


@_query(f"""with {_STACK}, a as (select cast(c_custkey as bigint) as branch, cast(c_custkey // 8 * 2 as bigint) as revision from customer)
  select a.branch, a.revision, exists (select 1 from stacks s where s.branch = a.branch and s.point = a.revision) as is_point from a""")
def branch_point_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as branch", "c_custkey div 8 * 2 as revision")
    return ancestry.is_branch_point(_stacks(spark, sf_dir), asked)


_WALK = f"""with recursive {_EDGES}, roots as (select s_suppkey as root from supplier where s_suppkey % 3 = 0),
  walk as (select r.root, e.target, 1 as depth from roots r join edges e on e.source = r.root
  union select w.root, e.target, w.depth + 1 from walk w join edges e on e.source = w.target where w.depth < 3),
  got as (select root, target, min(depth) as depth from walk group by 1, 2)"""


def _rooted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    ensure_checkpoints(spark)
    roots = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("long").alias("root"))
    edges = _edges(spark, sf_dir).distinct().withColumn("tags", F.when(F.col("target") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array(F.lit("odd"), F.lit("any"))))
    return ancestry.reach(edges, roots, **options)


@_query(f"{_WALK} select * from got")
def dep_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of every third node, three levels deep."""
    return _rooted(spark, sf_dir, max_depth=3)


@_query(f"""{_WALK.replace("from supplier where s_suppkey > 1", "from supplier where s_suppkey > 1 and s_suppkey // 2 % 2 = 1").replace("from supplier where s_suppkey > 2)", "from supplier where s_suppkey > 2 and s_suppkey // 3 % 2 = 1)").replace(" where w.depth < 3", "")}
  select * from got""")
def dep_resolve_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependencies of every third node over edges with a wanted tag."""
    return _rooted(spark, sf_dir, tags=["any", "none"])


@_query(f"{_WALK} select target as node from got union select root from roots")
def dep_with_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("long").alias("node"))
    return _rooted(spark, sf_dir, max_depth=3).select(F.col("target").alias("node")).union(roots).distinct()


@_query(f"""{_WALK} select root as node, target, case when exists (select 1 from edges e where e.source = root and e.target = got.target) then 0 else 1 end as depth
  from got where target <> root""")
def dep_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings: direct entries have depth 0, all others 1; the node itself is left out."""
    got = _rooted(spark, sf_dir, max_depth=3).where("target <> root")
    return got.select(F.col("root").alias("node"), "target", F.when(F.col("depth") == 1, 0).otherwise(1).alias("depth"))
