import hashlib
from unittest import mock

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import ancestry, catalogue, chunking, lineage


def plain_cuts(raw, least, mean, most):
    """The rule of ``cuts`` place by place."""
    m = (1 << 64) - 1

    def value(b):
        h = (b + 1) * 0x9E3779B97F4A7C15 & m
        return (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & m

    out, start = [], 0
    while start < len(raw):
        end = start
        while end < len(raw):
            end += 1
            if end - start >= most:
                break
            h = sum(value(raw[end - 1 - i]) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(min(chunking.WINDOW, end))) & m
            if end - start >= least and (h >> 40) % mean == 0:
                break
        start = end
        out.append(end)
    return out


def test_cuts_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    for n in (0, 1, 31, 32, 33, 3000):
        raw = rng.integers(97, 123, n).astype(np.uint8)
        assert chunking.cuts(raw, 16, 32, 100) == plain_cuts(raw.tolist(), 16, 32, 100)


def test_chunks_cover_each_text_and_survive_an_edit(spark):
    rng = np.random.default_rng(6)
    text = "".join(chr(c) for c in rng.integers(97, 123, 20_000)) + "é"
    docs = spark.createDataFrame([(1, text, "x"), (2, "new " + text, "x"), (3, "", "x"), (4, None, "x")], "doc_id long, text string, hash string")
    rows = chunking.content_chunks(docs).collect()
    parts = {d: sorted((r.seq, r.offset, r.n, r.hash) for r in rows if r.doc_id == d) for d in (1, 2, 3, 4)}
    assert not parts[3] and not parts[4]
    raw = text.encode()
    assert [hashlib.sha256(raw[o : o + n]).hexdigest() for _, o, n, _ in parts[1]] == [h for *_, h in parts[1]]
    assert sum(n for _, _, n, _ in parts[1]) == len(raw)
    assert len({h for *_, h in parts[1]} - {h for *_, h in parts[2]}) <= 2


def test_empty_metadata_and_locks(spark):
    rows = spark.createDataFrame([], "owner long, key string, value string")
    assert lineage.put_metadata(rows, rows).isEmpty()
    locks = spark.createDataFrame([("r", 1), ("s", 2)], "resource string, owner long")
    wanted = spark.createDataFrame([("r", 1), ("r", 1), ("t", 1), ("s", 3), ("t", 3)], "resource string, owner long")
    got = {r.owner: (r.wanted, r.held, r.granted) for r in lineage.acquire(locks, wanted).collect()}
    assert got == {1: (2, 1, True), 3: (2, 0, False)}


def grown_stacks(spark):
    keys = spark.range(1, 100_000).select(F.col("id").alias("branch"))
    grown = keys.select("branch", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("pos"))
    return keys, grown.withColumn("member", F.expr("shiftright(branch, pos + 1)")).where("member > 0").withColumn("point", F.col("member") * 2)


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_points_on_grown_stacks_are_not_broadcast(spark):
    keys, stacks = grown_stacks(spark)
    pairs = keys.selectExpr("branch as source", "branch as source_revision", "branch div 2 + 1 as target", "branch div 2 + 1 as target_revision")
    assert not broadcasts(ancestry.shared_points(stacks, pairs))


def test_base_of_points_finds_the_points_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    revisions = spark.range(1, 65).selectExpr("id as revision", "id as number", "case when id > 1 then id div 2 end as parent_self")
    shared = spark.range(2, 65).select(F.col("id").alias("source_point"), counted(F.col("id") - 1).alias("target_point"))
    got = {r.source_point: r.base for r in ancestry.base_of_points(revisions, shared).collect()}
    assert got[64] == 1 and got[63] == 31 and got[5] == 2 and seen.value == 63


def test_branch_points_of_grown_stacks_are_not_broadcast(spark):
    keys, stacks = grown_stacks(spark)
    assert not broadcasts(ancestry.is_branch_point(stacks, keys.selectExpr("branch", "branch div 8 * 2 as revision")))


def test_shared_branches_of_grown_stacks_are_not_broadcast(spark):
    keys, stacks = grown_stacks(spark)
    assert not broadcasts(lineage.shared_branch(stacks, keys.selectExpr("branch as mine", "branch - 1 as theirs")))


def grown_stacks(spark):
    keys = spark.range(1, 100_000).select(F.col("id").alias("branch"))
    grown = keys.select("branch", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("pos"))
    return keys, grown.withColumn("member", F.expr("shiftright(branch, pos + 1)")).where("member > 0").withColumn("point", F.col("member") * 2)


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_points_on_grown_stacks_are_not_broadcast(spark):
    keys, stacks = grown_stacks(spark)
    pairs = keys.selectExpr("branch as source", "branch as source_revision", "branch div 2 + 1 as target", "branch div 2 + 1 as target_revision")
    assert not broadcasts(ancestry.shared_points(stacks, pairs))


def test_base_of_points_finds_the_points_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    revisions = spark.range(1, 65).selectExpr("id as revision", "id as number", "case when id > 1 then id div 2 end as parent_self")
    shared = spark.range(2, 65).select(F.col("id").alias("source_point"), counted(F.col("id") - 1).alias("target_point"))
    got = {r.source_point: r.base for r in ancestry.base_of_points(revisions, shared).collect()}
    assert got[64] == 1 and got[63] == 31 and got[5] == 2 and seen.value == 63


def test_branch_points_of_grown_stacks_are_not_broadcast(spark):
    keys, stacks = grown_stacks(spark)
    assert not broadcasts(ancestry.is_branch_point(stacks, keys.selectExpr("branch", "branch div 8 * 2 as revision")))


def test_shared_branches_of_grown_stacks_are_not_broadcast(spark):
    keys, stacks = grown_stacks(spark)
    assert not broadcasts(lineage.shared_branch(stacks, keys.selectExpr("branch as mine", "branch - 1 as theirs")))


def test_branches_of_one_name_are_dealt_among_tasks(spark):
    branches = spark.range(0, 3000, 1, 1).selectExpr("id as branch", "if(id < 0, 'y', 'x') as name", "false as deleted")
    asked = spark.range(0, 3000, 1, 1).selectExpr("id as pos", "cast(null as bigint) as id", "if(id < 0, 'y', 'x') as name")
    dealt = catalogue.get_branches(branches, asked).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in dealt) == 9_000_000 and max(r["count"] for r in dealt) < 9_000_000


def plain_bases(revisions, pairs):
    parents = {r[0]: [p for p in r[2:4] if p is not None] for r in revisions}
    number = {r[0]: r[1] for r in revisions}

    def reached(x):
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents.get(y, [])
        return {y for y in seen if y in number}

    out = set()
    for mine, theirs, floor in pairs:
        best = max(reached(mine) & reached(theirs), key=number.get, default=None)
        low = number.get(floor)
        out.add((mine, theirs, best if low is None or (best is not None and number[best] > low) else floor))
    return out


def test_merge_bases_against_a_plain_search(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(7)
    for falling in (True, False):
        pick = lambda i: int(rng.integers(max(1, i - 6), i)) if i > 2 and rng.random() < 0.9 else None
        rows = [(i, i * 2, pick(i), pick(i) if i % 3 == 0 else None) for i in range(1, 40)]
        if not falling:  # a child numbered below its parent
            rows[20] = (21, 3, 20, None)
        pairs = [(int(a), int(b), int(a) // 2 if a % 4 == 0 else None) for a, b in {tuple(x) for x in rng.integers(1, 42, (60, 2)).tolist()}]
        revisions = spark.createDataFrame(rows, "revision long, number long, parent_self long, parent_other long")
        got = ancestry.merge_bases(revisions, spark.createDataFrame(pairs, "mine long, theirs long, floor long")).collect()
        assert {tuple(r) for r in got} == plain_bases(rows, pairs) and len(got) == len(pairs)


def test_merge_bases_do_not_find_the_whole_reach(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    revisions = spark.range(1, 257).selectExpr("id as revision", "id as number", "case when id > 1 then id - 1 end as parent_self", "cast(null as bigint) as parent_other")
    pairs = spark.range(2, 257).selectExpr("id as mine", "id - 1 as theirs", "cast(null as bigint) as floor")
    with mock.patch.object(ancestry, "reach", side_effect=AssertionError):
        assert all(r.base == r.theirs for r in ancestry.merge_bases(revisions, pairs).collect())
