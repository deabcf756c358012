from datetime import timedelta

import pytest

from tessera.operators import filters, history, trees
from tessera.streaming import notifications

TREE = "path string, context long, hash string"


def test_moves_pair_first_with_first(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "y")], TREE)
    new = spark.createDataFrame([("d", 1, "x"), ("c", 2, "z")], TREE)
    got = sorted((r.action, r.path, r.from_path) for r in trees.diff(base, new).collect())
    assert got == [("Delete", "b", "b"), ("Keep", "c", "c"), ("Move", "d", "a")]


def test_three_way_rules(spark):
    base = spark.createDataFrame([(p, i, "0") for i, p in enumerate("abcdefg", 1)], TREE)
    source = spark.createDataFrame([("a2", 1, "0"), ("b2", 2, "1"), ("c2", 3, "0"), ("e", 5, "9"), ("f", 6, "9"), ("g", 7, "5")], TREE)
    target = spark.createDataFrame([("a", 1, "7"), ("b", 2, "7"), ("e", 5, "9"), ("f", 6, "8"), ("g", 7, "0")], TREE)
    got = {r.from_path: r.outcome for r in trees.diff3(base, source, target).collect()}
    # rename takes up a change; changed move and change; move and delete; both delete; same; differing; only ours
    assert got == {"a": "change", "b": "conflict", "c": "conflict", "d": "same", "e": "same", "f": "conflict", "g": "change"}


def test_empty_trees(spark):
    none = spark.createDataFrame([], TREE)
    assert trees.diff(none, none).count() == trees.diff3(none, none, none).count() == 0


def admitted(spark, rules, *paths):
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    return [r.path for r in frame.where(filters.admits(frame.path, filters.parse(rules))).collect()]


def test_inclusion_reaches_below_an_excluded_directory(spark):
    paths = ("some/path/file.txt", "some/path/keep/a.txt", "some/path/keep/deep/b.txt", "other/x")
    assert admitted(spark, ["some/path"], *paths) == ["other/x"]
    assert admitted(spark, ["some/path", "!some/path/keep"], *paths) == ["some/path/keep/a.txt", "some/path/keep/deep/b.txt", "other/x"]
    assert admitted(spark, ["some/path", "!some/path/keep/a.txt"], *paths) == ["some/path/keep/a.txt", "other/x"]


def test_rule_lines(spark):
    assert admitted(spark, ["", "# note", "*.TMP", "\\!odd", "!!x.y"], "a/b.tmp", "a/c.txt", "!odd", "d/x.y") == ["a/c.txt"]
    assert admitted(spark, ["build/"], "build/a", "x/build", "x/build/b") == ["x/build"]
    assert admitted(spark, ["/top"], "top", "top/a", "x/top") == ["x/top"]
    assert admitted(spark, ["some/[pa]?th/**/*"], "some/path/a", "some/auth/b/c", "some/moth/x") == ["some/moth/x"]
    assert admitted(spark, ["a+b/(c)", "x{1,2}.t"], "a+b/(c)", "aab/c", "x1.t", "x3.t") == ["aab/c", "x3.t"]
    with pytest.raises(ValueError):
        filters.parse(["!**/a"])


def test_contexts_that_name_nothing_do_not_move(spark):
    base = spark.createDataFrame([("a", None, "x"), ("b", 0, "x")], TREE)
    new = spark.createDataFrame([("y", 0, "x"), ("z", None, "x")], TREE)
    assert sorted((r.action, r.path) for r in trees.diff(base, new).collect()) == [("Add", "y"), ("Add", "z"), ("Delete", "a"), ("Delete", "b")]


def test_node_diff_rules(spark):
    schema = "path string, kind string, mode int, context long, hash string"
    base = spark.createDataFrame([("a", "file", 1, 1, "x"), ("B", "file", 1, 2, "x"), ("c", "directory", 1, 3, "h"), ("d", "directory", 1, 4, "h"), ("e", "file", 1, 5, "x"), ("f", "file", 1, 6, "x"), ("g", "file", 1, 7, "x")], schema)
    new = spark.createDataFrame([("a", "file", 2, 1, "x"), ("b", "file", 1, 2, "x"), ("c", "directory", 1, 3, "i"), ("d", "directory", 2, 4, "h"), ("e", "directory", 1, 5, "x"), ("f", "file", 1, 6, "x"), ("g", "file", 1, 9, "x")], schema)
    got = sorted((r.action, r.path, r.from_path) for r in trees.node_diff(base, new).collect())
    assert got == [("Add", "e", "e"), ("Delete", "e", "e"), ("Keep", "a", "a"), ("Keep", "d", "d"), ("Keep", "g", "g"), ("Move", "b", "B")]


def test_closure_of_diamond_and_cycle(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")], "source string, target string")
    got = {(r.source, r.target): r.depth for r in history.closure(edges).collect()}
    assert len(got) == 16 and got["A", "D"] == 2 and got["A", "A"] == 3
    assert history.closure(edges, 1).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = notifications.subscribe(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    counts = notifications.tumbling(notifications.once(stream.selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type")), late=None)
    query = counts.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    newest = max(r.ts for r in rows.select("ts").collect())
    # a window is out once the watermark, ten minutes behind the newest event, has passed its end
    want = {(str(r.start), r.event_type, r.n) for r in notifications.tumbling(rows).collect() if r.start + timedelta(hours=1, minutes=10) <= newest}
    got = {(str(r.start), r.event_type, r.n) for r in spark.table("seen").collect()}
    assert got and got == want
