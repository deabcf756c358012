import pytest

from tessera.functions import values
from tessera.operators import paths, specifiers
from tessera.sources.files import working_changes, working_tree


def test_working_tree_against_a_revision(spark, tmp_path):
    for name, text in {"a.txt": "one", "d/b.txt": "two", "d/e/c.bin": "three"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    top = str(tmp_path)
    first = working_tree(spark, top)
    first = spark.createDataFrame(first.collect(), first.schema)
    assert sorted((r.path, r["size"]) for r in first.collect()) == [("a.txt", 3), ("d/b.txt", 3), ("d/e/c.bin", 5)]
    assert [r.path for r in working_tree(spark, top, "d/e").collect()] == ["d/e/c.bin"]
    assert [r.path for r in working_tree(spark, top, recursive=False).collect()] == ["a.txt"]
    assert sorted(r.path for r in working_tree(spark, top, glob="*.txt").collect()) == ["a.txt", "d/b.txt"]
    (tmp_path / "a.txt").write_text("longer")
    (tmp_path / "d/b.txt").unlink()
    (tmp_path / "new").write_text("x")
    got = sorted(tuple(r) for r in working_changes(first, working_tree(spark, top)).collect())
    assert got == [("a.txt", "Keep"), ("d/b.txt", "Delete"), ("new", "Add")]


def test_covering_set_of_the_root_is_everything(spark):
    frame = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert sorted(r.path for r in paths.covering_set(frame("a/b", "a/b/c", "a/bc", "a/b")).collect()) == ["a/b", "a/bc"]
    assert paths.covering_set(frame("a", "")).count() == 0


def test_clean_path(spark):
    cases = {"a//b": "a/b", "./a": "a", "a/.": "a", "a/./b": "a/b", "a\\b": "a/b", "a/../b": "b", "../a": "../a", "/../a": "/a", "a/../../b": "../b", "../../a/..": "../..", "a": "a"}
    frame = spark.createDataFrame(list(cases), "string")
    got = {r.value: r.c for r in frame.select("value", values.clean_path(frame.value).alias("c")).collect()}
    assert got == cases


def test_specifiers():
    assert specifiers.parse("ab12~3") == ("prefix", {"hash": "ab12"}, 3)
    assert specifiers.parse("main@7") == ("number", {"branch": "main", "number": 7}, 0)
    assert specifiers.parse("@latest~") == ("latest", {"branch": None}, 1)
    assert specifiers.parse("0" * 64)[0] == "hash"
    with pytest.raises(ValueError):
        specifiers.parse("what?")
