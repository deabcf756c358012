from collections import Counter, defaultdict
from unittest import mock

from tessera.llm import mixing
from tessera.llm.mixing import mix, repeat


def brute_targets(size):
    """Share, stop, share the rest again, until nobody is above."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(size.values())), set(names), {}
    while True:
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if unit * weight[s] > 3 * size[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * size[s]
            left -= out[s]
        open_ -= over


def docs(n=900):
    out = [(i, " ".join(["w"] * (i % 23)), f"s{i % 7}" if i % 3 else "hot") for i in range(n)]
    return out + [(5000, None, "s1"), (5001, "", "empty"), (None, "a b", None), (7, "x y z", "Z"), (7, "x y z", "Z"), (7, "x y", "Z")]


def check(spark):
    frame = spark.createDataFrame([(*d, 1.0) for d in docs()], "doc_id long, text string, source string, target double")
    got = mix(frame).collect()
    assert len(got) == len(docs())
    size, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs():
        size[s] += len((t or "").split())
    want = brute_targets(size)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        ratio = want[r.source] / size[r.source] if size[r.source] else 0
        assert abs(r.copies - ratio) < 1 + 1e-6
    assert all(abs(taken[s] - want[s]) <= 23 for s in size)  # one document of rounding at most
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(mix(frame.repartition(5)).collect())


def test_targets_and_rounding(spark):
    check(spark)


def test_reduction_tree(spark):
    with mock.patch.multiple(mixing, CHUNK=20, FAN_IN=3):
        check(spark)


def test_repeat_returns_documents(spark):
    frame = spark.createDataFrame([(*d, i) for i, d in enumerate(docs())], "doc_id long, text string, source string, copies int")
    out = repeat(frame)
    assert out.columns == frame.columns
    times = Counter(r.copies for r in out.collect())
    words = sum(len((docs()[i][1] or "").split()) * n for i, n in times.items())
    assert max(times.values()) <= 3 and words == sum(r.taken for r in mix(frame).collect()) or abs(words - sum(r.taken for r in mix(frame).collect())) <= 60


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
