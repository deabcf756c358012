import random
from collections import Counter
from unittest import mock

import numpy as np
import pytest

from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import common_prefixes, dedup, suffix_array


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    t = np.append(rng.integers(1, rng.choice([2, 3, 5, 200]) + 1, rng.choice([1, 2, 7, 60, 400])), 0)
    if seed % 3 == 0:
        t = np.append(np.tile(t[:-1], 4), 0)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffix_array(t.astype(np.int64), 257).tolist() == want


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(docs, raws, strict=True):
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone[:-1]], strict=False))
        out.append(((d is not None, d or 0), len(r), sum(gone), runs, kept))
    return sorted(out)


def fixture():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(60))
    docs = []
    for i in range(40):
        text = " ".join(word() for _ in range(rng.choice([0, 3, 50, 120])))
        if i % 3 == 0:
            a = rng.randrange(60)
            text = text[:80] + passage[a:] + text[80:]
        docs.append((i, text))
    docs += [(i + 100, docs[i][1]) for i in (3, 4, 4)] + [(200, "ab" * 400), (201, " " * 500), (202, None), (203, ""), (None, passage), (3, "tail " + passage)]
    return docs


def check(spark):
    docs = fixture()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, doc int")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup(frame).collect())
    assert got == brute(docs, 200)


def test_against_brute_force(spark):
    check(spark)


def test_crowded_anchors_and_slices(spark):
    with mock.patch.multiple(suffix_dedup, HOT=2, SHARD_BYTES=2000, SLICE=300):
        check(spark)


@pytest.mark.parametrize("seed", range(6))
def test_recursion_with_many_symbols(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(1, 30, 9) for _ in range(40)]
    t = np.append(np.concatenate([words[i] for i in rng.integers(0, 40, 900)]), 0)  # a second level of 40 names and more
    assert len(t) > 64 * 31
    sa = suffix_array(t.astype(np.int64), 31)
    assert sorted(sa.tolist()) == list(range(len(t)))
    raw = t.astype(">u2").tobytes()
    assert all(raw[2 * a :] < raw[2 * b :] for a, b in zip(sa, sa[1:], strict=False))


def test_permuted_common_prefixes():
    rng = np.random.default_rng(4)
    text = np.append(np.tile(rng.integers(0, 4, 90), 5), 255).astype(np.uint8)
    sa = suffix_array(np.append(text.astype(np.int64) + 1, 0), 257)
    got = common_prefixes(text, sa, 50, lanes=3)
    raw = text.tobytes()
    for x, y in zip(sa, sa[1:], strict=False):
        same = next((i for i in range(len(raw)) if raw[x + i : x + i + 1] != raw[y + i : y + i + 1] or max(x, y) + i >= len(raw)))
        assert got[y] == min(same, 50)


def test_very_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=1_500_000))
    docs = [(1, long), (2, long[700_000:700_400]), (3, "x" + long[1_048_500:1_048_720])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (620, 2), 2: (400, 1), 3: (220, 1)}


def test_empty(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_stretches_are_not_cut_to_single_strings(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(230)
    docs = [(i, word(300) + passage + word(300)) for i in range(80)]
    rows, stage = [], suffix_dedup.stage

    def counted(df, name):
        out = stage(df, name)
        if name == "suffix-parts":
            rows.append(out.count())
        return out

    with mock.patch.multiple(suffix_dedup, HOT=30, stage=counted):
        got = sorted(((True, r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs, 200)
    assert 0 < rows[0] and sum(rows) <= 15 * len(docs)  # by single strings it would be 31 for each
