import math
import random
from collections import Counter

import pytest

import numpy as np

from tessera.llm.lm_scoring import scores, words_of


def brute(docs):
    lists = [(t or "").lower().split() for _, t in docs]
    pairs = [Counter(zip(["", *x], x, strict=False)) for x in lists]
    words = [Counter(x) + Counter([""] * bool(x)) for x in lists]
    all_pairs, all_words = sum(pairs, Counter()), sum(words, Counter())
    total = sum(map(len, lists))
    out = []
    for (d, _), x, own, mine in zip(docs, lists, pairs, words, strict=True):
        s = 0.0
        for p, w in zip(["", *x], x, strict=False):
            c = all_pairs[p, w] - own[p, w]
            s += math.log(c / (all_words[p] - mine[p])) if c else math.log(0.4 * max(1, all_words[w] - mine[w]) / total)
        out.append(((d is not None, d or 0), len(x), s / len(x) if x else 0.0))
    return sorted(out)


@pytest.mark.parametrize("frequent", [1e-5, 0.01, 0.06, 2.0])
def test_against_brute_force(spark, frequent):
    """From all words known beforehand to none."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("The the of a b c d e f gé".split(), k=rng.choice([0, 1, 5, 80])) + [f"x{rng.randrange(200)}"])) for i in range(80)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (3, docs[3][1]), (None, "the of"), (103, "lone")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.score) for r in scores(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, w int"), frequent=frequent).collect())
    for a, b in zip(got, brute(docs), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6, (a, b)


def test_empty(spark):
    assert scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of():
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB \t\n\x0bé\u00a0", k=rng.choice([0, 1, 9, 300]))) for _ in range(40)] + [None, "x" * 5000, "x" * 4999 + "y", " a  b "]
    whole = words_of(texts)
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert [i for i, _ in want] == whole[1].tolist()
    by_word: dict = {}
    assert all(by_word.setdefault(w, h) == h for (_, w), h in zip(want, whole[0].tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word) and len(np.unique(whole[0])) == len(by_word)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    got = scores(spark.createDataFrame([(1, long), (2, "w1 w2 w9"), (3, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_words for r in got} == {1: 400_000, 2: 3, 3: 0}


def test_many_parts(spark):
    """Pairs of rare and frequent words in several parts and slices; ids that are no numbers."""
    rng = random.Random(5)
    docs = [(f"d{i}", " ".join(rng.choices("the of a b c".split(), k=9) + [f"x{rng.randrange(40)} y{rng.randrange(9)}" for _ in range(30)])) for i in range(90)]
    frame = spark.createDataFrame([*docs, docs[7]], "doc_id string, text string")
    want = brute([*enumerate(t for _, t in docs), (7, docs[7][1])])
    got = sorted(((True, int(r.doc_id[1:])), r.n_words, r.score) for r in scores(frame, slices=3, frequent=0.004, part_bytes=2000).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6, (a, b)


def shuffled(spark):
    """(number of stages, rows that they have written for shuffles)."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = [stages.apply(i) for i in range(stages.size())]
    return max([0, *(s.stageId() for s in found)]), lambda least: sum(s.shuffleWriteRecords() for s in found if s.stageId() > least)


def test_pairs_are_not_rows(spark):
    """Rows of one pair each took too many CPU seconds and too much of an executor's memory."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"v{int(rng.paretovariate(0.3)) % 3000}" for _ in range(400))) for i in range(300)]
    before, _ = shuffled(spark)
    assert len(scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), frequent=0.001).collect()) == 300
    assert 0 < shuffled(spark)[1](before) < 300 * 400 / 10
