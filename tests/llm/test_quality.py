import random
import zlib

import numpy as np

from tessera.llm import quality
from tessera.llm.quality import classify


def tables(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdef')}{rng.choice('stuv')}{rng.randrange(99)}" for _ in range(rng.randrange(5, 200))]
        bad = i % 6 == 0
        text = " ".join(w.upper() + "!!" if bad and i % 12 else w for w in words) if i % 12 or not bad else f"{words[0]} " * len(words)
        docs.append((i, text, 0.5))
        labels.append((i, int(not bad)))
    docs += [(n, None, 0.0), (n + 1, "", 0.0), (n + 2, "Long word " * 40_000, 0.0), (None, "a b", 0.0), (1, docs[1][1], 0.0)]
    labels += [(None, 1), (n + 5, 1), (2, 0), (3, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int"), labels


def test_held_out_accuracy(spark):
    docs, labels, known = tables(spark)
    got = classify(docs, labels).collect()
    assert len(got) == docs.count()
    want = {d: q for d, q in known if d is not None and q is not None and d not in (2, 3)}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 80
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_no_labels_or_no_documents(spark):
    docs, labels, _ = tables(spark, 30)
    assert {r.predicted for r in classify(docs, labels.limit(0)).collect()} == {1}
    assert classify(docs.limit(0), labels).count() == 0


def test_given_tables(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_bradley_terry_quality"](spark, sf).collect() if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in got) >= 0.95 * len(got)


def test_fit_against_plain_descent():
    """The pairwise logistic loss has one minimum; plain gradient descent finds the same weights."""
    rng = np.random.default_rng(2)
    diff = rng.normal(size=(400, 4)) + np.array([0.8, -0.3, 0.0, 0.1])
    got = quality._fit_pairs(diff, ridge=0.01)
    w = np.zeros(4)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(diff @ w))
        w -= 0.2 * (-(diff * p[:, None]).mean(0) + 0.01 * w)
    assert np.abs(got - w).max() < 1e-4


def test_scores_against_plain_formula(spark):
    docs, labels, _ = tables(spark, 200)
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in classify(docs, labels).collect():
        if r.doc_id not in (None, 1):
            z = float(((quality.features([texts[r.doc_id]])[0] - model.mean) / model.scale * model.weights).sum())
            z = model.slope * (z - model.threshold) + np.log(0.3 / 0.7)
            assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-9
