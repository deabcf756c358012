import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm.fingerprint import add_vectors, fingerprints, vector_of


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randrange(2, 9)))
    docs = [(i * 3, "".join(word() + rng.choice([" ", " ", ". ", "\n", "n "]) for _ in range(rng.choice([0, 1, 5, 300])))) for i in range(90)]
    docs += [(1000, None), (1001, ""), (1002, docs[5][1]), (1003, docs[5][1]), (None, "first of all. x"), (2000, "last one 😀 with text. " * 30)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_chars int")).collect()}
    order = sorted(((d is not None, d or 0), t or "", d) for d, t in docs)
    assert len(got) == len(docs)
    for i, (_, text, doc_id) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    assert got[1002].fingerprint == got[1003].fingerprint == got[15].fingerprint and got[1002].near_next == 1.0
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next + 0.1 for r in long) >= 0.9 * len([r for r in long if r.near_next < 1])


def test_order_insertion_and_deletion(spark):
    df = spark.range(1)
    texts = df.select(vector_of(F.lit("one.\ntwo.\nthree.")).alias("a"), vector_of(F.lit("three.\none.\ntwo.")).alias("b"), vector_of(F.lit("one.\ntwo.")).alias("c"), vector_of(F.lit("three.")).alias("d"))
    r = texts.select((F.col("a") == F.col("b")).alias("x"), (add_vectors(F.col("c"), F.col("d")) == F.col("a")).alias("y"), (add_vectors(F.col("a"), F.col("d"), -1) == F.col("c")).alias("z"), (F.col("a") == F.col("c")).alias("no")).first()
    assert (r.x, r.y, r.z, r.no) == (True, True, True, False)


def test_small(spark):
    schema = "doc_id long, text string"
    assert fingerprints(spark.createDataFrame([], schema)).count() == 0
    r = fingerprints(spark.createDataFrame([(1, "abcd")], schema)).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
