from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import decontaminate, mixing, quality, simhash, token_output
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, step in cp.STAGES:
        kept = step(spark, docs, SF)
        out.append((name, docs, kept))
        docs = cp.stage(kept, name)
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _, _ in stages] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_id_output",
    ]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_stages_against_brute_force(spark, stages):
    (_, docs, good), (_, good_in, single), (_, single_in, clean), (_, clean_in, mixed), (_, mixed_in, seqs) = stages
    model = quality.train(docs, table(spark, SF, "labels"))
    want = {r.doc_id for r in docs.collect() if model.score([r.text])[0] >= quality.ACCEPT}
    assert {r.doc_id for r in good.collect()} == want and 0 < len(want) < docs.count()

    rows = sorted(good_in.collect(), key=lambda r: r.doc_id)
    fps = [np.frombuffer(simhash.fingerprint_of(r.text, 5, 8, True), np.uint64) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 97:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    left = {r.doc_id for r in single.collect()}
    assert left == {rows[x].doc_id for x in set(root)}
    # the smallest of each group of similar texts stays, and no two similar texts do
    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id in left]
    assert not [(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) >= 0.9 * len(x | y)]

    index = decontaminate.BenchmarkIndex([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])
    bad = {r.doc_id for r in single_in.collect() for n, hit, _ in [index.scan(r.text)] if hit.any() and 20 * hit.sum() >= n}
    assert {r.doc_id for r in clean.collect()} == left - bad

    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= left - bad and max(copies.values()) <= 3
    sizes = clean_in.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    goals = {r.source: r.target for r in mixing.targets(sizes).collect()}
    for source, goal in goals.items():
        of = [r for r in sizes.where(F.col("source").eqNullSafe(source)).collect()]
        assert abs(sum(copies[r.doc_id] * r["size"] for r in of) - goal) <= max(r["size"] for r in of)

    got = seqs.orderBy("seq").collect()
    n_tokens = sum(r.n for r in token_output.tokens(mixed_in).collect())
    assert sum(r.n_tokens for r in got) == n_tokens
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {d for r in got for d in r.doc_ids} == set(copies)


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c", None, "s", 5), (3, "word " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit(1)).withColumn("fp", F.lit("x"))
    for frame in (docs, docs.limit(0)):
        for _, step in cp.STAGES[:-1]:
            kept = step(spark, frame, SF)
            assert kept.columns == docs.columns
            kept.collect()
        assert cp.token_id_output(spark, frame, SF).collect() is not None


def test_keep_one_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "x ")
    rows = [(5, base), (3, near), (4, base), (4, base), (9, "other text of its own here"), (None, ""), (7, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [3, 7, 9]


def test_repeat_is_exact_about_equal_rows(spark):
    rows = [(1, "a b c", "s")] * 5 + [(2, "d e", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = sorted(map(tuple, mixing.repeat(docs).collect()))
    assert once == sorted(map(tuple, mixing.repeat(docs).collect()))
    assert abs(sum(3 for r in once if r[0] == 1) - 17 * 5 / 7) <= 3 + 1e-9 or sum(1 for r in once if r[0] == 2) == 3


def test_stage_radius_tells_near_copies_from_others():
    rng = np.random.default_rng(3)
    links = {"near": [], "edge": [], "far": []}
    for _ in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(150, 600))]
        other = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.005, 0.12))), replace=False):
            other[at] = "edited"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        like = len(a & b) / len(a | b)
        x, y = (np.frombuffer(simhash.fingerprint_of(" ".join(t), 5, 8, True), np.uint64) for t in (words, other))
        band = "near" if like >= 0.85 else "edge" if like >= 0.8 else "far" if like < 0.55 else None
        if band:
            links[band].append(np.bitwise_count(x ^ y).sum() <= 97)
    assert min(map(len, links.values())) >= 10
    assert np.mean(links["near"]) >= 0.99 and np.mean(links["edge"]) >= 0.9 and np.mean(links["far"]) <= 0.02
    print({k: (len(v), float(np.mean(v))) for k, v in links.items()})
