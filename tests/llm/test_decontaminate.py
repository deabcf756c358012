import hashlib
import random
import re

from tessera.llm.decontaminate import contamination, op10_winnowing_decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    words = WORD.findall(text.encode().lower()) if text else []
    hit, found = set(), set()
    for name, item in items:
        iw = WORD.findall(item.encode().lower()) if item else []
        m = min(13, len(iw))
        windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for p in range(len(words) - m + 1 if m else 0):
            if tuple(words[p : p + m]) in windows:
                hit |= set(range(p, p + m))
                found.add(str(name))
    return len(words), len(hit), ",".join(sorted(found))


def fixture():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["É", "ß9"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 7, 12, 13, 20, 40])))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "...")]
    docs = []
    for d in range(60):
        parts = rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            source = items[rng.randrange(12)][1].split(" ")
            a = rng.randrange(len(source))
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = [w.upper() for w in source[a : a + rng.randrange(1, 40)]]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(60, None), (61, ""), (62, "a b " * 5000), (63, items[3][1]), (63, items[3][1]), (None, items[4][1])]
    return docs, items


def check(spark, **options):
    docs, items = fixture()
    got = contamination(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"),
        spark.createDataFrame(items, "item_id long, text string"),
        **options,
    ).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for row, (doc_id, text) in zip(sorted(got, key=key), sorted(docs, key=key), strict=True):
        n, hit, names = brute(text, items)
        assert (row.doc_id, row.n_words, row.n_hit, ",".join(row["items"])) == (doc_id, n, hit, names)
        assert row.contaminated == (hit > 0 and 20 * hit >= n)


def test_against_brute_force(spark):
    check(spark)


def test_benchmark_in_blocks_gives_the_same(spark):
    check(spark, max_block_bytes=300)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(docs, none).collect()] == [0]
    assert contamination(docs.limit(0), none).count() == 0


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_winnowing_decontamination(spark, sf).collect():
        n, hit, names = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items_sha256) == (n, hit, hashlib.sha256(names.encode()).hexdigest())
