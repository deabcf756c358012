import random
import re
from unittest import mock

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.simhash import components, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, words=4, radius=4):
    prints = []
    for _, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(words, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is not None, d or 0), f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True)))


def fixture():
    rng = random.Random(4)
    docs = []
    for i in range(60):
        w = [f"{rng.choice('Abcé')}{rng.randrange(500)}" for _ in range(rng.choice([0, 2, 4, 60, 400]))]
        for c in range(rng.choice([1, 1, 2, 6])):
            v = list(w)
            if v and c:
                v[rng.randrange(len(v))] = "edited"
            docs.append((i * 10 + c, rng.choice([" ", "\n", "\t "]).join(v)))
    return docs + [(900, None), (901, ""), (901, ""), (None, "lonely words in here now"), (None, docs[3][1])]


def check(spark):
    docs = fixture()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.fingerprint, r.component_id) for r in near_duplicates(frame).collect())
    assert list(map(str, got)) == list(map(str, brute(docs)))


def test_against_brute_force(spark):
    check(spark)


def test_crowded_buckets_in_tiles(spark):
    with mock.patch.multiple(simhash, TILE=3, GROUP=50):
        check(spark)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(101, 100)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard_kept(docs):
    """Ids that stay when texts at exact similarity 0.8 over five-word shingles are linked."""
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return sorted(min(d for (d, _), r in zip(docs, root, strict=True) if r == g) for g in set(root))


def keep_fixture():
    rng, docs = random.Random(8), [(1, ""), (2, None), (3, "a b"), (4, "a b")]
    for k in range(100):  # at exactly 0.8; just below it; short texts that differ in the last word
        w = [f"w{k}x{i}" for i in range(60)]
        docs += [(1000 + k, " ".join(w[:9])), (2000 + k, " ".join(w[:8]))]
        docs += [(3000 + k, " ".join(w[20:28])), (4000 + k, " ".join([*w[20:27], "other"]))]
    for k in range(20):  # shingles n of which m are common, below and above
        n = rng.choice([40, 150, 300])
        w = [f"v{k}x{i}" for i in range(n + 4)]
        docs.append((5000 + 10 * k, " ".join(w)))
        docs += [(5000 + 10 * k + c, " ".join(w[: round(n * share) + 4])) for c, share in enumerate([0.79, 0.72, 0.66], 1)]
        docs.append((5000 + 10 * k + 5, " ".join(w[: -(-n * 4 // 5) + 4])))
    for k in range(12):  # a chain whose ends are far apart
        docs.append((7000 + k, " ".join(f"c{i}" for i in range(8 * k, 8 * k + 104))))
    return docs


def test_keep_one_at_exact_similarity(spark):
    docs = keep_fixture()
    got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == jaccard_kept(docs)


def test_keep_one_in_small_tiles(spark):
    docs = keep_fixture()[-60:]
    with mock.patch.multiple(simhash, TILE=3, GROUP=50, SET_BYTES=4096):
        got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == jaccard_kept(docs)


def test_few_blocks_are_dealt_at_once(spark):
    docs, dealt, prints = keep_fixture()[-60:], [], []

    def staged(frame, name, real=simhash.stage):
        out = real(frame, name)
        if name == "simhash-blocks":
            dealt.append((out.count(), out.select("node").distinct().count()))
        if name == "keep-prints":
            prints.append(out.columns)
        return out

    with mock.patch.multiple(simhash, FEW_ROWS=100, TILE=1, stage=staged):
        got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == jaccard_kept(docs)
    assert len(dealt) == 4 and all(0 < rows <= 14 * n for rows, n in dealt)
    assert "sh" not in prints[0]  # whole sets are made for candidates only


def test_wider_blocks_for_many_prints(spark):
    assert [len(x) for x in simhash._places(64, 5, 0)] == [12, 13, 13, 13, 13]
    assert len(simhash._places(512, 56, 2_000_000)) == 56
    wide = simhash._places(512, 56, 10_000_000)
    assert {len(set(x.tolist())) for x in wide} == {12}
    meets = lambda places, apart: 1 - np.prod([1 - (1 - apart) ** len(x) for x in places])
    for apart in (78 / 512, 96 / 512):
        assert meets(wide, apart) >= meets(simhash._places(512, 56, 0), apart)
    docs = keep_fixture()
    with mock.patch.object(simhash, "_places", lambda *_: wide):
        got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == jaccard_kept(docs)


def test_near_stars_against_all_pairs():
    rng = np.random.default_rng(5)
    for two in (False, True):
        n = 300
        base = rng.integers(0, 2**63, (12, 8), dtype=np.uint64)
        noise = np.packbits(rng.random((n, 512)) < 0.12, axis=1).view(np.uint64)
        fp = base[rng.integers(0, 12, n)] ^ noise
        bucket, node, size, left = rng.integers(0, 4, n), rng.permutation(n) + 1000, rng.integers(4, 60, n), rng.random(n) < 0.5
        root = {x: x for x in node.tolist()}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(n):
            for j in range(i):
                bits = np.bitwise_count(fp[i] ^ fp[j])
                if bucket[i] == bucket[j] and bits.sum() <= 136 and bits[:2].sum() <= simhash.QUICK and 4 * max(size[i], size[j]) <= 5 * min(size[i], size[j]) and (not two or left[i] != left[j]):
                    a, b = find(int(node[i])), find(int(node[j]))
                    root[max(a, b)] = min(a, b)
        a, b = simhash._near_stars(bucket, node, fp, size, left, 136, two)
        want = {(find(x), x) for x in root if find(x) != x}
        assert want and len(want) < n - 4 and set(zip(a.tolist(), b.tolist(), strict=True)) == want
