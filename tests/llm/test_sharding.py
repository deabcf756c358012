import zlib
from collections import defaultdict

from tessera.llm.sharding import shard


def rows(n=3000):
    out = [(i, "é" * (i % 97) + str(i)) for i in range(n)]
    out += [(10_000 + i, "a hot text " * 20) for i in range(n // 2)]  # a third of all rows share one text
    out += [(20_000 + i, f"pair {i // 2}") for i in range(200)]
    return out + [(1, "é1"), (1, "é1"), (None, None), (None, ""), (5, None)]


def test_bytes_law_slots_and_sizes(spark):
    docs = rows()
    got = shard(spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, shard int")).collect()
    want = sorted((d is not None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    slots, size, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(abs(s - mean) for s in size.values()) <= 250 + mean * 0.01
    hot = zlib.crc32(("a hot text " * 20).encode())
    assert sum(len(s) > 1 for c, s in where.items() if c != hot) <= 1  # only the hot text is cut


def test_empty_and_tiny(spark):
    schema = "doc_id long, text string"
    assert shard(spark.createDataFrame([], schema)).count() == 0
    assert [(r.shard < 24, r.slot) for r in shard(spark.createDataFrame([(1, "x")], schema)).collect()] == [(True, 0)]
