"""Benchmark decontamination by winnowing.

Every document keeps the smallest k-gram hash of each sliding window of words; so does every
benchmark item. A span of ``window`` words that both hold keeps the same k-gram in both, so joining
the two fingerprint sets finds every such span; each hit is then extended along its diagonal and
counts only where ``window`` consecutive words are equal.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import small_batches, table

#: Bytes of benchmark text that one pass holds in a Python worker; more items take more passes.
MAX_BLOCK_BYTES = 16 << 20
GRAM = 5

#: ASCII bytes outside [0-9a-z] part words; A-Z are lowered; every byte from 0x80 on belongs to a word.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word ids; a gram with an unknown word (id 0) is the largest value."""
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)
        known &= part > 0
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[~known] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return h


def _winnow(ids: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the leftmost smallest gram of each window of ``w`` grams."""
    h = _grams(ids, k)
    if len(h) < w:
        return h[:0], np.zeros(0, np.int64)
    picks = np.unique(np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(len(h) - w + 1))
    picks = picks[h[picks] != np.uint64(0xFFFFFFFFFFFFFFFF)]
    return h[picks], picks


class BenchmarkIndex:
    """Fingerprints of a bounded block of benchmark items, sent to the tasks."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 13):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.ids: list[np.ndarray] = []
        by_length: dict[int, list[int]] = defaultdict(list)
        for name, text in items:
            words = words_of(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                by_length[min(window, len(words))].append(len(self.ids))
                self.ids.append(ids)
                self.names.append("" if name is None else str(name))
        self.classes = []
        for m, members in sorted(by_length.items()):
            k = min(GRAM, m)
            parts = [(*_winnow(self.ids[i], k, m - k + 1), i) for i in members]
            h = np.concatenate([p[0] for p in parts])
            order = np.argsort(h, kind="stable")
            item = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
            self.classes.append((m, k, h[order], item[order], np.concatenate([p[1] for p in parts])[order]))

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """(number of words, which words are hit, ids of the items found) of one whole text."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        hit = np.zeros(len(ids), bool)
        found: set[int] = set()
        if not self.classes or not len(ids):
            return len(words), hit, []
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        runs = edges.reshape(-1, 2)
        for m, k, fps, items, places in self.classes:
            for a, b in runs[runs[:, 1] - runs[:, 0] >= m]:
                part = ids[a:b]
                h, at = _winnow(part, k, m - k + 1)
                lo, hi = np.searchsorted(fps, h, "left"), np.searchsorted(fps, h, "right")
                pairs = {(int(items[x]), int(p - places[x])) for p, s, e in zip(at, lo, hi, strict=True) for x in range(s, e)}
                for i, shift in pairs:
                    other = self.ids[i]
                    s, e = max(0, shift), min(len(part), shift + len(other))
                    same = np.flatnonzero(
                        np.diff(np.concatenate(([0], (part[s:e] == other[s - shift : e - shift]).view(np.int8), [0])))
                    ).reshape(-1, 2)
                    for x, y in same[same[:, 1] - same[:, 0] >= m]:
                        hit[a + s + x : a + s + y] = True
                        found.add(i)
        return len(words), hit, [self.names[i] for i in found]


def _scanner(spark: SparkSession, items: list[tuple], window: int):
    shared = spark.sparkContext.broadcast(BenchmarkIndex(items, window))

    @F.pandas_udf("struct<n_words:bigint,hits:binary,items:array<string>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.scan(t) for t in texts]
        return pd.DataFrame(
            {
                "n_words": [r[0] for r in rows],
                "hits": [np.packbits(r[1]).tobytes() if r[1].any() else b"" for r in rows],
                "items": [r[2] for r in rows],
            }
        )

    return scan


@F.pandas_udf(LongType())
def _bits(*parts: pd.Series) -> pd.Series:
    """How many words any of the blocks has hit."""

    def one(row: tuple) -> int:
        got = [np.frombuffer(p, np.uint8) for p in row if p]
        return int(np.bitwise_count(np.bitwise_or.reduce(got)).sum()) if got else 0

    return pd.Series([one(r) for r in zip(*parts, strict=True)], dtype="int64")


def scan_columns(
    spark: SparkSession, text: Column, benchmark: DataFrame, window: int = 13, max_block_bytes: int = MAX_BLOCK_BYTES
) -> tuple[Column, Column, Column]:
    """Columns (n_words, n_hit, sorted ids of the items found) of a text against the whole benchmark.

    The benchmark goes to the tasks in blocks of at most about ``max_block_bytes`` of text (measured
    first); a larger benchmark takes more blocks, each a further pass over the text inside one task,
    so no row moves and nothing is left out.
    """
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    n = max(1, -(-size // max_block_bytes))
    if n == 1:
        blocks = [items.collect()]
    else:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        blocks = [items.where(part == b).collect() for b in range(n)]
    found = [_scanner(spark, [tuple(r) for r in b], window)(text) for b in blocks]
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found]))))
    return found[0]["n_words"], _bits(*[f["hits"] for f in found]), ids


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    A document is contaminated when at least a twentieth of its words is hit. Null or empty texts
    have no words; a null item id counts as the empty string; an empty benchmark hits nothing;
    repeated documents get equal rows. Other columns of either table are ignored.
    """
    n_words, n_hit, items = scan_columns(docs.sparkSession, F.col("text"), benchmark, window, **options)
    # one projection a level, so that the scan runs once
    found = docs.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", is_contaminated().alias("contaminated")
    )


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, **options) -> DataFrame:
    """``docs`` that are not contaminated, as they are; see ``contamination``."""
    n_words, n_hit, _ = scan_columns(docs.sparkSession, F.col("text"), benchmark, window, **options)
    found = docs.select(*docs.columns, F.struct(n_words.alias("n_words"), n_hit.alias("n_hit")).alias("__found"))
    return found.where(~is_contaminated("__found.n_words", "__found.n_hit")).select(*docs.columns)


# Every window of every item against every place of every document, by equal strings.
ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
sized as (select item, ws, least(13, len(ws)) as m from b where len(ws) > 0),
windows as (select distinct item, m, array_to_string(ws[i:i + m - 1], ' ') as k from (select item, ws, m, unnest(range(1, len(ws) - m + 2)) as i from sized)),
lengths as (select distinct m from sized),
places as (select r, m, i, array_to_string(ws[i:i + m - 1], ' ') as k from (select r, ws, m, unnest(range(1, len(ws) - m + 2)) as i from d, lengths where len(ws) >= m)),
hits as (select p.r, p.i, p.m, w.item from places p join windows w on w.m = p.m and w.k = p.k),
words as (select r, count(distinct pos) as n from (select r, unnest(range(i, i + m)) as pos from (select distinct r, i, m from hits)) group by r),
items as (select r, list_sort(list(distinct item)) as found from hits group by r)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(w.n, 0)::bigint as n_hit, coalesce(len(i.found), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(i.found, ','), '')) as items_sha256, coalesce(w.n, 0) > 0 and 20 * coalesce(w.n, 0) >= len(d.ws) as contaminated
from d left join words w on w.r = d.r left join items i on i.r = d.r
"""


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of benchmark decontamination over all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
