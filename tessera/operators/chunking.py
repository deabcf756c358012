"""Content-defined chunks: an edit changes the chunks it touches, and the cuts after it come back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that decide whether a place is a cut.
WINDOW = 32
_CHUNK = "doc_id bigint, seq bigint, offset bigint, n bigint, hash string"


def cuts(raw: np.ndarray, least: int, mean: int, most: int) -> list[int]:
    """Ends of the chunks of ``raw``: the first place at ``least`` bytes or more whose rolling hash of the last
    WINDOW bytes is 0 modulo ``mean`` (a power of two), or ``most`` bytes on."""
    if not len(raw):
        return []
    # a byte's value in the hash, from a rule; the window's hash by doubling
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    span = 1
    while span < WINDOW:
        older = np.concatenate((np.zeros(min(span, len(h)), np.uint64), h[:-span]))
        h = h + older * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64))
        span *= 2
    places = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + 1
    out, start, n = [], 0, len(raw)
    while start < n:
        i = int(np.searchsorted(places, start + least))
        end = int(places[i]) if i < len(places) else n
        start = min(end, start + most, n)
        out.append(start)
    return out


def content_chunks(docs: DataFrame, least: int = 256, mean: int = 512, most: int = 2048) -> DataFrame:
    """Chunks of whole texts as UTF-8 bytes: doc_id, seq, offset, n, hash. Null and empty texts have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ends = np.array(cuts(np.frombuffer(raw, np.uint8), least, mean, most), np.int64)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
                hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(ends), pa.int64()), pa.array(np.arange(len(ends))), pa.array(starts), pa.array(ends - starts), pa.array(hashes, pa.string())],
                    ["doc_id", "seq", "offset", "n", "hash"],
                )

    return docs.select("doc_id", "text").mapInArrow(find, _CHUNK)
