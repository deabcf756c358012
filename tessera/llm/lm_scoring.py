"""Language-model scores by stupid backoff, computed relationally.

Every distinct word pair of a document is an entry; entries travel in cells, one row for all those of a batch of
documents that go to one part. Pairs are dealt to parts by the hash of a rare word that they hold, else of the
pair, and the counts of the rare words are dealt alike: so one sorted pass over a part counts each pair in the
whole corpus, knows its words' counts and compares them with the document's own; a pair that no other document
holds backs off to its second word. Counts of frequent words and pairs, of which there can only be a bounded
number, are broadcast beforehand, so no key is hot. Pairs of two rare words get the count of the first by a join;
a sum per document ends it. A document's own words never count as evidence for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import small_batches, stage, table, unstage

BACKOFF = 0.4
#: Words, or pairs, that make up this share of all are at most 1 / FREQUENT many, so their counts are broadcast.
FREQUENT = 2e-6
#: The parts are worked through in so many slices; the entries on disk at once are that share of
#: all entries, which are as many as there are words, so disk is in a fixed proportion to the input.
SLICES = 2
#: So many bytes of text make a part: a Python worker holds the pairs, some 600,000, of one part at a time.
PART_BYTES = 4_000_000
_START = 0  # stands before the first word of every document

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first so many bytes of eight.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its text), words being parted by ASCII white space, without case."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    buffer = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buffer], [True])).view(np.int8)))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    padded = np.concatenate((_LOWER[buffer], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buffer) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    h = _mix((eight[begin] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    longer, at = np.flatnonzero(size > 8), 8
    while len(longer):
        more = eight[begin[longer] + at] & _MASK[np.minimum(size[longer] - at, 8)]
        h[longer] = _mix(h[longer] * _ODD + more)
        at += 8
        longer = longer[size[longer] > at]
    h = h.view(np.int64)
    h[h == _START] = 1
    return h, np.searchsorted(ends, begin, "right")


def _pair(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(p.view(np.uint64) * _ODD + w.view(np.uint64)).view(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in a sorted table, else -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key in a sorted table, else -1."""
    at = _find(keys, wanted)
    return np.where(at >= 0, values[at], -1) if len(keys) else at


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((_mix(keys.view(np.uint64)) >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def _cells(to: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each part: its number and, for each column, the values that go there, in order."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else np.zeros(1, np.int64)
    packed = [
        pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])])
        for x in columns.values()
    ]
    return pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]], pa.int32()), *packed], ["to", *columns])


def _entries(cells: pa.Table | pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    """All values of one column of cells."""
    return np.frombuffer(b"".join(cells.column(name).to_pylist()), kind)


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts[order], start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)


def _before(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before each word, whether it's the first of its text)."""
    first = np.concatenate(([True], doc[1:] != doc[:-1]))[: len(h)]
    return np.where(first, _START, np.concatenate(([_START], h[:-1]))[: len(h)]), first


def _count_words(parts: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc = words_of(batch.column(0).to_pylist())
            codes, keys = pd.factorize(h)
            keys, counts = np.append(keys, _START), np.append(np.bincount(codes, minlength=len(keys)), len(np.unique(doc)))
            yield _cells(_part(keys, parts), {"key": keys, "c": counts.astype(np.int32)})

    return find


def _add_words(cells: pa.Table) -> pa.Table:
    """Words of one part with their counts, in order, and the number of words in all."""
    keys, counts = _totals(_entries(cells, "key", np.int64), _entries(cells, "c", np.int32))
    return pa.table({"to": cells.column("to")[:1], "key": [keys.tobytes()], "c": [counts.tobytes()], "total": [int(counts[keys != _START].sum())]})


def _unpack(least: float, most: float):
    """Rows of the words whose counts are ``least`` or more and below ``most``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = _entries(batch, "key", np.int64), _entries(batch, "c", np.int64)
            some = (counts >= least) & (counts < most)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some])], ["key", "c"])

    return find


def _count_pairs(frequent, parts: int):
    """Counts of pairs of two frequent words; no other pair can be frequent."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = frequent.value
        start = _find(words, np.array([_START]))[0] >= 0
        for batch in batches:
            h, doc = words_of(batch.column(0).to_pylist())
            codes, keys = pd.factorize(h)
            often = (_find(words, keys) >= 0)[codes]
            p, first = _before(h, doc)
            both = often & np.where(first, start, np.concatenate(([False], often[:-1]))[: len(h)])
            codes, pairs = pd.factorize(_pair(p[both], h[both]))
            yield _cells(_part(pairs, parts), {"key": pairs, "c": np.bincount(codes, minlength=len(pairs)).astype(np.int32)})

    return find


def _add_pairs(least: float):
    def find(cells: pa.Table) -> pa.Table:
        keys, counts = _totals(_entries(cells, "key", np.int64), _entries(cells, "c", np.int32))
        return pa.table({"key": keys[counts >= least], "c": counts[counts >= least]})

    return find


#: An entry is a distinct pair of a document ``d``: ``n`` how often; ``pi`` and ``wi`` the places of its words among the
#: frequent ones, else -1; ``r`` the word it is dealt by where one is rare, ``q`` the first where both are; ``op`` and
#: ``ow`` how often the document holds each. Beside them ``kd``, ``ks`` and ``km``: documents, what their pairs
#: of known counts sum up to, and how many words of theirs the slice has.
_ENTRY = {"d": np.int64, "r": np.int64, "q": np.int64, "pi": np.int32, "wi": np.int32, "n": np.int32, "op": np.int32, "ow": np.int32}
_KNOWN = {"kd": np.int64, "ks": np.float64, "km": np.int64}


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1).astype(float))


def _pairs(frequent, total: int, backoff: float, parts: int, slices: int, which: int):
    """Cells of one slice of the parts, which it numbers from 0; pairs whose counts are all known are summed up here."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, word_counts, pairs, pair_counts = frequent.value
        start = _find(words, np.array([_START]))[0]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            h, doc = words_of(batch.column(1).to_pylist())
            if not len(h):
                continue
            codes, keys = pd.factorize(h)
            wi = _find(words, keys)[codes]
            held, _ = pd.factorize(doc * len(keys) + codes)  # a word of a document
            own = np.bincount(held)[held]
            p, first = _before(h, doc)
            shift = lambda x, start: np.where(first, start, np.concatenate(([0], x[:-1])))
            pi, op = shift(wi, start), shift(own, 1)
            b = _pair(p, h)
            to = _part(np.where(wi < 0, h, np.where(pi < 0, p, b)), parts)
            at = np.flatnonzero(to % slices == which)
            same, _ = pd.factorize((shift(held, -1) + 1)[at] * (len(held) + 1) + held[at])
            n = np.bincount(same)
            one = np.empty(len(n), np.int64)
            one[same[::-1]] = at[::-1]  # the first place of each distinct pair
            both = np.flatnonzero((pi[one] >= 0) & (wi[one] >= 0))
            c = np.full(len(one), -1, np.int64)
            c[both] = _lookup(pairs, pair_counts, b[one[both]])
            done = np.flatnonzero(c >= 0)
            i, m = one[done], n[done]
            back = math.log(backoff) + _log(word_counts[wi[i]] - own[i]) - math.log(max(total, 1))
            value = m * np.where(c[done] > m, _log(c[done] - m) - _log(word_counts[pi[i]] - op[i]), back)
            number = np.bincount(doc[at], minlength=batch.num_rows)
            some = np.flatnonzero(number)
            known = (ids[some], np.bincount(doc[i], weights=value, minlength=batch.num_rows)[some], number[some])
            left = c < 0
            i, n = one[left], n[left]
            rare_p, rare_w = pi[i] < 0, wi[i] < 0
            row = (ids[doc[i]], np.where(rare_w, h[i], np.where(rare_p, p[i], 0)), np.where(rare_w & rare_p, p[i], 0), pi[i], wi[i], n, op[i], own[i])
            entries = _cells(to[i] // slices, {name: x.astype(kind) for (name, kind), x in zip(_ENTRY.items(), row, strict=True)})
            spread = int(_part(h[:1], parts // slices)[0])
            for cells, columns in ((entries, _ENTRY), (_cells(np.full(len(some), spread), {k: x.astype(_KNOWN[k]) for k, x in zip(_KNOWN, known, strict=True)}), _KNOWN)):
                empty = pa.array([b""] * cells.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([cells.column("to"), *(cells.column(k) if k in columns else empty for k in (*_ENTRY, *_KNOWN))], ["to", *_ENTRY, *_KNOWN])

    return find


#: What a part returns to its documents: sums ``s`` and numbers of words ``m``; pairs that lack the count of a rare first word ``p``.
_SUM = {"d": np.int64, "s": np.float64, "m": np.int64}
_LATE = {"ld": np.int64, "p": np.int64, "n": np.int32, "own": np.int32}


def _score(frequent, total: int, backoff: float, doc_parts: int):
    """Values of the pairs of one part, beside whose cells stand the counts of its words."""

    def find(cells: pa.Table, unigrams: pa.Table) -> pa.Table:
        words, word_counts = frequent.value[:2]
        keys, key_counts = _entries(unigrams, "key", np.int64), _entries(unigrams, "c", np.int64)
        d, r, q, pi, wi, n, op, ow = (_entries(cells, name, kind) for name, kind in _ENTRY.items())
        kd, ks, km = (_entries(cells, name, kind) for name, kind in _KNOWN.items())
        rare_p, rare_w = pi < 0, wi < 0
        rare = np.flatnonzero(rare_p | rare_w)
        cr = np.zeros(len(d), np.int64)
        cr[rare] = _lookup(keys, key_counts, r[rare])
        of = lambda table, i, is_rare, other: np.where(is_rare, other, table[i] if len(table) else 0)
        pair = _pair(of(words, pi, rare_p, np.where(rare_w, q, r)), of(words, wi, rare_w, r))
        order = np.argsort(pair)
        pair = pair[order]
        edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True]))) if len(pair) else np.zeros(1, np.int64)
        c = np.empty(len(d), np.int64)
        c[order] = np.repeat(np.add.reduceat(n[order], edge[:-1], dtype=np.int64), np.diff(edge)) if len(pair) else 0
        del pair, order
        seen = c > n
        late = np.flatnonzero(seen & rare_p & rare_w)
        context = of(word_counts, pi, rare_p, cr) - op
        context[late] = 1  # the join divides by it
        back = math.log(backoff) + _log(of(word_counts, wi, rare_w, cr) - ow) - math.log(max(total, 1))
        value = n * np.where(seen, _log(c - n) - _log(context), back)
        codes, docs = pd.factorize(np.concatenate((d, kd)))
        sums = np.bincount(codes, weights=np.concatenate((value, ks)), minlength=len(docs))
        number = np.bincount(codes[len(d) :], weights=km, minlength=len(docs)).astype(np.int64)
        out = []
        for x, columns in ((dict(zip(_SUM, (docs, sums, number), strict=True)), _SUM), (dict(zip(_LATE, (d[late], q[late], n[late], op[late]), strict=True)), _LATE)):
            found = _cells(_part(next(iter(x.values())), doc_parts), x)
            empty = pa.array([b""] * found.num_rows, pa.binary())
            out.append(pa.RecordBatch.from_arrays([found.column("to"), *(found.column(k) if k in columns else empty for k in (*_SUM, *_LATE))], ["to", *_SUM, *_LATE]))
        return pa.Table.from_batches(out)

    return find


def _add_documents(cells: pa.Table) -> pa.Table:
    """A row for each document, and one for each late pair of one."""
    d, s, m = (_entries(cells, name, kind) for name, kind in _SUM.items())
    late = [_entries(cells, name, kind) for name, kind in _LATE.items()]
    codes, docs = pd.factorize(d)
    sums, number = np.bincount(codes, weights=s, minlength=len(docs)), np.bincount(codes, weights=m, minlength=len(docs))
    x, y = np.zeros(len(late[0]), np.int64), np.zeros(len(docs), np.int64)
    is_late = np.concatenate((np.zeros(len(docs), bool), np.ones(len(late[0]), bool)))
    return pa.table(
        {
            "d": np.concatenate((docs, late[0])), "s": np.concatenate((sums, x)), "m": np.concatenate((number.astype(np.int64), x)),
            "p": pa.array(np.concatenate((y, late[1])), mask=~is_late), "n": np.concatenate((y, late[2])), "own": np.concatenate((y, late[3])),
        }
    )


def _broadcast_table(spark: SparkSession, *frames: DataFrame):
    """Sorted keys and counts of frames of at most 1 / FREQUENT rows each."""
    out = []
    for frame in frames:
        rows = frame.toArrow()
        keys, counts = (rows.column(i).to_numpy() for i in (0, 1))
        order = np.argsort(keys)
        out += [keys[order], counts[order]]
    return spark.sparkContext.broadcast(tuple(out))


def _dealt(cells: DataFrame, parts: int):
    """Cells by part, one part a task, so that a task reads no more however large the input is."""
    return cells.repartitionById(parts, F.col("to")).groupBy("to")


def _binary(*columns: dict[str, type]) -> str:
    return ", ".join(["to int", *(f"{name} binary" for some in columns for name in some)])


def scores(
    docs: DataFrame, backoff: float = BACKOFF, slices: int = SLICES, frequent: float = FREQUENT, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, score (mean natural log of the words' scores).

    With c the counts in all other documents and N all words: a word after p scores c(p, w) / c(p) where
    that pair occurs elsewhere, else ``backoff`` * max(c(w), 1) / N. Words are parted by ASCII white
    space and compared without case (ASCII), by 64-bit hashes: two words that share one count as one. Null
    and empty texts have no words and score 0; repeated rows are documents of their own and score alike; an
    empty table gives no rows; extra columns are ignored. A very long text is one row of a small batch.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000, "3m")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    per_id = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("text")).alias("size"))
    repeats, size = per_id.agg(F.count_if((F.col("copies") > 1) | F.col("doc_id").isNull()), F.sum("size")).first()
    # a document goes by its id, or by a hash of id and text where some ids repeat or are no numbers
    simple = not repeats and isinstance(docs.schema["doc_id"].dataType, IntegralType)
    keyed = plain.select("doc_id", (F.col("doc_id").cast("long") if simple else F.xxhash64("doc_id", "text")).alias("d"), "text")
    each = 1 + (size or 0) // (part_bytes * slices)  # parts of a slice
    parts = each * slices
    texts, counts = keyed.select("text"), _binary({"key": 0, "c": 0})
    counted = _dealt(texts.mapInArrow(_count_words(parts), counts), parts).applyInArrow(_add_words, f"{counts}, total bigint")
    unigrams = stage(counted, "lm-words")
    total = unigrams.agg(F.sum("total")).first()[0] or 0
    least = max(1.0, total * frequent)
    words = unigrams.select("key", "c").mapInArrow(_unpack(least, math.inf), "key bigint, c bigint")
    both = texts.mapInArrow(_count_pairs(_broadcast_table(spark, words), each), counts)
    pairs = stage(_dealt(both, each).applyInArrow(_add_pairs(least), "key bigint, c bigint"), "lm-pairs")
    tables = _broadcast_table(spark, words, pairs)

    done = []
    for i in range(slices):
        cells = keyed.select("d", "text").mapInArrow(_pairs(tables, total, backoff, parts, slices, i), _binary(_ENTRY, _KNOWN))
        beside = unigrams.where(F.col("to") % slices == i).select(F.expr(f"int(to div {slices})").alias("to"), "key", "c")
        valued = _dealt(cells, each).cogroup(_dealt(beside, each)).applyInArrow(_score(tables, total, backoff, each), _binary(_SUM, _LATE))
        summed = _dealt(valued, each).applyInArrow(_add_documents, "d bigint, s double, m bigint, p bigint, n bigint, own bigint")
        done.append(stage(summed, "lm-sums"))
    sums = reduce(DataFrame.unionByName, done)
    # a pair that others hold too has a first word that occurs twice at least
    rare = unigrams.select("key", "c").mapInArrow(_unpack(2, least), "key bigint, c bigint")
    late = sums.where("p is not null").join(rare.withColumnRenamed("key", "p"), "p")
    less = (-F.col("n") * F.log(F.greatest(F.col("c") - F.col("own"), F.lit(1)).cast("double"))).alias("s")
    per_doc = sums.where("p is null").select("d", "s", "m").unionByName(late.select("d", less, F.lit(0).cast("long").alias("m")))
    known = per_doc.groupBy("d").agg(F.sum("s").alias("s"), F.sum("m").alias("words"))
    ids = keyed.select("doc_id", "d")
    if simple:
        known = known.withColumn("copies", F.lit(1))
    else:
        known = known.join(ids.groupBy("d").agg(F.count(F.lit(1)).alias("copies")), "d")
    known = stage(known, "lm-documents")
    unstage(unigrams, pairs, *done)
    return ids.join(known, "d", "left").select(
        "doc_id",
        F.coalesce((F.col("words") / F.col("copies")).cast("long"), F.lit(0)).alias("n_words"),
        F.round(F.coalesce(F.col("s") / F.col("words"), F.lit(0.0)), 6).alias("score"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT r, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '') AS p FROM t),
words AS (SELECT w, count(*) AS c FROM t GROUP BY w UNION ALL SELECT '', count(DISTINCT r) FROM t),
own_words AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w UNION ALL SELECT DISTINCT r, '', 1 FROM t),
own AS (SELECT r, p, w, count(*) AS n FROM s GROUP BY r, p, w),
pairs AS (SELECT p, w, sum(n) AS c FROM own GROUP BY p, w),
scored AS (
  SELECT o.r, o.n, o.n * CASE WHEN pairs.c > o.n THEN ln((pairs.c - o.n)::DOUBLE) - ln(greatest(wp.c - op.c, 1)::DOUBLE)
         ELSE ln(0.4) + ln(greatest(ww.c - ow.c, 1)::DOUBLE) - ln((SELECT count(*) FROM t)::DOUBLE) END AS s
  FROM own o JOIN pairs USING (p, w) JOIN words wp ON wp.w = o.p JOIN own_words op ON op.r = o.r AND op.w = o.p
  JOIN words ww ON ww.w = o.w JOIN own_words ow ON ow.r = o.r AND ow.w = o.w),
per AS (SELECT r, sum(s) AS s, sum(n) AS n FROM scored GROUP BY r)
SELECT d.doc_id, coalesce(per.n, 0)::BIGINT AS n_words, round(coalesce(per.s / per.n, 0.0), 6) AS score
FROM d LEFT JOIN per USING (r)
"""


def op1_stupid_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents against all other documents."""
    return scores(table(spark, sf_dir, "documents"))
