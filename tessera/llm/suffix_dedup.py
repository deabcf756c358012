"""Removal of repeated byte strings by suffix arrays.

A string of ``length`` bytes is dealt by its anchor: the smallest hash among the short byte grams that
lie inside it, a function of the string alone, so equal strings meet in one shard. Only anchors that
occur more than once go on, and equal stretches around them are kept once, with their number. Two equal
strings in different stretches share their anchor and a flank of it, 116 bytes in all, on one side at least;
a stretch that shares neither flank with a different one is settled by its number. Each shard joins its stretches and sorts all suffixes by induced sorting: suffixes are classified, the
leftmost-smaller substrings are sorted by the same method, one level down, and the rest is induced from
them. Permuted common prefixes, carried over from one place to the next, then part the sorted suffixes
into classes that share ``length`` bytes; a start whose class counts twice is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import small_batches, stage, table, unstage

LENGTH = 200
GRAM = 32
#: Bytes of one long text that are anchored at a time; places within it fit in 21 bits.
SLICE = 1 << 20
#: Bytes of text that one shard's suffix array covers.
SHARD_BYTES = 2 << 20
#: Different stretches under one anchor, or parts of one core, beyond which they are dealt again, by longer keys.
HOT = 2_000
#: Widths of the parts that stretches under a crowded anchor are cut into, the last being single strings.
PARTS = (21, 4, 1)


# ---------------------------------------------------------------- suffix array


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (the last, an end mark, counts as smaller)."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        up, same = t[:-1] < t[1:], t[:-1] == t[1:]
        # a run of equal symbols takes the type of what follows it
        at = np.where(same, n - 1, np.arange(n - 1))
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = np.append(up, True)[nxt]
    return s


def _induce_waves(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Suffix array from sorted leftmost-smaller suffixes where symbols are few: each symbol's bucket is
    scanned in waves, a wave being what the one before has put into the same bucket."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    counts = np.bincount(t, minlength=k)
    first = np.concatenate(([0], np.cumsum(counts)))
    heads, tails = first[:-1].copy(), first[1:].copy()
    symbols = np.flatnonzero(counts)

    def put(found: np.ndarray, forward: bool) -> None:
        c = t[found]
        order = np.argsort(c, kind="stable")  # symbols of 16 bits are sorted by radix
        found, c = found[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        sizes = np.diff(np.concatenate((at, [len(c)])))
        rank = np.arange(len(c)) - np.repeat(at, sizes)
        if forward:
            sa[heads[c] + rank] = found
            heads[c[at]] += sizes
        else:
            sa[tails[c] - 1 - rank] = found
            tails[c[at]] -= sizes

    put(seeds[::-1], False)
    seeded = tails.copy()
    for c in symbols.tolist():
        lo, done = first[c], first[c]
        while done < heads[c]:  # larger-type suffixes of this symbol, as they arrive
            j = sa[done : heads[c]] - 1
            done = heads[c]
            j = j[j >= 0]
            j = j[~s[j]]
            if len(j):
                put(j, True)
        j = sa[max(seeded[c], lo) : first[c + 1]] - 1
        j = j[j >= 0]
        j = j[~s[j]]
        if len(j):
            put(j, True)
    # forget the seeds, then induce the smaller-type suffixes from the right
    tails[:] = first[1:]
    for c in symbols[::-1].tolist():
        done = first[c + 1]
        while done > tails[c]:
            j = sa[tails[c] : done][::-1] - 1
            done = tails[c]
            j = j[j >= 0]
            j = j[s[j]]
            if len(j):
                put(j, False)
        j = sa[first[c] : heads[c]][::-1] - 1
        j = j[j >= 0]
        j = j[s[j]]
        if len(j):
            put(j, False)
    return sa


def _induce_each(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The same where symbols are many and buckets small: one suffix at a time."""
    n = len(t)
    first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=k))))
    # the symbol of the suffix that a suffix induces, or -1; place n stands for an empty slot
    before = np.concatenate(([0], t[:-1])).astype(np.int64)
    larger = np.concatenate(([False], ~s[:-1]))
    smaller = np.concatenate(([False], s[:-1]))
    sa = np.full(n, n, np.int64)
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    c = t[seeds]
    at = np.flatnonzero(np.concatenate((c[1:] != c[:-1], [True])))  # the last seed of each symbol
    sa[first[c + 1] - 1 - (np.repeat(at, np.diff(np.concatenate(([-1], at)))) - np.arange(len(c)))] = seeds
    slots, heads, induced = sa.tolist(), first[:-1].tolist(), np.append(np.where(larger, before, -1), -1).tolist()
    for j in slots:  # sees what is put further on meanwhile
        c = induced[j]
        if c >= 0:
            at = heads[c]
            slots[at] = j - 1
            heads[c] = at + 1
    # the larger-type suffixes and the end mark stay; read from the right, the others are put anew
    sa = np.array(slots, np.int64)
    sa[(sa < n) & np.append(s, False)[sa]] = n
    sa[0] = n - 1
    slots, tails, induced = sa[::-1].tolist(), (n - first[1:]).tolist(), np.append(np.where(smaller, before, -1), -1).tolist()
    for j in slots:
        c = induced[j]
        if c >= 0:
            at = tails[c]
            slots[at] = j - 1
            tails[c] = at + 1
    return np.array(slots[::-1], np.int64)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffixes of ``t`` in order. ``t`` ends with a 0 that occurs nowhere else; symbols are below ``k``."""
    n = len(t)
    few = n > 64 * k
    t = t.astype(np.uint16 if few and k <= 1 << 16 else np.int64)
    induce = _induce_waves if few else _induce_each
    s = _types(t)
    left = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(left) < 2:
        return induce(t, s, left, k)
    sa = induce(t, s, left, k)  # orders the leftmost-smaller substrings
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = sa[is_left[sa]]
    length = np.zeros(n, np.int64)
    length[left[:-1]] = np.diff(left) + 1
    length[left[-1]] = 1
    a, b = order[:-1], order[1:]
    differ = length[a] != length[b]
    same = np.flatnonzero(~differ)
    depth = 0
    while len(same):
        same = same[depth < length[a[same]]]
        bad = t[a[same] + depth] != t[b[same] + depth]
        differ[same[bad]] = True
        same = same[~bad]
        depth += 1
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate(([0], np.cumsum(differ)))
    reduced = names[left]
    count = int(reduced.max()) + 1
    if count == len(left):
        ranked = np.empty(len(left), np.int64)
        ranked[reduced] = np.arange(len(left))
    else:
        ranked = suffix_array(reduced, count)
    return induce(t, s, left[ranked], k)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, lanes: int = 1 << 14) -> np.ndarray:
    """Permuted common prefixes: for each place of ``text`` (which ends with a symbol of its own), the bytes,
    up to ``most``, that its suffix shares with the one before it in ``sa``.

    In text order each value is at least the one before less one, so it's carried over and only ever
    extended; ``lanes`` places of the text, far apart, go forward together.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[2:]] = sa[1:-1]  # the first of ``sa`` is the end mark, which shares nothing
    width = -(-n // lanes)
    room = np.concatenate((text, np.zeros(most + 16 + n - len(text), np.uint8)))
    words = np.ndarray(len(room) - 8, "<u8", room.data, strides=(1,))
    out = np.zeros(width * lanes, np.int64)
    starts = np.arange(lanes) * width
    carried = np.zeros(lanes, np.int64)
    for step in range(width):
        here = starts + step
        here = here[here < n]
        other = before[here]
        got = np.maximum(carried[: len(here)] - 1, 0)
        got[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (got < most))
        while len(live):
            x = words[here[live] + got[live]] ^ words[other[live] + got[live]]
            whole = x == 0
            got[live] += np.where(whole, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            live = live[whole & (got[live] < most)]
        carried[: len(here)] = np.minimum(got, most)
        out[here] = carried[: len(here)]
    return out[:n]


def repeated(text: np.ndarray, starts: np.ndarray, weight: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the given starts begin a string of ``length`` bytes that, by weights, occurs twice.

    ``text`` holds stretches, each closed by an end byte that occurs nowhere else in them; a start has
    ``length`` bytes left.
    """
    sa = suffix_array(np.append(text.astype(np.int64) + 1, 0), 257)
    shared = common_prefixes(text, sa, length)
    group = np.cumsum(shared[sa] < length)  # suffixes in order, parted where they share less
    counted = np.zeros(len(sa), np.int64)
    counted[starts] = np.minimum(weight, 2)
    total = np.bincount(group, weights=counted[sa])
    out = np.zeros(len(sa), bool)
    out[sa] = total[group] >= 2
    return out[starts]


# ---------------------------------------------------------------- anchors


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    h, size, base = b.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _flank(h: np.ndarray, at: np.ndarray, side: int, length: int) -> np.ndarray:
    """A hash of the anchor and of the bytes right (1) or left (-1) of it that the nearer half of all strings
    around it hold: from ``h`` at places that cover them. 0 where they don't lie in the text."""
    reach = length - GRAM - (length - GRAM) // 2  # bytes beyond the anchor
    steps = [*range(0, reach, GRAM), reach]
    inside = (at + side * reach >= 0) & (at + side * reach < len(h))
    out = np.full(len(at), side & 3, np.uint64)
    for step in steps:
        out = (out ^ h[np.where(inside, at + side * step, 0)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.where(inside, out | np.uint64(1), np.uint64(0)).view(np.int64)


def anchors(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(hash, first start, number of starts, place, right flank, left flank) of each run of starts that share an
    anchor."""
    out = []
    places = np.uint64((1 << 21) - 1)
    for lo in range(0, max(0, len(b) - length + 1), SLICE):
        part = b[lo : lo + SLICE + length - 1]
        n = len(part) - length + 1
        h = _grams(part)
        # hash and place in one number: its smallest in a window is the leftmost smallest hash
        low = (h & ~places) | np.arange(len(h), dtype=np.uint64)
        w, span = length - GRAM + 1, 1
        while span < w:
            step = min(span, w - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        at = (low[:n] & places).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        place = at[cut]
        out.append((h[place].view(np.int64), cut + lo, np.diff(np.append(cut, n)), place + lo, _flank(h, place, 1, length), _flank(h, place, -1, length)))
    if not out:
        return (np.zeros(0, np.int64),) * 6
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_RUN = "d1 bigint, d2 bigint, first bigint, n bigint, at bigint, anchor bigint, right bigint, left bigint, stretch binary"
_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def _runs(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        digests: list[bytes] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], _NAMES)

        for batch in batches:
            for d1, d2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                h, first, n, at, right, left = anchors(np.frombuffer(raw, np.uint8), length)
                for i in range(0, len(h), 20_000):
                    cut = slice(i, i + 20_000)
                    f, m = first[cut], n[cut]
                    held.append([np.full(len(f), d1), np.full(len(f), d2), f, m, at[cut] - f, h[cut], right[cut], left[cut]])
                    digests += [xxhash.xxh3_128_digest(raw[a : a + k + length - 1]) for a, k in zip(f.tolist(), m.tolist(), strict=True)]
                    if len(digests) >= 20_000:
                        yield batch_of()
                        held, digests = [], []
        if digests:
            yield batch_of()

    return find


def _narrow(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Cut stretches by how far a start lies before its anchor, in steps of ``width``, and keep the parts
    whose common core (the bytes that all strings of the step hold) occurs again.

    ``parts`` has stretch, n (starts), at (the anchor's place within the body), m (how often it occurs), body. A
    part has these and lo (its first start within the stretch), c1 and c2 (two hashes of step and core: equal
    strings lie in parts that share them).
    """
    k = F.explode(F.sequence(F.floor((F.col("at") - F.col("n") + 1) / width), F.floor(F.col("at") / width)))
    cut = parts.select("*", k.alias("k"))
    begin = F.greatest(F.lit(0), F.col("at") - width * (F.col("k") + 1) + 1)
    end = F.least(F.col("n") - 1, F.col("at") - width * F.col("k"))
    core = F.substring("body", (F.col("at") - width * F.col("k") + 1).cast("int"), F.lit(length - width + 1))
    cut = cut.select("*", begin.alias("b"), end.alias("e"), F.xxhash64("k", core).alias("c1"), F.xxhash64(core, "k").alias("c2"))
    again = cut.groupBy("c1", "c2").agg(F.sum("m").alias("s")).where("s > 1").select("c1", "c2")
    return cut.join(again, ["c1", "c2"], "left_semi").select(
        "c1",
        "c2",
        "stretch",
        F.col("b").alias("lo"),
        (F.col("e") - F.col("b") + 1).alias("n"),
        (F.col("at") - F.col("b")).alias("at"),
        "m",
        F.substring("body", (F.col("b") + 1).cast("int"), (F.col("e") - F.col("b") + length).cast("int")).alias("body"),
    )


def spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d1, d2, lo, hi): byte ranges that repeated strings cover. ``texts``: d1, d2 (two hashes of the text),
    text; equal texts share them, each row being an occurrence of its own."""
    runs = stage(texts.where(F.octet_length("text") >= length).mapInArrow(_runs(length), _RUN), "suffix-runs")
    # an anchor that occurs once lies in no repeated string
    often = runs.groupBy("anchor").count().where("count > 1").select("anchor")
    live = stage(runs.join(often, "anchor"), "suffix-live")
    unstage(runs)
    # equal stretches are kept once, with their number
    different = live.groupBy("anchor", "stretch").agg(
        F.min(F.struct("d1", "d2", "first", "n", "at", "right", "left")).alias("r"), F.count(F.lit(1)).alias("m")
    )
    every = stage(different.select("anchor", "stretch", "r.*", "m"), "suffix-stretches")
    # a stretch that shares no flank with a different one holds repeated strings only if it occurs again itself
    flanks = every.select("stretch", F.explode(F.array("right", "left")).alias("flank")).where("flank <> 0")
    shared = flanks.groupBy("flank").count().where("count > 1").select("flank")
    met = stage(flanks.join(shared, "flank").select("stretch").distinct(), "suffix-met")
    settled = every.where("m > 1").join(met, "stretch", "left_anti").select("stretch", F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).alias("hi"))
    settled = stage(settled, "suffix-settled")
    different = stage(every.join(met, "stretch", "left_semi"), "suffix-different")
    unstage(every, met)
    crowded = different.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    body = F.substring(F.col("text").cast("binary"), F.col("first").cast("int") + 1, (F.col("n") + length - 1).cast("int"))
    bodies = stage(
        different.join(crowded, "anchor", "left")
        .join(texts.dropDuplicates(["d1", "d2"]), ["d1", "d2"])
        .select("anchor", "stretch", "n", "at", "m", "hot", body.alias("body")),
        "suffix-bodies",
    )
    unstage(different)
    # under a crowded anchor stretches are cut into parts that are dealt by their core; equal parts are kept once,
    # with their number, and only those of a core that is crowded too are cut into narrower ones
    warm = bodies.where("hot is not null").select("stretch", "n", "at", "m", "body")
    cuts, dealt, hot = [], [], []
    for width in PARTS:
        parts = stage(_narrow(warm, width, length), "suffix-parts")
        each = parts.groupBy("c1", "c2", "body").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.sum("m").alias("m"))
        if width > 1:  # a core of single strings has but one part
            full = each.groupBy("c1", "c2").count().where(F.col("count") > HOT).select("c1", "c2", F.lit(True).alias("full"))
            each = stage(each.join(full, ["c1", "c2"], "left"), "suffix-different")
            hot.append(each)
            warm = each.where("full is not null").select(F.col("body").alias("stretch"), "n", "at", "m", "body")
            each = each.where("full is null")
        cuts.append(parts)
        dealt.append(each.select(F.col("body").alias("stretch"), "n", "m", "body", F.xxhash64("c1", "c2").alias("key"), F.lit(len(dealt)).alias("level")))
    cool = bodies.where("hot is null").select("stretch", "n", "m", "body", F.col("anchor").alias("key"), F.lit(-1).alias("level"))
    whole = reduce(DataFrame.unionByName, dealt, cool)
    total = whole.agg(F.sum(F.col("n") + length)).first()[0] or 0
    whole = whole.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // SHARD_BYTES)))))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        text = np.frombuffer(b"".join(b + b"\xff" for b in rows["body"]), np.uint8)
        sizes = rows["body"].map(len).to_numpy() + 1
        base = np.cumsum(sizes) - sizes
        n = rows["n"].to_numpy()
        owner = np.repeat(np.arange(len(rows)), n)
        into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = repeated(text, base[owner] + into, rows["m"].to_numpy()[owner], length)
        # runs of repeated starts within a stretch
        edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        new = np.append(True, owner[1:] != owner[:-1])
        begin = np.flatnonzero(hit & (new | (edge[:-1] == 1)))
        close = np.append(new[1:], True) | (edge[1:] == -1)
        end = np.flatnonzero(hit & close)
        at = owner[begin]
        return pd.DataFrame({"level": rows["level"].to_numpy()[at], "stretch": rows["stretch"].to_numpy()[at], "lo": into[begin], "hi": into[end]})

    out = "level int, stretch binary, lo bigint, hi bigint"
    found = stage(whole.groupBy("shard").applyInPandas(search, out), "suffix-found")
    # ranges of parts become ranges of what they were cut from, from the narrowest on
    at_level = lambda i: found.where(F.col("level") == i).select("stretch", "lo", "hi")
    ranges = at_level(len(cuts) - 1)
    for i in range(len(cuts) - 1, -1, -1):
        within = ranges.select(F.col("stretch").alias("of"), F.col("lo").alias("b"), F.col("hi").alias("e"))
        parts = cuts[i].withColumnRenamed("body", "of").join(within, "of")
        ranges = parts.select("stretch", (F.col("lo") + F.col("b")).alias("lo"), (F.col("lo") + F.col("e")).alias("hi")).unionByName(at_level(i - 1))
    ranges = stage(ranges.unionByName(settled), "suffix-ranges")
    unstage(bodies, found, settled, *cuts, *hot)
    gone = live.select("d1", "d2", "first", "stretch").join(ranges, "stretch").select(
        "d1", "d2", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + length).alias("hi")
    )
    gone = stage(gone, "suffix-spans")
    unstage(live, ranges)
    return gone


def _cut(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs)."""
    mark = np.zeros(len(raw) + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    gone = np.cumsum(mark)[:-1] > 0
    runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


@F.pandas_udf(
    StructType(
        [
            StructField("n_removed", LongType()),
            StructField("n_spans", LongType()),
            StructField("kept", BinaryType()),
        ]
    )
)
def cut(texts: pd.Series, los: pd.Series, his: pd.Series) -> pd.DataFrame:
    """What is left of each text without its ranges."""
    rows = []
    for text, lo, hi in zip(texts, los, his, strict=True):
        kept, n, runs = _cut(text.encode("utf-8", "surrogatepass"), np.array(lo, np.int64), np.array(hi, np.int64))
        rows.append((n, runs, kept))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the
    same document or another; all strings are judged on the input. A null text counts as empty;
    repeated rows repeat each other, so long ones lose everything; an empty table gives no rows; extra
    columns are ignored. A very long text is anchored slice by slice and comes back as one row.
    """
    small_batches(docs.sparkSession, 200)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    gone = spans(rows.select("d1", "d2", "text"), length)
    # the ranges of equal texts, and those of one start after another, are the same rows
    gone = gone.distinct().groupBy("d1", "d2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = rows.join(gone, ["d1", "d2"], "left")
    none = F.array().cast("array<bigint>")
    done = joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut("text", F.coalesce("lo", none), F.coalesce("hi", none)).alias("x"))
    return done.select("doc_id", "n_bytes", "x.n_removed", "x.n_spans", "x.kept")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of repeated-string removal over all documents."""
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
