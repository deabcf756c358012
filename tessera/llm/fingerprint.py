"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text is the multiset of its paragraphs, cut further after punctuation and some words, because most texts are
one paragraph: an edit then changes the pieces it touches and no other. Each piece is hashed to a wide vector
by two independent hashes; a document's fingerprint is the sum of those vectors, lane by lane modulo a power of
two. Order does not matter, and inserting or deleting a piece adds or subtracts its vector. Two groups of lanes:
63 narrow ones that count one bit each of the first hash (their centred values are sums of random signs, so the
cosine of two fingerprints estimates how many pieces two texts share), packed three to a long; and four wide
ones that sum 32 bits of either hash, 128 bits in all, which make unequal multisets differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import range_of, splitters, stage, table, unstage

#: Paragraphs end at line breaks, after punctuation and after words on n or s, so that an edit changes
#: the paragraphs it touches and no other.
PARAGRAPH = r"\n+|(?<=[.!?;:,|ns])\s+"
LANE_BITS = 21
_LANES = 3
_WIDE = 0xFFFFFFFF
_TAKE = sum(1 << (LANE_BITS * i) for i in range(_LANES))
_NARROW = LANE_BITS
_WIDE_LANES = 4
_KEEP = 2**62 - 1
#: Rows of one range that is put in order as a whole.
ROWS_A_RANGE = 20_000


def vector_of(text: Column) -> Column:
    """Sums of a text's paragraph vectors: 21 packed longs, 4 wide lanes, the number of paragraphs."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")
    hashes = F.transform(parts, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(5), p).alias("b")))

    def add(acc: Column, both: Column) -> Column:
        h, g = both["a"], both["b"]
        # 62 bits are kept, so that a further sum stays a long
        narrow = [
            (acc[f"n{i}"] + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_TAKE))).bitwiseAND(F.lit(_KEEP)).alias(f"n{i}") for i in range(_NARROW)
        ]
        low = (acc["w0"] + h.bitwiseAND(F.lit(_WIDE))).bitwiseAND(F.lit(_WIDE)).alias("w0")
        high = (acc["w1"] + F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(_WIDE)).alias("w1")
        more = [
            (acc["w2"] + g.bitwiseAND(F.lit(_WIDE))).bitwiseAND(F.lit(_WIDE)).alias("w2"),
            (acc["w3"] + F.shiftrightunsigned(g, 32)).bitwiseAND(F.lit(_WIDE)).alias("w3"),
        ]
        return F.struct(*narrow, low, high, *more)

    names = [f"n{i}" for i in range(_NARROW)] + [f"w{i}" for i in range(_WIDE_LANES)]
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    sums = F.aggregate(hashes, zero, add)
    # one element, so that the sums are computed once and then taken apart
    return F.element_at(
        F.transform(F.array(F.struct(sums.alias("s"), F.size(parts).cast("long").alias("n"))), lambda x: F.array(*[x["s"][n] for n in names], x["n"])),
        1,
    )


def add_vectors(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets together, or (sign -1) of one without the other. Lanes of a packed
    long do not carry into each other while counts stay below 2**20."""
    return F.zip_with(
        F.zip_with(a, F.sequence(F.lit(0), F.size(a) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        b,
        lambda p, y: F.when(
            (p["i"] >= _NARROW) & (p["i"] < _NARROW + _WIDE_LANES), (p["x"] + sign * y).bitwiseAND(F.lit(_WIDE))
        ).otherwise((p["x"] + sign * y).bitwiseAND(F.lit(_KEEP))),
    )


def text_of(vector: Column) -> Column:
    """A fingerprint as a string: every sum in hexadecimal."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.hex(x))), ".")


def _signs(vector: Column) -> Column:
    """The 63 centred lanes: sums of one random sign for each paragraph."""
    n = F.element_at(vector, _NARROW + _WIDE_LANES + 1)
    packed = F.slice(vector, 1, _NARROW)

    def lane(k: int) -> Column:
        return F.transform(packed, lambda x: 2 * F.shiftrightunsigned(x, LANE_BITS * k).bitwiseAND(F.lit(2**LANE_BITS - 1)) - n)

    return F.concat(*[lane(k) for k in range(_LANES)]).cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprint vectors alone: 1 where they are equal, else the cosine of their lanes."""
    pair = F.array(F.struct(_signs(a).alias("a"), _signs(b).alias("b")))
    cosine = F.element_at(
        F.transform(pair, lambda p: _dot(p["a"], p["b"]) / F.greatest(F.sqrt(_dot(p["a"], p["a"]) * _dot(p["b"], p["b"])), F.lit(1e-9))), 1
    )
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, vector, and those of the next document (by doc_id, nulls first; ties by text hash).

    One shuffle of the texts into ranges of about equal bytes; within a range the next row is a window
    away, and each range's first row, one a range, is handed to the range before it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"),
        F.xxhash64("text").alias("h"),
        (F.octet_length("text") + 64).cast("long").alias("size"),
    )
    keys = stage(keyed.select("k", "h", "size"), "fingerprint-keys")
    stats = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    n = max(8, stats[0] // ROWS_A_RANGE, (stats[1] or 0) // (8 << 20))
    cuts = splitters(keys, "size", ["k", "h"], n)
    r = range_of(["k", "h"], cuts)
    heads = keys.select(r.alias("r"), "k", "h").groupBy("r").agg(F.min(F.struct("k", "h")).alias("m")).collect()
    unstage(keys)
    ranges = sorted((row["r"], row["m"]["k"], row["m"]["h"]) for row in heads)
    # each range's first row goes to the range before it, the very first to the last
    target = {(k, h): ranges[i - 1][0] for i, (_, k, h) in enumerate(ranges)}
    ranged = keyed.withColumn("r", r)
    # the first key of each range, looked up by the range's number
    first = {number: (k, h) for number, k, h in ranges}
    of_range = lambda i: F.element_at(F.lit([first.get(j, (0, 0))[i] for j in range(len(cuts) + 1)]), F.col("r") + 1)
    head_rows = ranged.where((of_range(0) == F.col("k")) & (of_range(1) == F.col("h"))).dropDuplicates(["k", "h"])
    chosen = [(k, h, t) for (k, h), t in target.items()]
    side = docs.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("h"), F.lit(t).alias("to")) for k, h, t in chosen or [(0, 0, 0)]]))
    )
    heads_for = stage(head_rows.join(F.broadcast(side), ["k", "h"]).select("to", F.col("text").alias("head")), "fingerprint-heads")
    rows = ranged.select("doc_id", "text", "k", "h", "r", F.lit(0).alias("extra")).unionByName(
        heads_for.select(
            F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
            F.col("head").alias("text"),
            F.lit(2**63 - 1).alias("k"),
            F.lit(2**63 - 1).alias("h"),
            F.col("to").alias("r"),
            F.lit(1).alias("extra"),
        )
    )
    order = Window.partitionBy("r").orderBy("extra", "k", "h")
    return (
        rows.withColumn("vector", vector_of(F.col("text")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_vector", F.lead("vector").over(order))
        .where("extra = 0")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last half replaced by as many characters from the start of
    the next document. A null text counts as empty, a null doc_id comes first, repeated rows follow one
    another, a single document is its own next one, an empty table gives no rows; extra columns are
    ignored. Lanes count up to 2**20 pieces of a text: of longer ones likeness is an estimate of what is left
    modulo that, while equal texts stay equal.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("left(next_text, cast(floor(n_chars / 2) as int))"))
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    rows = rows.withColumn("edited_vector", vector_of(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("vector")).alias("fingerprint"),
        text_of(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
