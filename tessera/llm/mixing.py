"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of copies. The whole part is
taken; the fraction is rounded by the pivotal method: two documents trade probability, weighted by
their sizes so that the words stay the same, until one of them is certain; the other goes on. Each
chunk of a source leaves one undecided document, and those meet in the next level of a reduction tree.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents that one task rounds in one group, and undecided ones that meet in a node of the tree.
CHUNK = 2_000
FAN_IN = 1_000
#: Source rows up to which their table is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 50_000
_EPS = 1e-9
_STATE = "doc_id bigint, source string, size bigint, part bigint, source_size bigint, target double, nodes bigint, node bigint, whole int, p double, copies int"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, n, target. Sources share all words by weight; a target stops at
    MAX_REPEATS times its source's words and the rest is shared again among the others.

    With sources ordered by words a weight unit, the stopped ones come first; both windows run over
    the table of sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        .select("*", weight.cast("double").alias("w"))
        .withColumn("most", F.col("source_size").cast("double") * MAX_REPEATS)
    )
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unit = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    ranked = sources.withColumn("unit", unit).withColumn("open", F.col("most") >= F.col("unit") * F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), "unit"))).over(everything)["unit"]
    share = F.coalesce(F.least(F.col("most"), level * F.col("w")), F.col("most"))
    return ranked.select("source", "source_size", "n", share.alias("target"))


def _settle(copies: list, whole: list, size: list, free: list[bool], lacking: float) -> None:
    """Turn rounded rows over, largest first (rows come by size), while that brings ``lacking`` words nearer to none.
    Where no row on the needed side is small enough, the smallest one there is turned first, if that helps."""

    def fits(x: int, way: int) -> bool:
        return free[x] and copies[x] == whole[x] + (way < 0)

    def fill(left: float) -> tuple[float, list[tuple[int, int]]]:
        turned = []
        for x in range(len(size) - 1, -1, -1):
            way = 1 if left > 0 else -1
            if fits(x, way) and size[x] < 2 * abs(left):
                copies[x] += way
                left -= way * size[x]
                turned.append((x, way))
        return left, turned

    lacking, _ = fill(lacking)
    way = 1 if lacking > 0 else -1
    first = next((x for x in range(len(size)) if fits(x, way)), None)
    if first is not None and abs(lacking) > 1:
        copies[first] += way
        left, turned = fill(lacking - way * size[first])
        if abs(left) >= abs(lacking):
            for x, w in [*turned, (first, way)]:
                copies[x] -= w


def _round(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pivotal rounding of one group of one source; at most one row is left undecided, none at the top.

    At the top the last row is rounded by its probability; the words that this adds or lacks are made up for by
    the other rows that were rounded, so that what is left over is less than a small document.
    """
    rows = rows.sort_values(["size", "doc_id", "part"], kind="stable").reset_index(drop=True)
    rng = random.Random(repr(tuple(None if pd.isna(k) else k for k in key)))
    size, whole, p = rows["size"].tolist(), rows["whole"].tolist(), rows["p"].tolist()
    copies: list[int | None] = [None] * len(rows)
    open_rows = [_EPS < x < 1 - _EPS and n > 0 for x, n in zip(p, size, strict=True)]
    held = None
    for j in range(len(rows)):
        if size[j] <= 0 or p[j] <= _EPS or p[j] >= 1 - _EPS:
            copies[j] = whole[j] + (p[j] >= 1 - _EPS)
            continue
        if held is None:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # words that i can take from j
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if rng.random() * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        held = None
        for x in (i, j):
            if p[x] <= _EPS or p[x] >= 1 - _EPS:
                copies[x] = whole[x] + (p[x] >= 0.5)
            else:
                held = x
    if held is not None and rows["nodes"].iloc[0] <= 1:
        copies[held] = whole[held] + (rng.random() < p[held])
        _settle(copies, whole, size, [x and i != held for i, x in enumerate(open_rows)], (whole[held] + p[held] - copies[held]) * size[held])
    return rows.assign(p=p, copies=pd.array(copies, dtype="Int32"))


def copies_of(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size, part) with source_size, target and the number of copies taken.

    ``part`` tells apart documents that share an id. A hot source is many chunks, so no group grows
    with the data; each level of the tree has a thousandth of the rows of the one before. Chunks and
    their random numbers come from hashes, so a re-run agrees.
    """
    sizes = stage(sizes, "mix-sizes")
    goals = stage(targets(sizes), "mix-targets")
    known = goals.agg(F.count(F.lit(1)), F.max("n")).first()
    wide, most = known[0], known[1] or 0
    side = F.broadcast(goals) if wide <= BROADCAST_SOURCES else goals
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = (
        sizes.join(side, sizes["source"].eqNullSafe(goals["source"]))
        .drop(goals["source"])
        .withColumn("nodes", F.ceil(F.col("n") / CHUNK))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "size", "part"), F.col("nodes")))
        .withColumn("whole", F.floor(rate + _EPS).cast("int"))
        .withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole")))
        .withColumn("copies", F.lit(None).cast("int"))
        .select(*[c.split()[0] for c in _STATE.split(", ")])
    )
    decided, nodes = None, -(-most // CHUNK)
    while True:
        level = stage(state.groupBy("source", "nodes", "node").applyInPandas(_round, _STATE), "mix-level")
        done = level.where("copies is not null")
        decided = done if decided is None else decided.unionByName(done)
        if nodes <= 1:
            break
        state = (
            level.where("copies is null")
            .withColumn("nodes", F.ceil(F.col("nodes") / FAN_IN))
            .withColumn("node", F.floor(F.col("node") / FAN_IN))
        )
        nodes = -(-nodes // FAN_IN)
    return decided.select("doc_id", "source", "size", "part", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``taken`` is ``copies`` times ``size``; copies are 0 to MAX_REPEATS. Null and empty texts have size
    0 and take nothing; a null source is a source, the last; a source without words has target 0;
    repeated rows are rounded each on its own; an empty table gives no rows. Extra columns are ignored.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).cast("long").alias("part"))
    return copies_of(sizes).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with their own columns.

    Rows equal in every column are rounded one by one and come out as often as all of them together.
    """
    row = [F.xxhash64(*docs.columns).alias("__h1"), F.xxhash64(F.lit(1), *docs.columns).alias("__h2")]
    equal = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row)
    equal = equal.groupBy("doc_id", "source", "size", "__h1", "__h2").agg(F.count(F.lit(1)).alias("m"))
    # an equal row's number is part of its hash, so that hashes tell the rows apart
    numbered = stage(
        equal.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("again")).select(
            "doc_id", "source", "size", "__h1", "__h2", F.xxhash64("__h1", "__h2", "again").alias("part")
        ),
        "mix-rows",
    )
    taken = copies_of(numbered.select("doc_id", "source", "size", "part")).where("copies > 0").select("part", "copies")
    total = numbered.join(taken, "part").groupBy("__h1", "__h2").agg(F.sum("copies").cast("int").alias("__n"))
    joined = docs.select("*", *row).join(total, ["__h1", "__h2"]).dropDuplicates(["__h1", "__h2"])
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).select(*docs.columns)


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of mixing all documents to their sources' weights."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
