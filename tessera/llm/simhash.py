"""SimHash near-duplicates: exact comparison of fingerprints in tiles.

Fingerprints within a small radius agree on at least one of radius + 1 bit blocks, so they are dealt by
block value. A crowded bucket is cut into tiles by bands of population counts, a band as wide as the radius
(a band with too many prints into several tiles); only tiles of one band or of neighbouring ones are brought
together, all others differ beyond the radius by their counts alone, and compared by exclusive-or and bit
count. A tile pair returns a spanning forest of its links, never all pairs, so a group of n copies costs
about n rows.

Where the prints carry the size of their shingle set, only sizes that allow the similarity ``SHARE`` are
compared and bands are of sizes. Many blocks are dealt a few at a time, so that the disk holds the rows of those.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, table, unstage

#: Fingerprints of one bucket that one task compares with each other; larger buckets are cut into tiles.
TILE = 4096
#: Fingerprints a task group gathers from many small buckets.
GROUP = 50_000
#: Tiles of prints with sizes, of which a print meets few, are so many times as large.
SIZED = 4
#: Blocks that are dealt at once, and rows up to which all are.
AT_ONCE = 14
FEW_ROWS = 2_000_000
#: Share of bits that differ, on average, between near copies of few shingles, those furthest apart.
APART = 96 / 512
#: Bits of the first 128 in which near copies differ at most: 24 with a deviation of 4.4 at ``APART``.
QUICK = 52
#: Crowded buckets up to which their table is broadcast; more are joined by a shuffle.
MOST_BROADCAST = 20_000
#: Bytes kept of each shingle hash of a set.
HASH_BYTES = 6
#: Bytes of shingle hashes in a tile; a task compares two tiles.
SET_BYTES = 16 << 20
#: Least similarity of near copies, as a fraction.
SHARE = (4, 5)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Further hashes of the same shingles, mixed from the first."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles, in order; a text of fewer words is one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    spans = list(zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(spans))


def fingerprint_of(text: str | None, words: int, lanes: int = 1, distinct: bool = False) -> bytes:
    """``lanes`` times 64 bits, each set if set in over half of the shingle hashes; ``distinct`` counts a
    repeated shingle once."""
    hashes = _shingles(text, words)
    return _majority(np.unique(hashes) if distinct else hashes, lanes)


def _majority(hashes: np.ndarray, lanes: int) -> bytes:
    out = b""
    for lane in range(lanes):
        h = hashes if lane == 0 else _lane(hashes, lane)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 65_536):
            ones += np.unpackbits(h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def fingerprint(text: Column, words: int = 4, lanes: int = 1, distinct: bool = False) -> Column:
    """SimHash of a text's word shingles as a binary column."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words, lanes, distinct) for t in texts])

    return of(text)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The first HASH_BYTES bytes of sorted hashes, each once."""
    return np.unique(hashes >> np.uint64(64 - 8 * HASH_BYTES))


def _prints(text: Column, words: int, lanes: int) -> Column:
    """Struct of fp (SimHash over distinct shingles), size (number of their short hashes) and sid (128 bits of the
    whole ones)."""

    @F.pandas_udf("fp binary, size int, sid binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = np.unique(_shingles(t, words))
            rows.append((_majority(hashes, lanes), len(_short(hashes)), xxhash.xxh3_128_digest(hashes.astype(">u8").tobytes())))
        return pd.DataFrame(rows, columns=["fp", "size", "sid"])

    return of(text)


def _hashes(text: Column, words: int) -> Column:
    """Sorted short hashes of a text's shingles, as bytes."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        sets = [_short(np.unique(_shingles(t, words))).astype(">u8") for t in texts]
        return pd.Series([h.view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes() for h in sets], dtype=object)

    return of(text)


def _set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def _forest(fp: np.ndarray, left: np.ndarray, radius: int, two: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between rows of ``fp`` (rows, lanes); where ``two`` tiles
    meet (``left`` marks the rows of one), only links across them count. Rows come by population count."""
    pops = np.bitwise_count(fp).sum(axis=1).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    fp, pops, left = fp[order], pops[order], left[order]
    if two and left.all() == left.any():
        return []
    lo, hi = np.searchsorted(pops, pops - radius, "left"), np.searchsorted(pops, pops + radius, "right")
    free = np.ones(len(fp), bool)
    edges = []
    for root in range(len(fp)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            a, b = lo[i], hi[i]
            near = free[a:b] & (np.bitwise_count(fp[a:b] ^ fp[i]).sum(axis=1) <= radius)
            if two:
                near &= left[a:b] != left[i]
            for j in (np.flatnonzero(near) + a).tolist():
                free[j] = False
                edges.append((int(order[i]), int(order[j])))
                todo.append(j)
    return edges


def _stars(node: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges between the same rows' nodes, each tree of a forest as a star around its smallest node: trees of one
    group that several buckets hold then have most edges in common."""
    root = np.arange(len(node))
    for i, j in edges:  # a tree's edges come from its root outwards
        root[j] = root[i]
    least: dict[int, int] = {}
    for _, j in edges:
        r = int(root[j])
        least[r] = min(least.get(r, int(node[r])), int(node[j]))
    out = [(least[int(root[j])], int(node[j])) for _, j in edges] + [(low, int(node[r])) for r, low in least.items()]
    return [(a, b) for a, b in out if a != b]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows that the pairs (a, b) connect one label, the smallest of their rows, in place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _near_stars(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, size: np.ndarray, left: np.ndarray, radius: int, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between rows of one bucket whose sizes allow the similarity ``SHARE``, each connected
    group as a star around its smallest node; where ``two`` tiles meet, only links across them count.

    Rows stand by bucket and size; each is held against the first after it, then the second, and so on while any
    size allows it. Rows that are connected already are not compared again.
    """
    top, bottom = SHARE
    order = np.lexsort((size, bucket))
    bucket, node, fp, size, left = bucket[order], node[order], fp[order], size[order], left[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rank = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(bucket)]))))
    step = int(size.max()) * bottom + 1
    last = np.searchsorted(rank * step + size, rank * step + size * bottom // top, "right") - 1
    quick = [np.ascontiguousarray(fp[:, lane]) for lane in range(2)] if fp.shape[1] > 2 else []
    label, row, found, d = np.arange(len(node)), np.flatnonzero(last > np.arange(len(node))), [], 0
    while len(row):
        d += 1
        row = row[last[row] >= row + d]
        a = row[label[row] != label[row + d]]
        if two:
            a = a[left[a] != left[a + d]]
        if quick:
            a = a[sum(np.bitwise_count(q[a] ^ q[a + d]) for q in quick) <= QUICK]
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]).sum(axis=1) <= radius]
        if len(a):
            found.append((a, a + d))
        if found and (d & (d - 1) == 0 or d % 64 == 0 or not len(row)):
            _join(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
            found = []
    if found:
        _join(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
    least = node.copy()
    np.minimum.at(least, label, node)
    least = least[label]
    return least[least != node], node[least != node]


def _places(bits: int, blocks: int, prints: int) -> list[np.ndarray]:
    """Places of the bits of each of ``blocks`` equal cuts. Where a bucket would then hold over TILE of the ``prints`` on
    average: of wider blocks, over the bits in further orders, and so many that a pair ``APART`` meets as surely."""
    cuts = np.linspace(0, bits, blocks + 1).astype(int)
    equal = [np.arange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    width = min(bits, math.ceil(math.log2(max(1.0, prints / TILE))))
    if width <= bits // blocks:
        return equal
    missed = lambda w: math.log1p(-((1 - APART) ** w))
    need = math.ceil(sum(missed(len(x)) for x in equal) / missed(width))
    fit = bits // width
    orders = [np.random.default_rng(k).permutation(bits) for k in range(-(-need // fit))]
    return [o[i * width : (i + 1) * width] for o in orders for i in range(fit)][:need]


def links(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Edges (a, b), staged, that connect every pair of fingerprints within ``radius`` bits.

    ``prints`` has one row per distinct fingerprint: node (long), fp (binary of 8 bytes a lane). Every
    link is compared exactly in some bucket; edges form a forest in each, with the same components.
    With fewer ``blocks`` than radius + 1, wider ones, a pair at ``blocks`` bits or more is only sure to
    meet where some block is equal. With a column size (of the shingle set; one row per fingerprint and
    size), pairs below the similarity ``SHARE`` may stay unlinked, and blocks get wider with the number of prints.
    """
    blocks = blocks or radius + 1
    n, width = prints.agg(F.count(F.lit(1)), F.max(F.length("fp"))).first()
    width = width or 8
    cuts = _places(8 * width, blocks, n if "size" in prints.columns else 0)
    step = len(cuts) if n * len(cuts) <= FEW_ROWS else AT_ONCE
    found = [_links_of(prints, radius, width, dict(enumerate(cuts[i : i + step], i)), n) for i in range(0, len(cuts), step)]
    if len(found) == 1:
        return found[0]
    edges = stage(reduce(DataFrame.unionByName, found).distinct(), "simhash-edges")
    unstage(*found)
    return edges


def _links_of(prints: DataFrame, radius: int, width: int, cuts: dict[int, np.ndarray], n: int) -> DataFrame:
    """``links`` found by some blocks: the bits of each by its number."""
    sized = "size" in prints.columns
    tile_rows = SIZED * TILE if sized else TILE
    groups = max(1, -(-n * len(cuts) // GROUP))
    first = min(cuts)

    @F.pandas_udf("array<long>")
    def block_values(fps: pd.Series) -> pd.Series:
        if not len(fps):
            return pd.Series([], dtype=object)
        bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
        cols = []
        for cut in cuts.values():
            v = np.zeros(len(fps), np.int64)
            for c in cut:  # a wider block than 64 bits folds; equal blocks stay equal
                v = v * 2 + bits[:, c]
            cols.append(v)
        return pd.Series(list(np.stack(cols, axis=1)))

    own = ["node", "fp", *(["size"] if sized else [])]
    dealt = prints.select(*own, F.posexplode(block_values("fp")).alias("block", "value")).withColumn("block", F.col("block") + first)
    dealt = stage(dealt, "simhash-blocks")
    crowded = dealt.groupBy("block", "value").count().where(F.col("count") > tile_rows).select("block", "value")
    few = n * len(cuts) // tile_rows <= MOST_BROADCAST  # no more buckets than that can be crowded
    crowded = F.broadcast(crowded) if few else crowded
    joined = dealt.join(crowded.withColumn("crowded", F.lit(True)), ["block", "value"], "left")
    alone = joined.where("crowded is null").select(
        *own, F.pmod(F.xxhash64("block", "value"), F.lit(groups)).alias("g"), F.lit("").alias("x"), F.lit("").alias("y"), "block", "value", F.lit(True).alias("left")
    )
    # tiles of a band: so many that each holds about tile_rows prints; sizes of neighbouring bands differ more than ``SHARE`` allows
    lanes = [F.conv(F.hex(F.substring("fp", 1 + 8 * i, 8)), 16, -10).cast("long") for i in range(width // 8)]
    pop = reduce(lambda x, y: x + y, [F.bit_count(lane) for lane in lanes])
    band = F.floor(F.log("size") / math.log(1.05 * SHARE[1] / SHARE[0])) if sized else F.floor(pop / max(radius, 1))
    banded = joined.where("crowded").select(*own, "block", "value", band.alias("band"))
    parts = banded.groupBy("block", "value", "band").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"))
    near = parts.select("block", "value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other"), F.col("parts").alias("others"))
    meets = near.groupBy("block", "value", "band").agg(F.collect_list(F.struct("other", "others")).alias("near"))  # three at most
    placed = banded.join(F.broadcast(parts) if few else parts, ["block", "value", "band"]).join(meets, ["block", "value", "band"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = placed.select("*", mine.alias("t"), F.explode("near").alias("m")).select("*", F.explode(F.sequence(F.lit(0), F.col("m.others") - 1)).alias("o"))
    here, there = F.struct("band", "t"), F.struct(F.col("m.other").alias("band"), F.col("o").alias("t"))
    name = lambda tile: F.concat_ws(".", tile["band"], tile["t"])
    paired = placed.select(
        *own, F.xxhash64("block", "value").alias("g"), name(F.least(here, there)).alias("x"), name(F.greatest(here, there)).alias("y"), "block", "value", (here <= there).alias("left")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        two = rows["x"].iloc[0] != rows["y"].iloc[0]
        if sized:
            fp = np.frombuffer(b"".join(rows["fp"]), ">u8").reshape(len(rows), -1).astype(np.uint64)
            bucket = rows.groupby(["block", "value"], sort=False).ngroup().to_numpy()
            a, b = _near_stars(bucket, rows["node"].to_numpy(), fp, rows["size"].to_numpy().astype(np.int64), rows["left"].to_numpy(), radius, two)
            return pd.DataFrame({"a": a, "b": b})
        for _, b in rows.groupby(["block", "value"], sort=False):
            if len(b) > 1:
                fp = np.frombuffer(b"".join(b["fp"]), ">u8").reshape(len(b), -1).astype(np.uint64)
                node = b["node"].to_numpy()
                found += _stars(node, _forest(fp, b["left"].to_numpy(), radius, two))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    edges = stage(alone.unionByName(paired).groupBy("g", "x", "y").applyInPandas(compare, "a bigint, b bigint").distinct(), "simhash-edges")
    unstage(dealt)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Large-star and small-star rounds: every round hangs nodes on smaller neighbours, writes the edges
    to the shared folder, and ends when a round changes none. Joins and aggregates only; a hub's many
    edges are rows, never a list.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = stage(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), "edges")
    unstage(edges)

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())

    state = mark(e)
    while state[0]:
        nb = both(e)
        least = nb.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = nb.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_min.select("a", F.col("m").alias("b")))
        after = stage(small.distinct(), "edges")
        unstage(e)
        e, now = after, mark(after)
        if now == state:
            break
        state = now
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _alike_forest(fp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As ``_forest``, but an edge also needs an exact Jaccard similarity of ``SHARE`` of the rows' sets."""
    top, bottom = SHARE
    sizes = np.array([len(s) for s in sets])
    two = left.any() and not left.all()
    free = np.ones(len(fp), bool)
    edges = []
    for root in range(len(fp)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            near = free & (sizes * bottom >= sizes[i] * top) & (sizes[i] * bottom >= sizes * top)
            if two:
                near &= left != left[i]
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(fp[at] ^ fp[i]).sum(axis=1) <= radius]
            for c in range(0, len(at), 256):
                some = at[c : c + 256]
                held = np.concatenate([sets[j] for j in some])
                place = np.minimum(np.searchsorted(sets[i], held), sizes[i] - 1)
                starts = np.cumsum(sizes[some]) - sizes[some]
                common = np.add.reduceat(sets[i][place] == held, starts, dtype=np.int64)
                for j in some[common * bottom >= (sizes[i] + sizes[some] - common) * top].tolist():
                    free[j] = False
                    edges.append((i, j))
                    todo.append(j)
    return edges


def alike(sets: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between sets of one candidate group at exact Jaccard similarity ``SHARE`` or more.

    ``sets`` is staged and has one row per distinct set: node, root (the group), fp, sh (sorted hashes of
    HASH_BYTES). Small groups share a task; a group beyond ``SET_BYTES`` or ``TILE`` rows is cut into tiles, each
    pair of which returns a forest.
    """
    total = sets.agg(F.count(F.lit(1)), F.sum(F.length("sh"))).first()
    groups = max(1, -(-total[0] // GROUP), -(-(total[1] or 0) // (2 * SET_BYTES)))
    need = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.length("sh")) / SET_BYTES)).cast("int")
    crowded = sets.groupBy("root").agg(need.alias("parts")).where("parts > 1")
    tile = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    few = total[0] // TILE + (total[1] or 0) // SET_BYTES <= MOST_BROADCAST  # no more groups can be crowded
    dealt = sets.join(F.broadcast(crowded) if few else crowded, "root", "left").select("*", tile.alias("t"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("o"))
    rows = dealt.select(
        "node", "root", "fp", "sh",
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root")).alias("g"),
        F.when(F.col("parts").isNull(), -1).otherwise(F.least("t", "o")).alias("x"),
        F.when(F.col("parts").isNull(), -1).otherwise(F.greatest("t", "o")).alias("y"),
        F.coalesce(F.col("t") <= F.col("o"), F.lit(True)).alias("left"),
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, b in frame.groupby("root", sort=False):
            if len(b) > 1:
                fp = np.frombuffer(b"".join(b["fp"]), ">u8").reshape(len(b), -1).astype(np.uint64)
                held = [_set(s) for s in b["sh"]]
                node = b["node"].to_numpy()
                found += _stars(node, _alike_forest(fp, held, b["left"].to_numpy(), radius))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("g", "x", "y").applyInPandas(compare, "a bigint, b bigint").distinct()


def _classes(prints: DataFrame, radius: int, blocks: int | None, node: Column) -> DataFrame:
    """(fp, root) of each distinct fingerprint; ``prints`` is staged and has a column fp."""
    distinct = stage(prints.select("fp").distinct().select("fp", node.alias("node")), "simhash-distinct")
    roots = stage(components(links(distinct, radius, blocks)), "simhash-roots")
    return distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable).

    Texts without words have fingerprint zero and are linked like any other; fewer words than a shingle
    are one shingle. Null ids do not name a component unless it has no other (then null). Repeated rows
    give repeated rows; an empty table gives none; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    marked = stage(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "simhash-prints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _classes(marked, radius, None, F.conv(F.hex("fp"), 16, -10).cast("long")).join(least, "fp")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(component, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, lanes: int = 8, radius: int = 136, blocks: int = 56) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group: the smallest doc_id stays.

    Two texts are linked where the exact Jaccard similarity of their distinct shingles is 0.8 or more. The
    candidates come from fingerprints of 64 bits a lane: groups linked within ``radius`` bits between sets whose
    sizes allow 0.8, found where one of ``blocks`` parts is equal; beyond 512 times TILE sets wider parts, so many that
    a pair meets as surely. By calculation a pair at 0.8 differs in 78 of 512 bits on
    average, in 96 (deviation 9) with 4 and 5 shingles, the most; a pair fails to meet in any part with a chance
    of 1 in a million, of 1 in 10,000 with 4 and 5 shingles. Sets below 4 shingles reach 0.8 only
    when equal. Texts without words are one group. Null ids come last; repeated rows leave one; an
    empty table stays empty; further columns are kept as they are.
    """
    small_batches(docs.sparkSession)
    row = [F.xxhash64(*docs.columns).alias("__h1"), F.xxhash64(F.lit(1), *docs.columns).alias("__h2")]
    marked = stage(docs.select("doc_id", *row, _prints(F.col("text"), words, lanes).alias("p")).select("doc_id", "__h1", "__h2", "p.*"), "keep-prints")
    one = marked.where(F.col("size") >= SHARE[0]).groupBy("sid", "fp", "size").agg(F.min(F.struct("__h1", "__h2")).alias("r"))
    one = stage(one.select("sid", "fp", "size", "r.*"), "simhash-ids")
    distinct = one.groupBy("fp", "size").agg((F.count(F.lit(1)) > 1).alias("several"))
    distinct = stage(distinct.select("*", F.xxhash64("fp", "size").alias("node")), "simhash-distinct")
    near = stage(components(links(distinct.drop("several"), radius, blocks)), "simhash-roots")
    grouped = distinct.join(near, "node", "left").where("several or root is not null").select("fp", "size", F.coalesce("root", "node").alias("root"))
    asked = stage(one.join(grouped, ["fp", "size"]).select(F.xxhash64("sid").alias("node"), "root", "fp", "__h1", "__h2"), "simhash-asked")
    unstage(one)
    # hashes of whole sets are larger than their texts: only those of candidates are made, from one row of each set
    sets = docs.select("text", *row).join(asked, ["__h1", "__h2"]).dropDuplicates(["__h1", "__h2"])
    sets = stage(sets.select("node", "root", "fp", _hashes(F.col("text"), words).alias("sh")), "simhash-sets")
    unstage(asked)
    unstage(distinct, near)
    roots = stage(components(alike(sets, radius)), "simhash-roots")
    unstage(sets)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h1", "__h2")
    per_set = marked.groupBy("sid").agg(F.min(first).alias("f")).select(F.xxhash64("sid").alias("node"), "f")
    kept = per_set.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("f").alias("f")).select("f.__h1", "f.__h2")
    return docs.select("*", *row).join(kept, ["__h1", "__h2"]).dropDuplicates(["__h1", "__h2"]).select(*docs.columns)


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of SimHash components over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
