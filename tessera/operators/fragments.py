"""Stored fragments: reading ranges back, lists of references, validation, verification, copies, deletion, repacking.

``fragments``: partition, hash, context, data; ``lists``: name, offset, hash, size (of the referenced content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def references(parts: DataFrame) -> DataFrame:
    """Lists of more than one chunk (name, offset, hash, size); content in one chunk needs none."""
    size = parts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return parts.join(size, "name", "left_semi").select("name", "offset", "hash", "size")


def nested(lists: DataFrame, fan_out: int) -> DataFrame:
    """Lists of more than ``fan_out`` references with a level of lists in between: level, name, offset, hash, size.
    Level 0 rows are the given ones under the name of their group, level 1 rows refer to the groups by the hash of
    their references; a list that fits stays on level 0 under its own name."""
    order = Window.partitionBy("name").orderBy("offset")
    placed = lists.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    fits = placed.where(F.col("n") <= fan_out).select(F.lit(0).alias("level"), "name", "offset", "hash", "size")
    grouped = placed.where(F.col("n") > fan_out).withColumn("g", F.floor(F.col("place") / fan_out))
    heads = grouped.groupBy("name", "g").agg(
        F.min("offset").alias("offset"), F.sum("size").alias("size"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "hash"))), lambda x: x["hash"]), ","), 256).alias("hash")
    )
    inner = grouped.join(heads.select("name", "g", F.col("hash").alias("head")), ["name", "g"]).select(F.lit(0).alias("level"), F.col("head").alias("name"), "offset", "hash", "size")
    outer = heads.select(F.lit(1).alias("level"), "name", "offset", "hash", "size")
    return fits.unionByName(inner).unionByName(outer)


def list_faults(lists: DataFrame, content: DataFrame) -> DataFrame:
    """The first rule each list breaks, or null. ``lists``: name, pos, offset; ``content``: name, first, size.

    A list has two references or more, at growing offsets, the last inside the content.
    """
    before = F.lag("offset").over(Window.partitionBy("name").orderBy("pos"))
    seen = lists.withColumn("before", before).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("offset") <= F.col("before")).cast("int")).alias("back"), F.max_by("offset", "pos").alias("last")
    )
    fault = F.when(F.col("n") < 2, "fewer than two").when(F.col("back") == 1, "not growing").when(F.col("last") >= F.col("first") + F.col("size"), "outside content")
    return seen.join(content, "name").select("name", fault.alias("fault"))


def read_ranges(lists: DataFrame, fragments: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (request, name, low, high) with the content of that range: request, data.

    Ranges are clamped to the content, one behind its end is empty. Only chunks that a range meets are joined with
    their data, each cut to it before it is put in order. ``fragments``: hash, data (text).
    """
    met = asked.join(lists, "name").where((F.col("offset") < F.col("high")) & (F.col("offset") + F.col("size") > F.col("low")))
    joined = met.join(fragments.select("hash", "data"), "hash")
    start = F.greatest(F.lit(0), F.col("low") - F.col("offset"))
    piece = F.substring(F.col("data"), (start + 1).cast("int"), (F.col("high") - F.col("offset") - start).cast("int"))
    pieces = joined.select("request", F.struct("offset", piece.alias("piece")).alias("p"))
    whole = pieces.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("data"))
    return asked.select("request").join(whole, "request", "left").select("request", F.coalesce("data", F.lit("")).alias("data"))


def stream(lists: DataFrame, fragments: DataFrame, asked: DataFrame) -> DataFrame:
    """The chunks of whole contents in order: name, place, data; a chunk is a row, so nothing is gathered."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("offset")) - 1
    return lists.join(asked.select("name"), "name", "left_semi").withColumn("place", place).join(fragments.select("hash", "data"), "hash").select("name", "place", "data")


def resolved(keys: DataFrame, fragments: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (key) through its value, a hash, to the content: key, hash, data."""
    return asked.join(keys.select("key", F.col("value").alias("hash")), "key", "left").join(fragments.select("hash", "data"), "hash", "left").select("key", "hash", "data")


def rehash_faults(fragments: DataFrame) -> DataFrame:
    """Fragments whose content doesn't have the hash that names them."""
    return fragments.select("hash", F.sha2("data", 256).alias("found")).where("hash <> found")


def offset_faults(packed: DataFrame) -> DataFrame:
    """Hashes that one pack file holds at several offsets: pack, hash, places."""
    return packed.groupBy("pack", "hash").agg(F.countDistinct("at").alias("places")).where("places > 1")


def verify_tree(nodes: DataFrame, fragments: DataFrame) -> DataFrame:
    """What is wrong with nodes (node, parent, name, name_hash, hash): no parent, no content, wrong name hash, a name
    that a sibling has too. Columns: node, fault."""
    ids = nodes.select(F.col("node").alias("parent"))
    lost = nodes.where("parent is not null").join(ids, "parent", "left_anti").select("node", F.lit("no parent").alias("fault"))
    empty = nodes.join(fragments.select("hash"), "hash", "left_anti").select("node", F.lit("no content").alias("fault"))
    wrong = nodes.where(F.col("name_hash") != name_hash(F.col("name"))).select("node", F.lit("name hash").alias("fault"))
    twice = nodes.groupBy("parent", F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    alike = nodes.alias("n").join(twice.alias("t"), F.col("n.parent").eqNullSafe(F.col("t.parent")) & (F.lower("n.name") == F.col("t.key")))
    return lost.unionByName(empty).unionByName(wrong).unionByName(alike.select("n.node", F.lit("same name").alias("fault")))


def name_hash(name: Column) -> Column:
    """The key by which siblings are compared, without case."""
    return F.sha2(F.lower(name), 256)


def copy_associations(store: DataFrame, asked: DataFrame) -> DataFrame:
    """``store`` (partition, hash, context) with rows for hashes that are stored in some partition: no content moves."""
    known = store.select("hash").distinct()
    new = asked.join(known, "hash", "left_semi").join(store, ["partition", "hash", "context"], "left_anti").distinct()
    return store.unionByName(new.select("partition", "hash", "context"))


def obliterate(store: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, statistics): asked addresses (hash, context) become tombstones without payload; the payload of a hash
    counts as gone where no other row has it."""
    hit = asked.select("hash", "context", F.lit(True).alias("hit")).distinct()
    marked = store.join(hit, ["hash", "context"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    after = marked.select("partition", "hash", "context", F.when(F.col("hit"), 0).otherwise(F.col("size")).cast("long").alias("size"), (F.col("hit") | F.col("obliterated")).alias("obliterated"))
    by_hash = marked.groupBy("hash").agg(
        F.sum((F.col("hit") & ~F.col("obliterated")).cast("int")).alias("n"), F.max((~F.col("hit") & ~F.col("obliterated")).cast("int")).alias("left")
    )
    stats = by_hash.agg(F.sum("n").alias("fragments"), F.sum(((F.col("n") > 0) & (F.col("left") == 0)).cast("int")).alias("payloads"))
    return after, stats


def repack(packed: DataFrame, live: DataFrame) -> DataFrame:
    """A pack's live payloads (pack, at, hash, size) laid out anew, each hash once: pack, hash, size, new_at.

    Offsets are running sums within a pack; packs are bounded files, so a window over one is bounded too.
    """
    once = packed.join(live.select("hash"), "hash", "left_semi").groupBy("pack", "hash").agg(F.min("at").alias("at"), F.max("size").alias("size"))
    order = Window.partitionBy("pack").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return once.select("pack", "hash", "size", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("new_at"))


def evict_durable(store: DataFrame, capacity: int, percent: int, buckets: int) -> DataFrame:
    """Rows (bucket, key, last_access, durable) that leave: in each bucket the oldest of those stored elsewhere, until
    no more than the bucket's target is left; ties at the cut-off all go.

    The target is capacity * percent / (100 * 256 * buckets), in whole numbers; a percentage out of range counts as 80.
    """
    share = percent if 0 < percent <= 100 else 80
    target = capacity * share // (100 * 256 * buckets)
    size = store.groupBy("bucket").agg(F.count(F.lit(1)).alias("total")).withColumn("quota", F.col("total") - target).where("quota > 0")
    times = store.where("durable").groupBy("bucket", "last_access").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("last_access"))
    gone = times.withColumn("before", upto - F.col("n")).join(size, "bucket").where("before < quota").select("bucket", "last_access")
    return store.where("durable").join(gone, ["bucket", "last_access"]).select("bucket", "key", "last_access")


def collect_garbage(store: DataFrame, max_size: int, percent: int) -> DataFrame:
    """One full pass over rows (key, size, last_access): whether each is kept. Nothing goes below ``max_size`` bytes in
    all; else the newest stay up to percent / 100 of it, equal times together."""
    total = store.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    times = store.groupBy("last_access").agg(F.sum("size").alias("size"))
    # running sums over access times in two steps: within ranges of time, then over the ranges
    ranged = times.withColumn("r", F.floor(F.col("last_access") / 64))
    heads = ranged.groupBy("r").agg(F.sum("size").alias("s"))
    above = heads.select("r", F.coalesce(F.sum("s").over(Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("newer"))
    within = F.sum("size").over(Window.partitionBy("r").orderBy(F.desc("last_access")))
    sums = ranged.join(above, "r").select("last_access", (F.col("newer") + within).alias("upto"))
    target = max_size * percent // 100
    return store.join(sums, "last_access").select("key", (F.lit(total < max_size) | (F.col("upto") <= target)).alias("kept"))


def tiered(tiers: list[DataFrame]) -> DataFrame:
    """Each hash from the first of several tiers (hash, data) whose content has that hash: hash, tier, data."""
    ranked = None
    for i, tier in enumerate(tiers):
        sound = tier.where(F.sha2("data", 256) == F.col("hash")).select("hash", F.lit(i).alias("tier"), "data")
        ranked = sound if ranked is None else ranked.unionByName(sound)
    best = ranked.groupBy("hash").agg(F.min_by(F.struct("tier", "data"), "tier").alias("b"))
    return best.select("hash", "b.tier", "b.data")
