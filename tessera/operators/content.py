"""Content addressing, text inspection, catalogue and maintenance operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The marks that open a conflict section in a text.
MARKERS = ("<<<<<<< ", ">>>>>>> ", "||||||| ")


def chunks(docs: DataFrame, size: int = 256) -> DataFrame:
    """Fixed-size chunks of whole texts: doc_id, seq, offset, n, hash. Empty texts have none."""
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass over the text
    cut = docs.select("doc_id", F.posexplode(pieces).alias("at", "piece"))
    return cut.select(
        "doc_id", F.col("at").cast("long").alias("seq"), (F.col("at") * size).cast("long").alias("offset"), F.length("piece").cast("long").alias("n"), F.sha2("piece", 256).alias("hash")
    )


def dedup_stats(parts: DataFrame) -> DataFrame:
    """How many chunks and characters there are, and how many are left when equal chunks are stored once."""
    once = parts.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    return once.agg(
        F.sum("m").alias("chunks"),
        F.count(F.lit(1)).alias("distinct_chunks"),
        F.sum(F.col("m") * F.col("n")).alias("chars"),
        F.sum("n").alias("stored_chars"),
    )


def match_level(docs: DataFrame) -> DataFrame:
    """Best match of each document among those of smaller id: full (same source), partition (same lang), hash, none."""
    keyed = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    # the first holder at each level, found by aggregates, so that a large group of copies makes no pairs
    first = lambda name, *keys: keyed.groupBy(*keys).agg(F.min("doc_id").alias(name))
    joined = keyed
    for name, keys in (("full", ["hash", "lang", "source"]), ("part", ["hash", "lang"]), ("any", ["hash"])):
        joined = joined.join(first(name, *keys), keys, "left")
    level = F.when(F.col("full") < F.col("doc_id"), "full").when(F.col("part") < F.col("doc_id"), "partition").when(F.col("any") < F.col("doc_id"), "hash")
    return joined.select("doc_id", level.otherwise("none").alias("level"))


def normalize(text: Column) -> Column:
    """Lines that end in a line feed alone, without blanks before it."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n")


def inspect(docs: DataFrame) -> DataFrame:
    """Per text: number of lines, of conflict markers, whether it looks binary, hash of its normal form."""
    lines = F.split(F.col("text"), "\n")
    marked = lambda x: F.startswith(x, F.lit(MARKERS[0])) | F.startswith(x, F.lit(MARKERS[1])) | F.startswith(x, F.lit(MARKERS[2]))
    return docs.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, marked)).cast("long").alias("n_markers"),
        F.contains(F.col("text"), F.lit("\x00")).alias("is_binary"),
        F.sha2(normalize(F.col("text")), 256).alias("normal_hash"),
    )


def line_changes(docs: DataFrame) -> DataFrame:
    """Lines that each document adds to and drops from the one before it by id, as multisets."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    ids = docs.select("doc_id")
    both = lines.select("doc_id", "line", "n").unionByName(lines.select((F.col("doc_id") + 1).alias("doc_id"), "line", (-F.col("n")).alias("n")))
    net = both.groupBy("doc_id", "line").agg(F.sum("n").alias("d"))
    sums = net.groupBy("doc_id").agg(
        F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("dropped")
    )
    return ids.join(sums, "doc_id")


def evict(store: DataFrame, percent: int = 20) -> DataFrame:
    """Rows of ``store`` (bucket, key, size, last_access) at or below each bucket's cut-off: the access time of its
    (count * percent / 100)-th oldest row. Ties at the cut-off all go. Windows run over counts by access time."""
    times = store.groupBy("bucket", "last_access").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("last_access"))
    total = F.sum("n").over(Window.partitionBy("bucket"))
    ranked = times.withColumn("before", upto - F.col("n")).withColumn("quota", F.floor(total * percent / 100))
    gone = ranked.where("before < quota").select("bucket", "last_access")
    return store.join(gone, ["bucket", "last_access"]).select("bucket", "key", "size", "last_access")


def compaction(store: DataFrame, evicted: DataFrame, below: float = 0.8) -> DataFrame:
    """Per bucket: bytes, live bytes, and whether its share of live bytes calls for repacking."""
    dead = evicted.groupBy("bucket").agg(F.sum("size").alias("dead"))
    sizes = store.groupBy("bucket").agg(F.sum("size").alias("total")).join(dead, "bucket", "left")
    live = F.col("total") - F.coalesce("dead", F.lit(0))
    return sizes.select("bucket", "total", live.alias("live"), (live < F.col("total") * below).alias("repack"))


def lock_state(events: DataFrame, acquire: str, release: str) -> DataFrame:
    """Latest lock event of each resource: resource, owner, locked, since."""
    at = F.struct("ts", "event_id")
    last = events.where(F.col("event_type").isin(acquire, release)).groupBy(F.col("props").alias("resource")).agg(
        F.max_by(F.struct("user_id", "event_type", "ts"), at).alias("e")
    )
    return last.select("resource", F.col("e.user_id").alias("owner"), (F.col("e.event_type") == acquire).alias("locked"), F.col("e.ts").alias("since"))
