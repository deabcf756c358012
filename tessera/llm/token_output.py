"""Token-ID output in training order.

Documents are encoded with a given vocabulary and concatenated, an end token after each; the stream is
cut into sequences of equal length; a keyed Feistel permutation (walked until it stays inside the
range) gives every sequence a global slot; slots are dealt to tasks by ranges of shards, in order, each shard
being a run of slots with records of fixed stride, so slot s is at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The word pattern and the end token that belong to this public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
SEQUENCE = 2048
SEQUENCES_A_SHARD = 2048
KEY = 0x5EED
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each sequence 0..n-1: a bijection of that range decided by the key."""
    bits = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = np.asarray(x, np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = out >= np.uint64(n)  # fewer than three in four lie outside, so the walk is short
    return out.astype(np.int64)


def load_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, part, start (first token within the part), n, ids (uint16, little endian).

    A null text is encoded as an empty one: its end token only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.array([*encoder.encode_ordinary(t or ""), END], "<u2") for t in batch.column(1).to_pylist()]
            n = [len(x) for x in ids]
            starts = start + np.concatenate(([0], np.cumsum(n)))[:-1] if n else np.zeros(0, np.int64)
            start += sum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "part", "start", "n", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        encode, "doc_id bigint, part int, start bigint, n bigint, ids binary"
    )


def materialise(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    sequence: int = SEQUENCE,
    per_shard: int = SEQUENCES_A_SHARD,
    key: int = KEY,
) -> DataFrame:
    """One row per sequence: slot, shard, byte_offset, seq, n_tokens, doc_ids, ids (fixed stride).

    Sequences are numbered in the order in which Spark reads the documents; the encoded stream is
    staged once, so every later step, re-run or not, sees the same. The last sequence is filled up
    with end tokens. Null and empty texts are one end token each; repeated documents are repeated;
    an empty table gives no sequences; extra columns are ignored. Rows come in ranges of whole shards, by slot
    within each task; a very long text is spread over as many sequences as it fills.
    """
    stream = stage(tokens(docs, vocabulary), "token-stream")
    ends = sorted(map(tuple, stream.groupBy("part").agg(F.max(F.col("start") + F.col("n"))).collect()))
    before, total = {}, 0
    for part, n in ends:  # one number for each input partition
        before[part] = total
        total += n
    n_seq = max(1, -(-total // sequence))

    @F.pandas_udf("bigint")
    def slot(seq: pd.Series) -> pd.Series:
        return pd.Series(permute(seq.to_numpy(), n_seq, key))

    base = F.element_at(F.lit([before.get(i, 0) for i in range(max(before, default=0) + 1)]), F.col("part") + 1)
    first = F.col("seq") * sequence  # the sequence's first token in the whole stream
    pieces = (
        stream.select("doc_id", "n", "ids", (base + F.col("start")).alias("at"))
        .select("*", F.explode(F.sequence(F.floor(F.col("at") / sequence), F.floor((F.col("at") + F.col("n") - 1) / sequence))).alias("seq"))
        .select(
            "seq",
            F.greatest(F.lit(0), F.col("at") - first).alias("into"),
            "doc_id",
            F.expr(f"substring(ids, cast(2 * greatest(0, seq * {sequence} - at) + 1 as int), cast(2 * (least(at + n, (seq + 1) * {sequence}) - greatest(at, seq * {sequence})) as int))").alias("piece"),
        )
        .withColumn("slot", slot("seq"))
        .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    )
    stride = 2 * sequence
    filler = np.array([END], "<u2").tobytes()
    joined = (
        pieces.repartitionByRange("shard")
        .groupBy("shard", "slot", "seq")
        .agg(F.array_sort(F.collect_list(F.struct("into", "doc_id", "piece"))).alias("p"))
        .select(
            "slot",
            "shard",
            (F.col("slot") % per_shard * stride).alias("byte_offset"),
            "seq",
            F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
            F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("ids"),
        )
    )
    return joined.sortWithinPartitions("slot").select(
        "slot", "shard", "byte_offset", "seq", (F.octet_length("ids") / 2).cast("int").alias("n_tokens"), "doc_ids", F.rpad("ids", F.lit(stride), F.lit(filler)).alias("ids")
    )


def write_shards(sequences: DataFrame, folder: str) -> DataFrame:
    """Write each shard as one binary file into a folder mounted on every executor; returns shard, n_bytes.

    A file appears under its name only when whole, so a task that runs again replaces it with the same.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, shard, tmp, done = None, None, "", []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((shard, os.path.getsize(tmp)))
                os.replace(tmp, f"{folder}/shard-{shard:06d}.bin")

        for rows in batches:
            for s, ids in zip(rows["shard"], rows["ids"], strict=True):
                if s != shard:
                    close()
                    shard, tmp = s, f"{folder}/.{s:06d}-{os.getpid()}-{TaskContext.get().taskAttemptId()}"
                    out = open(tmp, "wb")
                out.write(ids)
        close()
        yield pd.DataFrame(done, columns=["shard", "n_bytes"])

    return sequences.repartitionByRange("shard").sortWithinPartitions("shard", "slot").select("shard", "ids").mapInPandas(write, "shard int, n_bytes bigint")


def read_sequence(folder: str, slot: int, sequence: int = SEQUENCE, per_shard: int = SEQUENCES_A_SHARD) -> np.ndarray:
    """The token ids of one slot: one seek."""
    return np.fromfile(f"{folder}/shard-{slot // per_shard:06d}.bin", "<u2", sequence, offset=slot % per_shard * 2 * sequence)


def op7_feistel_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride token sequences in training order."""
    return materialise(table(spark, sf_dir, "documents"))
