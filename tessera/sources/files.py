"""A working tree read from a folder as a table of files, and its difference to a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.merging import mark_dirty


def working_tree(spark: SparkSession, folder: str, under: str = "", recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Files of a folder, or of one of its subtrees: path (from the folder), size, mtime (ms), hash.

    ``recursive`` off lists one directory; content is only read where the hash is asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    top = f"{folder.rstrip('/')}/{under}".rstrip("/")
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return reader.load(top).select(
        F.expr(f"substr(regexp_replace(path, '^[a-z]+:/+', '/'), {len(folder.rstrip('/')) + 2})").alias("path") if folder.startswith("/") else path.alias("path"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("hash"),
    )


def working_changes(tree: DataFrame, working: DataFrame) -> DataFrame:
    """What the working files changed against a revision (path, size, mtime, hash): path and action."""
    return mark_dirty(tree, working)
