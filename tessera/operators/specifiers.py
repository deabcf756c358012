"""Revision specifiers: a text names a revision by hash, hash prefix, branch and number, latest of a branch, or
a number of steps back from any of these."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ancestry import lines, up

#: Digits of a full hash.
FULL = 64


def parse(text: str) -> tuple[str, dict, int]:
    """(kind, parts, steps back) of a specifier: ``hash``, ``prefix``, ``number`` (branch@N), ``latest`` (branch@LATEST)."""
    bare, _, back = text.partition("~")
    steps = int(back or 1) if "~" in text else 0
    if "@" in bare:
        branch, _, at = bare.partition("@")
        if at.upper() == "LATEST":
            return "latest", {"branch": branch or None}, steps
        if not at.isdigit():
            raise ValueError(f"not a revision: {text}")
        return "number", {"branch": branch or None, "number": int(at)}, steps
    if not re.fullmatch(r"[0-9a-f]{1,64}", bare):
        raise ValueError(f"not a revision: {text}")
    return ("hash" if len(bare) == FULL else "prefix"), {"hash": bare}, steps


def resolve(revisions: DataFrame, text: str, branch: object) -> DataFrame:
    """The revision (revision, hash) that a specifier names, no row for none; ``branch`` is the current branch.

    ``revisions``: revision, hash, number, parent_self, branch. A prefix prefers the current branch, then the newest.
    """
    kind, parts, steps = parse(text)
    on = parts.get("branch") or branch
    if kind == "hash":
        found = revisions.where(F.col("hash") == parts["hash"])
    elif kind == "prefix":
        found = revisions.where(F.startswith("hash", F.lit(parts["hash"]))).orderBy(F.col("branch") != F.lit(branch), F.desc("number")).limit(1)
    elif kind == "number":
        found = revisions.where((F.col("branch").cast("string") == F.lit(str(on))) & (F.col("number") == parts["number"]))
    else:
        found = revisions.where(F.col("branch").cast("string") == F.lit(str(on))).orderBy(F.desc("number")).limit(1)
    if steps:
        tips = found.select(F.col("revision").alias("tip"))
        back = up(lines(revisions, tips, steps + 1), tips.withColumn("n", F.lit(steps).cast("long")))
        found = revisions.join(back.where("revision is not null").select("revision"), "revision", "left_semi")
    return found.select("revision", "hash")
