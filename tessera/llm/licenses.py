"""License scan as an exact set-similarity join, in DataFrame operations only.

Text blocks (sentences and lines, and for long templates runs of a few of them, so that wrapped notices count) are
joined to license templates wherever a block holds enough of a template's distinct words, and all that tell it
from a similar template of another label. Words are ordered by how rare they are over all documents; a pair that can
reach the threshold shares one of the template's first (rarest) words, which is what the join is on,
and the block's size and the word's places bound the overlap before it is counted.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage

# Well-known notices by which texts state their license.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8

#: Templates of so many distinct words are also looked for in runs of as many lines or sentences as RUN.
LONG = 12
RUN = 4
# The letters whose case doesn't count.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCK = r"\n+|(?<=[.!?])\s+"


def lowered(text: Column) -> Column:
    """A text with A-Z in small letters; other letters stay."""
    return F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL)


def _words(lowered: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(lowered, _GAP, " ")), " ")


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(_WORD, text.lower())))


def _places(words: Column) -> Column:
    """(start, label) of every place where a base phrase's words stand consecutively."""

    def at(i: Column) -> Column:
        one, two = F.get(words, i - 1), F.get(words, i - 2)
        return (
            F.when(one.isin("mit", "apache"), F.struct((i - 1).alias("start"), one.alias("label")))
            .when((one == "public") & (two == "general"), F.struct((i - 2).alias("start"), F.lit("gpl").alias("label")))
        )

    ends = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == "license")
    return F.filter(F.transform(ends, at), lambda p: p.isNotNull())


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from the phrases alone; ``labels`` adds those of the matched templates. The score
    is 1 with a base phrase, else the largest share of a template found, else 0. Null and empty texts
    have no words and empty labels; repeated rows get equal rows; an empty table gives no rows; extra
    columns are ignored. A text of any length is one row: its blocks' words are bound once.
    """
    sets = [(label, _template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    known = F.lit(vocabulary)
    needs = [math.ceil(threshold * len(ws) - 1e-9) for _, ws in sets]
    # where another label's template holds enough words of this one, those that it lacks are obligatory
    musts = [
        [w for w in ws if any(w not in vs for other, vs in sets if other != label and len(set(ws) & set(vs)) >= need)]
        for (label, ws), need in zip(sets, needs, strict=True)
    ]

    least_long = min([need for need, (_, ws) in zip(needs, sets, strict=True) if len(ws) >= LONG], default=1 << 30)

    def runs(held: Column) -> Column:
        """Sets of template words of RUN blocks one after another, where they can make a long template."""
        several = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(held) - 1)), lambda i: F.size(F.get(held, i - 1)) > 0)
        joined = F.transform(several, lambda i: F.array_distinct(F.flatten(F.slice(held, i, RUN))))
        return F.filter(joined, lambda b: F.size(b) >= least_long)

    def facts(ws: Column) -> Column:
        """Of the word arrays of a text's blocks: word count, base places, sets of template words."""
        held = F.transform(ws, lambda w: F.array_intersect(known, w))
        some = F.transform(F.array(held), lambda h: F.struct(F.filter(h, lambda b: F.size(b) >= min(needs)).alias("one"), runs(h).alias("several")))
        return F.struct(
            F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + F.size(w) - F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)).alias("n_words"),
            F.when(F.exists(ws, lambda w: F.array_contains(w, "license")), F.get(F.transform(F.array(F.flatten(F.transform(ws, lambda w: F.filter(w, lambda x: x != "")))), _places), F.lit(0))).alias("places"),
            F.get(some, F.lit(0)).alias("found"),
        )

    # the words are bound once, as an array's only element, so that one pass over the text serves all
    per_block = F.transform(F.split(lowered(F.col("text")), _BLOCK), _words)
    base = stage(
        docs.select(
            "doc_id", F.xxhash64("text").alias("th"), F.get(F.transform(F.array(per_block), facts), F.lit(0)).alias("f")
        ).select("doc_id", "th", "f.n_words", "f.places", F.col("f.found.one").alias("sets"), F.col("f.found.several").alias("runs")),
        "license-base",
    )
    # how many documents hold each word of a template, where enough of them meet: at most one row a word
    seen = dict(map(tuple, base.select(F.explode(F.array_distinct(F.flatten("sets"))).alias("w")).groupBy("w").count().collect()))
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    index = []
    for t, (label, ws) in enumerate(sets):
        need = needs[t]
        ordered = sorted(ws, key=rank.__getitem__)
        for i, w in enumerate(ordered[: len(ws) - need + 1]):
            index.append((w, i, t, label, need, ordered, musts[t]))
    entry = lambda w, i, t, label, need, ws, must: F.struct(
        F.lit(w).alias("w"), F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(ws).alias("ws"),
        F.array(*map(F.lit, must)).cast("array<string>").alias("must"),
    )
    side = docs.sparkSession.range(1).select(F.inline(F.array(*[entry(*x) for x in index])))
    ordered_known = F.lit(sorted(vocabulary, key=rank.__getitem__))
    kept = lambda name, wide: base.select("doc_id", "th", F.explode(name).alias("b"), F.lit(wide).alias("wide"))
    blocks = kept("sets", False).unionByName(kept("runs", True)).select("doc_id", "th", "wide", F.array_intersect(ordered_known, "b").alias("b"))
    n = F.size("b")
    matched = (
        blocks.select("doc_id", "th", "wide", "b", F.posexplode("b").alias("j", "w"))
        .join(F.broadcast(side), "w")  # one row for each first word of a given template
        .where(~F.col("wide") | (F.size("ws") >= LONG))
        .where((n >= F.col("need")) & (F.least(n - F.col("j"), F.size("ws") - F.col("i")) >= F.col("need")))
        .withColumn("overlap", F.size(F.array_intersect("b", "ws")))
        .where("overlap >= need and size(array_except(must, b)) = 0")
        .groupBy("doc_id", "th")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.size("ws")).alias("share"))
    )
    out = base.alias("a").join(
        matched.alias("m"), F.col("a.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("a.th") == F.col("m.th")), "left"
    )
    starts = F.transform("places", lambda p: p["start"])
    own = F.coalesce(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), F.array().cast("array<string>"))
    n_base = F.greatest(F.size(F.coalesce("places", F.array())), F.lit(0)).cast("long")
    return out.select(
        F.col("a.doc_id").alias("doc_id"),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The same in DuckDB SQL, template by template, without filters on prefixes, lengths or positions."""
    sets = [(label, _template_words(text)) for label, text in TEMPLATES]
    rows = []
    for label, ws in sets:
        need = math.ceil(THRESHOLD * len(ws) - 1e-9)
        must = [w for w in ws if any(w not in vs for other, vs in sets if other != label and len(set(ws) & set(vs)) >= math.ceil(THRESHOLD * len(ws) - 1e-9))]
        rows.append(f"('{label}', {ws}, {need}, {must or '[]::varchar[]'})")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}') as t from documents),
t(label, ws, need, must) as (values {", ".join(rows)}),
w as (select r, doc_id, t, regexp_extract_all(t, '{word}') as ws from d),
places as (select r, i, ws, unnest(range(1, len(ws) + 1)) as i2 from w, (select 0 as i)),
p as (select r, case when ws[i2 - 1] in ('mit', 'apache') then i2 - 2 when ws[i2 - 1] = 'general' then null when ws[i2 - 1] = 'public' and ws[i2 - 2] = 'general' then i2 - 3 end as start,
  case when ws[i2 - 1] in ('mit', 'apache') then ws[i2 - 1] when ws[i2 - 1] = 'public' and ws[i2 - 2] = 'general' then 'gpl' end as label from places where ws[i2] = 'license'),
base as (select r, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as own from p where label is not null group by r),
b as (select r, list_transform(string_split_regex(t, '\n+|[.!?]\s+'), lambda x: list_distinct(regexp_extract_all(x, '{word}'))) as bs from w),
blocks as (select r, unnest(bs) as b, false as wide from b
  union all select r, unnest(list_transform(range(1, len(bs) + 1), lambda i: list_distinct(flatten(bs[i:i + {RUN - 1}])))), true from b),
m as (select r, label, len(list_intersect(t.ws, b)) as overlap, len(t.ws) as n, need, must, b, wide from blocks, t),
hits as (select r, list(distinct label) as more, max(overlap / n) as share from m
  where overlap >= need and len(list_intersect(must, b)) = len(must) and (not wide or n >= {LONG}) group by r)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(own), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from w left join base on base.r = w.r left join hits on hits.r = w.r
"""


ORACLE_SQL = _oracle()


def op9_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the license scan over all documents."""
    return scan(table(spark, sf_dir, "documents"))
