import random
import re
import textwrap

from tessera.llm.licenses import LONG, RUN, TEMPLATES, _template_words, op9_license_set_join, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    best, labels = 0.0, set(base)
    blocks = [set(WORD.findall(x.translate(LOWER))) for x in re.split(r"\n+|(?<=[.!?])\s+", text or "")]
    runs = [set().union(*blocks[i : i + RUN]) for i in range(len(blocks))]
    for label, template in TEMPLATES:
        ws = _template_words(template)
        # what a template of another label lacks, although it holds enough of this one
        must = {w for other, text in TEMPLATES if other != label and (vs := set(_template_words(text))) and 5 * len(set(ws) & vs) >= 4 * len(ws) for w in ws if w not in vs}
        for have in blocks + (runs if len(ws) >= LONG else []):
            n = sum(w in have for w in ws)
            if 5 * n >= 4 * len(ws) and must <= have:
                best = max(best, n / len(ws))
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 if places else best, 9))


def rows_of(frame):
    return sorted(
        ((r.doc_id is not None, r.doc_id or 0), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))
        for r in frame.collect()
    )


def same(got, docs):
    want = sorted(((d is not None, d or 0), brute(t)) for d, t in docs)
    assert list(map(str, got)) == list(map(str, want))


def test_against_brute_force(spark):
    rng = random.Random(1)
    docs = []
    for i in range(120):
        text = TEMPLATES[rng.randrange(len(TEMPLATES))][1]
        words = [w for w in text.split(" ") if rng.random() > rng.choice([0, 0.1, 0.3])]
        noise = [rng.choice(["the", "license", "MIT", "General", "Public", "License", "all", "é", "rights", "zz."]) for _ in range(rng.randrange(60))]
        at = rng.randrange(len(noise) + 1)
        docs.append((i, " ".join(noise[:at]) + rng.choice([" ", "\n", ". "]) + " ".join(words) + rng.choice([" ", "\n"]) + " ".join(noise[at:])))
    docs += [(500, None), (501, ""), (502, "MIT LICENSE mit-license (Apache\nLicense)"), (503, "general public license " * 3000), (502, "x"), (502, "x"), (None, "All rights reserved")]
    got = scan(spark.createDataFrame([(*d, "l") for d in docs], "doc_id long, text string, labels string"))
    same(rows_of(got), docs)


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(rows_of(op9_license_set_join(spark, sf)), docs)


def test_each_template_has_its_own_label_only(spark):
    docs = [(i, f"Some words before.\n{text}.\nAnd after", label) for i, (label, text) in enumerate(TEMPLATES)]
    docs += [(100, "Licensed under CC BY 4.0.", ""), (101, "Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-sa")]
    got = scan(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in got.collect()} == {i: label for i, _, label in docs}


def test_wrapped_notices(spark):
    docs = []
    for i, (label, text) in enumerate(TEMPLATES):
        if len(_template_words(text)) >= LONG:
            docs += [(f"{i}-{width}", label, "# Head\n\n" + textwrap.fill(text, width) + "\nmore text\n") for width in (60, 72, 80, 100)]
    assert len(docs) >= 12
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id string, text string")).collect()}
    assert got == {d: label for d, label, _ in docs}


def test_only_ascii_letters_are_lowered(spark):
    docs = [(1, "\u212a MIT License"), (2, "\u0130MIT License"), (3, "M\u0130T License")]
    got = {r.doc_id: (r.n_words, r.n_base) for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (3, 1), 2: (2, 0), 3: (2, 0)}


def test_scans_agree_over_partitions(spark):
    docs = [(i, t) for i, t in enumerate(["MIT License", "", None, "Apache License", "x"] * 8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    first = rows_of(scan(frame))
    same(first, docs)
    for n in (1, 3, 7, 40):
        assert rows_of(scan(frame.repartition(n))) == first


def test_very_long_text(spark):
    text = "word " * 200_000 + "\nReleased under the MIT License.\n" + "line\n" * 50_000
    row = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.labels) == (250_005, 1, "mit")
