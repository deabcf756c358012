import numpy as np
import pytest
import tiktoken

from tessera.llm.token_output import END, PATTERN, VOCABULARY, load_vocabulary, materialise, permute, read_sequence, write_shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    got = permute(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != np.arange(n)).mean() > 0.9 and (permute(np.arange(n), n, 9) != got).mean() > 0.9


def test_round_trip(spark, tmp_path):
    docs = [(i, f"Text {i}, é ß " * (i % 40)) for i in range(300)] + [(None, None), (7, ""), (7, ""), (8, "long word " * 20_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, slot int")
    out = materialise(frame, sequence=128, per_shard=50).cache()
    rows = sorted(out.collect(), key=lambda r: r.seq)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(len(r.ids) == 256 and r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 256 for r in rows)
    stream = np.concatenate([np.frombuffer(r.ids, "<u2")[: r.n_tokens] for r in rows])
    encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_vocabulary(VOCABULARY), special_tokens={})
    texts, at = [], 0
    for end in np.flatnonzero(stream == END):
        texts.append(encoder.decode(stream[at:end].tolist()))
        at = end + 1
    assert at == len(stream) and sorted(texts) == sorted(t or "" for _, t in docs)
    write_shards(out, str(tmp_path)).collect()
    for r in rows[:: max(1, len(rows) // 40)]:
        assert read_sequence(str(tmp_path), r.slot, 128, 50).tobytes() == bytes(r.ids)


def test_empty(spark):
    assert materialise(spark.createDataFrame([], "doc_id long, text string")).count() == 0
