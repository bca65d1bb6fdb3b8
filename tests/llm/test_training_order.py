"""The permutation by brute force, and shards read back slot by slot."""

import zlib

import numpy as np
import pytest

from strandbase.llm.training_order import END, LENGTH, PAD, materialise, permuted, read_slots, tokenizer


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    got = permuted(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    assert permuted(got, n, back=True).tolist() == list(range(n))
    assert n < 64 or (got != np.arange(n)).mean() > 0.9
    assert n < 64 or permuted(np.arange(n), n, key=3).tolist() != got.tolist()


def test_shards(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(60)] + [(60, None), (61, ""), (5, "same"), (5, "same"), (62, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slot", "2 as IDS")
    folder = f"file://{tmp_path}/out"
    index = sorted(materialise(df, folder).collect(), key=lambda r: r.slot)
    assert [r.slot for r in index] == list(range(len(index)))
    back = list(read_slots(folder, 0, len(index)))
    assert len(back) == len(index)
    docs = {}
    for r, ids in zip(index, back, strict=True):
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and (ids[r.n_ids :] == PAD).all() and len(ids) == LENGTH
        docs.setdefault(r.doc_id, []).append((r.seq, ids[: r.n_ids].tolist()))
    enc = tokenizer()
    for d, t in rows:
        want = [*enc.encode_ordinary(t or ""), END]
        parts = sorted(docs[d])
        if d != 5:
            assert sum((p for _, p in parts), []) == want
        else:
            assert len(parts) == 3
    assert np.array_equal(np.stack(back[7:]), np.stack(list(read_slots(folder, 7, 10**6 if len(index) > 8192 else len(index) - 7))))


def test_empty(spark, tmp_path):
    assert materialise(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none").count() == 0
