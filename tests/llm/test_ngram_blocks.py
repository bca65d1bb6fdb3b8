"""Long posting lists cut into small blocks, small ranges and groups, against all pairs; and which of repeated rows stays."""

import random

import pytest
from test_pipeline import brute_components

from strandbase.llm import ngram_join as N


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(60):  # all share a passage; some are near copies of each other
        tail = " ".join(rng.choice(words) for _ in range(rng.choice([5, 18, 40])))
        rows.append((i, f"{passage} {tail}"))
    for i in range(40):  # a chain of near copies within a group
        base = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(1, 4)):
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(base)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  B"), *rows[:5]]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "LIST_BLOCK", 3)
    monkeypatch.setattr(N, "RANGE_TOKENS", 500)
    monkeypatch.setattr(N, "FLUSH_TOKENS", 300)
    monkeypatch.setattr(N, "GROUP_CLASSES", 10)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.join_components(df).collect())
    assert got == sorted(brute_components(rows))


def test_repeated_rows_are_decided(spark):
    rows = [(1, "one two three four five six", k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    kept = {N.keep_one(df.repartition(n)).collect()[0].k for n in (1, 3, 7)}
    assert len(kept) == 1
