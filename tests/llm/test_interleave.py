"""Interleaving against plain Python, over small buckets and steps, and tables of every kind."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from strandbase.llm import interleave as I

SCHEMA = "doc_id long, text string, source string"


def plain(rows, shards=I.SHARDS):
    keyed = []
    for d, t, s in rows:
        b = (t or "").encode()
        key = (hashlib.md5(f"{I.SEED}:{'null' if d is None else d}:{zlib.crc32(b)}:{len(b) + 1}".encode()).hexdigest(), (d is not None, d or 0), zlib.crc32(b), len(b) + 1)
        keyed.append((s, key, d))
    n, rank, placed = Counter(s for s, *_ in keyed), Counter(), []
    for s, key, d in sorted(keyed, key=lambda x: ((x[0] is not None, x[0] or ""), x[1])):
        rank[s] += 1
        placed.append(((2 * rank[s] - 1) / (2 * n[s]), (s is not None, s or ""), key, d))
    out = []
    for position, (_, _, key, d) in enumerate(sorted(placed, key=lambda x: x[:3])):
        shard = position * shards // len(rows)
        out.append((d, key[3], key[2], shard, position - -(-shard * len(rows) // shards)))
    return out


def table(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]) if k % 3 else k, rng.choice([None, "", "a", "bb é", f"text {k}"]), rng.choice([None, "a", "b", "b", "b"])) for k in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n", [0, 1, 5, 15, 700])
def test_against_plain_python(spark, monkeypatch, n):
    monkeypatch.setattr(I, "BUCKET_ROWS", 4)
    monkeypatch.setattr(I, "STEP_BUCKETS", 5)
    rows = table(n, n)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as size", "3 as bucket", "'x' as TEXT", "4 as before", "5 as step")
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in I.interleave(df).collect()]
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_law_and_mixture(spark):
    rows = [(k, "x" * (k % 50), "big" if k % 3 else "small") for k in range(3200)] + [(9000, "y" * 1_000_000, "big")]
    got = I.interleave(spark.createDataFrame(rows, SCHEMA)).collect()
    count, mix = Counter(r.shard for r in got), Counter((r.shard, r.source) for r in got)
    assert max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(count[s])) for s in range(16))
    share = sum(r[2] == "big" for r in rows) / len(rows)
    assert all(abs(mix[s, "big"] - share * count[s]) <= 2 for s in range(16))
