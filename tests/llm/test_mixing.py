"""Mixing against plain Python: exponents, budgets, whole passes."""

import math
from collections import Counter, defaultdict

from strandbase.llm.mixing import Goal, find_exponent, mix


def shares(spark, counts):
    t = sum(counts)
    return spark.createDataFrame([(c / t,) for c in counts], "p double")


def entropy(counts, a):
    w = [(c / sum(counts)) ** a for c in counts]
    z = sum(w)
    return -sum(x / z * math.log(x / z) for x in w) / math.log(len(w))


def test_exponent(spark):
    counts = [700, 200, 50, 30, 20]
    a = find_exponent(shares(spark, counts), Goal(entropy=0.9, repeat=None))
    assert abs(entropy(counts, a) - 0.9) < 1e-9
    a = find_exponent(shares(spark, counts), Goal(entropy=None, repeat=4.0))
    assert abs((700 / 20) ** (1 - a) - 4) < 1e-9
    assert find_exponent(shares(spark, [10, 10, 10]), Goal()) == 1.0
    assert find_exponent(shares(spark, [5]), Goal()) == 1.0


def test_budget_and_passes(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else "small" if i % 2 else None) for i in range(600)] + [(600, None, "big"), (601, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    got = mix(df, Goal(entropy=None, repeat=2.0), block_tokens=50).collect()
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    read, seen = defaultdict(int), defaultdict(Counter)
    weight = {}
    for r in got:
        read[r.source] += r.mix_tokens
        seen[r.source][r.doc_id] += 1
        weight[r.source] = r.mix_weight
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s in ("big", "small", None):
        want = weight[s] * total
        assert want - 1 <= read[s] <= want + 8, (s, want, read[s])
        passes = want / tokens[s]
        assert {math.floor(passes), math.ceil(passes)} >= set(seen[s].values()) and max(seen[s].values()) <= math.ceil(passes)
    ratio = (weight["small"] / tokens["small"]) / (weight["big"] / tokens["big"])
    assert abs(ratio - 2) < 0.2
    assert seen["empty"] == {601: 1}
    places = Counter((r.source, r.mix_pass, r.mix_block, r.mix_position) for r in got)
    assert max(places.values()) == 1


def test_all_are_read(spark):
    rows = [(i, "a b c", "x" if i < 90 else "y") for i in range(100)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Goal(entropy=None, repeat=2.0, budget="all")).collect()
    count = Counter(r.doc_id for r in got)
    assert set(count) == set(range(100)) and all(count[i] == 1 for i in range(90)) and all(count[i] >= 2 for i in range(90, 100))


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_whole_order(spark):
    """By mix_at every pass is read block by block and whole, row after row, and all sources keep to their weights throughout."""
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else "small" if i % 2 else None) for i in range(900)]
    rows += [(None, "w w", "big"), (None, None, None), (1, "w w", "big"), (1, "w w", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as t", "2 as blocks", "'x' as TEXT", "3 as mix_id", "4 as passes", "5 as s")
    out = mix(df, Goal(entropy=None, repeat=3.0), block_tokens=60)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.select("source", "mix_weight", "mix_tokens", "mix_pass", "mix_block", "mix_position", "mix_at").collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r.source), r.mix_at, r.mix_pass, r.mix_position)):
        by[r.source].append(r)
    first_orders = {}
    for s, own in by.items():
        quota, before = sum(r.mix_tokens for r in own), 0
        blocks = []
        for r in own:
            assert abs(r.mix_at * quota - before) <= 8 + quota * 0.02, s  # the last row may go past the budget
            before += r.mix_tokens
            if not blocks or blocks[-1] != (r.mix_pass, r.mix_block):
                blocks.append((r.mix_pass, r.mix_block))
        assert [p for p, _ in blocks] == sorted(p for p, _ in blocks)
        assert len(blocks) <= len(set(blocks)) + 3  # blocks without tokens share a place
        first_orders[s] = [[b for p, b in blocks if p == k] for k in sorted({p for p, _ in blocks})]
    assert any(len(o) > 1 and len(o[0]) > 2 and o[0] != o[1] for o in first_orders.values())  # a new permutation for each pass
    weight = {s: own[0].mix_weight for s, own in by.items()}
    total = sum(r.mix_tokens for r in got)
    for cut in (0.25, 0.5, 0.75):
        for s, own in by.items():
            assert abs(sum(r.mix_tokens for r in own if r.mix_at < cut) / total - cut * weight[s]) < 0.03
