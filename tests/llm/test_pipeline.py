"""Each stage on its own input, against brute force."""

import re
from collections import Counter

import pytest

from strandbase.llm.ngram_join import join_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def brute_components(rows):
    """doc_id -> smallest doc_id reachable by links, by comparing all pairs."""
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_components_against_all_pairs(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words[: 40 + i])) for i in range(30)]  # a chain: neighbours link, ends don't
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE  two"), (105, "one two three"), (50, rows[0][1]), (50, rows[0][1]), (7, "one two")]
    rows += [(200 + i, " ".join(f"x{j if j % 23 != i else 1000 + i}" for j in range(120))) for i in range(20)]  # near copies of one text
    rows += [(300 + i, "a passage that many documents share word for word " * 1 + " ".join(f"y{i}_{j}" for j in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "'x' as TEXT2", "2 as component_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join_components(df).collect())
    assert got == sorted(brute_components(rows))


def test_empty(spark):
    assert join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_ids":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        before, after = docs.collect(), out.collect()
        seen[name] = (before, after)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    before, after = seen["quality"]
    left = {r.doc_id for r in after}
    judged = [(labels[r.doc_id], r.doc_id in left) for r in before if r.doc_id in labels]
    assert sum(bool(q) == k for q, k in judged) >= 0.95 * len(judged)
    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after} == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])} and len(after) == len({r.doc_id for r in after})
    before, after = seen["secrets"]
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        plain = r.text
        if not re.search("[0-9a-f]{16,}|AKIA|[A-Za-z0-9+/_-]{20,}|(?i:password|passwd|secret|token|api_?key)", plain):
            assert texts[r.doc_id] == plain
        assert not re.search("[0-9a-f]{16,}", texts[r.doc_id])
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["mixture"]
    count = Counter(r.doc_id for r in after)
    assert set(count) == {r.doc_id for r in before} and max(count.values()) <= 3
    before, after = seen["token_ids"]
    from tokenizers import Tokenizer

    from strandbase.llm.bpe import vocabulary_path

    lib = Tokenizer.from_file(vocabulary_path())
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in before}
    assert len(after) == len(before) and all(want[r.doc_id] == r.n_tokens == len(r.ids) // 4 for r in after)
