"""Every stage of the pipeline on odd tables: nulls in any column, empty and very long texts, repeated rows, clashing names, no rows."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, class string"
PROSE = "This is a quiet and orderly sentence about a river, number {0}, and the {0} boats that come home before the evening. "


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    good = [(i, PROSE.format(i) * 3, "en", "web", 300, "k") for i in range(40)]
    rows = [*good, good[0], good[0], (None, PROSE.format(77) * 2, None, None, None, None), (None, PROSE.format(99) * 4, "en", None, 5, None), (50, None, None, None, None, None), (51, "", "en", "web", 0, "k"), (52, " \n\t", "en", "web", 3, "k")]
    rows += [(53, PROSE.format(5) * 3_000, "en", "big", None, "k"), (54, "password = x7Kq9ZpL2vRt8WmB4nYcD3 and " + PROSE.format(54) * 2, "en", "web", 10, "k"), (1, PROSE.format(1000) * 2, "de", "web", 1, "k")]
    rows += [(100 + i, f"$$$ BUY {i} NOW!!! ||| ### %% {i * 31} >>>>", "en", "ads", 30, "k") for i in range(40)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(0, 40), *range(100, 140)]] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as TEXT2", "array(1) as s", "'x' as comp", "named_struct('a', 1) as mix_at")
    return df, sf


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, name):
    df, sf = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, df, sf)
    before, after = df.collect(), out.collect()
    assert stage(spark, df.limit(0), sf).count() == 0
    ids = Counter(r.doc_id for r in after)
    if name == "token_ids":
        assert ids == Counter(r.doc_id for r in before) and all(len(r.ids) == 4 * r.n_tokens for r in after)
        return
    assert out.columns == df.columns and out.dtypes == df.dtypes
    if name == "quality":
        assert all(ids[i] for i in range(40)) and ids[0] == 3 and not any(ids[i] for i in (50, 51, 52, *range(100, 140)))
    elif name == "near_duplicates":
        assert ids[0] == 1 and ids[50] == ids[51] == ids[52] == 1 and ids[None] == 2 and ids[1] == 2
    elif name == "secrets":
        texts = {(r.doc_id, r.n_chars): r.text for r in after}
        assert len(after) == len(before) and any("[SECRET]" in (t or "") for (i, _), t in texts.items() if i == 54) and sum(t == r.text for r in before for t in [next((a.text for a in after if a.doc_id == r.doc_id and a.lang == r.lang and (a.text or "")[:60] == (r.text or "")[:60]), 0)]) >= len(before) - 1
    elif name == "mixture":
        assert set(ids) == {r.doc_id for r in before} and ids[0] >= 3
