"""Co-training: Spark's sums against plain arrays, held-out accuracy, calibration, and tables of every kind."""

import numpy as np
import pytest

from strandbase.llm import quality_cotraining as Q

SF = "/root/testdata/sf0.1"


def plain(views, y, held, rounds):
    """The same co-training on whole arrays."""
    some = ~np.isnan(y) & ~held
    scaled = []
    for x in views:
        mean, spread = x[some].mean(axis=0), x[some].std(axis=0)
        scaled.append(np.column_stack([np.clip((x - mean) / np.where(spread < 1e-6, 1, spread), -8, 8), np.ones(len(x))]))
    logit = lambda k, w: np.clip(scaled[k] @ w, -30, 30)

    def step(k, w, said):
        """said: -1, 0 or 1 for each row, by the other view."""
        rows, label, weight = list(np.flatnonzero(some)), list(y[some]), [1.0] * int(some.sum())
        if said is not None:
            own = [(y[some] == c).sum() for c in (0, 1)]
            mine = [np.flatnonzero(np.isnan(y) & (said == v)) for v in (-1, 1)]
            share = min(min(1, len(m) / n) for m, n in zip(mine, own, strict=True))
            for c in (0, 1):
                rows += list(mine[c])
                label += [float(c)] * len(mine[c])
                weight += [share * own[c] / max(1, len(mine[c]))] * len(mine[c])
        z, label, weight = scaled[k][rows], np.array(label), np.array(weight)
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.r_[np.full(z.shape[1] - 1, Q.RIDGE), 1e-3]
        return w + np.linalg.solve((z.T * (weight * np.maximum(p * (1 - p), Q.LEAST_CURVE))) @ z + np.diag(penalty), z.T @ (weight * (label - p)) - penalty * w)

    def surely(k, w):
        l, cell = logit(k, w), 2 * Q.BOUND / Q.GRID  # noqa: E741
        at = np.clip((l + Q.BOUND) // cell, 0, Q.GRID - 1)
        curve = Q.fitted((at * cell + cell / 2 - Q.BOUND)[held][:, None], y[held], np.ones(held.sum()))
        odds, said = np.log(Q.SURE / (1 - Q.SURE)), np.zeros(len(y))
        for sign, good in ((-1, 0), (1, 1)):
            widest = np.zeros(len(y), bool)
            for edge in np.arange(-Q.BOUND, Q.BOUND + cell / 2, cell):  # the widest cut that held-out rows bear out
                beyond = (np.clip(l, -Q.BOUND, Q.BOUND - 1e-9) >= edge - 1e-12) if sign > 0 else (np.clip(l, -Q.BOUND, Q.BOUND - 1e-9) < edge)
                n, e = (held & beyond).sum(), (held & beyond & (y != good)).sum()
                if n and e + 1 <= (1 - Q.SURE) * (n + 1) and beyond.sum() > widest.sum():
                    widest = beyond
            said[widest & (curve[0] > 0) & (sign * (curve[0] * l + curve[1]) > odds)] = sign
        return said

    w = [np.zeros(z.shape[1]) for z in scaled]
    for _ in range(Q.FIRST_STEPS):
        w = [step(k, w[k], None) for k in (0, 1)]
    for _ in range(rounds):
        said = [surely(k, w[k]) for k in (0, 1)]
        for _ in range(Q.STEPS):
            w = [step(k, w[k], said[1 - k]) for k in (0, 1)]
    return w


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("rounds", [0, 2])
def test_sums_against_plain_arrays(spark, tables, rounds):
    docs, labels = tables
    got = Q.features(docs.repartition(3), labels).toArrow().combine_chunks().to_batches()[0]
    views = Q._views(got)
    y = np.array([np.nan if v is None else v for v in got["y"].to_pylist()])
    held = np.array(got["held"].to_pylist())
    model = Q.fit(docs, labels, rounds=rounds)
    want = plain(views, y, held, rounds)
    assert rounds == 0 or sum(map(sum, model.exchanged)) > 0
    for view, w in zip(model.views, want, strict=True):
        assert np.allclose(view.weights, w, atol=1e-5)


def test_held_out_accuracy(spark, tables):
    """Labels of a third of the ids are kept back; the scores of these documents are held against them."""
    docs, labels = tables
    back = labels.where("doc_id % 3 = 0").collect()
    model = Q.fit(docs, labels.where("doc_id % 3 <> 0"))
    kept = {r.doc_id: (r.kept, r.score) for r in Q.classify(docs, model).collect()}
    judged = [(bool(r.quality), *kept[r.doc_id]) for r in back if r.doc_id in kept]
    assert np.mean([q == k for q, k, _ in judged]) >= 0.97
    assert abs(np.mean([s for *_, s in judged]) - np.mean([q for q, *_ in judged])) < 0.05  # calibrated on the whole


def test_any_table(spark):
    good = [(i, f"This is sentence number {i} of a quiet and orderly text about river {i % 7}.", "web", "en", 60, 1) for i in range(60)]
    bad = [(100 + i, f"$$$ BUY {i} NOW!!! ||| ### %% {i * 31} >>>>", "ads", "en", 30, 0) for i in range(60)]
    odd = [(200, None, None, None, None, None), (201, "", "web", "en", 0, None), (202, " \n", "web", "en", 2, None), (None, good[0][1], "web", "en", 60, None), (1, good[1][1], "web", "en", 60, None), (203, good[0][1] * 4000, "web", "en", None, None)]
    df = spark.createDataFrame(good + bad + odd, "doc_id long, text string, source string, lang string, n_chars int, q int").selectExpr("*", "1 as content", "2 as y", "3 as held", "'x' as TEXT")
    labels = df.where("q is not null").selectExpr("doc_id", "q as quality", "0 as toxic")
    labels = labels.union(labels.sparkSession.createDataFrame([(5, 0, 0), (None, 1, 0), (7, None, 0)], labels.schema))  # a tie for 5
    model = Q.fit(df, labels)
    got = {(r.doc_id, r.score, r.kept) for r in Q.classify(df, model).collect()}
    assert len(got) >= len(good + bad) and all(k for i, s, k in got if i is not None and 10 <= i < 60) and not any(k for i, _, k in got if i is not None and 100 <= i < 200)
    assert {(200, 0.0, False), (201, 0.0, False), (202, 0.0, False)} <= got
    kept = Q.keep_good(df, model)
    assert kept.columns == df.columns and sum(r.doc_id == 1 for r in kept.collect()) == 2
    assert Q.fit(df, labels.where("quality = 1")) is None and Q.fit(df, labels.limit(0)) is None and Q.fit(df.limit(0), labels) is None
    for one in (3, 4, 6, 8, 9, 10, 11, 12):  # one label of each class, held out or not
        assert Q.fit(df, labels.where(f"doc_id in ({one}, {one + 100})"), rounds=0) is not None
    assert all(r.score == (r.doc_id not in (200, 201, 202)) for r in Q.classify(df, None).collect())
    assert Q.classify(df.limit(0), None).count() == 0
