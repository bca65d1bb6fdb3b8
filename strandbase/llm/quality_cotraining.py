"""Quality classifier by co-training: text content and page metadata teach each other, then score every document together.

Two logistic models see different views of a document: its content (counts of byte classes, words, lines and repetition, hashed words and byte
trigrams) and its metadata (source, language, length as recorded). Each round, each view labels all unlabelled documents it is sure
of, beyond logits at which its curve and the held-out labelled rows themselves bear that out (SURE); the other learns them besides the labelled ones, both classes with the
same share of its labelled rows' weight. In the end both views are calibrated on the held-out rows (a logistic curve of the logit), and a last logistic model of the two calibrated logits gives the probability of good quality.

Texts are read once for the features, which are kept as a narrow table, and once for the scores. Every fit is Newton's method on sums over that table
(gradients and Hessians of labelled and pseudo-labelled rows), added up in Spark; all labelled and all unlabelled rows take part. For the
calibration the held-out rows are counted in a grid of both logits. What the driver gets has the size of the models.

Defined results: a document without words (null or empty) has score 0 and is rejected, and takes no part in the fit; labels that contradict each other for one
id count as their mean, a tie as bad; a label counts for every row of its id; null ids have no label; where the
labels that are not held out are of one class, none is held out; null metadata are a value of their own; without labels
of both classes every document with words scores 1; repeated rows give repeated results and count as often in the fit; an empty table gives an empty result. Sums of
floating-point numbers depend on their order, so weights may differ between runs in the last digits.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, map_texts, pick, release_memory, settled, text_bytes
from .shingles import shingle_sets, words_of_texts

ROUNDS = 3
#: Newton steps of the first fit, and of those that go on from the round before.
FIRST_STEPS, STEPS = 6, 3
#: How sure a view must be to label a document for the other.
SURE = 0.97
RIDGE = 1.0
#: A row's part in the Hessian is this at least, so that no step goes too far where all rows are sure.
LEAST_CURVE = 0.02
KEEP_FROM = 0.5
#: Cells of hashed words and of hashed byte trigrams.
WORD_CELLS, GRAM_CELLS = 96, 64
#: One labelled row in so many is held out to calibrate; cells of a logit, and its bounds, in the grid.
HELD, GRID, BOUND = 5, 80, 10.0
#: Rows that the sums of all tasks are added up to before the driver gets them.
SUMS = 8

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",;:", b"!", b"?", b"|<>", b"#*$%&", b"\"'()", b"=_@~^+/\\{}[]-"]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _KIND[list(_k)] = _i
_KIND[128:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
N_CONTENT = N_KINDS + 7 + WORD_CELLS + GRAM_CELLS
N_SOURCES, N_LANGS = 64, 16
N_META = N_SOURCES + N_LANGS + 3


def content_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, N_CONTENT) features of texts, as exact as 16 bits, and their numbers of words."""
    u8, off = text_bytes(column)
    n, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * N_KINDS + _KIND[u8], minlength=n * N_KINDS).reshape(n, N_KINDS)
    words, woff = words_of_texts(column)
    n_words = np.diff(woff)
    text, _ = shingle_sets(words, woff, 3)
    trigrams = np.bincount(text, minlength=n)
    text, _ = shingle_sets(words, woff, 1)
    distinct = np.bincount(text, minlength=n)
    some, w = np.maximum(size, 1), np.maximum(n_words, 1)
    first = np.zeros(len(u8), bool)  # bytes that end a line with a full stop
    first[:-1] = (u8[:-1] == 46) & (u8[1:] == 10)
    stops = np.bincount(row[first], minlength=n)
    runs = np.zeros(len(u8), bool)  # a sign repeated at once
    runs[1:] = (u8[1:] == u8[:-1]) & (_KIND[u8[1:]] >= 5) & (_KIND[u8[1:]] < len(_KINDS)) & (row[1:] == row[:-1])
    more = [np.log1p(n_words), size / w, distinct / w, trigrams / np.maximum(n_words - 2, 1), stops / np.maximum(counts[:, 4], 1), np.bincount(row[runs], minlength=n) / w, counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)]
    # each word and trigram adds one to a cell, or takes one away
    at = np.repeat(np.arange(n), n_words) * WORD_CELLS + (words >> np.uint64(8)).astype(np.int64) % WORD_CELLS
    hashed = np.bincount(at, 1.0 - 2.0 * (words & np.uint64(1)), n * WORD_CELLS).reshape(n, WORD_CELLS) / np.sqrt(w)[:, None]
    lower = _LOWER[u8].astype(np.uint32)
    gram = (lower[:-2] << 16 | lower[1:-1] << 8 | lower[2:]) * np.uint32(2654435761) if len(u8) > 2 else np.zeros(0, np.uint32)
    whole = row[: len(gram)] == row[2:] if len(u8) > 2 else np.zeros(0, bool)
    at = row[: len(gram)] * GRAM_CELLS + (gram >> np.uint32(12)) % GRAM_CELLS
    grams = np.bincount(at[whole], (1.0 - 2.0 * (gram >> np.uint32(31)))[whole], n * GRAM_CELLS).reshape(n, GRAM_CELLS) / np.sqrt(some)[:, None]
    x = np.column_stack([np.sqrt(counts / some[:, None]), *more, hashed, grams])
    return x.astype(np.float16).astype(np.float64), n_words


def meta_features(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """(rows, N_META) features of the recorded metadata."""
    x = np.zeros((len(source), N_META))
    at = np.arange(len(source))
    x[at, [zlib.crc32(repr(s).encode()) % N_SOURCES for s in source]] = 1
    x[at, [N_SOURCES + zlib.crc32(repr(s).encode()) % N_LANGS for s in lang]] = 1
    known = ~np.isnan(n_chars)
    length = np.log1p(np.where(known, np.maximum(n_chars, 0), 0))
    x[:, -3:] = np.column_stack([~known, length / 10, (length / 10) ** 2])
    return x


def solved(gradient: np.ndarray, hessian: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights after a Newton step; the last one, the constant, is hardly held."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    return w + np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * w)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """A small logistic fit of weighted rows at once: weights, the constant last."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        new = solved(z.T @ (weight * (y - p)), (z * (weight * p * (1 - p))[:, None]).T @ z, w, ridge)
        done, w = np.abs(new - w).max() < 1e-9, new
        if done:
            break
    return w


@dataclass
class View:
    """A logistic model of standardised features, and its calibration: slope and constant for its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    #: Below the first logit it is sure of bad quality, above the second of good.
    cuts: tuple[float, float] = (-np.inf, np.inf)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.rows(x) @ self.weights, -30, 30)

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return np.clip(self.curve[0] * logit + self.curve[1], -30, 30)


@dataclass
class CoTrained:
    views: list[View]
    both: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0]))
    #: Documents that the content view and the metadata view labelled in the last round, bad and good.
    exchanged: list[list[float]] = field(default_factory=list)

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b = (v.calibrated(v.logit(x)) for v, x in zip(self.views, (content, meta), strict=True))
        return 1 / (1 + np.exp(-np.clip(self.both[0] * a + self.both[1] * b + self.both[2], -30, 30)))

    def calibrate(self, logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """logits: (rows, 2) of held-out rows."""
        for k, v in enumerate(self.views):
            v.curve = fitted(logits[:, k : k + 1], y, weight)
        self.both = fitted(np.column_stack([v.calibrated(logits[:, k]) for k, v in enumerate(self.views)]), y, weight)


def _picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    optional = {k: k for k in ("source", "lang", "n_chars") if k in df.columns}
    t = pick(df, doc_id=id_col, text=text_col, **optional)
    for k in ("source", "lang", "n_chars"):
        if k not in optional:
            t = t.withColumn(k, F.lit(None).cast("string"))
    return t.select("doc_id", "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.expr("try_cast(n_chars as double)").alias("n_chars"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    content, n_words = content_features(batch["text"])
    chars = np.array([np.nan if v is None else v for v in batch["n_chars"].to_pylist()], float)
    return content, meta_features(batch["source"].to_pylist(), batch["lang"].to_pylist(), chars), n_words


def features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with words: content (16-bit numbers), source, lang, n_chars, y (null: no label) and held."""
    t = _picked(docs, id_col, text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, n_words = content_features(batch["text"])
        packed = pa.array([r.tobytes() for r in content.astype(np.float16)], pa.binary())
        return pa.RecordBatch.from_arrays([batch["doc_id"], packed, batch["source"], batch["lang"], batch["n_chars"]], ["doc_id", "content", "source", "lang", "n_chars"]).filter(pa.array(n_words > 0))

    rows = map_texts(t, fn, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, content binary, source string, lang string, n_chars double")
    known = pick(labels, label_id="doc_id", quality="quality").where("label_id is not null and quality is not null").groupBy("label_id").agg((F.avg("quality") > 0.5).cast("double").alias("y"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    return rows.join(known, F.col("doc_id") == F.col("label_id"), "left").select("content", "source", "lang", "n_chars", "y", (held & F.col("y").isNotNull()).alias("held"))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    content = np.frombuffer(b"".join(batch["content"].to_pylist()), np.float16).astype(np.float64).reshape(batch.num_rows, N_CONTENT)
    chars = np.array([np.nan if v is None else v for v in batch["n_chars"].to_pylist()], float)
    return [content, meta_features(batch["source"].to_pylist(), batch["lang"].to_pylist(), chars)]


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all rows of of(views, y, held), an array of size numbers; added up in tasks, then in SUMS groups, then here."""

    def run(batches):
        def sums():
            total = np.zeros(size)
            for batch in batches:
                for at in range(0, batch.num_rows, 2_000):
                    part = batch.slice(at, 2_000)
                    y = np.array([np.nan if v is None else v for v in part["y"].to_pylist()], float)
                    total += of(_views(part), y, np.array(part["held"].to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        return settled(sums())

    def added(table: pa.Table) -> pa.Table:
        release_memory()
        total = sum((np.frombuffer(x) for x in table["sums"].to_pylist()), np.zeros(size))
        return pa.table({"part": table["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, sums binary"
    got = rows.mapInArrow(run, kind).groupBy("part").applyInArrow(added, kind).toArrow()
    return sum((np.frombuffer(x) for x in got["sums"].to_pylist()), np.zeros(size))


_SIZES = (N_CONTENT, N_META)
#: What is known of a row in a fit: labelled, or labelled by the other view, as bad or as good.
_GROUPS = 3


def _moments(views, y, held):
    """Rows of both labels among those to fit and those held out, then sums and squares of the features of those to fit."""
    some = ~np.isnan(y) & ~held
    counts = [np.sum(some & (y == 0)), np.sum(some & (y == 1)), np.sum(held & (y == 0)), np.sum(held & (y == 1))]
    return np.concatenate([counts, *(f for x in views for f in (x[some].sum(axis=0), (x[some] ** 2).sum(axis=0)))])


def _newton(models: list[View], teach: list[View] | None):
    """The sums of a Newton step of both views: for each view and group the number of rows, gradient and Hessian."""

    def of(views, y, held):
        out = []
        for k, (m, x) in enumerate(zip(models, views, strict=True)):
            group = np.where(np.isnan(y), -1, np.where(held, -1, 0))
            label = np.nan_to_num(y)
            if teach is not None:
                said, (low, high) = teach[1 - k].logit(views[1 - k]), teach[1 - k].cuts
                free = np.isnan(y)
                group[free & (said < low)], group[free & (said > high)] = 1, 2
                label = np.where(free, said > high, label)
            for g in range(_GROUPS):
                z, mine = m.rows(x[group == g]), label[group == g]
                p = 1 / (1 + np.exp(-np.clip(z @ m.weights, -30, 30)))
                out += [np.array([len(z)]), z.T @ (mine - p), ((z * np.maximum(p * (1 - p), LEAST_CURVE)[:, None]).T @ z).ravel()]
        return np.concatenate(out)

    return of


_STEP_SIZE = sum(_GROUPS * (1 + d + 1 + (d + 1) ** 2) for d in _SIZES)


def _stepped(models: list[View], sums: np.ndarray, labelled: tuple[float, float]) -> tuple[list[View], list[list[float]]]:
    """Models after a Newton step, and how many rows each view was taught."""
    at, out, taught = 0, [], []
    for m in models:
        d = len(m.weights)
        parts = sums[at : at + _GROUPS * (1 + d + d * d)].reshape(_GROUPS, 1 + d + d * d)
        at += parts.size
        many = parts[1:, 0]
        # pseudo-labelled rows of a class weigh as much together as its labelled ones at most, and both classes the same share of that
        share = min(min(1.0, n / c) for n, c in zip(many, labelled, strict=True))
        weight = np.array([1.0, *(share * c / n if n else 0.0 for n, c in zip(many, labelled, strict=True))])
        both = weight @ parts
        out.append(View(m.mean, m.scale, solved(both[1 : 1 + d], both[1 + d :].reshape(d, d), m.weights)))
        taught.append([float(n) if share else 0.0 for n in many])
    return out, taught


def cuts_of(bad: np.ndarray, good: np.ndarray, middle: np.ndarray) -> tuple[float, float]:
    """Logits beyond which held-out rows of one class alone stand, as good as: of n rows e are wrong and (e + 1) / (n + 1) is at most 1 - SURE."""

    def cut(right: np.ndarray, wrong: np.ndarray) -> float:
        """Over cells from the surest on, the last that qualifies."""
        n, e = np.cumsum(right + wrong), np.cumsum(wrong)
        fits = np.flatnonzero((e + 1) <= (1 - SURE) * (n + 1))
        return fits[-1] if len(fits) else -1

    low, high = cut(bad, good), cut(good[::-1], bad[::-1])
    half = (middle[1] - middle[0]) / 2
    return (middle[low] + half if low >= 0 else -np.inf, middle[len(middle) - 1 - high] - half if high >= 0 else np.inf)


def _cells(models: list[View], only_held: bool):
    edges = lambda logit: np.clip((logit + BOUND) / (2 * BOUND) * GRID, 0, GRID - 1).astype(np.int64)

    def of(views, y, held):
        some = held if only_held else ~np.isnan(y)
        a, b = (edges(m.logit(x[some])) for m, x in zip(models, views, strict=True))
        return np.bincount((y[some].astype(np.int64) * GRID + a) * GRID + b, minlength=2 * GRID * GRID).astype(float)

    return of


def _calibrated(rows: DataFrame, models: list[View], held: tuple[float, float]) -> CoTrained:
    """models with their curves, on the held-out rows (on all labelled ones if these are not of both classes)."""
    grid = _summed(rows, 2 * GRID * GRID, _cells(models, min(held) >= 1)).reshape(2, GRID, GRID)
    y, a, b = np.nonzero(grid)
    middle = lambda k: (k + 0.5) / GRID * 2 * BOUND - BOUND
    out = CoTrained(models)
    out.calibrate(np.column_stack([middle(a), middle(b)]), y.astype(float), grid[y, a, b])
    for k, v in enumerate(out.views):
        low, high = cuts_of(*grid.sum(axis=2 - k), middle(np.arange(GRID)))
        slope, constant = v.curve
        if slope > 0:  # and its curve must say so
            v.cuts = min(low, (-np.log(SURE / (1 - SURE)) - constant) / slope), max(high, (np.log(SURE / (1 - SURE)) - constant) / slope)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> CoTrained | None:
    """The models, from docs and labels (doc_id, quality)."""
    tables = Tables(docs.sparkSession)
    rows = tables.keep(features(docs, labels, id_col, text_col), "features")
    got = _summed(rows, 4 + 2 * sum(_SIZES), _moments)
    if min(got[:2]) < 1 <= min(got[:2] + got[2:4]):  # too few labels to hold any out
        rows = rows.withColumn("held", F.lit(False))
        got = _summed(rows, 4 + 2 * sum(_SIZES), _moments)
    labelled, held = (got[0], got[1]), (got[2], got[3])
    if min(labelled) < 1:
        return None
    models, at = [], 4
    for d in _SIZES:
        mean = got[at : at + d] / sum(labelled)
        spread = np.sqrt(np.maximum(got[at + d : at + 2 * d] / sum(labelled) - mean**2, 0))
        models.append(View(mean, np.where(spread < 1e-6, 1.0, spread), np.zeros(d + 1)))
        at += 2 * d
    for _ in range(FIRST_STEPS):
        models, taught = _stepped(models, _summed(rows, _STEP_SIZE, _newton(models, None)), labelled)
    for _ in range(rounds):
        teach = _calibrated(rows, models, held).views
        for _ in range(STEPS):
            models, taught = _stepped(models, _summed(rows, _STEP_SIZE, _newton(models, teach)), labelled)
        if not any(map(sum, taught)):
            break
    out = _calibrated(rows, models, held)
    tables.drop(rows)
    out.exchanged = taught[::-1]  # what a view was taught the other said
    release_memory()
    return out


def scored(model: CoTrained | None, batch: pa.RecordBatch) -> np.ndarray:
    content, meta, n_words = _arrays(batch)
    score = model.score(content, meta) if model else np.ones(len(n_words))
    return np.where(n_words > 0, score, 0.0)


def classify(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (rounded to 6 places), kept."""
    t = _picked(docs, id_col, text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.round(scored(model, batch), 6)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array(score >= KEEP_FROM)], ["doc_id", "score", "kept"])

    return map_texts(t, fn, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, score double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {k: names.index(k) if k in names else None for k in ("text", "source", "lang", "n_chars")}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        nothing = pa.nulls(part.num_rows, pa.string())
        view = {k: nothing if i is None else part.column(i) for k, i in at.items()}
        view["source"], view["lang"] = view["source"].cast(pa.string()), view["lang"].cast(pa.string())
        good = np.round(scored(model, pa.RecordBatch.from_pydict(view)), 6) >= KEEP_FROM
        return part.filter(pa.array(good))

    return map_texts(flat, run, flat.schema, f"c{at['text']}").toDF(*names)


def op6_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
