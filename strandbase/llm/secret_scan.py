"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two models of order 2 are trained from labelled samples: secrets (what the fixed patterns find in all texts, and random strings of the usual key
alphabets, seeded) and ordinary text (all other words of all texts, and identifiers, numbers and rules built from words of the corpus
and a short fixed list). A run of key characters, or what fixed patterns leave of it, is a secret if its log-likelihood ratio a character
exceeds a threshold for its length set on held-out samples, so that at most MISTAKES of the ordinary ones pass. If the whole is none, the
part between separators that exceeds most is judged, and then what lies beside it.

The corpus is counted once: every task adds up its trigrams in a table of fixed size, and Spark adds up the tables, so the driver gets one
row for each of at most 69**3 trigrams and label. Built identifiers take their words from a bounded sample of documents (SAMPLE_DOCS different ones,
SAMPLE_WORDS words); the scan covers every text.

Defined results: a null text counts as empty and has no spans; very long texts are scanned whole; repeated rows give
repeated results and count as often; ties can't arise, as spans of the model never overlap others; without any words the fixed list alone trains the
model; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pick, release_memory, settled, sliced

SAMPLE_DOCS = 2_000
SAMPLE_WORDS = 20_000
RANDOM_STRINGS = 8_000
MISTAKES = 0.0005
#: The weight of what fixed patterns find in the corpus, of that of the random strings: passwords are often words.
SECRET_SHARE = 0.25
#: What words the sample lacks may hold: without it a few unseen letters would make any word a secret.
FLOOR = 0.2
#: The log-odds against a secret before it is read: a run must speak for one by more.
ODDS = 7.0
#: A run must be this long to be judged at all; thresholds are set at these lengths and hold up to the next.
LEAST_LENGTH = 12
LENGTHS = (12, 14, 16, 20, 24, 32, 48)
KINDS = ("assign", "access", "hex", "model")
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}=*")
_PART = re.compile(r"[^+/_-]+|[+/_-]+")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(128, len(_LETTERS), np.int64)
_CODE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
_N = len(_LETTERS) + 1
#: Ordinary parts of identifiers that any corpus may lack.
ORDINARY = "get set user name file path index count value table column request response session config default client server handler manager update delete create object string number message version buffer thread context result status error".split()
#: Words of other languages, for their letter sequences.
ORDINARY += "zwischen wissenschaft entwicklung verwaltung wirtschaft freundschaft hoffnung bundesrepublik autobahn kraftwerk landschaft fenster hauptstadt schlüssel dampfer pfund fahrer fluss donner geschichte gemeinschaft schiffe rechnung nachricht aussage monde toujours gouvernement beaucoup aujourd question voyage ciudad desarrollo gobierno siempre trabajo escuela noticias palabra sviluppo governo sempre lavoro scuola parola".replace("ü", "ue").split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def trigrams(samples: list[str]) -> np.ndarray:
    counts = np.zeros((_N, _N, _N))
    for s in samples:
        c = codes(s)
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    return counts


class Markov:
    """Transition log-probabilities of order 2; what was seen too little falls back on orders 1 and 0, and a share FLOOR on none."""

    def __init__(self, counts: np.ndarray, weight: float = 8.0):
        zero = (counts.sum(axis=(0, 1)) + 0.5) / (counts.sum() + 0.5 * _N)
        one = counts.sum(axis=0)
        one = (one + weight * zero) / (one.sum(axis=1, keepdims=True) + weight)
        two = (counts + weight * one[None]) / (counts.sum(axis=2, keepdims=True) + weight)
        self.table = np.log((1 - FLOOR) * two + FLOOR / _N)


def codes(s: str) -> np.ndarray:
    """Symbol numbers after two start marks."""
    return np.concatenate([[_N - 1, _N - 1], _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]])


def random_strings(n: int, rng: random.Random) -> list[str]:
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", _LETTERS[:62], _LETTERS[:64], _LETTERS[:62] + "_-", _LETTERS[:26] + "234567", _LETTERS[26:62]]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(20, 65))) for _ in range(n)]


def identifiers(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Ordinary identifiers: words joined in the usual ways, some with small numbers or paths."""
    out, words = [], sorted(set(words) | set(ORDINARY))
    for _ in range(n):
        parts = [rng.choice(words) for _ in range(rng.randrange(2, 6))]
        style = rng.randrange(6)
        if style < 2:
            s = "_-"[style].join(p.lower() for p in parts)
        elif style == 2:
            s = parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        elif style == 3:
            s = "/".join(p.lower() for p in parts)
        elif style == 4:
            s = "_".join(p.upper() for p in parts)
        else:
            s = "".join(p.lower() for p in parts)
        if rng.random() < 0.5:
            s += rng.choice(["", "_", "-", "/"]) + str(rng.choice([rng.randrange(100), rng.randrange(1990, 2030), rng.randrange(10**6)]))
        out.append(s)
    return out


def ordinary_runs(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Identifiers, single words, numbers and rules, as texts hold them."""
    out, words = identifiers(words, n - n // 4, rng), sorted(set(words) | set(ORDINARY))
    for _ in range(n // 4):
        style = rng.randrange(4)
        if style == 0:
            w = rng.choice(words)
            out.append(rng.choice([w, w.lower(), w.upper(), w.capitalize()]) + rng.choice(["", "-" + rng.choice(words)]))
        elif style < 3:
            out.append(rng.choice(["", "-"]).join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 5))))
        else:
            out.append(rng.choice("-_/+-_x0") * rng.randrange(3, 80))
    return out


def joint(samples: np.ndarray, corpus: np.ndarray | None, share: float) -> np.ndarray:
    """Counts of samples and of the corpus, the latter with at most share of the samples' weight."""
    if corpus is None or not corpus.sum():
        return samples
    return samples + corpus * min(1.0, share * samples.sum() / corpus.sum())


class SecretModel:
    """words: ordinary words of the corpus; ordinary, secret: trigram counts of the corpus by label."""

    def __init__(self, words: list[str], ordinary: np.ndarray | None = None, secret: np.ndarray | None = None, seed: int = 11):
        rng = random.Random(seed)
        good, held_good = (ordinary_runs(words, RANDOM_STRINGS, rng) for _ in range(2))
        bad, held_bad = (random_strings(RANDOM_STRINGS, rng) for _ in range(2))
        self.ratio = Markov(joint(trigrams(bad), secret, SECRET_SHARE)).table - Markov(joint(trigrams(good), ordinary, 1.0)).table
        # short runs are cut from longer ones, and ordinary ones are joined to be long enough
        long = [f"{x}_{y}" if len(x) < LENGTHS[-1] else x for x, y in zip(held_good, held_good[1:] + held_good[:1], strict=True)]
        at = [np.sort([self.score(s[:n]) for s in {*held_good, *long} if len(s) >= n]) for n in LENGTHS]
        self.thresholds = [max(0.0, float(x[int(np.ceil(len(x) * (1 - MISTAKES))) - 1])) for x in at]
        found = lambda keys: float(np.mean([bool(self.spans(k, [])) for k in keys]))
        self.recall = found(held_bad[:2000])
        self.recall_at = {n: found([s[:n] for s in held_bad[:2000] if len(s) >= n]) for n in LENGTHS}

    def threshold(self, length: int) -> float:
        return max(self.thresholds[bisect.bisect_right(LENGTHS, length) - 1], ODDS / length)

    def score(self, s: str) -> float:
        """The log-likelihood ratio a character."""
        return float(self._ratios(s).sum()) / max(1, len(s))

    def _ratios(self, s: str) -> np.ndarray:
        c = codes(s)
        return self.ratio[c[:-2], c[1:-1], c[2:]]

    def _judged(self, s: str):
        """(start, end) of the secrets in a run."""
        if len(s) < LEAST_LENGTH:
            return
        ratios = self._ratios(s)
        if float(ratios.sum()) > self.threshold(len(s)) * len(s):
            yield 0, len(s)
            return
        parts = [m.span() for m in _PART.finditer(s)]
        if len(parts) < 2:
            return
        # the stretch of whole parts that exceeds the least threshold most
        over = np.concatenate([[0.0], np.cumsum(ratios - min(self.thresholds))])
        best, low, lead = (0.0, 0, 0), over[parts[0][0]], parts[0][0]
        for a, b in parts:
            if s[a] not in "+/_-" and over[a] <= low:
                low, lead = over[a], a
            if s[a] not in "+/_-" and over[b] - low > best[0]:
                best = over[b] - low, lead, b
        tries = [best[1:]] if best[2] > best[1] else []
        a, b = tries[0] if tries else (0, 0)
        if b - a >= LEAST_LENGTH and b - a < len(s) and self.score(s[a:b]) > self.threshold(b - a):
            yield from self._judged(s[:a])
            yield a, b
            yield from ((b + x, b + y) for x, y in self._judged(s[b:]))
            return
        for a, b in parts:
            if b - a >= LEAST_LENGTH and self.score(s[a:b]) > self.threshold(b - a):
                yield a, b

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """base and the runs that the models call random, sorted."""
        found, taken, j = [], merged(base), 0
        for m in _RUN.finditer(text):
            at, end = m.span()
            while j < len(taken) and taken[j][1] <= at:
                j += 1
            k = j
            while at < end:
                a, b = taken[k] if k < len(taken) and taken[k][0] < end else (end, end)
                if a > at:
                    found += [(at + x, 3, at + y) for x, y in self._judged(text[at:a])]
                at, k = max(at, b), k + 1
        return sorted(base + found) if found else base

    def scores(self, text: str, spans: list[tuple[int, int, int]]) -> list[float]:
        """The ratio a character of each span, whatever found it."""
        return [round(self.score(text[a:b]), 3) for a, _, b in spans]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What sorted spans cover, as stretches that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_CODE_OF_BYTE = np.full(256, -1, np.int64)
_CODE_OF_BYTE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
#: Letters of a word that counts as ordinary: in lower case, in upper case, or with one capital in front. Others may be parts of secrets.
WORD_LETTERS = (3, 16)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts, as one row of cells, of the ordinary words outside fixed patterns, and of what these found."""
    parts, keys = [], []
    for text in texts:
        base, at = base_spans(text), 0
        for a, b in merged(base):
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        for a, k, b in base:
            keys.append(_ASSIGN.match(text, a).group(2) if k == 0 else text[a:b])
    return _cells(" ".join(parts), words=True), _cells(" ".join(keys))


def _cells(text: str, words: bool = False) -> np.ndarray:
    """Trigrams of the runs of key characters, or of ordinary words; two marks stand before each."""
    c = _CODE_OF_BYTE[np.frombuffer(b"  " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    if words:
        letter, digit = (c >= 0) & (c < 52), (c >= 52) & (c < 62)
        begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        capitals = np.concatenate([[0], np.cumsum((c >= 0) & (c < 26))])
        many, size = capitals[end] - capitals[begin], end - begin
        good = (size >= WORD_LETTERS[0]) & (size <= WORD_LETTERS[1]) & ~digit[begin - 1] & ~digit[end]
        good &= (many == 0) | (many == size) | ((many == 1) & (c[begin] < 26))
        mark = np.zeros(len(c) + 1, np.int32)
        mark[begin[good]] = 1
        mark[end[good]] = -1
        c = np.where(np.cumsum(mark[:-1]) > 0, c, -1)
    inside = c[2:] >= 0
    one = np.where(c[1:-1] >= 0, c[1:-1], _N - 1)
    two = np.where((c[:-2] >= 0) & (c[1:-1] >= 0), c[:-2], _N - 1)
    return np.bincount(((two * _N + one) * _N + c[2:])[inside], minlength=_N**3)


def corpus_counts(t: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """counted() of all texts; each task sends a row for each trigram it met."""

    def run(batches):
        def sums():
            ordinary, secret = np.zeros(_N**3, np.int64), np.zeros(_N**3, np.int64)
            for batch in batches:
                for part in sliced(batch):
                    a, b = counted([x or "" for x in part["text"].to_pylist()])
                    ordinary += a
                    secret += b
            for label, n in ((0, ordinary), (1, secret)):
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), label, np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["label", "cell", "n"])

        return settled(sums())

    got = t.select("text").mapInArrow(run, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, _N**3))
    out[got["label"].to_numpy(), got["cell"].to_numpy()] = got["n"].to_numpy()
    return out[0].reshape(_N, _N, _N), out[1].reshape(_N, _N, _N)


def sample_words(t: DataFrame, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[str]:
    """Words of the different documents with the least hashes; both numbers are bounds."""
    h = F.xxhash64("doc_id", "text")
    least = t.select(h.alias("h")).distinct().orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    if least is None:
        return []
    some = t.where(h <= least).select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Za-z]{3,16}\b"), F.lit(0)))).alias("w"))
    return [r[0] for r in some.distinct().orderBy(F.xxhash64("w"), "w").limit(words).collect()]


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    t = pick(df, doc_id=id_col, text=text_col)
    model = SecretModel(sample_words(t), *corpus_counts(t))
    release_memory()
    return model


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by MASK; overlapping spans are replaced once."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            out += [text[at : max(a, at)], MASK if a >= at else ""]
            at = b
    return "".join(out) + text[at:]


def scan(df: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each row of df: doc_id, counts of the base kinds, base_sha256, spans, n_model, the ratio of each span and, if asked, masked_text."""
    t = pick(df, doc_id=id_col, text=text_col)
    model = model or trained(df, id_col, text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for text in batch["text"].to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = model.spans(text, base)
            kinds = [k for _, k, _ in spans]
            scores = model.scores(text, spans)
            text = masked(text, spans) if with_text else ""
            for c, v in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count(3), scores, text), strict=True):
                c.append(v)
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.float64()), pa.string()]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "scores", "masked_text"]
        n = 8 if with_text else 7
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols[:n], types, strict=False))], ["doc_id", *names[:n]])

    kind = t.schema["doc_id"].dataType.simpleString()
    return map_texts(t, fn, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, scores array<double>" + (", masked_text string" if with_text else ""))


def redact(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """docs with every secret in text replaced by MASK, and n_chars, if there, that of the new text."""
    names = docs.columns
    model = model or trained(docs)
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(at).to_pylist()
        new = [t if t is None else masked(t, model.spans(t, base_spans(t))) for t in texts]
        part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
        if size is not None:
            chars = [n if a == b else len(b) for n, a, b in zip(part.column(size).to_pylist(), texts, new, strict=True)]
            part = part.set_column(size, part.schema.field(size), pa.array(chars, part.schema.field(size).type))
        return part

    return map_texts(flat, run, flat.schema, f"c{at}").toDF(*names)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
