"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Seed entities (the spans of the fixed patterns) induce lexical patterns: the word before an entity, its two words before, the word
before and the word after, and the word after; the begin and the end of a line count as words. A pattern takes either
units with digits or units without, as its seeds are. Every other word is a candidate instance, and groups of digits with
blanks, dots or brackets between them are one. Patterns and instances are scored in rounds: a pattern that several different instances
accepted so far support is as sure as the mean score of all its instances, held down while it has few; what stands in a sure pattern is
accepted, as sure as its sure patterns together, and may support other patterns in the next round. Patterns that end up sure give their unseen instances.

The graph's tables stay in Spark. What is sent to the workers is the supported patterns and the newly accepted instances, MOST_SENT at a time. For a
pattern only lines with its words are looked at. Words of running text stand before anything: a pattern seen with more instances than its support allows
for can't be sure, and a part of the texts that shows them proves it, so such patterns are ruled out on a part, and on
no more; all instances of the others are found in all texts. A seed supports the patterns around its spans, an accepted instance those around all its occurrences.

Defined results: a null text counts as empty and has no spans; very long texts are scanned whole; repeated rows give repeated
results, and count once as support (support is by distinct instance); ties don't arise, scores are not ranked; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, map_texts, pick

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 4
#: A pattern must be supported by so many different accepted instances and score so much.
LEAST_SEEDS, LEAST_SCORE = 5, 0.8
PRIOR = 1.0
#: One text in so many is gone through to rule patterns out; the last part is all texts.
PARTS = (64, 8, 1)
#: Patterns, or instances, that are sent to the workers at once; with more, the texts are gone through several times.
MOST_SENT = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'“”‘’()[]{}<>,;:.!?|#*$%&"


def emails(text: str):
    """Leftmost matches of the address pattern, in linear time: from each @, back over the local part, then the domain."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, in code points, sorted."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def _table(chars: str) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_BLANK, _IS_EDGE, _IS_LABEL = _table(" \t\n\v\f\r"), _table(_EDGE), _table(":=#")
_IS_DIGIT, _IS_PART, _IS_JOINT, _IS_LOOSE = _table("0123456789"), _table("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ.()/+-"), _table(" ().-+"), _table(" \t\n\v\f\r().-")
_IS_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Marks: before the first word of a text, before the first word of a line, after the last one.
_FIRST, _START, _END = np.uint64(1), np.uint64(2), np.uint64(3)


def _mix(*parts) -> np.ndarray:
    """A 64-bit hash of the parts in their order."""
    h = np.uint64(0x51)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


_MIXED = _mix(np.arange(1 << 16, dtype=np.uint64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the base and of its inverse; kept, as every slice needs them."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _UNBASE)):
            p = np.full(n + n // 4, b)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return [p[:n] for p in _POWERS]


class _Hashes:
    """Hashes of stretches of a sequence of signs."""

    def __init__(self, signs: np.ndarray):
        n = len(signs) + 1
        powers, self.inverse = _powers(n)
        h = _MIXED[np.minimum(signs, 0xFFFF)]
        high = np.flatnonzero(signs > 0xFFFF)
        h[high] = _mix(signs[high].astype(np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * powers[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def units(texts: list[str], base: list[list[tuple[int, int, int]]]) -> dict[str, np.ndarray]:
    """All seeds and candidates of texts: row, start, end, seed, instance (hash) and patterns (four hashes each)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    u = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(u < 1 << 16, u, 0xFFFF)
    sa = np.array([begin[i] + a for i, spans in enumerate(base) for _, a, _ in spans], np.int64)
    sb = np.array([begin[i] + b for i, spans in enumerate(base) for _, _, b in spans], np.int64)
    inside = np.zeros(len(u), bool)
    for a, b in zip(sa.tolist(), sb.tolist(), strict=True):
        inside[a:b] = True
    # words: between blanks, and cut where a fixed span begins or ends, and after a label that is written together with its value
    full = ~_IS_BLANK[c] | inside
    cut = np.zeros(len(u) + 1, bool)
    cut[:-1][1:] = inside[1:] != inside[:-1]
    cut[2:-1] |= _IS_LABEL[c[1:-1]] & _IS_LETTER[c[:-2]] & (_IS_LETTER[c[2:]] | _IS_DIGIT[c[2:]] | (c[2:] == 43) | (c[2:] == 40))
    cut[:-1] &= full & ~np.concatenate([[False], inside[:-1] & inside[1:]])
    before = np.concatenate([[False], full])
    after = np.concatenate([full, [False]])
    ws = np.flatnonzero(after & (~before | cut))
    we = np.flatnonzero(before & (~after | cut))
    plain = _sums(~_IS_EDGE[c])
    held = inside[ws] if len(ws) else np.zeros(0, bool)
    bare = plain[we] == plain[ws]  # signs alone; those that touch a span are no words
    beside = np.zeros(len(ws), bool)
    if len(ws) > 1:
        near = we[:-1] == ws[1:]
        beside[:-1] |= near & held[1:]
        beside[1:] |= near & held[:-1]
    stay = ~(bare & beside & ~held)
    ws, we, held, bare = ws[stay], we[stay], held[stay], bare[stay]
    n = len(ws)
    row = np.searchsorted(begin, ws, "right") - 1
    line = _sums(c == 10)[ws]
    solid = np.append(np.flatnonzero(~_IS_EDGE[c]), len(u))
    ts, te = solid[np.searchsorted(solid, ws)], solid[np.searchsorted(solid, we) - 1] + 1
    digits = _sums(_IS_DIGIT[c])
    free = ~held & ~bare
    ts, te = np.where(free, ts, ws), np.where(free, te, we)
    some = digits[te] > digits[ts]
    # groups of digits that only blanks, dots and brackets divide (and short groups of capitals between them)
    parts, joints = _sums(~_IS_PART[c]), _sums(~_IS_JOINT[c])
    part = free & (parts[te] == parts[ts]) & (some | (te - ts <= 4))
    go = np.zeros(n, bool)
    if n > 1:
        go[1:] = part[1:] & part[:-1] & (line[1:] == line[:-1]) & (joints[ts[1:]] == joints[te[:-1]]) & (ts[1:] > te[:-1])
    group = np.cumsum(~go) - 1
    where = np.arange(n)
    lead, last = np.full(n, n), np.full(n, -1)
    np.minimum.at(lead, group[some & part], where[some & part])
    np.maximum.at(last, group[some & part], where[some & part])
    within = part & (where >= lead[group]) & (where <= last[group]) if n else part
    single = free & ~within
    heads = within & (where == lead[group]) if n else within
    i = np.concatenate([where[single], where[heads]])
    j = np.concatenate([where[single], last[group[heads]]])
    a, b, seed = ts[i], te[j], np.zeros(len(i), bool)
    if len(sa):
        x = np.searchsorted(ws, sa, "right") - 1
        y = np.searchsorted(we, sb, "left")
        i, j, a, b, seed = np.concatenate([i, x]), np.concatenate([j, y]), np.concatenate([a, sa]), np.concatenate([b, sb]), np.concatenate([seed, np.ones(len(sa), bool)])
    low = np.where(u < 1 << 16, _LOWER[c], u)
    word = _Hashes(np.where(_IS_DIGIT[c], 48, low)).of(ws, we)
    loose = ~_IS_LOOSE[c]
    at = _sums(loose)
    instance = _Hashes(low[loose]).of(at[a], at[b])

    def neighbour(k):
        """Hash, and whether on the unit's line and in its text."""
        k_ = np.clip(k, 0, max(0, n - 1))
        there = (k >= 0) & (k < n) & (row[k_] == row[i])
        return word[k_], there & (line[k_] == line[np.where(k < i, i, j)]), there

    w1, same1, there1 = neighbour(i - 1)
    w2, same2, _ = neighbour(i - 2)
    w3, same3, _ = neighbour(j + 1)
    left = np.where(same1, w1, np.where(there1, _mix(_START, w1), _FIRST))
    left2 = np.where(same2, w2, _START)
    right = np.where(same3, w3, _END)
    kind = (digits[b] > digits[a]).astype(np.uint64)
    patterns = np.stack([_mix(np.uint64(11), kind, left), _mix(np.uint64(12), kind, left2, left), _mix(np.uint64(13), kind, left, right), _mix(np.uint64(14), kind, right)])
    good = at[b] > at[a]
    r = row[i]
    ends = np.stack([np.where(there1, np.clip(i - 1, 0, None), -1), np.where(same3, np.clip(j + 1, None, max(0, n - 1)), -1)])
    return {
        "row": r[good], "start": (a - begin[r])[good], "end": (b - begin[r])[good], "seed": seed[good], "instance": instance[good].view(np.int64), "patterns": patterns[:, good].view(np.int64),
        "same": same1[good], "digits": kind[good] > 0, "ends": ends[:, good], "words": np.stack([ws, we]), "signs": np.where(_IS_DIGIT[c], 48, low), "bare": low[loose], "at": np.stack([at[a], at[b]])[:, good],
    }


def _text(signs: np.ndarray) -> str:
    return signs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def anchors(u: dict[str, np.ndarray], pattern: np.ndarray, unit: np.ndarray) -> list[str]:
    """What to look for to find a pattern's lines again: 0 or 1 for units without or with digits, then S and a word on the line,
    N and the last word before the line, F: a text's first line, or E: every line."""
    out, cache = [], {}
    for p, k in zip(pattern.tolist(), unit.tolist(), strict=True):
        kind = "1" if u["digits"][k] else "0"
        w = int(u["ends"][1 if p == 3 else 0, k])
        if w < 0:
            out.append(kind + ("E" if p == 3 else "F"))
            continue
        word = cache.get(w)
        if word is None:
            word = cache[w] = _text(u["signs"][u["words"][0, w] : u["words"][1, w]])
        out.append(kind + ("S" if p == 3 or u["same"][k] else "N") + word)
    return out


def bare_texts(u: dict[str, np.ndarray], unit: np.ndarray) -> list[str]:
    """The instances' signs that count."""
    return [_text(u["bare"][u["at"][0, k] : u["at"][1, k]]) for k in unit.tolist()]


_FOLD = bytes(48 if chr(i) in "0123456789" else ord(chr(i).lower()) for i in range(128)) + bytes(range(128, 256))
_LOW = bytes(ord(chr(i).lower()) for i in range(128)) + bytes(range(128, 256))


def _folded(text: str, digits: bool = True) -> bytes:
    """The text as words are compared: lower case, sign by sign, and all digits alike; in UTF-8."""
    if text.isascii():
        return text.encode().translate(_FOLD if digits else _LOW)
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(u < 1 << 16, u, 0xFFFF)
    low = np.where(u < 1 << 16, _LOWER[c], u)
    return _text(np.where(_IS_DIGIT[c], 48, low) if digits else low).encode("utf-8", "surrogatepass")


def _ends_in(words: frozenset[bytes], line: bytes, last: bool = False) -> bool:
    """Whether one of words is among the line's (or is its last one); a label's sign may end a word."""
    if not words:
        return False
    if not words.isdisjoint(line.split()[-1:] if last else line.split()):
        return True
    some = [k for k in (b":", b"=", b"#") if k in line]
    for k in some:
        line = line.replace(k, k + b" ")
    return bool(some) and not words.isdisjoint(line.split()[-1:] if last else line.split())


class Anchors:
    """Lines that may hold a unit of some patterns. It errs on the side of too many: a line with a fixed span always counts."""

    def __init__(self, wanted: list[str]):
        of = lambda k: frozenset(w[2:].encode("utf-8", "surrogatepass") for w in wanted if w.startswith(k))
        # of units without digits and with digits
        self.same, self.next = [of("0S"), of("1S")], [of("0N"), of("1N")]
        self.every, self.first = ["0E" in wanted, "1E" in wanted], ["0F" in wanted, "1F" in wanted]
        self.plain = bool(self.same[0] or self.next[0] or self.every[0] or self.first[0])

    def __call__(self, text: str, spans: list[tuple[int, int, int]]) -> list[int] | None:
        """The numbers of the lines, None for all."""
        if self.every[0]:
            return None
        digits = _DIGIT.search(text) is not None
        if not (digits or spans or self.plain):
            return []
        folded = _folded(text)
        if not (digits or spans or self.first[0] or _ends_in(self.same[0] | self.next[0], folded)):
            return []
        held = set(_with_spans(text, spans))
        out, before = [], None  # the last line with words
        for k, line in enumerate(folded.split(b"\n")):
            if line and not line.isspace():
                if k in held or self._meets(line, before, 1 if b"0" in line else 0, k - 1 in held or (before is not None and before[1] in held)):
                    out.append(k)
                before = line, k
        return out

    def _meets(self, line: bytes, before: tuple[bytes, int] | None, most: int, span_before: bool) -> bool:
        for kind in range(0 if self.plain else 1, most + 1):
            if self.every[kind] or _ends_in(self.same[kind], line) or (before is None and self.first[kind]):
                return True
            if before is not None and self.next[kind] and (span_before or _ends_in(self.next[kind], before[0], last=True)):
                return True
        return False


class Known:
    """Lines that may hold one of some instances."""

    def __init__(self, wanted: list[str]):
        import ahocorasick

        self.found = []
        for some in ([w for w in wanted if not _DIGIT.search(w)], [w for w in wanted if _DIGIT.search(w)]):
            self.found.append(ahocorasick.Automaton(ahocorasick.STORE_LENGTH) if some else None)
            for w in some:
                self.found[-1].add_word(w)
            if some:
                self.found[-1].make_automaton()

    def __call__(self, text: str, spans: list[tuple[int, int, int]]) -> list[int]:
        if self.found[0] is None and not _DIGIT.search(text):
            return []
        out = []
        for k, line in enumerate(text.split("\n")):
            automata = [a for a in (self.found if _DIGIT.search(line) else self.found[:1]) if a is not None]
            if line and automata:
                bare = _folded(line, digits=False).translate(None, b" \t\v\f\r().-").decode("utf-8", "surrogatepass")
                if any(next(a.iter(bare), None) is not None for a in automata):
                    out.append(k)
        return out


def units_of_lines(texts: list[str], base: list[list[tuple[int, int, int]]], lines) -> dict[str, np.ndarray]:
    """units() of the lines that lines(text, spans) names, each seen after the line with words before it; rows and places are those of the whole texts."""
    rows, parts, spans, maps = [], [], [], []
    for r, (text, own) in enumerate(zip(texts, base, strict=True)):
        got = lines(text, own)
        if got is None:
            rows.append(r), parts.append(text), spans.append(own), maps.append(None)
        elif got:
            old = text.split("\n")
            begin = list(itertools.accumulate((len(x) + 1 for x in old), initial=0))
            take, wanted = [], set(got)
            for k in got:
                j = k - 1
                while j >= 0 and not old[j].strip(" \t\v\f\r"):
                    j -= 1
                if j >= 0 and (not take or take[-1] < j):
                    take.append(j)
                take.append(k)
            part = "\n".join(old[k] for k in take)
            starts = list(itertools.accumulate((len(old[k]) + 1 for k in take), initial=0))[:-1]
            rows.append(r), parts.append(part), spans.append(base_spans(part))
            maps.append((np.array(starts), np.array([begin[k] for k in take]), np.array([k in wanted for k in take])))
    u = units(parts, spans)
    keep = np.ones(len(u["row"]), bool)
    heads = np.searchsorted(u["row"], np.arange(len(rows) + 1)) if np.all(u["row"][:-1] <= u["row"][1:]) else None
    for k, m in enumerate(maps):
        if m is not None:
            mine = slice(heads[k], heads[k + 1]) if heads is not None else u["row"] == k
            line = np.searchsorted(m[0], u["start"][mine], "right") - 1
            keep[mine] = m[2][line]
            shift = m[1][line] - m[0][line]
            u["start"][mine] += shift
            u["end"][mine] += shift
    u["row"] = np.array(rows, np.int64)[u["row"]] if rows else u["row"]
    for k in ("row", "start", "end", "seed", "instance", "same", "digits"):
        u[k] = u[k][keep]
    for k in ("patterns", "ends", "at"):
        u[k] = u[k][:, keep]
    return u


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in known, which is sorted."""
    if not len(known):
        return np.zeros(x.shape, bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _with_spans(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    cut = [0, *(i + 1 for i, x in enumerate(text) if x == "\n")] if spans else []
    return sorted({bisect.bisect_right(cut, a) - 1 for _, a, _ in spans})


_PAIRS = "pattern long, instance long, anchor string, bare string"


def _pairs(t: DataFrame, lines, use, most: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Distinct pairs (pattern, instance), each with the pattern's anchor and the instance's signs.

    lines: a maker of the function that names lines, and what it is made from; use(u): a mask of the (pattern, unit) pairs wanted. most: sorted patterns and
    the greatest number of instances each can have and still be sure; where a slice alone holds more, a null instance stands for all.
    """
    sent = t.sparkSession.sparkContext.broadcast((lines, use, most))
    made: list = []

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, use, most = sent.value
        if not made:
            made.append(lines[0](*lines[1:]) if isinstance(lines, tuple) else lines)
        texts = [x or "" for x in batch["text"].to_pylist()]
        u = units_of_lines(texts, [base_spans(x) for x in texts], made[0])
        which, unit = np.nonzero(use(u))
        p, i = u["patterns"][which, unit], u["instance"][unit]
        order = np.lexsort((i, p))
        p, i, which, unit = p[order], i[order], which[order], unit[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
        p, i, which, unit = p[new], i[new], which[new], unit[new]
        void = np.zeros(len(p), bool)
        if most is not None and len(p):
            heads, at, many = np.unique(p, return_index=True, return_counts=True)
            over = many > most[1][np.searchsorted(most[0], heads)]
            stay = ~np.repeat(over, many)
            stay[at[over]] = True
            void[at[over]] = True
            p, i, which, unit, void = p[stay], i[stay], which[stay], unit[stay], void[stay]
        bare = ["" if v else x for v, x in zip(void.tolist(), bare_texts(u, unit), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(i, mask=void), pa.array(anchors(u, which, unit), pa.string()), pa.array(bare, pa.string())], ["pattern", "instance", "anchor", "bare"])

    # of a pattern all anchors, and of an instance all signs, are alike
    return map_texts(t, fn, _PAIRS).groupBy("pattern", "instance").agg(F.min("anchor").alias("anchor"), F.min("bare").alias("bare"))


class _Seeds:
    def __call__(self, u):
        return np.broadcast_to(u["seed"], u["patterns"].shape)


class _OfPatterns:
    def __init__(self, patterns: np.ndarray):
        self.patterns = patterns

    def __call__(self, u):
        return _among(u["patterns"], self.patterns)


class _OfInstances:
    def __init__(self, instances: np.ndarray):
        self.instances = instances

    def __call__(self, u):
        return np.broadcast_to(_among(u["instance"], self.instances), u["patterns"].shape)


def _chunks(df: DataFrame, key: str, *more: str, most: int | None = None):
    """Columns of df on the driver, ordered by key, no more than about ``most`` rows at a time."""
    many = df.count() // (most or MOST_SENT) + 1
    for k in range(many if many > 1 or not df.isEmpty() else 0):
        got = df.where(F.pmod(F.xxhash64(key), F.lit(many)) == k).select(key, *more).toArrow()
        order = np.argsort(got[key].to_numpy())
        yield got[key].to_numpy()[order], *(got[c].take(pa.array(order)) for c in more)


class Bootstrap:
    """The graph of patterns and instances as it grows; all its tables stay in Spark."""

    def __init__(self, t: DataFrame):
        self.t, self.tables = t, Tables(t.sparkSession)
        nothing = t.sparkSession.createDataFrame([], "pattern long, instance long, anchor string, bare string")
        self.pairs = self.tables.keep(_pairs(t, _with_spans, _Seeds()), "seeds")
        self.seeds = self.tables.keep(self.pairs.select("instance").distinct().withColumn("score", F.lit(1.0)), "seed-instances")
        self.edges, self.full = nothing, nothing.select("pattern")
        self.bounds = nothing.selectExpr("pattern", "cast(null as long) as seen")
        self.reached = (0, 0.0)  # sure patterns, and the sum of their scores
        self.scores, self.sure = self.seeds, nothing.selectExpr("pattern", "anchor", "0d as p_score")

    def support(self) -> DataFrame:
        """Patterns with enough accepted instances, and how many instances each can have and still be sure."""
        got = self.pairs.join(self.scores.select(F.col("instance").alias("k"), "score"), F.col("instance") == F.col("k"))
        per = got.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.min("anchor").alias("anchor"))
        per = per.where((F.col("n") >= LEAST_SEEDS) & (F.col("s") >= LEAST_SCORE * (F.col("n") + PRIOR)))
        return self.tables.keep(per.withColumn("most", F.floor(F.col("s") / LEAST_SCORE - PRIOR + 1e-9)), "support")

    def enumerate(self, support: DataFrame) -> None:
        """All instances of the supported patterns that can be sure.

        A pattern of running text is soon seen with more instances than it can have: a part of the texts that shows them
        is proof enough. So texts are gone through in parts that grow, and only what stands the last, which is all texts, is kept.
        """
        todo = support.join(self.full, "pattern", "left_anti").join(self.bounds.groupBy("pattern").agg(F.max("seen").alias("seen")), "pattern", "left")
        todo = self.tables.keep(todo.where("seen is null or seen <= most").select("pattern", "most", "anchor"), "todo")
        for share in PARTS:
            part = self.t if share == 1 else self.t.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
            for known, most, wanted in _chunks(todo, "pattern", "most", "anchor"):
                lines = Anchors, sorted(set(wanted.to_pylist()))
                got = self.tables.keep(_pairs(part, lines, _OfPatterns(known), (known, most.to_numpy())), "edges")
                per = got.groupBy("pattern").agg(F.count("instance").alias("seen"), F.bool_or(F.col("instance").isNull()).alias("over")).join(todo.select("pattern", "most"), "pattern")
                per = self.tables.keep(per.select("pattern", F.when(F.col("over"), F.greatest(F.col("seen"), F.col("most") + 1)).otherwise(F.col("seen")).alias("seen"), "most"), "counts")
                self.bounds = self.bounds.union(per.where("seen > most").select("pattern", "seen"))
                if share == 1:
                    self.full = self.full.union(per.where("seen <= most").select("pattern"))
                    self.edges = self.edges.union(got.join(per.where("seen <= most").select("pattern"), "pattern").select(*self.edges.columns))
            if todo.isEmpty():
                return
            todo = self.tables.keep(todo.join(self.bounds.groupBy("pattern").agg(F.max("seen").alias("seen")), "pattern", "left").where("seen is null or seen <= most").select("pattern", "most", "anchor"), "todo")

    def round(self) -> bool:
        """One round; false if nothing came of it."""
        support = self.support()
        self.enumerate(support)
        per = self.edges.groupBy("pattern").agg(F.count("*").alias("all"))
        sure = support.join(per, "pattern").select("pattern", "anchor", (F.col("s") / (F.col("all") + PRIOR)).alias("p_score")).where(F.col("p_score") >= LEAST_SCORE)
        self.sure = self.tables.keep(sure, "sure")
        # sure if any of its patterns is: one less the chance that all are wrong
        lent = self.edges.join(self.sure.select("pattern", F.least("p_score", F.lit(0.999)).alias("p_score")), "pattern").join(self.seeds.select("instance"), "instance", "left_anti")
        lent = lent.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("p_score"))))).alias("score"), F.min("bare").alias("bare"))
        lent = self.tables.keep(lent, "lent")
        new = self.tables.keep(lent.join(self.scores, "instance", "left_anti").select("instance", "bare"), "new")
        self.scores = self.seeds.union(lent.select("instance", "score"))
        before, self.reached = self.reached, tuple(self.sure.agg(F.count("*"), F.coalesce(F.sum("p_score"), F.lit(0.0))).first())
        if new.isEmpty():
            return before[0] != self.reached[0] or abs(before[1] - self.reached[1]) > 1e-6
        for known, bare in _chunks(new, "instance", "bare"):
            lines = Known, bare.to_pylist()
            self.pairs = self.pairs.union(self.tables.keep(_pairs(self.t, lines, _OfInstances(known)), "pairs"))
        return True


def sure_patterns(t: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, anchor and p_score of the patterns that are sure in the end."""
    graph = Bootstrap(t)
    for _ in range(rounds):
        if not graph.round():
            break
    return graph.sure


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of df: doc_id, counts of the base kinds, base_sha256, spans, n_context, has_private (any span)."""
    t = pick(df, doc_id=id_col, text=text_col)
    kind = t.schema["doc_id"].dataType.simpleString()
    found = t.withColumn("context", F.expr("cast(array() as array<bigint>)"))
    # beyond MOST_SENT patterns the texts are gone through again for the rest
    for known, wanted in _chunks(sure_patterns(t.select("text"), rounds), "pattern", "anchor"):
        sent = df.sparkSession.sparkContext.broadcast((known, sorted(set(wanted.to_pylist()))))

        def look(batch: pa.RecordBatch, sent=sent, made=[]) -> pa.RecordBatch:  # noqa: B006
            if not made:
                made.append(Anchors(sent.value[1]))
            texts = [x or "" for x in batch["text"].to_pylist()]
            u = units_of_lines(texts, [base_spans(x) for x in texts], made[0])
            hit = ~u["seed"] & _among(u["patterns"], sent.value[0]).any(axis=0)
            out = batch["context"].to_pylist()
            for r, a, b in zip(u["row"][hit].tolist(), u["start"][hit].tolist(), u["end"][hit].tolist(), strict=True):
                out[r] += [a, b]
            return batch.set_column(2, "context", pa.array(out, pa.list_(pa.int64())))

        found = map_texts(found, look, found.schema)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        base = [base_spans(x or "") for x in batch["text"].to_pylist()]
        extra = [sorted({(4, a, b) for a, b in zip(x[::2], x[1::2], strict=True)}) for x in batch["context"].to_pylist()]
        text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(4)]
        sha = pa.array([hashlib.sha256(text(spans).encode()).hexdigest() for spans in base], pa.string())
        spans = pa.array([text([*x, *y]) for x, y in zip(base, extra, strict=True)], pa.string())
        some = pa.array([bool(x or y) for x, y in zip(base, extra, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch["doc_id"], *counts, sha, spans, pa.array([len(x) for x in extra], pa.int64()), some], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_context", "has_private"])

    return map_texts(found, fn, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base_sha256 string, spans string, n_context long, has_private boolean")


def op5_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
