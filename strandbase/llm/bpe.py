"""BPE encoding by per-prefix dynamic programming, and decoding, for vocabularies with word ends.

For every prefix of a piece exactly one token can be the last of that prefix's encoding. A suffix automaton of the vocabulary,
fed symbol by symbol, gives the tokens that end at each position; a token is the last one if it is compatible with
the last token of the prefix before it, that is if merging the two tokens' text gives just these two tokens. One last
token per prefix is stored, and the ids follow from the back-pointers.

Whether two tokens are compatible follows from their merge histories: the right edge of the first token and the left edge
of the second change at known ranks, and the pair is broken if, at some time, a merge across the border comes first.

Defined results: a null text counts as empty and has no tokens; very long texts are worked off in parts, cut at blanks; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, pick, release_memory

VOCABULARY = "word_bpe_49k.json"
#: Bytes of pieces and ids, about, that a worker remembers in all; what an entry costs besides.
MEMORY_BYTES, ENTRY_BYTES = 48 << 20, 300
#: Characters that are worked off together, about, and of the parts that longer texts are cut into.
STEP_CHARS, PART_CHARS = 2 << 20, 1 << 18
#: Pairs of tokens whose compatibility a worker remembers before it starts anew.
PAIRS = 200_000
_END = 256


def _kinds() -> tuple[str, str]:
    """The letters and the numbers up to U+024F, as the inside of a character class."""
    of = lambda k: "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == k)
    return of("L"), of("N")


_L, _N = _kinds()
#: In this range normalisation is lower case only, and what is a letter or a number is the same in all Unicode versions.
_EASY = re.compile("[\0-\u012f\u0131-\u024f]*")
_EASY_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+").findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class SuffixAutomaton:
    """Of all tokens (sequences of symbols): from the longest suffix that occurs in a token, to the tokens it ends with.

    ``to`` maps state << 9 | symbol to a state; following ``up`` from a state gives the tokens that end there, long ones first.
    """

    def __init__(self, tokens: dict[tuple[int, ...], int]):
        self.length, self.link, self.to = [0], [-1], {}
        self.children: list[list[int]] = [[]]
        for token in tokens:
            last = 0
            for symbol in token:
                last = self._extend(last, symbol)
        del self.children
        # a token is the longest string of its state, so a state has one at most
        self.token = [-1] * len(self.length)
        for token, name in tokens.items():
            state = 0
            for symbol in token:
                state = self.to[state << 9 | symbol]
            self.token[state] = name
        self.up = [0] * len(self.length)  # the nearest suffix state with a token
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            link = self.link[s]
            self.up[s] = link if link and self.token[link] >= 0 else self.up[link] if link > 0 else 0

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.children.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        for s in self.children[q]:
            self.to[clone << 9 | s] = self.to[q << 9 | s]
        self.children[clone] = list(self.children[q])
        self.link[q] = clone
        while p >= 0 and self.to.get(p << 9 | symbol) == q:
            self.to[p << 9 | symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.to.get(last << 9 | symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (p << 9 | symbol) not in self.to:
            self.to[p << 9 | symbol] = new
            self.children[p].append(symbol)
            p = self.link[p]
        if p >= 0:
            q = self.to[p << 9 | symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new


@dataclass(frozen=True)
class Tables:
    """A vocabulary as flat arrays, a few MB: made once on the driver and sent to the workers; its size is that of the vocabulary."""

    names: list[str]
    special: dict[str, int]
    #: The tokenizer file without its vocabulary: the library normalises and splits what is not plain Latin.
    frame: str
    steps: np.ndarray  # state << 9 | symbol of each step of the automaton
    targets: np.ndarray
    length: np.ndarray
    link: np.ndarray
    token: np.ndarray  # the token that is a state's longest string, or -1
    up: np.ndarray  # the nearest suffix state with a token, or 0
    pairs: np.ndarray  # first << 20 | second of each merge, by rank
    parts: np.ndarray  # (2, tokens): what a token is merged from, or -1
    rank: np.ndarray  # at which rank


def tables(path: str) -> Tables:
    """Of a tokenizer file (byte-level BPE with a word-end suffix and no decoder)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    suffix, letters = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_letters())}

    def symbols(token: str) -> tuple[int, ...]:
        body = token[: -len(suffix)] if token.endswith(suffix) else token
        out = [letters[c] for c in body]
        if body is not token:
            out[-1] += _END
        return tuple(out)

    vocab: dict[str, int] = model["vocab"]
    by_id = {i: t for t, i in [*vocab.items(), *special.items()]}
    size = max(by_id) + 1
    if size > 1 << 20:
        raise ValueError("more than 2**20 tokens")
    pairs, parts, rank = [], np.full((2, size), -1, np.int32), np.full(size, len(model["merges"]), np.int32)
    for k, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        whole = vocab[a + b]
        pairs.append(vocab[a] << 20 | vocab[b])
        if parts[0, whole] < 0:
            parts[:, whole], rank[whole] = (vocab[a], vocab[b]), k
    reachable = {s: i for t, i in vocab.items() if len(s := symbols(t)) == 1 or parts[0, i] >= 0}
    auto = SuffixAutomaton(reachable)
    frame = json.dumps({**spec, "added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})
    ints = lambda x: np.array(x, np.int32)
    return Tables([by_id.get(i, "") for i in range(size)], special, frame, np.fromiter(auto.to, np.int64, len(auto.to)), ints(list(auto.to.values())), ints(auto.length), ints(auto.link), ints(auto.token), ints(auto.up), np.array(pairs, np.int64), parts, rank)


class Memory(dict):
    """What pieces were found to be, in two halves: when the young one is full the old one goes, so that what is met often stays."""

    def __init__(self):
        super().__init__()
        self.old, self.held = {}, 0

    def put(self, piece: str, got: tuple[bytes, str]) -> None:
        self.held += ENTRY_BYTES + len(piece) + 5 * len(got[0]) // 2
        self[piece] = got

    def renew(self, pieces: set[str]) -> None:
        """Those of the old half that are met again go to the young one."""
        old = self.old
        for piece in pieces.difference(self).intersection(old):
            self.put(piece, old[piece])

    def turn(self) -> None:
        """Between steps: a step's pieces are all there until it ends."""
        if self.held > MEMORY_BYTES // 2:
            self.old, self.held = dict(self), 0
            self.clear()


class WordBpe:
    """Encoder and decoder."""

    def __init__(self, of: Tables | str):
        from tokenizers import Tokenizer

        t = tables(of) if isinstance(of, str) else of
        tok = Tokenizer.from_str(t.frame)
        self.normalize, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.special = t.special
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        self.names = t.names
        self.to = dict(zip(t.steps.tolist(), t.targets.tolist(), strict=True))
        self.ranks = {p: k for k, p in reversed(list(enumerate(t.pairs.tolist())))}
        flat = lambda x: array("i", x.astype(np.intc).tobytes())
        self.length, self.link = t.length.tolist(), t.link.tolist()
        self.token, self.up = flat(t.token), flat(t.up)
        self.endings: list[tuple | None] = [None] * len(self.length)
        self.left, self.right, self.merged = flat(t.parts[0]), flat(t.parts[1]), flat(t.rank)
        width = np.zeros(len(t.names), np.intc)
        ends = t.token >= 0
        width[t.token[ends]] = t.length[ends]
        self.width = flat(width)
        self.agree: dict[int, bool] = {}
        self.memory = Memory()

    def _edge(self, token: int, side: array) -> list[tuple[int, int]]:
        """A token's outermost part on a side and the rank at which that part is merged away, from the whole token inwards."""
        out, until = [(token, len(self.ranks))], 0
        while side[token] >= 0:
            until, token = self.merged[token], side[token]
            out.append((token, until))
        return out

    def _compatible(self, first: int, second: int) -> bool:
        """True if the text of both tokens is encoded as these two."""
        right, left, rank = self._edge(first, self.right), self._edge(second, self.left), self.ranks
        i, j = len(right) - 1, len(left) - 1
        while True:
            (a, a_until), (b, b_until) = right[i], left[j]
            across = rank.get(a << 20 | b)
            # of equal ranks the merge further left comes first
            if across is not None and across < a_until and across <= b_until:
                return False
            if i == 0 and j == 0:
                return True
            if j == 0 or (i > 0 and a_until <= b_until):
                i -= 1
            else:
                j -= 1

    def _endings(self, state: int) -> tuple[tuple[int, int], ...]:
        """(size, token) of all tokens that end at a state, long ones first."""
        out, s = [], state if self.token[state] >= 0 else self.up[state]
        while s > 0:
            out.append((self.length[s], self.token[s]))
            s = self.up[s]
        got = self.endings[state] = tuple(out)
        return got

    def _extend(self, symbols, states: list[int], matches: list[int], last: list[int]) -> None:
        """Of prefixes that grow by symbols: the automaton's state, the matched length and the last token."""
        go, length, link, endings, agree = self.to.get, self.length, self.link, self.endings, self.agree
        fit = agree.get
        state, matched, at = states[-1], matches[-1], len(last) - 1
        for symbol in symbols:
            at += 1
            to = go(state << 9 | symbol)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = go(state << 9 | symbol)
            if to is None:
                raise ValueError("a symbol is not in the vocabulary")
            state = to
            matched += 1
            found = -1
            for size, token in endings[state] or self._endings(state):
                if size <= matched:
                    if size == at:
                        found = token
                        break
                    before = last[at - size]
                    if before >= 0:
                        pair = before << 20 | token
                        fits = fit(pair)
                        if fits is None:
                            if len(agree) >= PAIRS:
                                agree.clear()
                            fits = agree[pair] = self._compatible(before, token)
                        if fits:
                            found = token
                            break
            states.append(state)
            matches.append(matched)
            last.append(found)

    def learn(self, pieces) -> None:
        """Encode pieces and remember them. In sorted order a piece goes on from the prefix it shares with the one before."""
        names, width, memory = self.names, self.width, self.memory
        states, matches, last, before = [0], [0], [-1], b""
        for piece in sorted(pieces):
            raw = piece.encode()
            n, shared = len(raw) - 1, 0  # the last symbol is another one, as it ends the piece
            most = min(n, len(before) - 1)
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], matches[shared + 1 :], last[shared + 1 :]
            self._extend((*raw[shared:n], raw[n] + _END), states, matches, last)
            before, ids, at = raw, [], n + 1
            while at:  # back along the pointers
                ids.append(last[at])
                at -= width[last[at]]
            ids.reverse()
            memory.put(piece, (struct.pack(f"<{len(ids)}I", *ids), "".join([" " + names[i] for i in ids])))

    def pieces(self, text: str) -> list[str]:
        """The normalised text's pieces: letters, digits one by one, or other signs."""
        if _EASY.fullmatch(text):
            return _EASY_PIECES(text.lower())
        back = self.letters
        return [bytes([back[c] for c in x]).decode() for x, _ in self.split(self.normalize(text))]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text in 4 bytes each, and the decoded text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """encode() of each; the new pieces of a step of about STEP_CHARS are learnt together."""
        out: list[tuple[list, list]] = [([], []) for _ in texts]
        step, size = [], 0
        for i, text in enumerate(texts):
            for part in parts_of(text):
                step.append((i, part))
                size += len(part)
                if size >= STEP_CHARS:
                    self._encode_step(step, out)
                    step, size = [], 0
        self._encode_step(step, out)
        return [(b"".join(ids), "".join(words)[1:]) for ids, words in out]

    def _encode_step(self, step: list[tuple[int, str]], out: list[tuple[list, list]]) -> None:
        memory, cut, new = self.memory, [], set()
        for i, text in step:
            for part in self.special_cut.split(text) if self.special_cut else [text]:
                if part in self.special:
                    cut.append((i, part))
                elif part:
                    cut.append((i, self.pieces(part)))
                    new.update(cut[-1][1])
        memory.renew(new)
        self.learn(new.difference(memory))
        for i, part in cut:
            ids, words = out[i]
            if isinstance(part, str):
                ids.append(struct.pack("<I", self.special[part]))
                words.append(" " + part)
            else:
                got = [memory[piece] for piece in part]
                ids.append(b"".join([a for a, _ in got]))
                words.append("".join([b for _, b in got]))
        memory.turn()

    def decode(self, ids: bytes) -> str:
        return " ".join(self.names[i] for i in np.frombuffer(ids, "<u4").tolist())


def parts_of(text: str, most: int = 0):
    """A text in parts of about PART_CHARS, cut before a blank: no piece, special token or sign that normalisation looks at reaches across one."""
    most, at = most or PART_CHARS, 0
    while len(text) - at > most:
        to = text.rfind(" ", at + 1, at + most)
        to = to if to > 0 else text.find(" ", at + most)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


#: Of this worker: the last vocabulary's number and its encoder.
_READY: dict[int, WordBpe] = {}
_NUMBERS = itertools.count(1)


def forget() -> None:
    """A worker lives on between tasks; its encoder need not."""
    _READY.clear()


def encoder(number: int, of: Tables) -> WordBpe:
    if number not in _READY:
        _READY.clear()
        _READY[number] = WordBpe(of)
    return _READY[number]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each row of df: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (binary, 4 bytes each, little-endian)."""
    t = pick(df, doc_id=id_col, text=text_col)
    path = path or vocabulary_path()
    known = df.sparkSession.sparkContext.broadcast((next(_NUMBERS), tables(path)))
    release_memory()  # making the tables takes many times their size

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(*known.value)
        ids, n, sha, out = [], [], [], []
        for got, decoded in bpe.encode_all([x or "" for x in batch["text"].to_pylist()]):
            if with_ids:
                ids.append(got)
            n.append(len(got) // 4)
            sha.append(hashlib.sha256(got).hexdigest())
            out.append(hashlib.sha256(decoded.encode()).hexdigest())
        cols = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))

    kind = t.schema["doc_id"].dataType.simpleString()
    return map_texts(t, fn, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""), after=forget)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
