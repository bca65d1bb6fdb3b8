"""The encoder against the tokenizers library."""

import random

import numpy as np
import pytest

from strandbase.llm.bpe import WordBpe, vocabulary_path


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    return WordBpe(path), Tokenizer.from_file(path)


def same(both, text):
    own, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    ids, decoded = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert decoded == own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_chosen_texts(both):
    for text in ["", " ", "Hello it's WORLD 123\n é<|endoftext|> İ ﬁ don't", "<|startoftext|><|endoftext|>", "a\0b ́", "aaaaaaaaaaaaaaaa", "ΑΣ ς", "日本語のテキスト", "🙂🙂🙂", "!" * 300, "'LL 'S x'Re", " a b\x85c", "Ⅷ ½ ²", "a\x1cb\x1fc\x00", "x\u00a0y\u2003z", "ÀÉ ǅ ŉ ª º µ", "".join(map(chr, range(1, 0x250))), "<|endoftext|"]:
        same(both, text)


def test_random_texts(both):
    rng = random.Random(3)
    kinds = ["abcdefgh", "aab", "theingreandou ", "éèçàüßñ ", "01 .,!?'\"-", "́̈x", "日本🙂 ", "ABC'sStT "]
    for _ in range(3000):
        kind = rng.choice(kinds) + rng.choice(kinds)
        same(both, "".join(rng.choice(kind) for _ in range(rng.randrange(60))))


def test_parts(both, monkeypatch):
    """Texts in small parts and a memory that is always full give the same."""
    from strandbase.llm import bpe

    rng = random.Random(5)
    for name, v in (("PART_CHARS", 7), ("STEP_CHARS", 20), ("MEMORY_BYTES", 2000), ("PAIRS", 10)):
        monkeypatch.setattr(bpe, name, v)
    for _ in range(400):
        same(both, "".join(rng.choice(["word", "ΑΣ", "ΣΣ.", " ", "  ", "\n", "\u00a0", "<|endoftext|>", "́x", " ́", "don't", "İ", "日本 語", "x" * 12]) for _ in range(rng.randrange(30))))


def test_vocabulary_words(both):
    own, _ = both
    rng = random.Random(4)
    names = sorted(own.names)
    for _ in range(3000):
        same(both, "".join(rng.choice(names).replace("</w>", rng.choice(["", " "])) for _ in range(rng.randrange(1, 5))))


def test_any_table(spark, both):
    import hashlib

    from strandbase.llm.bpe import encode

    own, lib = both
    rows = [(1, "some Text", "a"), (1, "some Text", "a"), (None, None, None), (2, "", "b"), (3, "words and more w0rds " * 20_000, "c"), (4, "x" * 3000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "'x' as TEXT", "1 as n_tokens")
    got = encode(df).collect()
    assert len(got) == len(rows)
    texts = {d: (t or "") for d, t, _ in rows}
    for r in got:
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = np.array(want, "<u4").tobytes()
        assert r.n_tokens == len(want) and bytes(r.ids) == raw and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert encode(df.limit(0)).count() == 0
