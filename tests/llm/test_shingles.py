"""Hashes of words and shingles against sets of byte strings."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandbase.llm.shingles import class_hashes, shingle_sets, words_of_texts


def _texts(n=300):
    rng = random.Random(1)
    made = ["".join(rng.choice("abCé \n\t .\x0b ") for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]
    return [t if rng.random() < 0.95 else None for t in made]


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_against_sets(step):
    texts = _texts()
    words, off = words_of_texts(pa.array(texts, pa.string()), step)
    ref = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert np.diff(off).tolist() == [len(r) for r in ref]
    known = {}
    for i, r in enumerate(ref):
        for x, h in zip(r, words[off[i] : off[i + 1]], strict=True):
            assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)
    text, sets = shingle_sets(words, off, 5)
    want = [{tuple(r[i : i + 5]) for i in range(max(1, len(r) - 4))} if r else set() for r in ref]
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(x) for x in want]
    classes = {}
    for r, h in zip(ref, class_hashes(words, off), strict=True):
        assert classes.setdefault(tuple(r), h) == h
    assert len(set(classes.values())) == len(classes)
