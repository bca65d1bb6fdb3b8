"""Secrets without digits, short ones, ones in paths and beside fixed patterns."""

import random
import string

import pytest

from strandbase.llm.secret_scan import SecretModel, base_spans, ordinary_runs

WORDS = ["weather", "quarter", "analysis", "transport", "reading", "measure"]


@pytest.fixture(scope="module")
def model():
    return SecretModel(WORDS)


def test_lengths(model):
    rng = random.Random(4)
    for n, least in ((12, 0.5), (20, 0.9), (32, 0.95)):
        keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for _ in range(300)]
        assert sum(model.spans(f"key {k} end", []) == [(4, 3, 4 + n)] for k in keys) >= least * 300, n
    assert set(model.recall_at) >= {12, 20, 32}


def test_letters_paths_and_rests(model):
    letters, key = "qXvTbZrWkJpLmHgFdNcSyQ", "x7Kq9ZpL2vRt8WmB4nYc"
    assert model.spans(f"a {letters} b", []) == [(2, 3, 2 + len(letters))]
    path = "measure/weather/quarter/analysis/transport/reading/"
    assert [s for s in model.spans(f"{path}{key}", []) if s[2] == len(path + key)][0][0] >= len(path) - 8
    text = "0123456789abcdef0123" + key.upper()
    assert base_spans(text) == [(0, 2, 20)] and (20, 3, len(text)) in model.spans(text, base_spans(text))


def test_ordinary_runs_stay(model):
    runs = ordinary_runs(["harbour", "kitchen"], 2000, random.Random(7))
    assert sum(bool(model.spans(r, [])) for r in runs) <= 0.02 * len(runs)
