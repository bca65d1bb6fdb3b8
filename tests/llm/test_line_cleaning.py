"""Line cleaning against plain Python, and tables of every kind."""

import random
import re

from strandbase.llm import line_cleaning as L

SPACE = "[\x20\x09-\x0d]+"


def words(t):
    return [w for w in re.split(SPACE, t) if w]


def fails(line):
    w = len(words(line))
    if len(re.findall(r"[#*$%&<>]{2,}|!!", line)) > 0.25 * w or len(re.findall("[|»›•]", line)) > 0.25 * w:
        return True
    if len(re.findall("[A-Z]", line)) >= 20 and not re.search("[a-z]", line):
        return True
    if w < 3 and not re.search(r"""[.!?:;…。！？]["'”’)\]]*[\x20\x09-\x0d]*\Z""", line):
        return True
    return re.search(L.BOILERPLATE, line) is not None


def plain(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lost = sum(len(words(x)) for x in lines if fails(x))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and lost <= 0.5 * len(w), lost)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]


def test_against_plain_python(spark):
    rng = random.Random(4)
    bits = ["a", "bc", "déf", "The house.", "one two three four five six", "HOME", "SHOUTED WORDS ARE REJECTED HERE ALWAYS", "Home | News | Contact", "!!!", "$$ ##", "<b>", "Alle Rechte vorbehalten.", "tous DROITS réservés", "Política de privacidad", "Licensed under the MIT license", "»", "ok.", "(so.)", "\t", "\x0b", "\r", " ", " x", "日本 語。"]
    texts = [(rng.choice(["\n", " ", "\n\n"])).join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = {r.doc_id: r for r in L.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLUMNS) == plain(t), t
        assert got[i].cleaned_text == "\n".join(x for x in t.split("\n") if not words(x) or not fails(x))
    assert any(r.kept for r in got.values()) and any(not r.kept and not r.base_failed for r in got.values())


def test_any_table(spark):
    long = "\n".join(f"Line number {i} of a very long text that goes on." for i in range(20_000)) + "\n" + "x" * 500_000
    rows = [(1, "Home", "a"), (1, "Home", "a"), (None, None, None), (2, "", "b"), (3, " \n\t", "c"), (4, long, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string").selectExpr("*", "'x' as TEXT", "2 as n_words", "3 as kept")
    got = L.clean_lines(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=key) == sorted(((d, *plain(t)) for d, t, _ in rows), key=key)
    assert L.clean_lines(df.limit(0)).count() == 0
