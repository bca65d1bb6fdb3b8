"""The fixed patterns against plain regular expressions, and the bootstrap on a small graph."""

import random
import re

from strandbase.llm.pii_bootstrap import base_spans, extract


def brute(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@x", ".", "-", "_", "+", "%", " ", "1", "25", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824", "(", ")", "é", "\n", "7", "x@y.z", "1.2.3.4"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        assert base_spans(text) == brute(text), text


def test_bootstrap(spark):
    people = [f"his card number 411111111111111{d} was used" for d in range(10)]  # one passes the Luhn test
    phones = [f"number {i}: please call: +1 743 555 38{i} today" for i in range(10, 30)]
    unseen = ["we should please call: 555-3824-77 today", "lines 1234567 of the log", "please call me today"]
    rows = [(i, t) for i, t in enumerate([*people, *phones, *unseen, None, ""])]
    got = {r.doc_id: r for r in extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    new = got[len(people) + len(phones)]
    assert new.n_phone == 0 and new.n_context == 1 and new.spans == "context:23:34"
    assert all(got[i].n_context == 0 for i in range(len(rows)) if i != new.doc_id)
    assert got[len(people)].n_phone == 1


def found(spark, texts):
    """The contextual spans of each text, as texts."""
    got = extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    spans = [[s.split(":") for s in r.spans.split(",") if s.startswith("context")] for r in got]
    return [[t[int(a) : int(b)] for _, a, b in s] for t, s in zip(texts, spans, strict=True)]


def test_running_text(spark):
    texts = [f"u{i} you may ring me on +1 743 555 38{i} any day v{i}" for i in range(10, 30)]
    texts += [f"w{i} it went on {i} of x{i}" for i in range(10)]  # the word alone is no sure pattern, both words are
    assert found(spark, [*texts, "do ring me on 555-3824-77 when x", "it went on 17 of them"])[-2:] == [["555-3824-77"], []]


def test_labelled_records(spark):
    texts = [f"row {i}\nPhone: +1 743 555 38{i}\nend" for i in range(10, 30)] + [f"row {i}\nCall\n+1 743 556 38{i}\nend" for i in range(10, 30)]
    unseen = ["z\nPhone: 5550199222", "z\nPhone: 020 7946 0958", "z\nPhone: (020) 7946.0958 x", "Phone:123", "Call\n5550199222"]
    assert found(spark, texts + unseen)[-5:] == [["5550199222"], ["020 7946 0958"], ["020) 7946.0958"], ["123"], ["5550199222"]]


def test_found_instances_support_patterns(spark):
    texts = [f"u{i} Phone: +1 743 555 3{i} v{i}" for i in range(100, 200)]
    shared = [f"55501992{i}" for i in range(10, 30)]
    texts += [f"a{x} Phone: {x} b{x}" for x in shared] + [f"c{x} Fax: {x} d{x}" for x in shared]
    assert found(spark, [*texts, "e Fax: 77-88 f"])[-1] == ["77-88"]
