"""One document of each component stays, whatever the ids are."""

from strandbase.llm.ngram_join import keep_one


def test_null_and_repeated_ids(spark):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c", 39)), (5, text("d")), (5, text("e")), (5, text("e")), (7, text("f")), (6, text("f", 39)), (None, text("f", 38)), (None, ""), (None, None)]
    got = [(r.doc_id, (r.text or "")[:1]) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (None, "b"), (None, "c"), (5, "d"), (5, "e"), (6, "f"), (None, ""), (None, "")], key=str)
