"""Null and repeated ids in the pipeline's choice of one document of each group."""

from krigstone.llm import setsketch


def test_null_and_repeated_ids(spark):
    text, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, text), (1, text), (1, text.upper()), (1, other), (2, text), (3, "on its own, and no other"), (None, "clean text"), (None, text), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    found = setsketch.keep_one(docs)
    assert found.columns == docs.columns
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in found.collect()), key=str)
    assert kept == sorted([(1, text), (1, other), (3, "on its own, and no other"), (None, "clean text"), (None, text), (4, "")], key=str)
