import pytest

#: Null, empty, blank, short, repeated and very long texts, with columns that operators use themselves.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"), (6, "one two three"),
    (7, "A b C d E f G h I j K l M n O p Q r"), (8, "a B c D e F g H i J k L m N o P q R"), (9, "ж" * 3000), (10, "word " * 20000), (None, "nobody owns this text"), (11, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), 1, "x", 2.0, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, comp string, rate double, band int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
