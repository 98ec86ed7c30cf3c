import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: (doc_id, text): nulls, blanks, ties, repeated rows, a very long text.
EDGES = [
    (1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"),
    (3, None), (4, ""), (5, " \t\n\v\f\r "), (None, "no id here but a text of some words"), (None, None), (6, "one  two\nthree four five six seven eight nine ten"),
    (7, LONG), (8, LONG + " end"), (9, "a"), (10, "üß 日本語 \U0001f600 é"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with more columns whose names operators use themselves."""
    rows = [(i, t, "en", 1, 2, 3.0, True, "x") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest int, fp int, rate double, kept boolean, _id string").repartition(3)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture()
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
