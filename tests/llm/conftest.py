import pytest

EDGE = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen end"),
    (3, None), (4, ""), (5, "   \n\t "), (6, "short"), (7, "short"), (8, "İé日本 \U0001f600 x"), (2, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen end"),
    (9, "word " * 30_000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, repeats, a long text, and columns with the names that operators use inside."""
    rows = [(i, x, None, "h" if i % 2 else None, 1, 2, 3) for i, x in EDGE] + [(None, "no id here", "en", None, 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, key int, gone int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
