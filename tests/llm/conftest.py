import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 30_000


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns that operators also use."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), 1, -1, "x") for i, t in rows],
            DOCS + ", fp long, row_hash int, label string",
        )
    return make


@pytest.fixture
def edge_rows():
    """Null ids and texts, empty, blank and very long texts, repeated ids and rows."""
    return [
        (None, "a null id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two words"),
        (-5, "é 漢字 😀 " * 50), (6, LONG), (7, "x" * 200_000), (8, "1" * 50_000), (2 ** 62, "far id"),
    ]
