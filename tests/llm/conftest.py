import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "ids", "kind", "version", "decoded", "score", "n_lines", "copies", "maybe", "f", "_id", "label", "target"]

LONG = " ".join(f"word{k % 997} and{k % 13}" for k in range(20_000)) + "\n" + "shared closing line of the very long text"
PROSE = "the river runs past the old mill and the children play on its banks until the evening bells ring out over the valley"


def _edit(text: str, at: int) -> str:
    words = text.split(" ")
    words[at] = f"edit{at}"
    return " ".join(words)


ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE.upper(), "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "  \t\n \n", "fr", None),
    (6, "one two three", "fr", "b"),
    (7, "ONE two  three", "fr", "b"),
    (8, "one two four", "de", "b"),
    (9, LONG, "de", "c"),
    (9, LONG, "de", "c"),
    (10, "Shared closing line of the very long text \nown line number ten here\nshared closing line of the very long text", "en", "c"),
    (11, "İstanbul ÉCLAIR ß ſ  12 🙂🙂 日本語 'tis don't we'll\r\n\t x", None, "b"),
    (12, "12345 !!! 999", "es", "a"),
    (None, PROSE, "en", None),
    (None, "no id here at all, only text that stands alone", "en", "a"),
    (13, " ".join([PROSE] * 6), "en", "b"),
    (14, _edit(" ".join([PROSE] * 6 + [_edit(PROSE, k) for k in range(3)]), 100), "en", "b"),
    (15, " ".join([PROSE] * 6 + [_edit(PROSE, k) for k in range(3)]), "en", "b"),
    (16, _edit(" ".join([PROSE] * 6 + [_edit(PROSE, k) for k in range(3)]), 3), "en", "c"),
    (17, "own line number ten here\nown line number ten here\nshort", "en", "c"),
]


@pytest.fixture(scope="session")
def rows():
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in ROWS]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with nulls in every column, empty and long texts, copies, near copies, repeated rows."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="session")
def split_words():
    return words
