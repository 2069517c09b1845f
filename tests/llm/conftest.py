import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, _id string, size string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, repeated rows, ties, a very long text, and columns with clashing names."""
    line = "this line is long enough to count as one that repeats in the corpus"
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t\n", None, "a"), (4, "one two three", "en", "b"), (5, "One  two three", "en", "b"),
        (6, "tab\tand\x0bodd\r\nspace é ü 中文", "de", "b"), (7, "x" * 300, "en", "a"), (8, "x" * 300, "en", "a"), (9, "ab " * 40_000, "en", "a"), (None, "no id here at all", "en", "a"),
        *[(10 + i, f"{line}\nown words {i} and more of them {i * 7}\n {line.upper()}", "en", "a") for i in range(7)],
        (30, " ".join(f"w{i}" for i in range(400)), "en", "c"), (31, " ".join(f"w{i}" for i in range(2, 400)), "en", "c"), (32, " ".join(f"w{i}" for i in range(30, 400)), "en", "c"),
        (40, "same row twice over", "en", "b"), (40, "same row twice over", "en", "b"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y", None, "z") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
