import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, size string, start string, chunk string, rn string, sid string, fp string, c string, m string, n string, label string, score string, tokens string, h string, line string"

LONG = "word " * 30_000 + "x" * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    texts = [
        (1, "one two three four five\na line that is long enough to count\nend", "s1"),
        (2, "one two three four five\nA line that is long enough to count \nother", "s1"),
        (3, "\ta line that is LONG enough to count\n\n", "s2"),
        (3, "\ta line that is LONG enough to count\n\n", "s2"),
        (4, "", "s1"), (5, None, None), (None, "a text without an id", "s3"), (None, None, None),
        (6, LONG, "s1"), (7, "one two three four five\na line that is long enough to count\nend", "s1"), (8, " \t\n", "s2"), (9, "élan 漢字 🎉 end", "é"),
    ]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["clash"] * 15) for i, t, s in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
