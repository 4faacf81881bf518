import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, v string, start int, score string"


def doc(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), "k", i, "v", 1, "x")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties and repeated rows, and columns with names that operators use."""
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [
        doc(1, "one two three four five six seven eight nine ten eleven"), doc(2, "one two three four five six seven eight nine ten eleven"), doc(2, "one two three four five six seven eight nine ten eleven"),
        doc(3, None), doc(4, ""), doc(5, " \n\t "), doc(6, "x"), doc(7, "x y"), doc(8, long), doc(9, long + " tail"), doc(None, "null id"), doc(10, "Zoë 😀 naïve"), (None,) * 10, doc(11, "a\n" * 400, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])
