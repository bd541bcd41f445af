import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a"), (2, "one two three four five six seven eight nine ten", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, long, "en", "a"), (6, long + " more", "de", "b"), (7, "x", "en", "a"),
        (1, "one two three four five six seven eight nine ten", "en", "a"), (8, "é ü 日本語 😀 \n\n \n<s>", "xx", "c"),
    ]
    wide = [(*r, "clash", 1, "s", 0.5, "w", [1]) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, sig string, n long, line string, score double, word string, ids array<int>")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
