import pytest

#: Nulls, empty and blank texts, repeated rows, ties, a long text and columns whose names clash with those made inside.
LONG = " ".join(f"w{i}" for i in range(30000))
ROWS = [
    (0, "the quick brown fox jumps over the lazy dog near the river bank today\nshort", "s1", "en"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today\nshort", None, None),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today\nshort", None, None),
    (2, None, "s1", "en"),
    (3, "", "s2", "fr"),
    (4, " \t\n ", "s2", "fr"),
    (5, LONG, "s1", "en"),
    (6, LONG + " extra", "s3", "en"),
    (None, "a row without an id has a text of its own here", "s3", "de"),
    (7, "déjà vu Ünïcode 中文字符 test line with several words in it\n\n\nend", "s3", None),
    (8, "one two", "s1", "en"),
    (9, "one two", "s1", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 1, "x", 2.0, "y") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, key int, id string, score double, rank string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
