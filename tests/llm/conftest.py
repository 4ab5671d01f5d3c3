"""Awkward documents that every operator must take: nulls, empty and long texts, ties, clashing columns."""

import pytest

LONG = " ".join(f"w{i % 97} Ünïcode{i}" for i in range(6000))
ROWS = [
    (1, "The quick brown fox, don't stop!\nSecond line here", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "   \n\t ", "en"),
    (5, "the QUICK brown fox, don't stop!\nsecond line here", "en"),
    (6, LONG, None),
    (7, LONG, "x"),
    (8, LONG.upper(), "x"),
    (9, "日本語 テキスト 🙂🙂 é é <|endoftext|> x", "ja"),
    (10, "one", None),
    (10, "one", None),
    (10, "another text under the same number", None),
    (None, "a text without a number", "en"),
    (None, None, None),
    (11, "aaaaaaaaaaaaaaaa" * 40, "en"),
]
CLASHING = ("row", "n", "h", "label", "score", "more", "name", "id", "block", "kept", "start", "part", "value", "media", "in_text", "gone_id", "component")


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with many further columns whose names operators use inside."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in ROWS], f"doc_id long, text string, lang string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
