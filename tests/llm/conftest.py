import pytest

CLASHES = ("id", "n", "cell", "size", "slot", "shard", "item", "copies", "v", "rep", "hash", "_id", "_rank", "_bucket", "values", "component", "unit", "w")


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    long_text = " ".join(f"word{k % 977} other{k % 13}" for k in range(60_000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon for a while tonight.", "en", "a"),
        (1, "The cat sat on the mat and looked at the moon for a while tonight.", "en", "a"),
        (2, "the CAT sat on the mat and looked at the moon for a while tonight.", "en", "b"),
        (3, None, None, None),
        (None, "An orphan without an id but with several words in it.", "en", "a"),
        (None, None, None, None),
        (4, "", "de", "b"),
        (5, " \n\t ", "de", "b"),
        (6, long_text, "en", "a"),
        (7, "x" * 50_000, "xx", "c"),
        (8, "one", "en", None),
        (9, "zwei Wörter", "de", "b"),
        (10, "éàü 漢字 😀 fin.", "fr", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *[k for k in range(len(CLASHES))]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))
    return df


@pytest.fixture(scope="session")
def no_documents(messy):
    return messy.limit(0)
