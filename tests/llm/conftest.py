import pytest

LONG = "long words " * 20000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and blank texts, a very long one, equal and near-equal ones, repeated rows, clashing columns."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word59", "other")
    rows = [
        (1, base, "a"),
        (2, base, "b"),
        (3, near, "a"),
        (4, None, None),
        (5, "", "a"),
        (6, "  \n ", "b"),
        (7, LONG, "b"),
        (8, "Tiny text", "c"),
        (8, "Tiny text", "c"),
        (None, "no id here", "c"),
        (9, "é 漢字 ▁ 😀\x00 tab\there", None),
    ]
    full = [(*r, "en", 0.5, 7, "x") for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, source string, lang string, score double, size int, row_no string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
