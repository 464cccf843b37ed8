import pytest

#: Rows that every operator must survive: null and empty texts, repeated rows, ties, clashing extra columns.
TEXTS = [None, "", "   \n\t ", "One.", "the quick brown fox jumps over the lazy dog. " * 3, "ÉCOLE Ünïcode ÑANDÚ ςΣ İ", "a\x0bb\x0cc\rd\te f"]


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, "s" if i % 2 else None, "x", "y", True, 7) for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], None, "x", "y", True, 7), (50, TEXTS[4].upper(), "s", None, None, None, None), (None, "no id", "s", "", "", False, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h string, kept boolean, n int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
