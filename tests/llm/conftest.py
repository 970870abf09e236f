"""Small tables for the operators' edge cases."""

import pytest
from odd_texts import ODD_TEXTS

@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(ODD_TEXTS)] + [(3, "a b c d", None, None, None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
