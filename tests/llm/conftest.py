import pytest
from pyspark.sql import DataFrame

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that an operator might use for itself.
CLASHING = "id bigint, text_hash bigint, n bigint, fp bigint, digest string, label string, words string, kept boolean"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text), with the other columns of documents and clashing ones."""

    def make(*rows: tuple, lang: str = "en") -> DataFrame:
        full = [(i, t, lang, f"s{k % 3}", len(t or ""), 1, 2, 3, 4, "d", "l", "w", True) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, f"{DOCS}, {CLASHING}")

    return make
