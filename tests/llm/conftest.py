import os

import pytest
from pyspark.sql import DataFrame

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _key string, root string, score string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of ``(doc_id, text)`` or ``(doc_id, text, source)``, with columns whose names clash."""

    def make(rows) -> DataFrame:
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y", "z")
            for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
