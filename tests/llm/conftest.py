import re

import pytest

#: Columns whose names the operators use themselves.
CLASHING = ["lang", "source", "n_chars", "size", "target", "key", "label", "a", "b", "doc", "text2", "score", "_text", "component_id", "node", "cell"]


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Makes a documents table of (doc_id, text) with extra columns whose names clash."""

    def make(rows, parts=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return df.select("doc_id", "text", *[F.lit("x").alias(c) for c in CLASHING])

    return make


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
