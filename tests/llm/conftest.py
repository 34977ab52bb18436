import uuid

import pytest


@pytest.fixture
def brute(spark):
    """Rows of a small DataFrame as a sorted list of tuples."""

    def rows(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))

    return rows


@pytest.fixture
def documents(spark, tmp_path):
    """Write rows (doc_id, text, source) as a documents table; gives the folder that queries take."""

    def write(rows, name="documents", schema="doc_id long, text string, lang string, source string, n_chars long", parts=3):
        folder = f"{tmp_path}/{uuid.uuid4().hex}"
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
