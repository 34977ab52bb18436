"""Results do not hang on how a table is split when it is read again: executors come and go."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from leafstack.llm import common, languages, mixing, simhash, substrings, warc
from leafstack.llm.queries.languages import op3_language_id
from leafstack.llm.queries.mixing import op2_mixing
from leafstack.llm.queries.substrings import op7_substring_dedup
from leafstack.llm.queries.warc import op6_warc

SF = "/root/testdata/sf0.001"
SPLITS = {"spark.sql.files.maxPartitionBytes": ("4k", "64m", "48k"), "spark.sql.files.openCostInBytes": ("1", "8m", "4k")}


@pytest.fixture
def tables(spark, tmp_path):
    """Copies of the tables in twelve files, with repeated rows."""
    for name in ("documents", "pages"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.unionByName(df.limit(40)).repartition(12).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def resplit(spark, monkeypatch):
    """After every written table all later scans are split anew."""
    turn, before = itertools.count(), {k: spark.conf.get(k) for k in SPLITS}
    real = common.written

    def flip(df, name):
        out = real(df, name)
        k = next(turn)
        for key, values in SPLITS.items():
            spark.conf.set(key, values[k % 3])
        return out

    for module in (common, languages, mixing, simhash, substrings, warc):
        monkeypatch.setattr(module, "written", flip)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def calm(spark, tables):
    """Results on the same rows in one file, read alike throughout."""
    one = f"{tables}/one"
    for name in ("documents", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").coalesce(1).write.parquet(f"{one}/{name}.parquet")
    docs = spark.read.parquet(f"{one}/documents.parquet")
    out = {q.__name__: rows(q(spark, one)) for q in (op2_mixing, op3_language_id, op6_warc, op7_substring_dedup)}
    return out | {"near": rows(cp.simhash_near_dedup(spark, docs, one)), "language": rows(cp.language_id(spark, docs, one))}


def test_rereads(spark, tables, calm, resplit):
    for query in (op3_language_id, op6_warc, op7_substring_dedup, op2_mixing):
        got = rows(query(spark, tables))
        assert got == calm[query.__name__], query.__name__
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert rows(cp.simhash_near_dedup(spark, docs, tables)) == calm["near"]
    assert rows(cp.language_id(spark, docs, tables)) == calm["language"]
    mixed = cp.mixing(spark, docs, tables)
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == spark.createDataFrame([(0,)]).select(F.lit(sum(int(r.split("taken=")[1].rstrip(")")) for r in calm["op2_mixing"]))).first()[0]
