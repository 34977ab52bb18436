"""From documents to packed training sequences: language ID, near-dedup, substring dedup, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its
predecessor kept, written as Parquet and read again.  All but the last return the columns of `documents`.

In every stage null texts count as empty, ids and sources may be null, and rows equal in all columns
are rows of their own, told apart by a number that is written with them or by id and text, never by
their place in a table that is read again.  Columns beyond those of `documents` stay; names that an
operator uses inside are replaced.  Texts may be of any length; an empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.llm.common import TABLES, removed, written
from leafstack.llm.languages import fit, speak
from leafstack.llm.mixing import mix, mixed_documents
from leafstack.llm.packing import pack
from leafstack.llm.registry import prepare
from leafstack.llm.simhash import one_of_each
from leafstack.llm.substrings import remove_repeats


def _with_text(docs: DataFrame, columns, text) -> DataFrame:
    """`columns` of `docs` with a new text, and its length where they have one."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which no language can be told (no letters, or no label and letters like no modelled language).

    The model is fitted on the labels of `docs`; their source stands for the host and their label
    for the declared language.  Without labels there is no model, and nothing is rejected.
    """
    prepare(spark)
    model = fit(docs)
    return speak(docs, model, host=F.col("source"), declared=F.col("lang")) if model.languages else docs


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id (null ids last; of rows equal in id and text any one).

    SimHash fingerprints of three-word shingles link at 3 or fewer differing bits, by the trie join of
    op10.  As 64 bits miss near copies with more edits, similarities of 0.8 or more of five-word shingle
    sets link too: candidates share bands of least hashes and are decided by their whole sets.  The
    classes are those of all links together.  Documents without words are one class.
    """
    prepare(spark)
    return one_of_each(docs, budget=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that start anywhere else too are cut out; the documents stay, with the rest of their text."""
    prepare(spark)
    return _with_text(remove_repeats(docs), docs.columns, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row per copy taken, the last one of a source cut to its words."""
    prepare(spark)
    return _with_text(mixed_documents(mix(docs)), docs.columns, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the mix in sequences of at most 2048, one row per piece."""
    prepare(spark)
    return pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

# hashes of shingles, sampling keys and token ids are beyond SQL; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(TABLES)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            # what the stage wrote on its way, and its input, are read no more
            removed(spark, TABLES[start:-1])
    return docs
