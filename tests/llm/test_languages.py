import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import languages as L
from leafstack.llm.queries.languages import op3_language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.fit(docs.filter("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, model):
    assert set(model.languages) == {"en", "de", "fr", "es"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 1").withColumnRenamed("lang", "truth")
    out = L.identify(docs, model).select("truth", "language", "text_language").collect()
    assert len(out) == docs.count()
    assert sum(r.truth == r.language for r in out) / len(out) > 0.99


def test_query(spark):
    out = op3_language_id(spark, SF)
    rows = out.collect()
    assert out.columns == ["doc_id", "page_id", "language", "confidence", "text_language", "declared", "host", "kept"]
    pages, docs = [r for r in rows if r.page_id is not None], [r for r in rows if r.doc_id is not None]
    assert len(pages) == 250 and len(docs) == 1000 and len(rows) == 1250
    for part in (pages, docs):
        assert sum(r.language == r.declared for r in part) > 0.97 * len(part) and all(r.kept for r in part)
    assert sorted(map(str, rows)) == sorted(map(str, op3_language_id(spark, SF).collect()))


def plain(model, rows):
    """rows: (text, host, declared) -> (language, confidence), straight from the formulas."""
    n, scored = len(model.languages), []
    for text, host, declared in rows:
        gains, count = L.text_gains(model, [(text or "").encode()])
        gains, count = gains[:, 0], int(count[0])
        weighed = gains * count * L.TEXT_GRAMS / (count + L.TEXT_GRAMS)
        post = np.exp(weighed - weighed.max())
        post = np.rint(post / post.sum() * L.UNIT) / L.UNIT
        host = host or ""
        keys = {"host": host, "domain": ".".join(host.split(".")[-2:]) if "." in host else "", "suffix": host.rsplit(".", 1)[1] if "." in host else "", "declared": declared or ""}
        scored.append((weighed.round(6), post, count > 0 and gains.max() > L.LEAST_GAIN, keys))
    sums, whole = defaultdict(lambda: np.zeros(n)), np.zeros(n)
    for _, post, heard, keys in scored:
        if heard:
            whole += post
            for k, v in keys.items():
                sums[k, v] += post
    all_ = (whole + 1) / (whole.sum() + n)
    out = []
    for weighed, post, heard, keys in scored:
        mine, got = post * heard, {k: sums[k, v] if v else np.zeros(n) for k, v in keys.items()}
        less = {k: np.maximum(got[k] - mine, 0) for k in ("host", "domain")}
        rest = {k: max(got[k].sum() - heard, 0) for k in ("host", "domain")}
        domain = (less["domain"] + L.HOST_ROWS * all_) / (rest["domain"] + L.HOST_ROWS)
        prior = (less["host"] + L.HOST_ROWS * domain) / (rest["host"] + L.HOST_ROWS)
        logs = np.log(prior) + weighed
        for k in ("declared", "suffix"):
            if keys[k]:
                logs = logs + np.log((got[k] + L.HINT_ROWS * all_) / (got[k].sum() + L.HINT_ROWS) / all_)
        p = 1 / np.exp(logs - logs.max()).sum()
        out.append((model.languages[int(logs.argmax())] if heard and round(p, 4) >= L.LEAST_POSTERIOR else "und", p))
    return out


def test_fusion_against_formulas(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").collect()
    rows = [(d.text[:d.doc_id % 40], f"{'www.' * (d.doc_id % 2)}h{d.doc_id % 3}.example.{['de', 'fr', 'com'][d.doc_id % 3]}", d.lang if d.doc_id % 4 else None) for d in docs]
    rows += [(None, "h1.example.fr", "fr"), ("", None, None), ("12 !", "localhost", "xx"), ("!", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, text string, h string, d string")
    got = sorted(L.identify(df, model, host=F.col("h"), declared=F.col("d")).collect(), key=lambda r: r.k)
    assert len(got) == len(rows)
    for r, (language, p) in zip(got, plain(model, rows), strict=True):
        assert r.language == language and math.isclose(r.confidence, p, abs_tol=2e-4)


def test_a_hint_decides_a_short_text(spark, model):
    rows = [("de la " * 3, f"h.example.{s}", s) for s in ("fr", "es")] + [("ouéaieuxlepa éelleç mentoi " * 9, "h.example.fr", "fr")] * 30 + [("ciónasadoñ cióngaque osdoboga " * 9, "h.example.es", "es")] * 30
    df = spark.createDataFrame(rows, "text string, h string, d string").withColumn("t", F.col("text"))
    got = L.identify(df, model, host=F.col("h"), declared=F.col("d")).filter("t like 'de la%'").collect()
    assert {r.declared: r.language for r in got} == {"fr": "fr", "es": "es"}


def test_markup_and_addresses(spark):
    df = spark.createDataFrame([("HTTPS://u@WWW.Ex.org:8/x", '<!doctype html><HTML class=a LANG="De-AT">'), ("x", "<p lang=fr>"), (None, None), ("//h/p", "<html lang='eng'>")], "url string, html string")
    got = df.select(L.host_of(F.col("url")).alias("h"), L.declared_of(F.col("html")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("www.ex.org", "de"), ("", ""), ("", ""), ("h", "eng")]


def test_edges(spark, model):
    empty = spark.createDataFrame([], "text string, language int, page long")
    out = L.identify(empty, model)
    assert out.columns[:2] == ["page", "language"] and out.collect() == []
    nothing = L.fit(spark.createDataFrame([], "text string, lang string"))
    assert nothing.languages == ()
    df = spark.createDataFrame([("a b", 1), (None, 2)], "text string, n int")
    assert {r.language for r in L.identify(df, nothing).collect()} == {"und"}
    kept = L.speak(spark.createDataFrame([("the of and thand onth", 1), ("123", 2), (None, 3), ("the of and thand onth", 1)], "text string, n int"), model)
    assert sorted(r.n for r in kept.collect()) == [1, 1]


RUSSIAN = "ещё один текст на другом языке "


def test_a_language_is_modelled_at_any_size(spark):
    rows = [(i, f"the of and thand onth {i}", "en") for i in range(3000)] + [(9000 + i, RUSSIAN * 3, "ru") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(df, rows=200).languages == ("en", "ru")


def test_labelled_rows_without_a_model_stay(spark, model):
    rows = [(1, RUSSIAN * 9, "ru"), (2, RUSSIAN * 9, None), (3, RUSSIAN * 9, "en"), (4, "12 !", "ru"), (5, "the of and thand onth " * 5, "en")]
    df = spark.createDataFrame(rows, "k long, text string, d string")
    got = {r.k: (r.language, r.confidence > 0) for r in L.identify(df, model, declared=F.col("d")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "ru", 2: "und", 3: "en", 4: "und", 5: "en"} and not got[1][1] and got[5][1]
    assert sorted(r.k for r in L.speak(df, model, declared=F.col("d")).collect()) == [1, 3, 5]


def test_any_number_of_languages(spark):
    """Eighty invented languages, of six labelled rows each."""
    rng = np.random.default_rng(8)
    alphabet = np.array([chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(80):
        syllables = ["".join(rng.choice(alphabet, 3)) for _ in range(12)]
        rows += [(k * 10 + j, " ".join("".join(rng.choice(syllables, 2)) for _ in range(60)), f"x{k:02d}") for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df.filter("doc_id % 10 < 6"))
    assert len(model.languages) == 80
    got = L.identify(df.filter("doc_id % 10 >= 6"), model).collect()
    assert sum(r.language == r.lang for r in got) > 0.97 * 160
