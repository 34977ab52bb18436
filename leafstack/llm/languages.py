"""Language identification by Bayesian fusion of evidence.

The text gives a likelihood per language (a multinomial model over hashed byte trigrams).  To it
come the declared markup language and the address suffix, whose reliability is measured by grouped
sums over all rows, and a host prior smoothed towards its domain's and that towards all rows'.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, text_groups, text_key, without, written

BUCKETS = 1 << 16
# Rows that the model is fitted on (a bound, not a share, dealt to the languages alike, but at least LANGUAGE_ROWS each), and rows that a language needs.
FIT_ROWS, LANGUAGE_ROWS = 20_000, 5
# A text counts as at most this many trigrams, as neighbouring ones are not independent.
TEXT_GRAMS = 100
# Strength of the smoothing: rows' worth of the level above, and rows added to every hint.
HOST_ROWS, HINT_ROWS = 20, 1
# Below this posterior, or this log likelihood per trigram against a uniform one, there is no answer.
LEAST_POSTERIOR, LEAST_GAIN = 0.5, 0.0
UNIT = 1_000_000
# Values of the hash that rows are drawn by.
DRAWS = 1 << 40

# Letters as they are, in lower case; all other ASCII is a blank; bytes of other characters stay.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
# Markup, script, style and comments; what is not closed goes to the end.
_MARKUP = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    gain: np.ndarray  # (languages, BUCKETS): log likelihood of a trigram against a uniform choice


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams with no two blanks in a row, and the number of the text of each."""
    data = np.frombuffer(b"  ".join([b"", *texts, b""]).translate(_FOLD), np.uint8)
    at = np.cumsum([1, *(len(t) + 2 for t in texts)])  # the blank before a text is the text's
    wide = data.astype(np.uint32)
    blank = data == 32
    two = blank[:-1] & blank[1:]
    keep = np.flatnonzero(~(two[:-1] | two[1:]))
    code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[keep]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), np.searchsorted(at, keep, side="right") - 1


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", rows: int = FIT_ROWS) -> Model:
    """A model from about `rows` labelled rows; every language has an equal quota of them, and all its rows if it has fewer.

    Rows are drawn by a hash of their `doc_id`, if there is one, and text.  Rows with null text or
    label play no part.  Languages with under LANGUAGE_ROWS rows in all, at any size of the input,
    are not modelled; all others are, however many: a language takes a quarter megabyte.
    """
    ids = [F.col("doc_id")] if "doc_id" in labelled.columns else []
    known = labelled.select(F.col(f"`{language}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(*ids, F.col(f"`{text}`"), F.lit(1)), F.lit(DRAWS)).alias("draw")).filter("lang is not null and text is not null")
    frequent = known.groupBy("lang").count().filter(F.col("count") >= LANGUAGE_ROWS).orderBy("lang").collect()
    names, quota = [r["lang"] for r in frequent], max(rows / max(len(frequent), 1), LANGUAGE_ROWS)
    index = {name: k for k, name in enumerate(names)}
    shares = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, quota / r["count"]) * DRAWS)) for r in frequent], "lang string, below long")
    drawn = known.join(F.broadcast(shares), "lang").filter("draw < below")

    def count(batches):
        sums = {}
        for group, batch in text_groups(batches):
            code, of = grams(group)
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                sums[lang] = sums.get(lang, 0) + np.bincount(code[mine[of]], minlength=BUCKETS)
        for lang, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["lang", "n"])

    # at most 8 rows of one table each for a language
    parts = drawn.select("lang", "text").repartition(8).mapInArrow(count, "lang string, n binary")
    table = np.zeros((len(names), BUCKETS))
    for r in parts.toLocalIterator():
        table[index[r["lang"]]] += np.frombuffer(r["n"], "<i8")
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return Model(tuple(names), (np.log(share) + np.log(BUCKETS)).astype(np.float32))


def text_gains(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean gain per trigram of each text in each language, and the texts' trigram numbers."""
    code, of = grams(texts)
    n = np.bincount(of, minlength=len(texts))[:len(texts)]
    gains = np.stack([np.bincount(of, weights=g[code], minlength=len(texts))[:len(texts)] for g in model.gain]) if len(model.languages) else np.zeros((0, len(texts)))
    return gains / np.maximum(n, 1), n


def host_of(url: Column) -> Column:
    """Lower-case host of an address, '' if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def declared_of(html: Column) -> Column:
    """Primary subtag of the language that the markup declares, '' if none."""
    return F.lower(F.coalesce(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1), F.lit("")))


def identify(rows: DataFrame, model: Model, text: str = "text", markup: bool = False, host: Column | None = None, declared: Column | None = None) -> DataFrame:
    """`rows` without their text, with `language`, `confidence` (its posterior), `text_language`, and the hints used.

    `host` and `declared` are string columns ('' or null: no such hint); with `markup` the tags of
    the text are dropped first.  `language` is 'und' where no text or too little speaks for any
    language: no trigram, a posterior under LEAST_POSTERIOR, or trigrams no likelier in the best
    language than by chance.  In the last case a declared language is the answer, and so is one that is
    not modelled wherever the text is not told; `confidence` is then 0.  Null text is empty.  A row's own text does not count in its host prior.
    All sums are of whole millionths, so reruns agree.  Any number of hosts may be there, and any
    host may have most rows.  Each row goes through once, with its other columns, so `rows` may come
    in any order and partitioning at each reading; an empty table gives no rows; input columns named
    like an output are replaced.
    """
    outputs = ("language", "confidence", "text_language", "declared", "host")
    kept = without(rows, *outputs, text, "__host", "__declared", "__weighed", "__post", "__letters", "__heard").columns
    asked = rows.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(h if h is not None else F.lit(""), F.lit("")).alias(n) for h, n in ((host, "__host"), (declared, "__declared"))], F.col(f"`{text}`").alias("__text"))
    n, names = len(model.languages), F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array().cast("array<string>")
    gain = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for group, batch in text_groups(batches):
            if markup:
                group = [_MARKUP.sub(b" ", t) for t in group]
            gains, count = text_gains(gain.value, group)
            best = gains.max(axis=0, initial=-np.inf)
            weighed = gains * (count * TEXT_GRAMS / (count + TEXT_GRAMS))
            post = np.exp(weighed - weighed.max(axis=0, initial=-np.inf, keepdims=True)) if n else weighed
            post = np.rint(post / post.sum(axis=0, keepdims=True) * UNIT).astype(np.int64) if n else post
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(weighed.T.round(6)), pa.list_(pa.float64())), pa.array(list(post.T), pa.list_(pa.int64())), pa.array(count > 0), pa.array((count > 0) & (best > LEAST_GAIN))], names=fields)

    schema = T.StructType(asked.schema.fields[:-1] + [T.StructField("__weighed", T.ArrayType(T.DoubleType())), T.StructField("__post", T.ArrayType(T.LongType())),
                                                                   T.StructField("__letters", T.BooleanType()), T.StructField("__heard", T.BooleanType())])
    fields = schema.names
    scored = written(asked.mapInArrow(score, schema), "languages")
    gain.destroy()
    scored = (scored.withColumn("__suffix", F.regexp_extract("__host", r"\.([^.]+)$", 1)).withColumn("__domain", F.regexp_extract("__host", r"([^.]+\.[^.]+)$", 1)))
    heard = scored.filter("__heard")

    def sums(key, out):
        """Rows per language by the text alone, in millionths, by the values of `key`."""
        return (heard.filter(F.col(key) != "").groupBy(key).agg(*[F.sum(F.col("__post")[i]).alias(f"s{i}") for i in range(n)])
                .select(F.col(key).alias(f"{out}_key"), F.array(*[F.col(f"s{i}") for i in range(n)]).alias(out)))

    whole = (heard.agg(*[F.sum(F.col("__post")[i]) for i in range(n)]).first() if n else ()) or ()
    everywhere = [((whole[i] or 0) / UNIT + 1) / (sum(x or 0 for x in whole) / UNIT + n) for i in range(n)]
    for key, out in (("__host", "__hs"), ("__domain", "__ds"), ("__suffix", "__ss"), ("__declared", "__ls")) if n else ():
        side = beside(written(sums(key, out), "hints"), 64 + 8 * n)
        scored = scored.join(side, F.col(key) == F.col(f"{out}_key"), "left").drop(f"{out}_key")

    def count(out, i):
        return F.coalesce(F.col(out)[i], F.lit(0)) / UNIT

    def total(out):
        return sum((count(out, i) for i in range(n)), F.lit(0.0))

    own = F.when(F.col("__heard"), 1.0).otherwise(0.0)
    logs = []
    for i in range(n):
        mine = own * F.col("__post")[i] / UNIT
        domain = (F.greatest(count("__ds", i) - mine, F.lit(0.0)) + HOST_ROWS * everywhere[i]) / (F.greatest(total("__ds") - own, F.lit(0.0)) + HOST_ROWS)
        prior = (F.greatest(count("__hs", i) - mine, F.lit(0.0)) + HOST_ROWS * domain) / (F.greatest(total("__hs") - own, F.lit(0.0)) + HOST_ROWS)
        value = F.log(prior) + F.col("__weighed")[i]
        for out, key in (("__ls", "__declared"), ("__ss", "__suffix")):
            # P(hint | language) up to a factor: how much likelier the language is with the hint
            lift = (count(out, i) + HINT_ROWS * everywhere[i]) / (total(out) + HINT_ROWS) / everywhere[i]
            value = value + F.when(F.col(key) != "", F.log(lift)).otherwise(0.0)
        logs.append(value)
    if n:
        scored = scored.withColumn("__logs", F.array(*logs)).withColumn("__top", F.array_max("__logs"))
        share = 1 / F.aggregate(F.transform("__logs", lambda x: F.exp(x - F.col("__top"))), F.lit(0.0), lambda a, x: a + x)
        scored = (scored.withColumn("confidence", F.round(share, 4)).withColumn("__best", F.get(names, F.array_position("__logs", F.col("__top")).cast("int") - 1))
                  .withColumn("text_language", F.when(F.col("__heard"), F.get(names, F.array_position("__weighed", F.array_max("__weighed")).cast("int") - 1)).otherwise("und")))
    else:
        scored = scored.withColumns({"confidence": F.lit(0.0), "__best": F.lit("und"), "text_language": F.lit("und")})
    told = F.col("__heard") & (F.col("confidence") >= LEAST_POSTERIOR)
    labelled = ~told & F.col("__letters") & (F.col("__declared") != "") & (~F.col("__heard") | ~F.col("__declared").isin(list(model.languages)))
    return scored.select(
        *[F.col(f"`{c}`") for c in kept], F.when(told, F.col("__best")).when(labelled, F.col("__declared")).otherwise("und").alias("language"),
        F.when(labelled, 0.0).otherwise(F.col("confidence")).alias("confidence"), "text_language",
        F.nullif("__declared", F.lit("")).alias("declared"), F.nullif("__host", F.lit("")).alias("host"))


def speak(rows: DataFrame, model: Model, text: str = "text", **hints) -> DataFrame:
    """`rows` whose language could be told; those answered 'und' go.

    An answer hangs on the text and the hints alone, so rows are told apart by those.
    """
    key = F.unhex(F.md5(F.concat_ws("\x00", *[F.coalesce(hints.get(h, F.lit("")), F.lit("")) for h in ("host", "declared")], F.hex(text_key(F.col(f"`{text}`")))).cast("binary")))
    keyed = rows.withColumn("__told", key)
    drop = written(identify(keyed, model, text, **hints).filter("language = 'und'").select("__told").distinct(), "und")
    return keyed.join(beside(drop, 48), "__told", "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])
