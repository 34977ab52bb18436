"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a number of words.  As many complete epochs as fit come first; the rest is
drawn without replacement: each document gets an exponential key, scaled by its quality weight,
and the documents with the smallest keys fill the rest, found by a prefix sum in key order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import rank_rows, running_sum
from .common import WORD, beside, ordered_sums, without, written

LEAST_WEIGHT = 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Default quality: 0.25 for text without letters up to 1 for letters and spaces only."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return 0.25 + 0.75 * F.coalesce(kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def mix_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`sources` (source, source_size) with `target`: words to take from each.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times all
    words by weight.  A target stops at `cap` times its source's size; what lies above is shared by
    weight among the rest until none is above.  That fixpoint is a water level, target =
    min(cap * size, level * weight): in the order of size / weight, the level is the first that
    leaves the next source below its cap.  There may be any number of sources.
    """
    named = rank_rows(sources, [], [F.col("source").asc_nulls_last()], "__code")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    named = named.withColumn("__w", F.element_at(kinds, (F.col("__code") % len(weights) + 1).cast("int")))
    named = rank_rows(named.withColumn("__full", cap * F.col("source_size") / F.col("__w")), [], ["__full", "__code"], "__i")
    named = running_sum(running_sum(named, [], "__i", "source_size", "__s"), [], "__i", "__w", "__v")
    words, weight = named.agg(F.sum("source_size"), F.sum("__w")).first()
    below, rest = cap * (F.col("__s") - F.col("source_size")), (weight or 0.0) - F.col("__v") + F.col("__w")
    named = named.withColumn("__level", (share * (words or 0) - below) / rest)
    level = named.filter("__level <= __full").agg(F.min_by("__level", "__i")).first()[0]
    target = F.least(cap * F.col("source_size"), F.lit(level or 0.0) * F.col("__w"))
    return named.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: str | None = None, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All of `docs` with `size`, `source_size`, `target` and `taken` (words the mix takes, repeats counted).

    `taken` is `size` times the complete epochs, plus what the draw adds: all words, none, or, for
    the one document of a source at which its target is reached, the first words still owed.  So a
    source's words are its target, rounded.  `quality` names a column of weights (null or not
    positive: the least weight); without it letters count.  Null text has no words and is never
    taken; a null source is a source.  Keys come from (seed, id, text) alone, so reruns agree;
    rows equal in all of that tie, and any of them may be taken first.  An empty table gives no
    rows.  Input columns named like an output are replaced; others stay.
    """
    docs = without(docs, "size", "source_size", "target", "taken", "__key", "__row", "__src", "__full", "__pick")
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    weight = F.col(f"`{quality}`").cast("double") if quality else letter_share(words)
    weight = F.when(weight > LEAST_WEIGHT, weight).otherwise(LEAST_WEIGHT)
    # 52 bits of a hash, never 0 or 1
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), words), 12) + 0.5) / float(1 << 52)
    # rows are numbered once, and the numbers are written with them
    keyed = written(docs.withColumns({"size": word_count(words), "__key": -F.log(uniform) / weight, "__row": F.monotonically_increasing_id()}), "keyed")
    narrow = keyed.select(F.col(f"`{source}`").alias("source"), "size", "__key", "__row")
    ordered = ordered_sums(narrow.filter("size > 0"), ["source"], ["__key", "__row"], "size", "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (written(mix_targets(sizes, weights, share, cap), "targets")
            .withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("__owed", F.floor(F.col("target") + 0.5).cast("long") - F.col("__epochs") * F.col("source_size")))
    plan = plan.withColumn("__owed", F.greatest(F.lit(0), F.least("__owed", "source_size")))
    owed = plan.select(F.col("source").alias("__s"), "__owed")
    # the row of each source at which its prefix sum passes what is owed
    cuts = (ordered.join(beside(owed, 64), F.col("source").eqNullSafe(F.col("__s")))
            .filter("__before <= __owed and __owed < __before + size")
            .select("__s", F.col("__key").alias("__cut_key"), F.col("__row").alias("__cut_row"), (F.col("__owed") - F.col("__before")).alias("__part")))
    plan = (plan.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumnRenamed("source", "__src"))
    drawn = F.when(F.col("__cut_key").isNull(), F.when(F.col("__owed") > 0, F.col("size")).otherwise(0)).otherwise(
        F.when((F.col("__key") == F.col("__cut_key")) & (F.col("__row") == F.col("__cut_row")), F.col("__part"))
        .when(F.struct("__key", "__row") < F.struct("__cut_key", "__cut_row"), F.col("size")).otherwise(0))
    return (keyed.join(beside(plan, 96), F.col(f"`{source}`").eqNullSafe(F.col("__src")))
            .select(*[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target",
                    (F.col("__epochs") * F.col("size") + drawn).cast("long").alias("taken")))


def mixed_documents(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The documents of a mix: one row per copy taken, the last one cut to its words where `taken` is no whole copy."""
    whole, rest = F.expr("int(taken div greatest(size, 1))"), F.expr("int(taken % greatest(size, 1))")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), rest), " ")
    copies = F.array_repeat(F.col(f"`{text}`"), whole)
    copies = F.when(rest > 0, F.concat(copies, F.array(part))).otherwise(copies)
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    return (mixed.filter("taken > 0").select(*[F.col(f"`{c}`") for c in kept if c != text], F.explode(copies).alias(text))
            .select(*[F.col(f"`{c}`") for c in kept]))
