"""Mixing of sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.llm.common import BLANKS, running_sum, words_of, written

#: The most copies of a source that a mix takes.
EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """A document's weight from its text, in (0, 1]: the share of letters among
    its characters that are not white space, squared, at least 0.01."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.01), F.coalesce(F.pow(F.try_divide(letters, F.length(solid)), F.lit(2.0)), F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """(source_id, source, source_size, target) from (source, source_size).

    Sources in code point order (null last) get the weights in turn. They share
    the sum of all sizes by weight; a target above ``epochs`` times its source
    stops there and the rest is shared again, until none is above.
    """
    ordered = written(running_sum(
        sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)),
        ["_null", "source"], "_one", "source_id").drop("_null", "_one"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_id") % len(weights) + 1).cast("int"))
    ordered = ordered.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    total = float(ordered.agg(F.sum("source_size")).first()[0] or 0)
    # the share per unit of weight grows from round to round until no further source reaches its cap
    level, now = None, 0.0
    while level != now:
        level = now
        capped = F.col("cap") <= level * F.col("weight") if level else F.lit(False)
        row = ordered.agg(F.sum(F.when(capped, F.col("cap"))).alias("fixed"),
                          F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        now = (total - (row["fixed"] or 0.0)) / row["open"]
    return ordered.select("source_id", "source", "source_size",
                          F.least(F.col("cap"), F.lit(float(now)) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = EPOCHS, seed: int = 0,
                id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                size: Column | None = None, quality: Column | None = None) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies, taken) per row of ``docs``.

    A source is taken whole as often as its target allows (complete epochs);
    what remains of the target is filled with documents in the order of
    exponential keys -ln(u) / quality, u drawn from a hash of seed, id and text
    (Efraimidis-Spirakis). A document belongs to the fraction while the prefix
    sum up to its middle is within the budget, so the taken words miss the
    target by half a document at most. Same rows and seed, same mix.

    ``size`` defaults to the number of words (0 for null, empty, blank texts,
    which are then never taken), ``quality`` to a weight from the text. A null
    source is a source of its own. Repeated rows count each. Sources without
    words have target 0. Other columns are ignored.
    """
    text = F.col(text_column)
    size = F.size(words_of(text)) if size is None else size
    quality = quality_weight(text) if quality is None else quality
    rows = written(docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(source_column).alias("source"),
        size.cast("long").alias("size"), quality.cast("double").alias("quality")), "sizes")
    targets = written(source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "targets")
    named = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # 53 random bits, never 0
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = named.withColumn("key", -F.log(u) / F.col("quality"))
    summed = running_sum(keyed, ["key", "doc_id", "text_key"], "size", "before", "source_id")
    whole = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    part = F.col("target") - whole * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= part)
    copies = F.when(F.col("size") > 0, whole + more.cast("long")).otherwise(F.lit(0)).cast("long")
    return summed.withColumn("copies", copies).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))
