"""Mixing sources to target weights, in DataFrame operations only.

Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...  Together they are to
give ``budget`` times all words.  No target exceeds ``ceiling`` times its source: what a source
cannot take is shared again by weight.  Sharing until none is above its ceiling has a closed
form: with sources sorted by ceiling / weight, a prefix is held at its ceiling and every other
source gets weight times one common level.

The repetition rate of a source is its target over its size.  A document is emitted
floor(rate) times, and once more if a uniform number drawn from the hash of its doc_id and the
seed is below the rest, so that reruns agree on any partitioning.

Defined results: a null or empty text has size 0, and its copies take 0 words; a source of size
0 has target 0 and rate 0; rows that repeat a doc_id share its draw; an empty table gives an
empty result; columns other than doc_id, text and source are carried by ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CEILING = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """In [0, 1), from 48 bits of a digest that other engines have too."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING) -> DataFrame:
    """One row per source of ``sized(source, size)``: source, source_size, target, rate.

    The windows below see one row per source, not the documents.
    """
    everything = Window.partitionBy(F.lit(0))
    named = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1))
        .withColumn("most", F.col("source_size") * ceiling)
    )
    by_level = everything.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        named.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("held", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.lit(float(budget)) * F.col("total") - F.col("held"))
        # the first source whose ceiling holds all of its share ends the prefix of held ones
        .withColumn("fits", F.col("most") * F.col("open") >= F.col("left") * F.col("weight"))
        .withColumn("first", F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "place", "left", "open"))).over(everything))
        .withColumn("ended", F.max(F.when(F.col("fits"), 1).otherwise(0)).over(by_level))
    )
    share = F.col("left_at") * F.col("weight") / F.col("open_at")
    target = F.when(F.col("ended") == 1, F.least(F.col("most").cast("double"), share)).otherwise(F.col("most").cast("double"))
    return (
        levels.withColumn("left_at", F.col("first.left")).withColumn("open_at", F.col("first.open"))
        .select("source", "source_size", target.alias("target"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )


def plan_mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, budget: float = BUDGET, ceiling: int = CEILING, carry: str | None = None) -> DataFrame:
    """doc_id, text, source (and the column named carry) of docs with size, source_size, target, rate and copies."""
    sized = docs.select("doc_id", "text", "source", *([carry] if carry else [])).withColumn("size", n_words(F.col("text")))
    targets = materialize(source_targets(sized.select("source", "size"), weights, budget, ceiling))
    targets = targets.withColumnRenamed("source", "of_source")
    whole = F.floor("rate")
    draw = F.when(uniform(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    # the table of sources is broadcast only if Spark finds it small; else the join is split where a source is hot
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
        .withColumn("copies", (whole + draw).cast("long"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    packed = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("0"), *others).alias("carried"))
    taken = plan_mix(packed, carry="carried", **options).where("copies > 0")
    each = taken.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(*(F.col("carried")[c].alias(c) if c in others else F.col(c) for c in docs.columns))
