"""Similarity of units: token multisets, grayscale samples, and both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank, tokens


def token_counts(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, token, n."""
    return units.select(*keys, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def dice_pairs(pairs: DataFrame, counts: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """``pairs`` with ``dice``: twice the shared tokens of the multisets over the sum of their sizes.

    Two units without tokens are alike (1), one without and one with are not (0).
    """
    sizes = counts.groupBy(key).agg(F.sum("n").alias("size"))
    a = counts.select(F.col(key).alias(left), "token", F.col("n").alias("na"))
    b = counts.select(F.col(key).alias(right), "token", F.col("n").alias("nb"))
    shared = pairs.select(left, right).join(a, left).join(b, [right, "token"]).groupBy(left, right).agg(F.sum(F.least("na", "nb")).alias("shared"))
    out = pairs.join(sizes.toDF(left, "size_a"), left, "left").join(sizes.toDF(right, "size_b"), right, "left").join(shared, [left, right], "left")
    out = out.na.fill(0, ["size_a", "size_b", "shared"])
    both = F.col("size_a") + F.col("size_b")
    return out.withColumn("dice", F.when(both == 0, 1.0).otherwise(2 * F.col("shared") / both)).drop("size_a", "size_b", "shared")


def token_dice(a: Column, b: Column) -> Column:
    """Dice of two token arrays, in the row."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2 * shared / both)


def sample_similarity(a: Column, b: Column) -> Column:
    """1 - mean absolute difference / 255 - a quarter of the share of values that only one side has, at least 0."""
    n, m = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / n / 255 - 0.25 * (1 - n / m)))


def unit_similarity(text_a: Column, text_b: Column, dice: Column, visual: Column) -> Column:
    """Both blank: the samples; one blank: 0.9 of them; else mostly tokens."""
    blank_a, blank_b = is_blank(text_a), is_blank(text_b)
    return F.when(blank_a & blank_b, visual).when(blank_a | blank_b, 0.9 * visual).otherwise(F.least(F.lit(1.0), 0.86 * dice + 0.14 * visual))
