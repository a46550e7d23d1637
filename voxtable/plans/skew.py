"""Joins and running totals that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A key is hot if it has more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])


def skew_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``groups`` (one row a key, ``weight`` = rows of that key), null-safe.

    Hot keys are joined by broadcast, without a shuffle: at most HOT_SHARE groups can
    each hold more than 1/HOT_SHARE of the rows, so that side has a proven bound.
    All other keys meet in a shuffled join. ``how`` is inner or left. Both inputs are
    read twice and should be staged.
    """
    total = groups.agg(F.sum(weight)).head()[0] or 0
    least = max(1, total // HOT_SHARE)
    g = groups.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    hot, cold = g.filter(F.col(weight) > least), g.filter(F.col(weight) <= least)
    drop = [f"_r_{k}" for k in keys]
    marks = F.broadcast(hot.select(*drop))
    by_hot = rows.join(F.broadcast(hot), _on(rows, hot, keys), "inner").drop(*drop)
    rest = rows.join(marks, _on(rows, marks, keys), "left_anti")
    by_cold = rest.join(cold, _on(rest, cold, keys), how).drop(*drop)
    return by_hot.unionByName(by_cold)


def bucket_bits(df: DataFrame) -> int:
    """Bits of a hash that deal rows over four times the shuffle partitions: 6 to 16."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(6, min(16, (4 * n - 1).bit_length()))


def running_total(df: DataFrame, keys: Sequence[str], order_hash: str, ties: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same ``keys``.

    Rows of a key stand in the order of the bigint ``order_hash`` (as unsigned) and
    ``ties``. The top bits of the hash cut every key into buckets; each bucket is summed
    on its own and gets the total of the buckets before it, so no task holds a whole key.
    The result doesn't depend on the number of buckets. ``keys`` must not be null.
    """
    bits = bucket_bits(df)
    b = df.withColumn("_b", F.shiftrightunsigned(order_hash, 64 - bits))
    sums = b.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    here = W.partitionBy(*keys, "_b").orderBy(order_hash, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        b.join(offsets, [*keys, "_b"])
        .withColumn(out, F.col("_off") + F.coalesce(F.sum(value).over(here), F.lit(0)))
        .drop("_b", "_off")
    )
