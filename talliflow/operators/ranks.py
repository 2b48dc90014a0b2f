"""Ranks and running totals in a random order within categories, without a task that holds a category.

The order within a category is cut into buckets of about equal size by a hash of the ids, which is the same whenever a
row is computed again. The totals of the buckets make one small table; ranks within a bucket come from a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one bucket, about.
BUCKET_ROWS = 50_000


def fraction(seed: int, *parts: Column) -> Column:
    """A uniform number in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(2**53))


def buckets_for(most: int) -> int:
    """Buckets that a category of ``most`` rows is cut into."""
    return max(1, math.ceil(most / BUCKET_ROWS))


def bucketed(rows: DataFrame, key: str, ids: list[str], most: int, seed: int) -> DataFrame:
    """``rows`` with their place in the order, ``_h``, and their bucket; ``most`` is the size of the largest category."""
    h = rows.withColumn("_h", fraction(seed, F.col(key), *(F.col(i) for i in ids)))
    return h.withColumn("_bucket", F.floor(F.col("_h") * buckets_for(most)).cast("int"))


def ranked(rows: DataFrame, key: str, ids: list[str], most: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``_rank``, from 1 within each category, in a random order. Null keys are left out."""
    h = bucketed(rows, key, ids, most, seed)
    sizes = h.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = h.withColumn("_r", F.row_number().over(W.partitionBy(key, "_bucket").orderBy("_h", *ids)))
    out = inside.join(starts, [key, "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_r"))
    return out.select(*rows.columns, "_rank")
