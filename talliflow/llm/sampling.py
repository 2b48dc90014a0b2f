"""A sample whose categories have wanted shares, with floors for small categories.

Systematic unequal-probability sampling: rows stand in random order within the sorted categories, their inclusion
probabilities are summed up along that order across partitions, and a row is taken where the sum, from one random
start, passes a whole number. Floors are repaired afterwards from the rows left.

The order within a category is cut into buckets of about equal size by a hash, so the prefix sums need one small
table of bucket counts and no task ever holds a category; a category may hold any part of the rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.functions.text import loose_key
from talliflow.operators import ranks

#: More wanted categories than this are refused, as their counts come to the driver.
MAX_CATEGORIES = 100_000


def random_start(seed: int) -> float:
    """A number in [0, 1) that depends on the seed only."""
    return int.from_bytes(hashlib.sha256(f"start {seed}".encode()).digest()[:6]) / 2**48


def usable_targets(golden: DataFrame, wanted: DataFrame) -> DataFrame:
    """``entry_id, target_no, target_key`` of the targets whose type and category equal a wanted key.

    Letter case, blanks at the ends and the kind of word separator don't count. Null targets, types and categories are
    not usable; rows that occur twice count twice.
    """
    keys = wanted.select(
        "target_key",
        loose_key(F.split_part("target_key", F.lit(":"), F.lit(1))).alias("_t"),
        loose_key(F.split_part("target_key", F.lit(":"), F.lit(2))).alias("_c"),
    )
    keys = keys.groupBy("_t", "_c").agg(F.min("target_key").alias("target_key"))
    # of the targets the scan reads these two fields only
    flat = golden.select("entry_id", F.posexplode(F.arrays_zip("targets.type", "targets.category")).alias("p", "target")).where(
        F.col("target.type").isNotNull() & F.col("target.category").isNotNull()
    )
    flat = flat.select(
        "entry_id",
        (F.col("p") + 1).alias("target_no"),
        loose_key(F.col("target.type")).alias("_t"),
        loose_key(F.col("target.category")).alias("_c"),
    )
    return flat.join(keys, ["_t", "_c"]).drop("_t", "_c")


def quotas(wanted: list[tuple[str, float, int]], counts: dict[str, int], size: float, refill: bool) -> list[float]:
    """Rows that each category gives: its share of ``size``, or all it has.

    With ``refill`` the others take what short categories leave, in proportion to their shares, less what floors take: the quotas are the shares times
    one factor, within floors and what there is, and the factor, 1 at least, is bisected so that they add up to ``size``.
    """
    have = [counts.get(name, 0) for name, _, _ in wanted]

    def at(factor: float) -> list[float]:
        return [min(n, max(factor * share * size, min(floor or 0, n) if refill else 0)) for (_, share, floor), n in zip(wanted, have)]

    if not refill:
        return at(1.0)
    low, high = 1.0, 2.0
    most = min(size, sum(n for (_, share, _), n in zip(wanted, have) if share > 0))
    while sum(at(high)) < most * (1 - 1e-12) and high < 1e300:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid)) < size else (low, mid)
    return at(low)


def draw(
    rows: DataFrame,
    key: str,
    ids: list[str],
    wanted: list[tuple[str, float, int]],
    size: float,
    seed: int = 0,
    counts: dict[str, int] | None = None,
    refill: bool = False,
) -> DataFrame:
    """The rows of the sample, with ``picked``: ``share`` or, for a repaired floor, ``floor``.

    ``wanted`` are the categories in their order with share and least number of rows; ``size`` is the size of the sample.
    A category gets its quota (:func:`quotas`), rounded up or down by the random start, or all its rows where it has fewer.
    Rows of other categories are left out. ``ids`` order rows with the same hash; rows equal in all of them may
    take each other's place.
    """
    counts = category_counts(rows, key) if counts is None else counts
    u = random_start(seed)
    plan, base = [], 0.0
    for (name, _, floor), quota in zip(wanted, quotas(wanted, counts, size, refill)):
        n = counts.get(name, 0)
        p = min(1.0, quota / n) if n else 0.0
        first = math.floor(base + u)
        got = math.floor(base + n * p + u) - first
        plan.append((name, base, p, first, max(0, min(floor or 0, n) - got)))
        base += n * p
    rates = rows.sparkSession.createDataFrame(plan, f"{key} string, _base double, _p double, _first long, _lack long")
    ranked = ranks.ranked(rows, key, ids, max(counts.values(), default=0), seed)
    # at most MAX_CATEGORIES short rows
    ranked = ranked.join(F.broadcast(rates), key)
    r = F.col("_rank")
    upto = F.floor(F.col("_base") + r * F.col("_p") + u)
    upto_last = F.floor(F.col("_base") + (r - 1) * F.col("_p") + u)
    left_rank = r - (upto - F.col("_first"))
    picked = F.when(upto > upto_last, "share").when(left_rank <= F.col("_lack"), "floor")
    out = ranked.withColumn("picked", picked).where("picked is not null")
    return out.select(*rows.columns, "picked")


def category_counts(rows: DataFrame, key: str) -> dict[str, int]:
    """Rows of each category; no more categories than a bound come to the driver."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n")).limit(MAX_CATEGORIES + 1).collect()
    if len(counted) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    return {r[0]: r["n"] for r in counted}


def matching_sample(
    golden: DataFrame, targets: DataFrame, fraction: float = 0.2, seed: int = 0, refill: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The sample of usable targets and the report on its categories.

    The sample has ``fraction`` of all usable targets, without ``refill`` less what short keys leave. The report has, for each wanted key: ``target_key,
    share, min_rows, available, wanted`` (share of the size), ``quota``, ``sampled``, ``actual_share`` (null in an empty sample) and ``short``: fewer usable
    targets than ``wanted`` or than ``min_rows``. Keys without targets are reported with zeros; an empty table gives an empty sample, in which
    only floors can be missed.
    """
    usable = usable_targets(golden, targets)
    listed = targets.select("ord", "target_key", "share", "min_rows").where("target_key is not null").limit(MAX_CATEGORIES + 1).collect()
    if len(listed) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    wanted = [(r["target_key"], r["share"] or 0.0, r["min_rows"] or 0) for r in sorted(listed, key=lambda r: (r["ord"] is None, r["ord"], r["target_key"]))]
    counts = category_counts(usable, "target_key")
    size = fraction * sum(counts.values())
    sample = draw(usable, "target_key", ["entry_id", "target_no"], wanted, size, seed, counts, refill)
    rows = [(k, s, m, counts.get(k, 0), s * size, q) for (k, s, m), q in zip(wanted, map(float, quotas(wanted, counts, size, refill)))]
    report = golden.sparkSession.createDataFrame(rows, "target_key string, share double, min_rows int, available long, wanted double, quota double")
    got = sample.groupBy("target_key").agg(F.count("*").alias("sampled"))
    report = report.join(got, "target_key", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    # a row for each wanted key
    report = report.withColumn("actual_share", F.try_divide("sampled", F.sum("sampled").over(W.partitionBy())))
    short = (F.col("available") < F.col("wanted")) | (F.col("available") < F.col("min_rows")) | (F.col("sampled") < F.floor("wanted"))
    return sample, report.withColumn("short", short)
