"""Profiles of curated entries and conversations: counts, shares, amounts, coverage, gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.session import shared_path

#: Bounds of the recommendations.
SKEW_PERCENT, COVERAGE_SHARE, MULTI_SHARE = 70, 0.5, 0.2
#: Words that tell a message speaks of dollars.
USD_MARKERS = ["usd", "dolar", "dólares", "dolares", "usds", "dólar"]


def items(rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """One row per item of an array column with the given fields as ``t``. A null item is one whose fields are all null.

    The fields' own arrays are zipped, so the scan reads these fields and no others.
    """
    return rows.select(F.explode(F.arrays_zip(*(F.col(f"{column}.{f}").alias(f) for f in fields))).alias("t"))


def count_by_type(rows: DataFrame, column: str) -> DataFrame:
    """Items by type; a missing type is ``unknown``."""
    return items(rows, column, ["type"]).groupBy(F.coalesce(F.col("t.type"), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def totals(conversations: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: conversations, distinct saved messages, and how many remain (may be negative)."""
    a = conversations.agg(F.count("*").alias("total"))
    # an approximate count won't do: the difference is shown to users
    b = golden.agg(F.countDistinct("input").alias("saved"))
    both = a.select("total", F.lit(1).alias("_k")).join(b.select("saved", F.lit(1).alias("_k")), "_k")
    return both.select("total", "saved", (F.col("total") - F.col("saved")).alias("remaining"))


def category_counts(golden: DataFrame) -> DataFrame:
    """Targets by type and category."""
    return items(golden, "targets", ["type", "category"]).groupBy(F.col("t.type").alias("type"), F.col("t.category").alias("category")).agg(F.count("*").alias("n"))


def targets_per_entry(golden: DataFrame) -> DataFrame:
    """Entries by their number of targets; null arrays have none."""
    k = F.coalesce(F.size("targets.type"), F.lit(0))
    return golden.groupBy(k.alias("n_targets")).agg(F.count("*").alias("n"))


#: Half the width, in parts of all rows, of the interval that is searched for an exact median.
MEDIAN_MARGIN = 1e-3
#: Distinct values of a group that are put in order by one task, at most; ranges that a longer interval is cut into, and passes that do so.
MEDIAN_ROWS, MEDIAN_RANGES, MEDIAN_PASSES = 1_000_000, 1024, 20


def _written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, f"values-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _narrowed(counts: DataFrame) -> DataFrame:
    """Of values (_v, null for all below) with counts (_k) those of the range that the median lies in; what is below becomes one item."""
    ends = counts.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_m")).withColumnRenamed("_g", "_s")
    part = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    rows = counts.join(ends, F.col("_g").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_r", F.when(F.col("_m") > MEDIAN_ROWS, F.least(F.floor(part * MEDIAN_RANGES), F.lit(MEDIAN_RANGES - 1))).otherwise(F.lit(0)))
    rows = rows.withColumn("_r", F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.coalesce("_r", F.lit(0)))).drop("_s", "_lo", "_hi", "_m")
    ranges = rows.groupBy("_g", "_n", "_r").agg(F.sum("_k").alias("_t"))
    # MEDIAN_RANGES + 1 rows a group
    upto = W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    hit = ranges.withColumn("_c", F.sum("_t").over(upto)).where(F.col("_c") > F.floor(F.col("_n") / 2))
    hit = hit.groupBy("_g").agg(F.min("_r").alias("_at")).withColumnRenamed("_g", "_s")
    rows = rows.join(hit, F.col("_g").eqNullSafe(F.col("_s"))).where(F.col("_r") <= F.col("_at"))
    low = F.when(F.col("_r") == F.col("_at"), F.col("_v"))
    return rows.groupBy("_g", "_n", low.alias("_v")).agg(F.sum("_k").alias("_k"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, upper_median``: the larger of the middle two values for an even number, the middle one else. Null groups count, null values don't.

    Approximate quantiles bracket the median; the values below are counted and only those inside are put in order. While a bracket has more than
    ``MEDIAN_ROWS`` distinct values it is cut into ranges, of which the counts tell the one to go on with, so no task holds a group's values.
    """
    rows = rows.select(F.col(by).alias("_g"), F.col(value).alias("_v")).where("_v is not null")
    # the sketch errs by 1e-4 of the rows at most, a tenth of the margin
    marks = F.percentile_approx("_v", F.array(F.lit(0.5 - MEDIAN_MARGIN), F.lit(0.5 + MEDIAN_MARGIN)), 10_000)
    stats = rows.groupBy("_g").agg(F.count("*").alias("_n"), marks.alias("_q"))
    stats = stats.select(F.col("_g").alias("_s"), "_n", F.get("_q", F.lit(0)).alias("_lo"), F.get("_q", F.lit(1)).alias("_hi"))
    placed = rows.join(stats, F.col("_g").eqNullSafe(F.col("_s"))).where("_v <= _hi")
    # all values below the bracket are one item, so the window has the bracket's distinct values only
    low = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))
    counts = placed.groupBy("_g", "_n", low.alias("_v")).agg(F.count("*").alias("_k"))
    counts = _written(counts)
    for _ in range(MEDIAN_PASSES):
        if counts.groupBy("_g").agg(F.count("*").alias("k")).where(F.col("k") > MEDIAN_ROWS).isEmpty():
            break
        counts = _written(_narrowed(counts))
    upto = W.partitionBy("_g").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
    hits = counts.withColumn("_c", F.sum("_k").over(upto)).where(F.col("_c") > F.floor(F.col("_n") / 2))
    return hits.groupBy(F.col("_g").alias(by)).agg(F.min("_v").alias("upper_median"))


def amount_statistics(golden: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and upper median of the amounts by type; null amounts don't count."""
    rows = items(golden, "targets", ["type", "amount"]).select(F.col("t.type").alias("type"), F.col("t.amount").alias("amount")).where("amount is not null")
    simple = rows.groupBy("type").agg(F.min("amount").alias("low"), F.max("amount").alias("high"), F.avg("amount").alias("mean"), F.count("*").alias("n"))
    middle = upper_median(rows, "type", "amount").withColumnRenamed("type", "_t")
    return simple.join(middle, F.col("type").eqNullSafe(F.col("_t"))).drop("_t")


def currency_counts(golden: DataFrame) -> DataFrame:
    return items(golden, "targets", ["currency"]).groupBy(F.col("t.currency").alias("currency")).agg(F.count("*").alias("n"))


def type_percentages(golden: DataFrame) -> DataFrame:
    """One row: percentages of expenses and incomes, rounded to one digit, 0 of nothing."""
    kind = F.upper(F.trim(F.col("t.type")))
    counts = items(golden, "targets", ["type"]).agg(
        F.count("*").alias("n"), F.count_if(kind == "EXPENSE").alias("e"), F.count_if(kind == "INCOME").alias("i")
    )
    def pct(c: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), F.col("n")), F.lit(0.0)), 1)

    return counts.select(F.col("n").alias("targets"), pct("e").alias("expense_pct"), pct("i").alias("income_pct"))


def recommendations(golden: DataFrame, categories: DataFrame) -> DataFrame:
    """Remarks on balance, coverage and entries of several targets, as rows (ord, kind, topic, value)."""
    p = type_percentages(golden)
    kind = F.upper(F.trim(F.col("t.type")))
    used = items(golden, "targets", ["type", "category"]).agg(
        F.countDistinct(F.when(kind == "EXPENSE", F.col("t.category"))).alias("used_e"),
        F.countDistinct(F.when(kind == "INCOME", F.col("t.category"))).alias("used_i"),
    )
    dims = categories.agg(F.count_if(F.col("kind") == "expense").alias("all_e"), F.count_if(F.col("kind") == "income").alias("all_i"))
    multi = golden.agg(F.count_if(F.size("targets.type") > 1).alias("multi"), F.count("*").alias("entries"))
    one = None
    for part in (p, used, dims, multi):  # one row each
        part = part.withColumn("_k", F.lit(1))
        one = part if one is None else one.join(part, "_k")
    def note(ord_: int, kind_: str, topic: str, value: str) -> Column:
        return F.struct(F.lit(ord_).alias("ord"), F.lit(kind_).alias("kind"), F.lit(topic).alias("topic"), F.col(value).cast("double").alias("value"))

    notes = F.array(
        F.when(F.col("expense_pct") > SKEW_PERCENT, note(1, "warning", "expenses", "expense_pct"))
        .when(F.col("income_pct") > SKEW_PERCENT, note(1, "warning", "incomes", "income_pct"))
        .otherwise(note(1, "success", "balance", "expense_pct")),
        F.when(F.col("used_e") < F.col("all_e") * COVERAGE_SHARE, note(2, "info", "expense_categories", "used_e")),
        F.when(F.col("used_i") < F.col("all_i") * COVERAGE_SHARE, note(3, "info", "income_categories", "used_i")),
        F.when(F.col("multi") < F.col("entries") * MULTI_SHARE, note(4, "info", "several_targets", "multi")),
    )
    return one.select(F.inline(F.array_compact(notes)))


def with_shares(counts: DataFrame, *within: str) -> DataFrame:
    """Counts with their share of the total and their width against the largest, within the given columns.

    The input is an aggregate, so the window holds one row per group.
    """
    w = W.partitionBy(*within)
    return counts.select("*", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.col("n") / F.max("n").over(w)).alias("width"))


def source_counts(golden: DataFrame) -> DataFrame:
    return golden.groupBy(F.col("metadata.source").alias("source")).agg(F.count("*").alias("n"), F.sum(F.size("targets.type")).alias("targets"))


def corpus_profile(golden: DataFrame) -> DataFrame:
    """One row: entries, targets, mean targets per entry and shares of targets by kind, date and size."""
    t = items(golden, "targets", ["type", "amount", "date_delta_days", "date_raw_expression"])
    part = {
        "expense_share": F.upper(F.trim(F.col("t.type"))) == "EXPENSE",
        "absolute_date_share": F.col("t.date_delta_days").isNull() & F.col("t.date_raw_expression").isNotNull(),
        "today_share": F.col("t.date_delta_days").eqNullSafe(F.lit(0)),
        "small_share": F.coalesce(F.col("t.amount") < 15_000, F.lit(False)),
        "large_share": F.coalesce(F.col("t.amount") > 1_000_000, F.lit(False)),
    }
    a = t.agg(F.count("*").alias("targets"), *(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in part.items()))
    b = golden.agg(F.count("*").alias("entries"))
    both = b.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("complexity", F.try_divide(F.col("targets"), F.col("entries")))


def features(golden: DataFrame) -> DataFrame:
    """One row: targets in dollars, targets with a date that isn't today's, entries without, with one and with several targets."""
    def count(cs: Column, cond) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(cs, cond))), F.lit(0))

    dates = F.arrays_zip(F.col("targets.date_delta_days").alias("d"), F.col("targets.date_raw_expression").alias("x"))
    n = F.coalesce(F.size("targets.currency"), F.lit(0))
    return golden.agg(
        count(F.col("targets.currency"), lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))) == "USD").alias("usd"),
        F.count_if(n == 0).alias("non_transactional"),
        F.count_if(n == 1).alias("single_transaction"),
        F.count_if(n > 1).alias("multi_transaction"),
        count(dates, lambda t: (F.coalesce(t["d"], F.lit(0)) != 0) | t["x"].isNotNull()).alias("dated"),
    )


def clean_corpus(golden: DataFrame, longest: int = 500, largest: float = 3e6) -> DataFrame:
    """Entries of at most ``longest`` characters without an amount over ``largest``; of entries with the same message the first.

    Null messages are kept; they are no duplicates of each other.
    """
    large = F.coalesce(F.exists("targets.amount", lambda a: F.coalesce(a > largest, F.lit(False))), F.lit(False))
    good = golden.where(F.coalesce(F.length("input") <= longest, F.lit(True)) & ~large)
    firsts = good.where("input is not null").groupBy("input").agg(F.min("entry_id").alias("entry_id")).select("entry_id")
    return good.join(firsts.union(good.where("input is null").select("entry_id")), "entry_id", "left_semi")


def dollar_messages(golden: DataFrame) -> DataFrame:
    """Entries with a target in dollars, with whether the message says so."""
    usd = F.exists("targets.currency", lambda c: F.coalesce(c == "USD", F.lit(False)))
    low = F.lower("input")
    says = F.coalesce(F.exists(F.array(*(F.lit(m) for m in USD_MARKERS)), lambda m: F.contains(low, m)), F.lit(False))
    return golden.where(usd).select("entry_id", says.alias("says_dollars"))
