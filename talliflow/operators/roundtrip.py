"""Round-trip validation: do the targets extracted from a generated text agree with those it was made from?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_amount(xs: Column) -> Column:
    """A target array sorted by amount, equal amounts in their order; a missing amount counts as 0."""
    keyed = F.transform(xs, lambda t, i: F.struct(F.coalesce(t["amount"], F.lit(0.0)).alias("a"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["a"] < y["a"], -1).when(x["a"] > y["a"], 1).otherwise(x["i"] - y["i"])), lambda x: x["t"])


def off(o: Column, e: Column) -> Column:
    """Whether amounts differ: by over 5 % and over 10, or by over 0.1 from an original of 0 or less."""
    gap = F.abs(o - e)
    return F.when(o > 0, (F.coalesce(F.try_divide(gap, o), F.lit(0.0)) > 0.05) & (gap > 10)).otherwise(gap > 0.1)


def pair_reason(o: Column, e: Column) -> Column:
    """The first field in which a pair differs, or null. Descriptions and expressions aren't compared; no delta equals 0."""
    def up(c: Column) -> Column:
        return F.upper(F.coalesce(c, F.lit("None")))

    zero = F.lit(0)
    return (
        F.when(up(o["type"]) != up(e["type"]), "type")
        .when(off(F.coalesce(o["amount"], F.lit(0.0)), F.coalesce(e["amount"], F.lit(0.0))), "amount")
        .when(up(o["currency"]) != up(e["currency"]), "currency")
        .when(up(o["category"]) != up(e["category"]), "category")
        .when(F.coalesce(o["date_delta_days"], zero) != F.coalesce(e["date_delta_days"], zero), "date_delta")
    )


def reason(original: Column, extracted: Column) -> Column:
    """Null for a valid round trip, ``length`` for another number of targets, else the first differing field of the pairs by amount."""
    pairs = F.zip_with(by_amount(original), by_amount(extracted), pair_reason)
    return F.when(F.size(original) != F.size(extracted), "length").otherwise(F.get(F.array_compact(pairs), F.lit(0)))


def final_targets(original: Column, extracted: Column) -> Column:
    """Targets to keep: the extracted values, the original's where one is missing; an empty description counts as missing, dates never fall back."""
    def merge(o: Column, e: Column) -> Column:
        kept = [F.coalesce(e[k], o[k]).alias(k) for k in ("type", "amount", "currency", "category")]
        text = F.coalesce(F.nullif(e["description"], F.lit("")), o["description"]).alias("description")
        return F.struct(*kept, text, e["date_delta_days"].alias("date_delta_days"), e["date_raw_expression"].alias("date_raw_expression"))

    return F.zip_with(by_amount(original), by_amount(extracted), merge)


def validate(rows: DataFrame, original: str, extracted: str) -> DataFrame:
    """``rows`` with ``reason`` and, for valid ones, ``final_targets``. A null array is an empty one."""
    kind = rows.schema[original].dataType
    o = F.coalesce(F.col(original), F.array().cast(kind))
    e = F.coalesce(F.col(extracted), F.array().cast(kind))
    out = rows.withColumn("reason", reason(o, e))
    return out.withColumn("final_targets", F.when(F.col("reason").isNull(), final_targets(o, e)))
