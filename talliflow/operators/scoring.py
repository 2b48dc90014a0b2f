"""Scores of predictions against curated targets.

Everything that depends on counts alone is a narrow expression over the two arrays; greedy matching is an ``aggregate`` over the
predictions that carries the set of matched targets. Text similarity of date expressions, the one
thing Spark lacks, is computed beforehand for the few pairs that need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talliflow.functions.text import exact_round, let, scaled_round, strip
from talliflow.functions.udfs import strict_json
from talliflow.schemas import TARGETS
from talliflow.session import spread

#: Weights of a pair's fields, and of the two parts of its date.
WEIGHTS = {"amount": 0.35, "currency": 0.15, "type": 0.15, "category": 0.15, "temporal": 0.20}
DELTA_WEIGHT, EXPRESSION_WEIGHT = 0.70, 0.30
#: Parts of the composite metric.
F1_WEIGHT, ENTITY_WEIGHT = 0.50, 0.50

ERRORS = ["amount", "currency", "type", "category", "date_delta", "date_expression"]


def last_wins(rows: DataFrame, key: str = "input", order: str = "entry_id") -> DataFrame:
    """One row per ``key``, the one with the highest ``order``; null keys are left out. Aggregates before it shuffles."""
    rest = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(key, "_r.*")


def matched(predictions: DataFrame, golden: DataFrame) -> DataFrame:
    """Predictions with ``predicted`` and ``expected`` arrays; an unknown message expects nothing.

    Null arrays are empty, a null item is one whose fields are all null. Spark broadcasts the curated side if its size allows.
    """
    expected = last_wins(golden.select("entry_id", "input", "targets")).select("input", F.col("targets").alias("_targets"))
    none = F.array().cast(TARGETS)
    out = predictions.join(expected, "input", "left")
    return out.withColumn("predicted", F.coalesce("parsed_targets", none)).withColumn("expected", F.coalesce("_targets", none))


def matched_fields(predictions: DataFrame, golden: DataFrame, fields: dict[str, str], *keep: str) -> DataFrame:
    """``keep`` of the predictions and arrays ``p_<field>`` and ``e_<field>`` of single fields (with their types) of both sides.

    The same rows as :func:`matched`, but the scans read the named fields only.
    """
    p = predictions.select(*keep, "input", *(F.col(f"parsed_targets.{f}").alias(f"p_{f}") for f in fields))
    g = last_wins(golden.select("entry_id", "input", *(F.col(f"targets.{f}").alias(f"e_{f}") for f in fields)))
    out = p.join(g.drop("entry_id"), "input", "left")
    return out.select(*keep, *(F.coalesce(f"{side}_{f}", F.array().cast(f"array<{t}>")).alias(f"{side}_{f}") for f, t in fields.items() for side in "pe"))


def _norm(c: Column, upper: bool = True) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    return F.upper(c) if upper else F.lower(c)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    def count(xs: Column, k: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x.eqNullSafe(k)))

    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, k: n + F.least(count(a, k), count(b, k)))


def transaction_keys(amounts: Column, types: Column) -> Column:
    """What transactions are counted by: amount and type in upper case."""
    return F.zip_with(amounts, types, lambda a, t: F.struct(a.alias("a"), F.upper(F.coalesce(t, F.lit(""))).alias("t")))


def transaction_counts(p: Column, e: Column) -> Column:
    """Struct of predicted, expected, true_positives, false_positives and false_negatives of two arrays of keys."""
    tp = overlap(p, e)
    return F.struct(
        F.size(p).alias("predicted"),
        F.size(e).alias("expected"),
        tp.alias("true_positives"),
        (F.size(p) - tp).alias("false_positives"),
        (F.size(e) - tp).alias("false_negatives"),
    )


def category_match(p: Column, e: Column) -> Column:
    """Of two arrays of categories, those that both have as a share of the longer one; 1 if both are empty, 0 if one is."""
    def names(xs: Column) -> Column:
        return F.transform(xs, lambda c: _norm(c, upper=False))

    return (
        F.when((F.size(p) == 0) & (F.size(e) == 0), 1.0)
        .when((F.size(p) == 0) | (F.size(e) == 0), 0.0)
        .otherwise(overlap(names(p), names(e)) / F.greatest(F.size(p), F.size(e)))
    )


def _norm_text(x: str | None) -> str | None:
    return None if x is None else x.strip().lower()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of each predicted with each expected expression where neither is null or contains the other; null if no pair needs it."""
    for p, e in batches:
        out = []
        for a, b in zip(p, e):
            xs = [] if a is None else [_norm_text(x) for x in a]
            ys = [] if b is None else [_norm_text(y) for y in b]
            needed = [[x is not None and y is not None and x not in y and y not in x for y in ys] for x in xs]
            if not any(map(any, needed)):
                out.append(None)
                continue
            out.append([[SequenceMatcher(None, x, y).ratio() if k else None for y, k in zip(ys, row)] for x, row in zip(xs, needed)])
        yield pd.Series(out, dtype=object)


def _expression_score(x: Column, y: Column, ratio: Column) -> Column:
    a, b = F.lower(strip(x)), F.lower(strip(y))
    return (
        F.when(x.isNull() & y.isNull(), 1.0)
        .when(x.isNull() | y.isNull(), 0.0)
        .when(F.contains(a, b) | F.contains(b, a), 1.0)
        .otherwise(F.coalesce(ratio, F.lit(0.0)))
    )


def pair(p: Column, e: Column, ratio: Column) -> Column:
    """Struct of a pair's score and its six error flags. Two nulls agree; the date's score is rounded before it is weighted."""
    delta = p["date_delta_days"].eqNullSafe(e["date_delta_days"]).cast("double")
    expression = _expression_score(p["date_raw_expression"], e["date_raw_expression"], ratio)
    temporal = exact_round(DELTA_WEIGHT * delta + EXPRESSION_WEIGHT * expression, 4)
    same = {
        "amount": p["amount"].eqNullSafe(e["amount"]),
        "currency": _norm(p["currency"]) == _norm(e["currency"]),
        "type": _norm(p["type"]) == _norm(e["type"]),
        "category": _norm(p["category"], upper=False) == _norm(e["category"], upper=False),
    }
    score = sum((WEIGHTS[k] * v.cast("double") for k, v in same.items()), F.lit(0.0)) + WEIGHTS["temporal"] * temporal
    flags = [(~v).alias(f"{k}_error") for k, v in same.items()]
    return F.struct(
        score.alias("score"), F.struct(*flags, (delta < 1).alias("date_delta_error"), (expression < 1).alias("date_expression_error")).alias("errors")
    )


def greedy(rows: DataFrame) -> DataFrame:
    """``rows`` with ``entity_accuracy`` and ``error_breakdown``.

    Each prediction in order takes the free expected target with the strictly greatest score, the first of equal ones. For the
    accuracy a score must be above 0; for the breakdown any free target will do. Pair scores are computed once and serve both.
    """
    p, e = F.col("predicted"), F.col("expected")
    # the Python function reads plain columns and its result is zipped in: neither its arguments nor lambdas may hold the other
    work = rows.withColumn("_ratios", _ratios(F.col("parsed_targets.date_raw_expression"), F.col("_targets.date_raw_expression")))
    none = F.lit(None)
    by_row = F.coalesce(F.col("_ratios"), F.transform(p, lambda _: none.cast("array<double>")))

    def scored(t: Column, row: Column) -> Column:
        return F.zip_with(e, F.coalesce(row, F.transform(e, lambda _: none.cast("double"))), lambda x, q: pair(t, x, q))

    errors_type = "array<struct<" + ",".join(f"{k}_error:boolean" for k in ERRORS) + ">>"
    state = f"struct<used:array<int>,total:double,zero:boolean,errors:{errors_type}>"

    def walk(pairs: Column, least: float) -> Column:
        start = F.from_json(F.lit('{"used":[],"total":0.0,"zero":false,"errors":[]}'), state)

        def step(acc: Column, row: Column) -> Column:
            ranked = F.transform(row, lambda x, j: F.struct(x["score"].alias("s"), (-j).alias("o"), j.alias("j"), x["errors"].alias("errors")))
            free = F.filter(ranked, lambda x: (x["s"] > least) & ~F.array_contains(acc["used"], x["j"]))

            def taken(best: Column) -> Column:
                return F.when(best.isNull(), acc).otherwise(
                    F.struct(
                        F.concat(acc["used"], F.array(best["j"])).alias("used"),
                        (acc["total"] + best["s"]).alias("total"),
                        (acc["zero"] | (best["s"] <= 0)).alias("zero"),
                        F.concat(acc["errors"], F.array(best["errors"])).alias("errors"),
                    ).cast(state)
                )

            return let(F.array_max(free), taken)

        return F.aggregate(pairs, start, step)

    np_, ne = F.size(p), F.size(e)

    def chosen(pairs: Column) -> Column:
        """Total score and error flags; the walk for the accuracy differs only where a pair without any score was taken."""
        one = F.get(F.get(pairs, F.lit(0)), F.lit(0))
        single = F.struct(F.greatest(F.lit(0.0), one["score"]).alias("total"), F.array(one["errors"]).cast(errors_type).alias("errors"))
        several = let(
            walk(pairs, -1.0),
            lambda w: F.struct(F.when(w["zero"], walk(pairs, 0.0)["total"]).otherwise(w["total"]).alias("total"), w["errors"].alias("errors")),
        )
        return F.when((np_ == 1) & (ne == 1), single).otherwise(several)

    work = work.withColumn("_g", let(F.zip_with(p, by_row, scored), chosen))
    accuracy = F.when((np_ == 0) & (ne == 0), 1.0).when((np_ == 0) | (ne == 0), 0.0).otherwise(F.col("_g.total") / F.greatest(np_, ne))
    return work.withColumn("entity_accuracy", accuracy).withColumn("error_breakdown", F.col("_g.errors")).drop("_ratios", "_g")


def evaluate_entries(predictions: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per prediction: strict-JSON score, entity accuracy, category match, counts and error flags of matched pairs."""
    rows = matched(spread(predictions.select("pred_id", "model", "input", "raw_response", "parsed_targets", "latency_seconds")), golden)
    keys = (transaction_keys(F.col(f"{c}.amount"), F.col(f"{c}.type")) for c in ("predicted", "expected"))
    rows = rows.withColumn("transaction_counts", transaction_counts(*keys))
    rows = rows.withColumn("category_match", category_match(F.col("predicted.category"), F.col("expected.category")))
    rows = rows.withColumn("strict_json_score", strict_json(F.col("raw_response")))
    return greedy(rows)


def ratio_of(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Micro-averaged precision, recall and F1, each rounded to 4 digits as Python rounds; all 1 where nothing was expected or predicted."""
    none = (tp + fp + fn) == 0
    precision, recall = ratio_of(tp, tp + fp), ratio_of(tp, tp + fn)
    f1 = ratio_of(2 * precision * recall, precision + recall)
    return [exact_round(F.when(none, 1.0).otherwise(c), 4).alias(k) for c, k in ((precision, "precision"), (recall, "recall"), (f1, "f1_score"))]


def _flagged(field: str) -> Column:
    """Number of matched pairs that have an error in a field."""
    return F.size(F.filter("error_breakdown", lambda x: x[f"{field}_error"]))


def report(entries: DataFrame, *by: str) -> DataFrame:
    """One row (for each value of ``by``): means, rounded to 4 digits, micro-averaged scores, error totals and latencies over evaluated entries.

    A false negative counts as an error of each field, also beside a wrong pair's own flags. An empty input gives zeros and the scores 1.
    """
    c = "transaction_counts."
    sums = [F.coalesce(F.sum(c + k), F.lit(0)).alias(a) for k, a in (("true_positives", "tp"), ("false_positives", "fp"), ("false_negatives", "fn"), ("expected", "expected"))]
    errors = [
        F.coalesce(F.sum(_flagged(k) + F.col(c + "false_negatives")), F.lit(0)).alias(f"{k}_errors") for k in ERRORS
    ]
    means = [exact_round(F.coalesce(F.avg(k), F.lit(0.0)), 4).alias(k) for k in ("strict_json_score", "entity_accuracy", "category_match")]
    totals = entries.groupBy(*by).agg(
        F.count("*").alias("total_entries"),
        *means,
        *sums,
        F.coalesce(F.sum(F.size("error_breakdown")), F.lit(0)).alias("matched_pairs"),
        F.coalesce(F.count_if(F.col("strict_json_score") == 0), F.lit(0)).alias("hard_gate_failures"),
        *errors,
        *_latencies(),
    )
    return totals.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def cleaned_strict(parsed: Column) -> Column:
    """The strict score of parsed targets that are written as JSON again: 0 if there are none or one is null, else 1, as typed targets have all keys."""
    return F.when(parsed.isNotNull() & ~F.exists(parsed, lambda t: t.isNull()), 1.0).otherwise(0.0)


def composite_metric(entries: DataFrame) -> DataFrame:
    """``entries`` with ``score``: half the entry's own F1, rounded, and half its entity accuracy; 0 for an empty answer and for one that wasn't understood."""
    t = F.col("transaction_counts")
    f1 = prf(t["true_positives"], t["false_positives"], t["false_negatives"])[2]
    blank = F.coalesce(strip(F.col("raw_response")), F.lit("")) == ""
    return entries.withColumn("score", F.when(blank | (cleaned_strict(F.col("parsed_targets")) == 0), 0.0).otherwise(F1_WEIGHT * f1 + ENTITY_WEIGHT * F.col("entity_accuracy")))


def latency_percentiles(predictions: DataFrame, *by: str) -> DataFrame:
    """p50 and p99 with linear interpolation, rounded to 3 digits as SQL rounds (reports round as Python does); 0 without any value.

    The exact aggregate keeps counts of distinct values, which the clock's resolution bounds.
    """
    return predictions.groupBy(*by).agg(*_latencies(scaled_round))


def _latencies(rounded: Callable[[Column, int], Column] = exact_round) -> list[Column]:
    return [rounded(F.coalesce(F.percentile("latency_seconds", F.lit(q)), F.lit(0.0)), 3).alias(f"{k}_seconds") for q, k in ((0.5, "p50"), (0.99, "p99"))]
