"""Samples with wanted shares."""

import math

from pyspark.sql import functions as F

from talliflow.llm import sampling
from talliflow.operators import ranks
from talliflow.schemas import TARGETS


def target(kind, category):
    return (kind, 1.0, "ARS", category, None, 0, None)


def tables(spark, counts, wanted):
    rows, i = [], 0
    for (kind, cat), n in counts.items():
        for _ in range(n):
            rows.append((i, [target(kind, cat), None], "clash"))
            i += 1
    g = spark.createDataFrame(rows, f"entry_id long, targets {TARGETS}, target_key string")
    w = spark.createDataFrame([(k, key, s, m) for k, (key, s, m) in enumerate(wanted)], "ord int, target_key string, share double, min_rows int")
    return g, w


def test_shares_floors_and_report(spark):
    counts = {("EXPENSE", "A_B"): 3000, (" expense", "a - b\t"): 300, ("INCOME", "C"): 40, ("INCOME", "D"): 12, ("INCOME", "E"): 3, ("X", "Y"): 500, (None, "C"): 9, ("INCOME", None): 9}
    g, w = tables(spark, counts, [("EXPENSE:A_B", 0.9, 5), ("INCOME:C", 0.05, 5), ("INCOME:D", 0.001, 10), ("INCOME:E", 0.04, 5), ("INCOME:F", 0.009, 2)])
    old, ranks.BUCKET_ROWS = ranks.BUCKET_ROWS, 100
    try:
        sample, report = sampling.matching_sample(g, w, 0.2)
        rows = sample.collect()
    finally:
        ranks.BUCKET_ROWS = old
    n = 3355
    got = {r["target_key"]: r for r in report.collect()}
    assert {k: r["available"] for k, r in got.items()} == {"EXPENSE:A_B": 3300, "INCOME:C": 40, "INCOME:D": 12, "INCOME:E": 3, "INCOME:F": 0}
    size = {k: sum(r["target_key"] == k for r in rows) for k in got}
    assert abs(size["EXPENSE:A_B"] - 0.9 * 0.2 * n) < 1 and abs(size["INCOME:C"] - 0.05 * 0.2 * n) < 1
    assert size["INCOME:D"] == 10 and size["INCOME:E"] == 3 and size["INCOME:F"] == 0
    assert {k for k, r in got.items() if r["short"]} == {"INCOME:E", "INCOME:F"}
    assert {k: r["sampled"] for k, r in got.items()} == size
    assert len({(r["entry_id"], r["target_no"]) for r in rows}) == len(rows)
    # the same sample again, another one for another seed
    again = sampling.matching_sample(g, w, 0.2)[0].collect()
    assert {r["entry_id"] for r in again} == {r["entry_id"] for r in rows} or old != 100
    other = sampling.matching_sample(g, w, 0.2, seed=1)[0].collect()
    assert {r["entry_id"] for r in other} != {r["entry_id"] for r in again}


def test_inclusion_is_even(spark):
    """Each row of a category is as likely as any other."""
    df = spark.range(60).select(F.lit("k").alias("k"), F.col("id"))
    hits = [0] * 60
    for seed in range(40):
        for r in sampling.draw(df, "k", ["id"], [("k", 1.0, 0)], 20, seed, {"k": 60}).collect():
            hits[r["id"]] += 1
    assert sum(hits) == 40 * 20
    mean, sd = 40 / 3, math.sqrt(40 * (1 / 3) * (2 / 3))
    assert all(abs(h - mean) < 4.5 * sd for h in hits)


def test_edges(spark):
    g, w = tables(spark, {("A", "b"): 4}, [("A:b", 1.0, 9)])
    sample, report = sampling.matching_sample(g, w, 0.5)
    assert sample.count() == 4 and report.first()["short"]
    empty, rep = sampling.matching_sample(g.where("false"), w, 0.5)
    assert empty.count() == 0 and rep.first()["short"] and rep.first()["available"] == 0
    assert sampling.matching_sample(g, w.where("false"))[1].count() == 0
    twice = sampling.matching_sample(g.union(g), w, 1.0)[0]
    assert twice.count() == 8


def test_others_take_what_short_keys_leave(spark):
    counts = {("A", "a"): 2000, ("A", "b"): 900, ("A", "c"): 40, ("A", "d"): 60}
    g, w = tables(spark, counts, [("A:a", 0.3, 5), ("A:b", 0.2, 5), ("A:c", 0.49, 5), ("A:d", 0.01, 30), ("A:e", 0.0, 3)])
    sample, report = sampling.matching_sample(g, w, 0.2, refill=True)
    got = {r["target_key"]: r for r in report.collect()}
    assert sample.count() == sum(r["sampled"] for r in got.values()) and abs(sample.count() - 600) <= 1
    assert got["A:c"]["sampled"] == 40 and got["A:d"]["sampled"] == 30 and got["A:e"]["sampled"] == 0
    assert abs(got["A:a"]["sampled"] - 530 * 0.6) < 1 and abs(got["A:b"]["sampled"] - 530 * 0.4) < 1
    assert {k for k, r in got.items() if r["short"]} == {"A:c", "A:e"}
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9 and got["A:c"]["actual_share"] == 40 / sample.count()


def test_quotas():
    some = [("a", 0.5, 0), ("b", 0.5, 10)]
    assert sampling.quotas(some, {"a": 100, "b": 100}, 50, True) == [25, 25] == sampling.quotas(some, {"a": 100, "b": 100}, 50, False)
    # all that there is, where the size can't be met
    assert sampling.quotas(some, {"a": 3, "b": 4}, 50, True) == [3, 4]
    assert sampling.quotas(some, {}, 0, True) == [0, 0] and sampling.quotas([], {}, 5, True) == []
    # floors never take from a served share
    assert sampling.quotas([("a", 0.9, 0), ("b", 0.1, 30)], {"a": 100, "b": 100}, 50, True) == [45, 30]
