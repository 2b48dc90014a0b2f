"""Containers and mixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talliflow.llm import mixing, packing, tokens

WORDS = "gasto pan luna verde casa río monto".split()


def docs(spark, sizes, source="s"):
    rows = [(i, None if n is None else " ".join(WORDS[(i + k) % 7] for k in range(n)), source, "x", n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, container string, n int")


def test_patterns_are_all_there():
    sizes = np.array([1, 2, 3, 5])
    got = {tuple(sorted(x for x in p if x)) for p in packing.patterns(6, 3, sizes).tolist()}
    want = {tuple(sorted(c)) for n in (1, 2, 3) for c in __import__("itertools").combinations_with_replacement([1, 2, 3, 5], n) if sum(c) == 6}
    assert got == want


def test_fit_solves_small_systems():
    found = np.array([[3, 1, 0], [2, 2, 0], [4, 0, 0]])
    h = np.array([0, 30, 40, 30, 7], float)
    assert np.allclose(packing.fit(found, h, 3000), [30, 20, 7], atol=0.1)


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_every_item_once(seed):
    rng = np.random.default_rng(seed)
    total = 64
    h = np.zeros(total + 1, np.int64)
    np.add.at(h, rng.integers(1, total + 1 if seed % 2 else 20, 3000), 1)
    h[total] += 7
    plan = packing.make_plan(h, total)
    block, direct, whole = packing.Finder(plan.to_block), packing.Finder(plan.to_container), packing.Finder(plan.blocks)
    load = np.zeros(plan.n_containers)
    size = plan.blocks[0].size if plan.blocks else 0
    for s in range(1, total + 1):
        r = np.arange(h[s])
        b = block.bins(np.full(h[s], s), r)
        c = np.where(b >= 0, whole.bins(np.full(h[s], size), b), direct.bins(np.full(h[s], s), r))
        assert (c >= 0).all() and not ((b >= 0) & (direct.bins(np.full(h[s], s), r) >= 0)).any()
        np.add.at(load, c, s)
    assert load.max() <= total and (load > 0).all()
    assert load.sum() / total / plan.n_containers > 0.93


def test_pack(spark):
    sizes = [None, 0, 1, 3000, 9000] + [int(x) for x in np.random.default_rng(1).integers(5, 700, 300)] + [50] * 200
    df = docs(spark, sizes)
    rows = packing.pack(df, capacity=512).collect()
    counts = {r["doc_id"]: r["n"] for r in df.select("doc_id", tokens.token_count(F.col("text")).alias("n")).collect()}
    load, by_doc = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        by_doc.setdefault(r["id"], []).append(r)
    assert max(load.values()) <= 512 and set(by_doc) == {i for i, n in enumerate(sizes) if n is not None}
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece_no"])
        assert sum(r["n_tokens"] for r in parts) == counts[i] and len(parts) == max(1, -(-counts[i] // 512))
        assert [r["start_token"] for r in parts] == [512 * k for k in range(len(parts))]
    (rep,) = packing.packing_report(packing.pack(df, capacity=512), 512).collect()
    assert rep["used_share"] > 0.95 and rep["fullest"] <= 512
    assert packing.pack(df.where("false")).count() == 0
    assert packing.pack(df.where("doc_id = 0")).count() == 0
    assert packing.pack(df.union(df).where("doc_id = 2")).count() == 2


def test_budgets():
    def s(name, share, most, n):
        return mixing.Source(name, share, most, n, 10)

    got, e = mixing.budgets([s("a", 0.5, 1, 900), s("b", 0.5, 2, 600)], 1500)
    assert got == [750, 750] and e == 1.0
    got, e = mixing.budgets([s("a", 0.5, 1, 100), s("b", 0.25, 1, 800), s("c", 0.25, 1, 600)], 1000)
    assert got[0] == 100 and got[1] == pytest.approx(450) and got[2] == pytest.approx(450)
    got, e = mixing.budgets([s("a", 0.6, 1, 0), s("b", 0.3, 1, 500), s("c", 0.1, 1, 500)], 900)
    assert 0 < e < 1 and got[1] == pytest.approx(500, rel=1e-6) and sum(got) == pytest.approx(900)
    got, _ = mixing.budgets([s("a", 0.5, 1, 10), s("b", 0.5, 1, 10)], 1000)
    assert got == [10, 10]
    assert mixing.budgets([], 10) == ([], 1.0) and mixing.budgets([s("a", 1.0, 1, 0)], 0)[0] == [0]


def test_exponents():
    def s(name, share, most, n):
        return mixing.Source(name, share, most, n, 10)

    # a's limit stops the exponent of the whole mix where a gives all it has; b and c then meet their shares of the rest
    sources = [s("a", 0.5, 1, 100), s("b", 0.25, 1, 800), s("c", 0.25, 1, 600)]
    got, stopped = mixing.allocated(sources, 1000)
    e = mixing.mix_exponent(sources, 1000)
    assert 0 < e < 1 and stopped == [pytest.approx(e), None, None]
    w = mixing.weights([100.0, 800.0, 600.0], [0.5, 0.25, 0.25], e)
    assert w[0] * 1000 == pytest.approx(100, rel=1e-6) and got == [100, pytest.approx(450), pytest.approx(450)]
    # two limits, one after the other
    got, stopped = mixing.allocated([s("a", 0.6, 1, 100), s("b", 0.3, 1, 350), s("c", 0.1, 2, 2000)], 1000)
    assert got == [100, 350, pytest.approx(550)] and 0 < stopped[0] < stopped[1] < 1 and stopped[2] is None
    # a source with more than the natural mix takes, which only its own target holds within its limit
    got, stopped = mixing.allocated([s("a", 0.1, 1, 900), s("b", 0.9, 3, 400)], 1300)
    assert got == [pytest.approx(130), pytest.approx(1170)] and stopped == [None, None]


def test_passes_are_different_permutations(spark):
    df = docs(spark, [10] * 400, "a").union(docs(spark, [10] * 2000, "b").withColumn("doc_id", F.col("doc_id") + 1000))
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, share double, max_repeats int")
    mix, report = mixing.mix(df, t)
    passes = {}
    for r in mix.where("source = 'a'").orderBy("place").collect():
        passes.setdefault(r["copy_no"], []).append(r["doc_id"])
    assert sorted(passes) == [1, 2, 3] and sorted(passes[1]) == sorted(passes[2]) == list(range(400))
    for a, b in ((1, 2), (1, 3), (2, 3)):
        n = len(passes[b])
        assert passes[a][:n] != passes[b]
        after = {x: y for x, y in zip(passes[a], passes[a][1:])}
        # neighbours of one pass are seldom neighbours of another, within blocks as well
        assert sum(after.get(x) == y for x, y in zip(passes[b], passes[b][1:])) < n / 5
    rep = {r["source"]: r for r in report.collect()}
    assert rep["a"]["mixed_tokens"] == rep["b"]["mixed_tokens"] and rep["a"]["exponent"] == 1.0


def test_mix(spark):
    df = docs(spark, [40] * 300, "A-a").union(docs(spark, [30] * 200, " a_A").withColumn("doc_id", F.col("doc_id") + 1000)).union(
        docs(spark, [20] * 50, "b").withColumn("doc_id", F.col("doc_id") + 2000)
    ).union(docs(spark, [None, 0, 3000], "other").withColumn("doc_id", F.col("doc_id") + 3000)).union(docs(spark, [5], None))
    t = spark.createDataFrame([("a_a", 0.7, 2), ("b", 0.25, 3), ("none", 0.05, 3)], "source string, share double, max_repeats int")
    mix, report = mixing.mix(df, t)
    rows, rep = mix.collect(), {r["source"]: r for r in report.collect()}
    assert {k for k, r in rep.items() if r["short"]} == {"b", "none"}
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(v for k, v in times.items() if k >= 2000) == 3 and max(times.values()) <= 3 and all(v <= 2 for k, v in times.items() if k < 2000)
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert rep["b"]["mixed_tokens"] == 3 * rep["b"]["tokens"] and rep["none"]["mixed_tokens"] == 0
    assert abs(rep["a_a"]["mixed_tokens"] - rep["a_a"]["budget"]) < 100
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    # any stretch of the mix has about the shares of the whole
    rows.sort(key=lambda r: r["place"])
    half = rows[: len(rows) // 2]
    share = sum(r["n_tokens"] for r in half if r["source"] == "b") / sum(r["n_tokens"] for r in half)
    assert share == pytest.approx(rep["b"]["actual_share"], abs=0.03)
    empty, rep = mixing.mix(df.where("false"), t)
    assert empty.count() == 0 and rep.count() == 3
