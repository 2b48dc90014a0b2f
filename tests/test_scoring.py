"""Scores: invariants and a brute-force version of the greedy matching."""

import json
from difflib import SequenceMatcher

import duckdb
import pytest

from talliflow.functions import udfs
from talliflow.functions.text import exact_round, scaled_round
from talliflow.operators import scoring
from talliflow.plans import catalogue
from talliflow.schemas import TARGETS


def t(type="EXPENSE", amount=100.0, currency="ARS", category="Food", delta=0, expr=None, description="d"):
    return {"type": type, "amount": amount, "currency": currency, "category": category, "description": description, "date_delta_days": delta, "date_raw_expression": expr}


def score(p, e):
    def n(x, up=True):
        x = (x or "").strip()
        return x.upper() if up else x.lower()

    d = float(p["date_delta_days"] == e["date_delta_days"])
    a, b = p["date_raw_expression"], e["date_raw_expression"]
    if a is None and b is None:
        x = 1.0
    elif a is None or b is None:
        x = 0.0
    else:
        a, b = a.strip().lower(), b.strip().lower()
        x = 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
    flags = (p["amount"] != e["amount"], n(p["currency"]) != n(e["currency"]), n(p["type"]) != n(e["type"]), n(p["category"], False) != n(e["category"], False), d < 1, x < 1)
    s = 0.35 * (not flags[0]) + 0.15 * (not flags[1]) + 0.15 * (not flags[2]) + 0.15 * (not flags[3]) + 0.2 * round(0.7 * d + 0.3 * x, 4)
    return s, flags


def greedy(P, E, least):
    used, total, rows = set(), 0.0, []
    for p in P:
        best, at = least, -1
        for i, e in enumerate(E):
            s, _ = score(p, e)
            if i not in used and s > best + 1e-12:
                best, at = s, i
        if at >= 0:
            used.add(at)
            total += best
            rows.append(score(p, E[at])[1])
    return total, rows


def by_hand(P, E):
    P, E = ([x or dict.fromkeys(t()) for x in xs or []] for xs in (P, E))
    if not P and not E:
        return 1.0, []
    if not P or not E:
        return 0.0, []
    return greedy(P, E, 0.0)[0] / max(len(P), len(E)), greedy(P, E, -1.0)[1]


CASES = [
    ([t()], [t()]),
    ([], []),
    (None, [t()]),
    ([t()], None),
    ([t(amount=1.0)], [t()]),
    ([t(type="INCOME", amount=1.0, currency="USD", category="x", delta=5, expr="ayer")], [t()]),  # zero score: a pair, no match
    ([t(category=" FOOD "), t(category="Bar")], [t(category="bar"), t()]),
    ([t(expr="ayer", delta=-1)], [t(expr="fue ayer", delta=-1)]),
    ([t(expr="el 4 de julio", delta=None)], [t(expr="4/7", delta=None)]),
    ([t(expr="")], [t(expr="x")]),
    ([t(expr=None)], [t(expr="x")]),
    ([t(type=None, currency=None, category=None, amount=None)], [t(type=None, currency="", category=" ", amount=None)]),
    ([t(amount=1.0), t(amount=2.0), t(amount=3.0)], [t(amount=3.0), t(amount=1.0)]),
    ([t(), t(), t()], [t(), t()]),
    ([None, t(expr="lunes")], [t(expr="el martes"), None]),
]


@pytest.fixture(scope="module")
def evaluated(spark):
    ps = [(i, "m", f"in{i}", json.dumps([p for p in P or [] if p]), P, 1.0, "clash") for i, (P, _) in enumerate(CASES)]
    p = spark.createDataFrame(ps, f"pred_id long, model string, input string, raw_response string, parsed_targets {TARGETS}, latency_seconds double, targets string")
    gs = [(i, f"in{i}", E) for i, (_, E) in enumerate(CASES)] + [(-1, "in0", [t(amount=9.0)]), (-2, None, [t()])]
    g = spark.createDataFrame(gs, f"entry_id long, input string, targets {TARGETS}")
    return scoring.evaluate_entries(p, g)


def test_greedy_against_brute_force(evaluated):
    rows = {r["pred_id"]: r for r in evaluated.collect()}
    for i, (P, E) in enumerate(CASES):
        accuracy, flags = by_hand(P, E)
        assert rows[i]["entity_accuracy"] == pytest.approx(accuracy, abs=1e-4), CASES[i]
        assert [tuple(x) for x in rows[i]["error_breakdown"]] == flags, CASES[i]
        c = rows[i]["transaction_counts"]
        assert c["true_positives"] + c["false_positives"] == c["predicted"] and c["true_positives"] + c["false_negatives"] == c["expected"]
        assert 0 <= rows[i]["category_match"] <= 1 and rows[i]["entity_accuracy"] <= 1


def test_report(evaluated):
    (r,) = scoring.report(evaluated).collect()
    n_pairs = sum(len(by_hand(P, E)[1]) for P, E in CASES)
    assert r["matched_pairs"] == n_pairs and r["total_entries"] == len(CASES)
    flags = [sum(f[k] for P, E in CASES for f in by_hand(P, E)[1]) for k in range(6)]
    assert [r[f"{k}_errors"] - r["fn"] for k in scoring.ERRORS] == flags
    (empty,) = scoring.report(evaluated.where("false")).collect()
    assert (empty["total_entries"], empty["f1_score"], empty["entity_accuracy"]) == (0, 1.0, 0.0)


def test_counts_and_categories_do_not_depend_on_order(spark):
    rows = [(P, E) for P, E in CASES if P and E]
    df = spark.createDataFrame([(P, E) for P, E in rows] + [(E, P) for P, E in rows] + [(P[::-1], E) for P, E in rows], f"p {TARGETS}, e {TARGETS}")
    keys = [scoring.transaction_keys(df[f"{c}.amount"], df[f"{c}.type"]) for c in "pe"]
    out = df.select(scoring.transaction_counts(*keys).alias("c"), scoring.category_match(df["p.category"], df["e.category"]).alias("m")).collect()
    k = len(rows)
    for a, b, c in zip(out[:k], out[k : 2 * k], out[2 * k :]):
        assert a["c"]["true_positives"] == b["c"]["true_positives"] == c["c"]["true_positives"] and a["m"] == b["m"] == c["m"]


def test_unknown_message_expects_nothing(spark):
    p = spark.createDataFrame([(1, "new", []), (2, None, [])], f"pred_id long, input string, parsed_targets {TARGETS}")
    g = spark.createDataFrame([(1, "a", [t()])], f"entry_id long, input string, targets {TARGETS}")
    assert [r["expected"] for r in scoring.matched(p, g).collect()] == [[], []]


@pytest.mark.parametrize(
    "raw, score",
    [
        (json.dumps(t()), 1.0), (json.dumps([t(), t()]), 1.0), ("[]", 1.0), ("```json\n[]\n```", 0.0), ("hola", 0.0), ("", 0.0), (None, 0.0),
        ('[{"type": "EXPENSE"}]', 0.0), (json.dumps([t()]) + " x", 0.0), ("5", 0.0), ("[5]", 0.0), ("{'a': 1}", 0.0), ("null", 0.0),
        (json.dumps(dict.fromkeys(["type", "amount", "currency", "category", "description"])), 1.0), ("[" * 100_000, 0.0),
    ],
)
def test_strict_json(raw, score):
    assert udfs.strict_score(raw) == score


def test_tolerant_parsing(spark):
    assert udfs.tolerant_targets('```json\n{"amount": "5", "type": "expense"}\n```')[0] == {
        "type": "EXPENSE", "amount": 5.0, "currency": "ARS", "category": "", "description": "", "date_delta_days": None, "date_raw_expression": None,
    }
    assert udfs.tolerant_targets("[{}, 5]") is None and len(udfs.tolerant_targets("[{}, 5]", True)) == 1
    assert udfs.tolerant_targets("x") is None and udfs.tolerant_targets("x", True) == [] and udfs.tolerant_targets(None) is None
    assert udfs.tolerant_targets('{"amount": "x"}') is None and udfs.tolerant_targets('{"type": null}') is None
    assert udfs.string_items('```\n["a", " ", 3, "b "]\n```') == ["a", "b"] and udfs.string_items("{}") == []
    assert udfs.unwrapped_objects('{"n": 1, "xs": [{"a": 1}]}') == ['{"a": 1}'] and udfs.unwrapped_objects("x") == []
    df = spark.createDataFrame([("[{}]",), (None,), ("x",)], "raw string")
    assert [None if r[0] is None else len(r[0]) for r in df.select(udfs.parse_response(df.raw)).collect()] == [1, None, None]
    assert [r[0] for r in df.select(udfs.strict_json(df.raw)).collect()] == [0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(udfs.parse_strings(df.raw)).collect()] == [[], [], []]


def test_exact_json_and_rounding(spark):
    rows = [([t(description="añ\"o", amount=1e16), None],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"ts {TARGETS}")
    assert [r[0] for r in df.select(udfs.dumps(df.ts)).collect()] == [None if x is None else json.dumps(x, ensure_ascii=False) for (x,) in rows]
    xs = [0.08875, 2.675, 0.5, -1.005, None, 0.15625, 5e-5, 5e-4, -5e-3, 4.9e-5, 0.005, 1e-9, 123456.78905]
    xs += [a / b for a in range(40) for b in range(1, 40)] + [k / 100_000 for k in range(5, 3000, 10)]
    d2 = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (2, 3, 4):
        assert [r[0] for r in d2.select(exact_round(d2.x, n)).collect()] == [None if x is None else round(x, n) for x in xs]
    d3 = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string")
    assert [r[0] for r in d3.select(udfs.seq_ratio(d3.a, d3.b)).collect()] == [0.75, None]
    assert d3.select(udfs.unwrap_objects(d3.a)).count() == 2


def test_latency(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0)] + [("b", None)], "model string, latency_seconds double")
    got = {r["model"]: (r["p50_seconds"], r["p99_seconds"]) for r in scoring.latency_percentiles(df, "model").collect()}
    assert got == {"a": (2.0, 3.96), "b": (0.0, 0.0)}


PAIRS = {f"pair{k}": [k / 1000, (k + 1) / 1000] for k in (*range(0, 4000, 7), 1881)}
SINGLE = {f"single{k}": [k / 10_000] for k in (5, 5005, 10005, 18815, 20015, 80875)}
ODD = {"none": [None], "inf": [1.0, float("inf")], "nan": [float("nan")], "large": [1e306], "less": [-0.0005, None]}


@pytest.mark.parametrize("groups", [PAIRS, SINGLE, ODD], ids=["pairs", "single", "odd"])
def test_latency_rounds_as_its_sql(spark, groups):
    rows = [(m, x) for m, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "model string, latency_seconds double")
    con = duckdb.connect()
    con.execute("create table predictions (model varchar, latency_seconds double)")
    con.executemany("insert into predictions values (?, ?)", rows)
    want = {r[0]: repr(r[1:]) for r in con.execute(catalogue.SQL["latency_percentiles"]).fetchall()}
    got = {r["model"]: repr((r["p50_seconds"], r["p99_seconds"])) for r in scoring.latency_percentiles(df, "model").collect()}
    assert got == want and got.get("pair1881", "(1.882, 1.882)") == "(1.882, 1.882)"


def test_scaled_round(spark):
    xs = [k / 10_000 for k in range(5, 30_000, 10)] + [0.00049999999999999994, -0.0005, 0.0, 2**52 + 0.5, 1e300, 1.7e308, float("-inf"), None]
    want = [r[0] for r in duckdb.execute("select round(unnest(?::double[]), 3)", [xs]).fetchall()]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.coalesce(1).select(scaled_round(df.x, 3)).collect()] == want


def test_metric(evaluated):
    rows = {r["pred_id"]: r["score"] for r in scoring.composite_metric(evaluated).collect()}
    assert rows[0] == 1.0 and rows[1] == 1.0 and rows[2] == 0.0 and 0 < rows[4] < 1


def test_answers_that_were_not_understood(spark):
    rows = [(1, [t()]), (2, []), (3, None), (4, [t(), None])]
    df = spark.createDataFrame(rows, f"id int, parsed_targets {TARGETS}")
    got = {r["id"]: r["s"] for r in df.select("id", scoring.cleaned_strict(df.parsed_targets).alias("s")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    # the same as writing and checking the text, but for the missing answer, which is written as an empty text
    again = {r["id"]: r["s"] for r in df.select("id", udfs.strict_json(udfs.dumps(df.parsed_targets)).alias("s")).collect()}
    assert again == got
