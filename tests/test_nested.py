"""Nested reports: links, numbers and variants."""

import json

from pyspark.sql import functions as F

from talliflow.operators import nested


def items(spark, *payloads):
    df = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, p in enumerate(payloads)], "report_id int, payload string, node string")
    return sorted(tuple(r)[:5] for r in nested.children(df).drop("node", "variant").collect())


def test_links_and_numbers(spark):
    got = items(
        spark,
        {"per_entry_results": [
            None,
            {"parsed_targets": [{"amount": 1}, None, {"amount": "2"}], "transaction_counts": {"predicted": "1"}, "error_breakdown": [],
             "conversation": {"outputs": [{"type": "x", "history": [None, {"status": "a"}]}, None, {"history": {"status": "b"}}]}},
        ]},
        {"entries": {"target": {"type": "EXPENSE"}, "conversation": {"output": {"history": None}}, "error_breakdown": {"amount_error": True}}},
    )
    assert got == [
        (0, 2, "counts", 0, 1),
        (0, 2, "history", 1, 2),
        (0, 2, "history", 3, 1),
        (0, 2, "output", 0, 1),
        (0, 2, "output", 0, 3),
        (0, 2, "target", 0, 1),
        (0, 2, "target", 0, 3),
        (1, 1, "error", 0, 1),
        (1, 1, "output", 0, 1),
        (1, 1, "target", 0, 1),
    ]


def test_odd_payloads(spark):
    assert items(spark, None, "", "no json", "[]", "{}", {"per_entry_results": None}, {"entries": "x"}, {"entries": [1, "a"]}) == []
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "{}")], "report_id int, payload string")
    assert sorted(r[0] for r in nested.unparsed(df).collect()) == [1, 2]
    assert nested.children(df.where("false")).count() == 0


def test_many_entries_in_one_report(spark):
    big = {"entries": [{"target": [{"amount": 1}] * 3}] * 20_000}
    assert len(items(spark, big)) == 60_000


def test_typed_tables_and_states(spark):
    p = {"entries": [{"transaction_counts": {"predicted": "2", "expected": 1, "extra": 1}, "target": [{}, 5, {k: None for k in nested.FIELDS["target"]}]}]}
    df = spark.createDataFrame([(1, json.dumps(p))], "report_id int, payload string")
    kids = nested.children(df)
    (c,) = nested.typed_table(kids, "counts").collect()
    assert (c["predicted"], c["expected"], c["true_positives"], c["shape"]) == (2, 1, None, "part+text+more")
    assert [r["shape"] for r in nested.typed_table(kids, "target").orderBy("item_no").collect()] == ["empty", "scalar", "empty"]
    (e,) = nested.entry_table(df).collect()
    assert e["shape"] == "record" and e["pred_id"] is None


MIXED = {
    "entries": [
        {
            "target": [{"amount": 1}, {"amount": "1"}, {"other": 1}, {}, 5, "x", None, [1], {"amount": None}],
            "transaction_counts": {"predicted": "1"},
            "error_breakdown": [{"amount_error": True}, {"amount_error": None}],
            "conversation": {"outputs": [{"amount": 1, "history": [None, {"status": "a"}]}, {"amount": "2", "history": [None]}, {"history": {"at": "x"}}, 7]},
        },
        {"transaction_counts": [1], "conversation": [1]},
        {"transaction_counts": 3},
        {"transaction_counts": {}},
    ]
}
STATES = {
    "target": {1: "typed", 2: "lax", 3: "bare", 4: "bare", 5: "scalar", 6: "scalar", 8: "scalar", 9: "bare"},
    "error": {1: "typed", 2: "bare"},
    "output": {1: "typed+history", 2: "lax", 3: "bare+history", 4: "scalar"},
}


def test_states_decide_items_and_tables(spark, tmp_path):
    kids = nested.children(spark.createDataFrame([(1, json.dumps(MIXED))], "report_id int, payload string"))
    got = {}
    for r in kids.collect():
        got.setdefault(r["item_kind"], {})[r["entry_no"], r["parent_no"], r["item_no"]] = r["variant"]
    for kind, states in STATES.items():
        assert got[kind] == {(1, 0, k): v for k, v in states.items()}
    assert got["counts"] == {(1, 0, 1): "lax", (4, 0, 1): "bare"}
    assert got["history"] == {(1, 1, 2): "typed", (1, 3, 1): "typed"}
    assert all(v in nested.variants(k) for k, vs in got.items() for v in vs.values())
    # the tables of all variants hold every item once, each node as it was
    nested.write_variants(kids, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == kids.count() == sum(nested.variant_table(kids, k, v).count() for k in nested.FIELDS for v in nested.variants(k))
    (lax,) = nested.variant_table(kids, "target", "lax").collect()
    assert lax["amount"] == 1.0 and json.loads(lax["raw"]) == {"amount": "1"}


def test_without_the_automaton_items_are_wrong(spark, monkeypatch):
    df = spark.createDataFrame([(1, json.dumps(MIXED))], "report_id int, payload string")
    right = sorted(tuple(r) for r in nested.children(df).drop("node", "variant").collect())
    monkeypatch.setattr(nested, "node_state", lambda *_: F.lit("typed"))
    assert sorted(tuple(r) for r in nested.children(df).drop("node", "variant").collect()) != right
