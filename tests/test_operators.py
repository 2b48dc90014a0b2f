"""Chat parsing, checks, round trips, plans, splits, synthesis, sources, sinks and streams."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from talliflow.functions import text
from talliflow.operators import balance, chat, generation, profile, quality, ranks, roundtrip, splits, synth
from talliflow.schemas import TARGETS
from talliflow.sources import readers, sinks
from talliflow.streaming import pipelines

BOT_SAVED = "✅ *Guardado correctamente*\n📤 *Gasto*\n📝 *Descripción:* pan \n💰 *Monto:* 1.234,50 ARS\n🏷️ *Categoría:* Comida\n🗓️ *Fecha:* 01/02/25"
CHAT = (
    "preamble\n[01/02/25, 09:00:00] Ana: gasté 10\r\nen pan\n[01/02/25, 09:00:05] Bot: " + BOT_SAVED + "\n[01/02/25, 09:00:06] Bot: ✅ Confirmar ❌ Cancelar\n📥 *Ingreso*\n"
    "[02/02/25, 09:00:00] Ana: <Media omitted>\n[02/02/25, 09:00:05] Bot: ✅ Guardado correctamente 📤 *Gasto*\n"
    "[02/02/25, 10:00:00] Ana: ✅ Confirmar\n[02/02/25, 10:00:05] Bot: ❌ falló\n"
    "‎[03/02/25, 23:59:59] Ana: cobré: 5\n[04/02/25, 00:00:05] Bot: ✅ Guardado correctamente 📥 *Ingreso*\n[05/02/25, 99:00:00] Sys: x"
)


def target(type="EXPENSE", amount=10.0, currency="ARS", category="a", description="d", delta=0, expr=None):
    return (type, amount, currency, category, description, delta, expr)


def golden(spark, rows):
    return spark.createDataFrame(rows, f"entry_id long, input string, targets {TARGETS}")


def test_messages_and_conversations(spark):
    df = spark.createDataFrame([(1, CHAT), (2, None), (3, ""), (4, "no header\n" * 3), (5, "[1/2/25, 1:00:00] Bot: solo")], "doc_id int, text string")
    ms = chat.messages(df)
    rows = [tuple(r) for r in ms.where("id = 1").orderBy("msg_no").collect()]
    assert rows[0][2:] == (datetime.datetime(2025, 2, 1, 9, 0), "Ana", "gasté 10\nen pan")
    assert len(rows) == 10 and rows[-1][2] is None and rows[7][4] == "cobré: 5"
    assert {r["id"] for r in ms.collect()} == {1, 5}
    out = chat.conversations(ms, F.col("sender") == "Bot", system=["Sys"]).orderBy("msg_no").collect()
    assert [(r["input"], r["conversation_date"], len(r["outputs"])) for r in out] == [("gasté 10\nen pan", "2025-02-01", 2), ("cobré: 5", "2025-02-03", 1)]
    first = out[0]["outputs"][0]
    assert (first["type"], first["description"], first["amount"], first["currency"], first["category"]) == ("expense", "pan", 1234.5, "ARS", "Comida")
    assert out[0]["outputs"][1]["status"] == "pending_confirmation"
    days = chat.conversations(ms, F.col("sender") == "Bot", "2025-02-03", "2025-02-03").collect()
    assert [r["input"] for r in days] == ["cobré: 5"]  # the reply after midnight stays with it
    assert chat.messages(df.where("false")).count() == 0


def test_reply_kinds(spark):
    texts = [BOT_SAVED, "✅ Guardado correctamente", "❌ Error ", chat.LINKED, "hola", None, "✅ Guardado correctamente 📤 *Gasto*\n💰 *Monto:* ,., ARS"]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    got = [r[0] for r in df.select(chat.reply_details(df.c)).collect()]
    assert [g and g["type"] for g in got] == ["expense", None, "error", "account_linked", None, None, "expense"]
    assert got[2]["message"] == "❌ Error" and got[6]["amount"] is None


def test_quality_flags(spark):
    rows = [
        (None, []), ("  ", []), ('[{"a": 1}]', []), ("gasté 15 mil en pan", [target(amount=15000.0)]), ("gasté 15.000,50", [target(amount=15000.5)]),
        ("gasté algo", [target(amount=15000.0)]), ("10 usd", [target(currency="USD")]), ("10", [target(currency="USD")]), ("x" * 501, []), ("hola", None),
        ("7", [target(amount=None)]), ("8k", [target(amount=8000.0)]), ("9.000", [target(amount=9000.0)]),
    ]
    df = spark.createDataFrame(rows, f"input string, targets {TARGETS}")
    got = [(r[0]["rejected"], r[0]["warnings"]) for r in df.select(quality.text_flags(df.input, df.targets)).collect()]
    assert got == [
        ("empty", []), ("empty", []), ("json", []), (None, []), (None, []), (None, ["amount"]), (None, []), (None, ["currency"]), (None, ["long"]), (None, []),
        (None, []), (None, []), (None, []),
    ]


def test_schema_errors(spark):
    full = dict.fromkeys(quality.TARGET_KEYS) | {"type": "INCOME"}
    entry = {"input": "x", "targets": [full], "metadata": {"source": "s", "num_transactions": 1}, "conversation_date": "d"}
    cases = [
        (json.dumps(entry), []),
        (json.dumps({"input": 1}), ["missing conversation_date", "missing metadata", "missing targets"]),
        (json.dumps(entry | {"targets": [{"type": "x"}], "metadata": {}}), ["metadata missing num_transactions", "metadata missing source", "target 0 invalid type"]
         + [f"target 0 missing {k}" for k in sorted(quality.TARGET_KEYS[1:])]),
        ("[]", ["not an object"]), ("x", ["not an object"]), (None, ["not an object"]),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "e string")
    assert [sorted(r[0]) for r in df.select(quality.schema_errors(df.e)).collect()] == [e for _, e in cases]


def test_save_requests(spark):
    kind = "array<struct<type:string,amount:string,currency:string,category:string,description:string,date_delta_days:string,date_raw_expression:string>>"
    good = ("expense", "5", "ARS", "a", "d", None, None)
    rows = [
        (None, "d", [good]), ("a", None, [good]), ("a", "d", None), ("a", "d", [("expense", None, "ARS", "a", "d", None, None)]), ("a", "d", [("e", "x", "A", "a", "d", "", "")]),
        ("a", "d", [good, ("income", "1.5", "USD", "b", "d", "", "ayer"), ("income", "1", "USD", "b", "d", "-1", "ayer"), ("income", "1", "USD", "b", "d", "", "")]), ("a", "d", []),
    ]
    df = spark.createDataFrame(rows, f"input string, conversation_date string, targets {kind}")
    got = quality.save_request(df).collect()
    assert [r["error"] for r in got] == ["missing input", "missing conversation_date", "missing targets", "missing amount", "amount is no number", None, None]
    e = got[5]["entry"]
    assert [(x["type"], x["amount"], x["date_delta_days"], x["date_raw_expression"]) for x in e["targets"]] == [
        ("EXPENSE", 5.0, 0, None), ("INCOME", 1.5, None, "ayer"), ("INCOME", 1.0, -1, "ayer"), ("INCOME", 1.0, 0, None),
    ]
    assert e["num_transactions"] == 4


def test_no_day_of_a_chat_is_left_out(spark, tmp_path):
    from talliflow.plans import reference

    old = CHAT.replace("/02/25", "/02/19")
    spark.createDataFrame([(1, CHAT), (2, old), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    days = {r["day"]: (r["n"], r["chats"]) for r in reference.chat_all_days(spark, str(tmp_path)).collect()}
    month = {"01": 3, "02": 4, "03": 1, "04": 1}
    assert days == {f"{y}-02-{k}": (n, 1) for y in (2019, 2025) for k, n in month.items()} | {None: (2, 2)}
    assert reference.chat_days(spark, str(tmp_path)).count() == 0
    bot = CHAT.replace(" Bot:", " Asistente:")
    spark.createDataFrame([(1, bot), (2, bot.replace("/02/25", "/02/19"))], "doc_id long, text string").write.parquet(f"{tmp_path}/2/documents.parquet")
    talks = reference.chat_conversations(spark, f"{tmp_path}/2").collect()
    assert {r["id"] for r in talks} == {1, 2} and {r["conversation_date"][:4] for r in talks} == {"2019", "2025"}


def test_round_trip(spark):
    a, b = target(amount=1000.0), target("INCOME", 5.0)
    cases = [
        ([a, b], [b, a], None), ([a], [], "length"), (None, [], None), ([a], None, "length"), ([a], [target(amount=1049.0)], None), ([a], [target(amount=1051.0)], "amount"),
        ([target(amount=20.0)], [target(amount=29.9)], None), ([target(amount=0.0)], [target(amount=0.2)], "amount"), ([a], [target(amount=1000.0, delta=None)], None),
        ([a], [target(amount=1000.0, delta=-1)], "date_delta"), ([a], [target(amount=1000.0, currency="usd")], "currency"), ([a], [target(amount=1000.0, category="B")], "category"),
        ([a], [target("INCOME", 1000.0)], "type"), ([target(amount=None)], [target(amount=0.0)], None),
    ]
    df = spark.createDataFrame([(i, o, e) for i, (o, e, _) in enumerate(cases)], f"i int, o {TARGETS}, e {TARGETS}")
    rows = roundtrip.validate(df, "o", "e").orderBy("i").collect()
    assert [r["reason"] for r in rows] == [c[2] for c in cases]
    assert [x["amount"] for x in rows[0]["final_targets"]] == [5.0, 1000.0] and rows[4]["final_targets"][0]["amount"] == 1049.0


def test_plan_against_a_loop(spark):
    rows = [(i, f"m{i % 37}", [target(category=c) for c in ("a", "b", "c")[: i % 4]]) for i in range(60)] + [(99, None, [target()]), (100, "z", None)]
    wanted = [("EXPENSE:a", 70), ("EXPENSE:b", 52), ("EXPENSE:c", 30), ("EXPENSE:none", 9), ("INCOME:a", 0)]
    w = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(wanted)], "ord int, target_key string, target long")
    g = golden(spark, rows)
    gaps = balance.category_gaps(g, w)
    got = [tuple(r) for r in balance.plan(g, gaps).orderBy("step", "n_variants", "input").collect()]
    count = {k: sum(f"{t[0]}:{t[3]}" == k for _, _, ts in rows for t in ts or []) for k, _ in wanted}
    used, expected = set(), []
    for k, n in sorted(wanted, key=lambda x: -max(0, x[1] - count[x[0]])):
        left = max(0, n - count[k])
        for _, text_, ts in rows:
            if left <= 0:
                break
            if text_ and text_ not in used and any(f"{t[0]}:{t[3]}" == k for t in ts or []):
                used.add(text_)
                expected.append((k, text_, min(5, left)))
                left -= min(5, left)
    assert sorted(x[1:] for x in got) == sorted(expected)
    assert balance.plan(g, gaps.where("false")).count() == 0
    per_key = balance.plan_per_key(g, gaps).groupBy("target_key").agg(F.sum("n_variants").alias("n")).collect()
    gap = {r["target_key"]: r["gap"] for r in gaps.collect()}
    assert all(r["n"] <= gap[r["target_key"]] for r in per_key)


def test_wanted_numbers_grow_with_the_table(spark, monkeypatch):
    shares = spark.createDataFrame([(1, "EXPENSE:a", 0.25), (2, "EXPENSE:b", 0.5), (3, "EXPENSE:none", 0.25)], "ord int, target_key string, share double")
    for times in (1, 10):
        g = golden(spark, [(i, f"m{i}", [target(category="b" if i % 8 == 0 else "a")]) for i in range(80 * times)])
        gaps = balance.category_gaps(g, balance.wanted_counts(g, shares))
        assert {r["target_key"]: r["gap"] for r in gaps.collect()} == {"EXPENSE:a": 0, "EXPENSE:b": 30 * times, "EXPENSE:none": 20 * times}
        monkeypatch.setattr(balance, "RANGE_ENTRIES", 7)
        rows = balance.plan_per_key(g, gaps).orderBy("rn").collect()
        assert [(r["rn"], r["input"], r["n_variants"]) for r in rows] == [(k + 1, f"m{8 * k}", 5) for k in range(6 * times)]
        assert sorted(r["input"] for r in balance.plan(g, gaps).collect()) == sorted(r["input"] for r in rows)
    # keys that are wanted but have no seed
    assert balance.plan(g, gaps.where("target_key = 'EXPENSE:none'")).count() == 0


def test_plans_are_filled_on_tables_of_any_size(spark):
    from talliflow.plans import reference

    for d in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{d}"
        if not os.path.isdir(d):
            pytest.skip("no test tables here")
        gaps = {r["target_key"]: r["gap"] for r in reference.share_gap_summary(spark, d).collect()}
        assert gaps.get("EXPENSE:Gimnasia_Canchas", 0) > 0
        assert reference.plan_seeds(spark, d).where("target_key = 'EXPENSE:Gimnasia_Canchas'").count() > 0
        assert sum(r["generated"] for r in reference.planned_variants(spark, d).collect()) > 0


def test_ranks_are_a_permutation(spark):
    df = spark.createDataFrame([("a", i) for i in range(5000)] + [("b", 1), ("b", 1), (None, 2)], "k string, i int")
    old, ranks.BUCKET_ROWS = ranks.BUCKET_ROWS, 300
    try:
        got = ranks.ranked(df, "k", ["i"], 5000).collect()
    finally:
        ranks.BUCKET_ROWS = old
    assert sorted(r["_rank"] for r in got if r["k"] == "a") == list(range(1, 5001))
    assert sorted(r["_rank"] for r in got if r["k"] == "b") == [1, 2]
    assert [r["i"] for r in sorted(got, key=lambda r: r["_rank"]) if r["k"] == "a"] != list(range(5000))


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "entry_id")
    parts = splits.split(df, "entry_id", {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 72, "validation": 15, "test": 16}
    assert splits.split(df.where("false"), "entry_id", {"a": 0.5, "b": 0.5}).count() == 0
    g = golden(spark, [(i, f"m{i}", [target()] if i % 2 else []) for i in range(10)])
    rows = splits.few_shot(g, 3).collect()
    assert len(rows) == 10 and all(len(r["examples"]) == 3 and r["entry_id"] not in [x["example_id"] for x in r["examples"]] for r in rows)
    r = g.select(splits.chatml(splits.chat_record("s", F.col("input"), F.col("targets"))).alias("x")).first()[0]
    assert r.count("<|im_start|>") == 3 and r.endswith("[]<|im_end|>")
    ex = F.array(F.struct(F.lit("q").alias("input"), F.lit("a").alias("answer")))
    turns = g.select(splits.prompt("s", ex, F.col("input")).alias("t")).first()[0]
    assert [x["role"] for x in turns] == ["system", "user", "assistant", "user"]


def test_few_shot_draws_from_all_candidates(spark):
    g = golden(spark, [(i, f"m{i}", [target()] if i % 2 else []) for i in range(1000)])
    rows = splits.few_shot(g, 3).collect()
    assert sorted(r["entry_id"] for r in rows) == list(range(1000))
    chosen = [[x["example_id"] for x in r["examples"]] for r in rows]
    assert all(len(set(c)) == 3 and r["entry_id"] not in c for r, c in zip(rows, chosen))
    assert all(x["input"] == f"m{x['example_id']}" for r in rows for x in r["examples"])
    times = {i: sum(c.count(i) for c in chosen) for i in range(1000)}
    # 6 times each on average; a candidate in none of 1,000 draws has a chance of 0.25 %
    assert sum(times[i] > 0 for i in range(1, 1000, 2)) > 480 and max(times.values()) < 25 and not any(times[i] for i in range(0, 1000, 2))
    few = {r["entry_id"]: {x["example_id"] for x in r["examples"]} for r in splits.few_shot(g.where("entry_id < 6"), 3).collect()}
    assert few == {i: {1, 3, 5} - {i} for i in range(6)}
    assert [r["examples"] for r in splits.few_shot(g.where("entry_id = 0"), 3).collect()] == [[]]


def test_random_intents(spark):
    cats = spark.createDataFrame([("expense", c, "") for c in "abc"] + [("income", "z", "")], "kind string, name string, description string")
    rows = synth.intents(spark.range(4000), "id", cats, "2026-01-31").collect()
    n = len(rows)
    assert 0.68 < sum(r["type"] == "EXPENSE" for r in rows) / n < 0.78 and {r["category"] for r in rows} == set("abcz")
    assert all(50 <= r["amount"] <= 5_000_000 for r in rows) and 0.75 < sum(r["currency"] == "ARS" for r in rows) / n < 0.85
    assert all(r["date_raw_expression"] for r in rows if r["date_delta_days"] is None)
    assert all(r["amount"] == int(r["amount"]) for r in rows if r["tone"] == "SLANG_CHAOTIC") is False
    assert rows == synth.intents(spark.range(4000), "id", cats, "2026-01-31").collect()


def test_forward_generation(spark):
    cats = spark.createDataFrame([("expense", c, "") for c in ("Bar_Uno", "Casa")] + [("income", "Sueldo", "")], "kind string, name string, description string")
    terms = [("luca", 1000.0, None), ("usd", 1.0, "USD")]
    made = generation.forward(synth.intents(spark.range(1500), "id", cats, "2026-01-31"), terms)
    rows = made.collect()
    assert len(rows) == 1500 and [r["text"] for r in rows if r["reason"]] == []
    for r in rows[:200]:
        key = [(t["type"], t["amount"], t["currency"], t["category"], t["date_delta_days"], t["date_raw_expression"]) for t in r["original"]]
        assert key == [(t["type"], pytest.approx(t["amount"]), t["currency"], t["category"], t["date_delta_days"], t["date_raw_expression"]) for t in r["extracted"]]
    y = generation.yields(made, "tone").collect()
    assert sum(r["attempts"] for r in y) == 1500 and all(r["yield_pct"] == 100.0 for r in y)
    # texts that lose an item or an amount are found out
    broken = generation.read_back(generation.render(generation.intent_lists(synth.intents(spark.range(50), "id", cats, "2026-01-31"))).withColumn("text", F.lit("gasté 1 en Bar_Uno")), terms)
    reasons = {r["reason"] for r in roundtrip.validate(broken, "original", "extracted").collect()}
    assert reasons <= {"length", "amount", "type"} and reasons

    def model(batches):
        for b in batches:
            yield b.assign(answer=b["text"].str.upper())[["id", "answer"]]

    assert generation.with_model(made.select("id", "text"), model, "id long, answer string").count() == 1500


def test_reverse_generation(spark):
    g = golden(spark, [(1, "gasté 5 en pan", [target(amount=5.0)]), (2, "gasté 5 en pan", []), (3, "{json", [target(category="b")])])
    plan = spark.createDataFrame([("EXPENSE:a", "gasté 5 en pan", 5), ("EXPENSE:b", "{json", 1)], "target_key string, input string, n_variants int")
    made = generation.variants(plan, g)
    rows = [r for r in made.collect() if r["target_key"] == "EXPENSE:a"]
    assert len(rows) == 5 and len({r["text"] for r in rows}) == 5 and all("gasté 5 en pan" in r["text"] and len(r["targets"]) == 1 for r in rows)
    entries = generation.entries_of(made, "reverse", "2026-01-01").collect()
    assert len(entries) >= 5 and entries[0]["metadata"]["num_transactions"] == 1


def test_dry_run_of_a_plan(spark):
    g = golden(spark, [(1, "x" * 70, [target(), target("INCOME", category="b")]), (2, "x" * 70, []), (3, "hola", []), (4, "qué", None)])
    plan = spark.createDataFrame([("x" * 70, 5), ("hola", 2), ("qué", 1)], "input string, n_variants int")
    rows = {(r["key"], r["start"], r["n_variants"]) for r in balance.dry_run(plan, g).collect()}
    assert rows == {("EXPENSE:a", "x" * 60, 5), ("N/A:non-tx", "hola", 2), ("N/A:non-tx", "qué", 1)}


def test_messages_without_a_transaction(spark):
    made = generation.non_transactional(spark.range(500).withColumnRenamed("id", "entry_id"))
    rows = made.collect()
    assert len(rows) == 500 and len({r["text"] for r in rows}) > 50
    assert all(r["text"] and not any(c.isdigit() for c in r["text"]) and r["targets"] == [] and r["rejected"] is None and r["warnings"] == [] for r in rows)
    entries = generation.entries_of(made, "reverse", "2026-01-01").collect()
    assert len(entries) == 500 and all(r["metadata"]["num_transactions"] == 0 for r in entries)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    f = tmp_path / "g.jsonl"
    f.write_text("".join(json.dumps({"input": f"m{i % 50}", "conversation_date": str(i)}) + "\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert readers.lines_in_order(spark, str(f)).rdd.getNumPartitions() > 10
        rows = readers.golden_map(spark, str(f)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert {r["input"]: r["conversation_date"] for r in rows} == {f"m{i % 50}": str(i) for i in range(1950, 2000)}


def test_profile_edges(spark):
    g = golden(spark, [(1, "a", [target(amount=1.0), target(amount=2.0), target(amount=3.0), target(amount=4.0), None]), (2, "a", None), (3, None, []), (4, "x" * 600, [target(amount=5e6)])])
    (s,) = profile.amount_statistics(g.where("entry_id < 4")).collect()
    assert (s["low"], s["high"], s["mean"], s["upper_median"], s["n"]) == (1.0, 4.0, 2.5, 3.0, 4)
    assert sorted(r["entry_id"] for r in profile.clean_corpus(g).collect()) == [1, 3]
    (p,) = profile.type_percentages(g.where("false")).collect()
    assert (p["targets"], p["expense_pct"]) == (0, 0.0)
    assert {r["n_targets"]: r["n"] for r in profile.targets_per_entry(g).collect()} == {5: 1, 0: 2, 1: 1}


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "g.jsonl"
    lines = [
        {"input": "a", "conversation_date": "2025-01-01", "targets": [{"type": "EXPENSE", "amount": 1}], "metadata": {"source": "s"}},
        {"input": "b", "target": {"type": "INCOME", "amount": 2}},
        {"input": "a", "targets": []},
    ]
    f.write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    g = {r["input"]: r for r in readers.golden(spark, str(f)).collect()}
    assert g["b"]["targets"][0]["amount"] == 2.0 and readers.golden(spark, str(tmp_path / "none")).count() == 0
    rows, counts = readers.usable_lines(spark, str(f))
    assert rows.count() == 2 and tuple(counts.first()) == (4, 2)
    with pytest.raises(Exception):
        readers.golden_map(spark, str(f)).collect()
    f.write_text("\n".join(map(json.dumps, lines)))
    assert {r["input"]: len(r["targets"] or []) for r in readers.golden_map(spark, str(f)).collect()} == {"a": 0, "b": 0}
    (tmp_path / "c.json").write_text(json.dumps({"expense": [{"name": "x"}], "income": [{"name": "x"}, {"name": "y"}]}, indent=1))
    assert sorted(tuple(r)[:2] for r in readers.categories(spark, str(tmp_path / "c.json")).collect()) == [("expense", "x"), ("income", "x"), ("income", "y")]
    (tmp_path / "t.json").write_text(json.dumps({"metadata": {}, "conversations": [{"input": "q", "outputs": [{"amount": 1}]}]}))
    assert readers.tentative(spark, str(tmp_path / "t.json")).first()["outputs"][0]["amount"] == 1.0
    (tmp_path / "chat.txt").write_text(CHAT)
    assert readers.chat_export(spark, str(tmp_path / "chat.txt"), "Bot").count() == 2
    df = spark.createDataFrame([(1, True, 0.5), (2, False, 0.9), (3, None, 0.1)], "i int, ok boolean, score double")
    for _ in range(2):
        sinks.split_sink(df, "ok", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "good")).count() == 2 and spark.read.json(str(tmp_path / "bad")).count() == 4
    assert sinks.failures(df, str(tmp_path / "fail")) and not sinks.failures(df.where("i = 2"), str(tmp_path / "fail2"))
    sinks.envelope(df, str(tmp_path / "env"), "chat.txt", {"start": "x"}, "now")
    assert spark.read.json(str(tmp_path / "env" / "metadata")).first()["total_conversations"] == 3
    assert sinks.report_name("a/b", "1") == "results_a_b_1"
    d = spark.createDataFrame([(1, 3), (1, 0)], "n int, d int")
    assert [r[0] for r in d.select(sinks.percent("n", "d")).collect()] == ["33.3%", "N/A"]
    rep = spark.createDataFrame([("m", 0.5, 0.5, 0.5, 0.5)], "model string, f1_score double, precision double, recall double, entity_accuracy double")
    assert [r[0] for r in sinks.comparison(rep).collect()][2] == "| m | 0.5000 | 0.5000 | 0.5000 | 0.5000 |"


def test_streams(spark, tmp_path):
    base = tmp_path / "d"
    rows = [(f"m{i % 7}", [1] * (i % 3), datetime.datetime(2025, 1, 1 + i % 5)) for i in range(40)] + [(None, None, datetime.datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "input string, outputs array<int>, ingested_at timestamp")
    df.repartition(4).write.parquet(str(base / "t.parquet"))
    first = pipelines.run_once(pipelines.first_messages(pipelines.table_stream(spark, str(base), "t", files=1)), "first")
    assert sorted(r[0] for r in first.collect()) == [f"m{i}" for i in range(7)]
    daily = pipelines.run_once(pipelines.daily_counts(pipelines.table_stream(spark, str(base), "t")), "daily", "complete")
    assert sum(r["conversations"] for r in daily.collect()) == 41
    q = pipelines.validated(pipelines.table_stream(spark, str(base), "t").withColumn("ok", F.col("input") == "m1"), "ok", str(base / "g"), str(base / "b"), str(base / "s"), 0)
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(base / "g")).count() == 6 and spark.read.json(str(base / "b")).count() == 35


def test_text_functions(spark):
    df = spark.createDataFrame([("  Á - b\t", "1.234,50", "```json\n[]\n```"), (None, "x", "a")], "a string, n string, f string")
    r = df.select(text.loose_key(df.a), text.latin_number(df.n), text.unfence(df.f), text.plain(df.a), text.blank(df.a)).collect()
    assert tuple(r[0])[:3] == ("á_b", 1234.5, "[]") and tuple(r[1]) == (None, None, "a", None, True)


def test_targeted_intents(spark):
    cats = spark.createDataFrame([("expense", "A"), ("expense", "B"), ("expense", "C"), ("income", "A"), ("income", "D")], "kind string, name string")
    ids = spark.range(4000)
    rows = synth.intents(ids, "id", cats, "2026-01-31", targeted=True, boosted=("A",)).collect()
    expenses = [r for r in rows if r["type"] == "EXPENSE"]
    assert abs(len(expenses) / len(rows) - 0.9) < 0.03
    assert abs(sum(r["category"] == "A" for r in expenses) / len(expenses) - 5 / 7) < 0.03
    incomes = [r for r in rows if r["type"] == "INCOME"]
    assert abs(sum(r["category"] == "A" for r in incomes) / len(incomes) - 1 / 2) < 0.08
    assert all(r["date_delta_days"] != 0 for r in rows) and abs(sum(r["date_delta_days"] == -1 for r in rows) / len(rows) - 0.2) < 0.03
    first = {r["id"]: r["length"] for r in rows}
    assert abs(sum(x == "SHORT" for x in first.values()) / len(first) - 0.7) < 0.03 and abs(sum(x == "LONG" for x in first.values()) / len(first) - 0.1) < 0.03


def test_upper_median_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(profile, "MEDIAN_ROWS", 5)
    monkeypatch.setattr(profile, "MEDIAN_RANGES", 4)
    monkeypatch.setattr(profile, "MEDIAN_MARGIN", 0.4)
    rng = random.Random(3)
    groups = {"even": [float(i) for i in range(1000)], "odd": [rng.random() for _ in range(777)], "ties": [1.0] * 500 + [2.0] * 500, "one": [7.0]}
    groups |= {"skew": [10.0 ** rng.randint(-300, 300) * rng.choice([1, -1]) for _ in range(900)], None: [rng.gauss(0, 1) for _ in range(901)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None)]
    got = {r["g"]: r["upper_median"] for r in profile.upper_median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}
