"""Defects of prompt-response pairs: rules, neighbours in text order, length limits."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talliflow.llm import defects as d

MSG = "gasté 10.500 en bar Lolo ayer"
REC = {"type": "EXPENSE", "amount": 10500.0, "currency": "ARS", "category": "Bar", "description": "Cena con débito en bar Lolo", "date_delta_days": -1, "date_raw_expression": "ayer"}
GOOD = json.dumps([REC], ensure_ascii=False)


@pytest.mark.parametrize(
    "message, raw, wanted",
    [
        (MSG, GOOD, None),
        (MSG, f"```json\n{GOOD}\n```", None),
        (MSG, "Listo, anoté un gasto de 10.500 en bar Lolo.", None),
        (MSG, "Anotado: un gasto de 10.500 en bar Lolo. No pude leer la fecha, así que usé la de hoy.", None),
        ("hola, cuenta Q123", "[]", None),
        ("hola, cuenta Q123", "Hola, decime qué gasto querés anotar y lo sumo.", None),
        (None, GOOD, None),
        (MSG, None, "empty"),
        (MSG, "", "empty"),
        (MSG, " ​\n", "empty"),
        (MSG, "``````", "empty"),
        (MSG, "```json\n```", "empty"),
        (MSG, "N/A", "empty"),
        (MSG, "sin respuesta", "empty"),
        (MSG, "(vacío)", "empty"),
        (MSG, "—", "empty"),
        (MSG, "[]", "empty"),
        (MSG, "[ ]", "empty"),
        (MSG, '""', "empty"),
        (MSG, "[null]", "empty"),
        ("hola", "[{}]", "empty"),
        (MSG, "{}", "empty"),
        (MSG, GOOD[:40], "truncated"),
        (MSG, "[", "truncated"),
        (MSG, "```json\n" + GOOD[:-1], "truncated"),
        (MSG, "Listo, anoté un gasto de 10.", "truncated"),
        (MSG, "Listo, anoté un gasto de 10.500 en ba", "truncated"),
        (MSG, "No puedo procesar datos de una pers", "truncated"),
        (MSG, "No puedo procesar datos de dinero de una persona.", "refusal"),
        (MSG, "```\nPrefiero no opinar. Consultá con un profesional.\n```", "refusal"),
        (MSG, '{"error": "Se rechaza la solicitud por contener datos personales."}', "refusal"),
        (MSG, '[{"type": null, "amount": null, "description": "Mis reglas me impiden tocar información bancaria."}]', "refusal"),
        ("I paid 5 at bar", "I'd rather not record this operation.", "refusal"),
        ("paguei 5 na loja", "Infelizmente não tenho permissão para registrar esta operação.", "refusal"),
        (MSG, MSG, "copy"),
        (MSG, MSG.upper() + "!!", "copy"),
        (MSG, f"Mensaje: {MSG}", "copy"),
        (MSG, f"{MSG}\n{MSG}", "copy"),
        (MSG, json.dumps({"message": MSG}), "copy"),
        (MSG, json.dumps([{"input": MSG}]), "copy"),
        (MSG, json.dumps(MSG), "copy"),
        ("no puedo creerlo: gasté 5", "no puedo creerlo: gasté 5", "copy"),
        (MSG, "Saved an expense of 10.500 for bar Lolo in your account.", "language"),
        (MSG, json.dumps([REC | {"description": "The weekly groceries which I paid for at bar Lolo"}]), "language"),
        ("I paid 5 at bar Lolo", GOOD, "language"),
        ("I paid 5 at bar Lolo", json.dumps([REC | {"description": 'Dinner with the card at "la casa de la abuela"'}]), None),
        ("bar Lolo 5", "Pronto, anotei uma despesa de 5 na bar Lolo.", "language"),
    ],
)
def test_rules(message, raw, wanted):
    assert d.defect(message, raw) == wanted


def rows_of(spark, rows):
    return spark.createDataFrame([(i, m, msg, raw, "clash") for i, (m, msg, raw) in enumerate(rows)], "pred_id long, model string, input string, raw_response string, defect string")


def test_shortened_versions(spark):
    rows = [("m", MSG, "Perfecto. Sumé un gasto de 10.500 en bar Lolo a tu cuenta."), ("m", MSG, "Perfecto."), ("m", MSG, None), (None, None, None), ("m", MSG, GOOD)]
    rows += [("m", MSG, f"Texto {i:04d} completo.") for i in range(500)] + [("m", MSG, "Texto 0123 completo. Y sigue.")]
    got = {r["pred_id"]: r["defect"] for r in d.find_defects(rows_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(5)] == [None, "truncated", "empty", "empty", None]
    # a whole sentence that names an amount stays a whole answer, also if another goes on
    assert got[5 + 123] is None


def test_continued_texts_against_brute_force(spark):
    texts = [w for n in range(1, 60) for w in ("a" * n, "b" * n + ".", f"{n}x", "a" * n + "\U0001f642")] + ["a" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts * 2], "prose string")
    got = {r["prose"]: r["next_char"] for r in d.continued_texts(df).collect()}
    want = {t for t in texts if any(u != t and u.startswith(t) for u in texts)}
    assert set(got) == want


def test_length_limits(spark):
    rows = [("m", f"x{i:03d}" + "y" * 20) for i in range(60)] + [("m", "z" * i) for i in range(1, 40)] + [("k", "z" * 24)] * 10
    df = spark.createDataFrame(rows, "model string, prose string")
    assert [tuple(r) for r in d.length_limits(df).collect()] == [("m", 24)]


def test_tables(spark):
    assert d.find_defects(rows_of(spark, [("m", MSG, GOOD)]).where("false")).count() == 0
    long = "palabra " * 200_000 + "fin."
    hot = [("m", MSG, "El resumen se ve desde el menú de tu cuenta.")] * 300
    got = {r["pred_id"]: r["defect"] for r in d.find_defects(rows_of(spark, [("m", long, long), ("m", MSG, long), *hot, ("m", MSG, "[" * 50_000)])).collect()}
    assert got[0] == "copy" and got[1] is None and got[302] == "truncated" and len(got) == 303


def test_what_neighbours_and_limits_find(spark):
    said = "pagué {n} en {place} {name}"
    done = "Quedó registrado un gasto de {n} para {place} {name}."
    some = [(f"{i}.{i % 9}00", ("bar", "cooperativa de luz", "club de juegos")[i % 3], f"N{'aeiou'[i % 5]}l{i}ur") for i in range(1, 60)]
    rows = [("m", said.format(n=n, place=p, name=x), done.format(n=n, place=p, name=x)) for n, p, x in some]
    rows += [("m", said.format(n=n, place=p, name=x), done.format(n=n, place=p, name=x)[: 12 + 3 * (i % 13)]) for i, (n, p, x) in enumerate(some)]
    whole, cut = range(59), range(59, 118)
    # answers of another model stop at 120 characters, some after a full stop
    rows += [("k", MSG, f"Sumé {i} gastos. " + (f"{i:03d} " * 40)[: 120 - len(f"Sumé {i} gastos. ") - 1] + ".xyz"[i % 4]) for i in range(60)]
    rows += [("k", MSG, f"Sumé {i} gastos.") for i in range(60)]
    limited = range(118, 178)
    df = rows_of(spark, rows)

    def found(**off):
        return {r["pred_id"]: r["evidence"] for r in d.find_defects(df, **off).where("defect = 'truncated'").collect()}

    both = found()
    assert set(both) == {*cut, *limited} and not set(whole) & set(both)
    assert {both[i] for i in cut} == {"neighbour"} and "limit" in {both[i] for i in limited}
    assert not set(found(neighbours=False)) & set(cut)
    assert set(limited) - set(found(limits=False)) >= set(range(118, 178, 4))


def test_same_defects_at_every_length_of_blanks(spark):
    for n in (0, 1, 61, 62, 63, 64, 70, 10_000):
        assert d.defect("hola", "[" + " " * n + "]") is None
        assert d.defect(MSG, "[" + " " * n + "]") == "empty"
        assert d.defect("hola", "{" + " " * n + "}") == "empty"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.sampled_from(["$ 3.047,25", "72 Lucas", "15 EUR", "u$s 949,50", "4k"]), st.sampled_from(["bar Lolo", "cooperativa de luz Fefulur", "club de juegos N. Ñu"]))
def test_what_is_masked_of_a_beginning_begins_what_is_masked(cut, amount, place):
    message = f"puse {amount} en {place} ayer"
    text = f"Anotado: un gasto de {amount} en {place} el día de ayer"
    part = text[: cut % len(text)]
    own = d.words_of(message)
    assert d.masked(text, own).startswith(d.masked(part, own, cut=True))
    body = json.dumps([REC | {"description": text}, REC], indent=cut % 3 or None, ensure_ascii=False)
    assert d.shape(body).startswith(d.shape(body[:cut]))


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "m", MSG, GOOD[:60]), (None, "m", MSG, GOOD), (3, "m", MSG, GOOD[:60]), (3, "m", MSG, GOOD[:60]), (4, None, None, None)]
    df = spark.createDataFrame(rows, "pred_id long, model string, input string, raw_response string")
    got = sorted(map(repr, map(tuple, d.find_defects(df).collect())))
    assert got == sorted(map(repr, [(None, "truncated", "neighbour"), (None, None, None), (3, "truncated", "neighbour"), (3, "truncated", "neighbour"), (4, "empty", None)]))
