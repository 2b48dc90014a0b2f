"""Unit conversion: mentions in messages and values in pesos."""

from decimal import Decimal

import pytest

from talliflow.operators import units

TERMS = [
    ("luca", 1000.0, None), ("k", 1000.0, None), ("mil", 1000.0, None), ("palo", 1e6, None), ("gamba", 100.0, None), ("mango", 1.0, "ARS"),
    ("peso", 1.0, "ARS"), ("$", 1.0, "ARS"), ("dólar", 1.0, "USD"), ("verde", 1.0, "USD"), ("usd", 1.0, "USD"), ("u$s", 1.0, "USD"), ("us$", 1.0, "USD"),
    ("euro", 1.0, "EUR"), ("eur", 1.0, "EUR"), ("€", 1.0, "EUR"),
]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("gasté 144k en bar Xo ref 21636402", [(144, 1000, None)]),
        ("7 lucas verdes y $ 4.522,50 en bar", [(7, 1000, "USD"), (4522.5, 1, "ARS")]),
        ("€344 en bar, 23 luquitas y 1,8 palitos hace 3 días", [(344, 1, "EUR"), (23, 1000, None), (1.8, 1e6, None)]),
        ("US$178,25 el 9 de agosto", [(178.25, 1, "USD")]),
        ("amount: 25,654.50 pesos - date: 06/01/2025", [(25654.5, 1, "ARS")]),
        ("3 gambitas el 21/10, cuenta Q12345", [(3, 100, None)]),
        ("40 dólares (ticket 15)", [(40, 1, "USD")]),
        ("comprobante: 26251362 - monto: 197 mil pesos", [(197, 1000, "ARS")]),
        ("10.000 mangos y 12.361 en bar", [(10000, 1, "ARS"), (12361, 1, None)]),
        ("nada por acá", []),
        ("", []),
    ],
)
def test_mentions(text, wanted):
    found = units.automaton(units.aliases(TERMS))
    assert units.mentions(found, text) == wanted


def frames(spark, golden):
    target = "struct<type:string,amount:double,currency:string,category:string,description:string,date_delta_days:int,date_raw_expression:string>"
    g = spark.createDataFrame(golden, f"entry_id long, input string, conversation_date string, targets array<{target}>, metadata struct<source:string>, scale string")
    t = spark.createDataFrame(TERMS, "term string, factor double, currency string")
    r = spark.createDataFrame([("2025-01", "USD", 1000.0), ("2025-01", "EUR", 1100.5)], "rate_month string, currency string, ars_per_unit double")
    s = spark.createDataFrame([("banco", 0.01), ("hoja", 1000.0), ("app", 1.0)], "source string, amount_scale double")
    return g, t, r, s


def target(amount, currency):
    return ("EXPENSE", amount, currency, "c", None, 0, None)


def test_values(spark):
    golden = [
        (1, "gasté 144k en bar", "2025-01-03", [target(144.0, "ARS")], ("app",), "clash"),
        (2, "gasté 144k en bar", "2025-01-03", [target(144000.0, "ARS")], ("app",), "clash"),
        (3, "10 usd y 100 mangos", "2025-01-03", [target(10.0, None), target(100.0, " ")], ("app",), None),
        (4, "100 usd", "2025-01-03", [target(10000000.0, "ARS")], ("banco",), None),
        (5, "5 lucas", "2025-01-03", [target(5.0, "Pesos arg.")], ("hoja",), None),
        (6, "€2", "2025-02-03", [target(2.0, "€")], ("app",), None),  # no rate
        (7, "€2 y 3", "2025-01-03", [None, target(2.0, None), target(None, None)], (None,), None),
        (8, None, None, [target(1e300, "USD"), target(float("nan"), "ARS"), target(0.0, "USD")], None, None),
        (9, "x", "2025-01-01", [], ("app",), None),
        (10, "x", "2025-01-01", None, ("app",), None),
        (11, "gasté 7" + " y más" * 200_000, "2025-01-01", [target(7.0, None)], ("app",), None),
        (12, "500 EUR", "2025-01-31", [target(550250.0, "ars")], ("app",), None),  # recorded in pesos
    ]
    out = units.common_units(*frames(spark, golden))
    got = {(r["entry_id"], r["target_no"]): (r["value"], r["centavos"], r["differs"]) for r in out.collect()}
    assert {k: v[1] for k, v in got.items() if v[2]} == {
        (1, 1): 14400000, (3, 1): 1000000, (4, 1): 10000000, (5, 1): 500000, (7, 2): 220100,
    }
    assert got[(2, 1)][2] is False and got[(12, 1)][2] is False and got[(11, 1)][2] is False
    assert got[(6, 1)][0] is None and got[(8, 1)][0] is None and got[(8, 2)][0] is None and got[(7, 3)][2] is None
    assert got[(3, 2)][0] == Decimal(100) and got[(7, 1)][1:] == (None, None) and len(got) == 15
    empty = [x.where("false") for x in frames(spark, golden)[1:]]
    assert units.common_units(frames(spark, golden)[0], *empty).count() == 15
    assert units.common_units(frames(spark, golden)[0].where("false"), *frames(spark, golden)[1:]).count() == 0


def test_repeated_dimension_rows_add_no_rows(spark):
    g, t, r, s = frames(spark, [(1, "10 usd", "2025-01-03", [target(10.0, None)], ("app",), None)])
    assert units.common_units(g, t.union(t), r.union(r), s.union(s)).count() == 1


@pytest.mark.parametrize(
    "text, wanted",
    [("0.125", 0.125), ("0,125", 0.125), ("00.500", 0.5), ("1.234", 1234), ("1234.567", 1234.567), ("1.234.567", 1234567), ("12,5", 12.5), ("1.234,567", 1234.567), ("7", 7)],
)
def test_numbers(text, wanted):
    assert units.parse_number(text) == wanted


def test_small_and_large_factors_and_rates(spark):
    golden = [(i, m, "2025-01-03", [target(a, c)], ("app",), None) for i, (m, a, c) in enumerate([
        ("3 medias", 3.0, None), ("1000 rial", 1000.0, "rial"), ("2 gogols", 2.0, None), ("2 raras", 2.0, None), ("1e12 usd", 1e12, "usd"), ("1 xyz", 1.0, "xyz"),
    ])]
    g, t, r, s = frames(spark, golden)
    more = [("media", 0.5, None), ("rial", 1.0, "IRR"), ("gogol", 1e100, None), ("rara", 1.00001, None), ("xyz", 1.0, "XYZ")]
    t = t.union(spark.createDataFrame(more, t.schema))
    r = r.union(spark.createDataFrame([("2025-01", "IRR", 0.00004)], r.schema))
    got = {x["entry_id"]: (x["value"], x["reason"]) for x in units.common_units(g, t, r, s).collect()}
    assert got == {0: (Decimal("1.5"), None), 1: (Decimal("0.04"), None), 2: (None, "range"), 3: (None, "range"), 4: (Decimal(10) ** 15, None), 5: (None, "rate")}
