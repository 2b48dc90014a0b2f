"""Free values and their canonical entries."""

import pytest

from talliflow.llm import canonical as c
from talliflow.schemas import TARGETS

CATEGORIES = [(n, None) for n in ("Almacen_Verduleria", "Bares_Delivery", "Casa_Veterinaria", "Cursos_Libros", "Obsequios_Varios", "Techo_Facturas")]
CURRENCIES = [("ARS", "peso argentino"), ("USD", "dólar estadounidense"), ("EUR", "euro")]


@pytest.mark.parametrize(
    "value, wanted",
    [
        ("almacén y verdulería", "Almacen_Verduleria"), ("Verduleria_Almacen!", "Almacen_Verduleria"), ("AlmacenVerduleria", "Almacen_Verduleria"),
        ("Almac. Verdule.", "Almacen_Verduleria"), ('"rubro almacen verduleria"', "Almacen_Verduleria"), ("vrduleria almcen", "Almacen_Verduleria"),
        ("Bares_eDlivery", "Bares_Delivery"), ("delivery", "Bares_Delivery"), ("Curso. Libr.", "Cursos_Libros"), ("Csa Veterinaria", "Casa_Veterinaria"),
        ("Casa", "Casa_Veterinaria"), ("vaois obsequios", "Obsequios_Varios"), ("casa rodante", None), ("Mantenimiento del barco", None), ("Ropa_Calzado", None),
        ("???", None), ("n/d", None), ("cat:", None), ("bares y casa", None), ("Hipódromo", None),
    ],
)
def test_categories(value, wanted):
    assert c.Matcher(CATEGORIES, {}).match(value) == wanted


@pytest.mark.parametrize(
    "value, wanted",
    [
        ("A.R.S.", "ARS"), ("pesos arg", "ARS"), ("Peso Arg.", "ARS"), ("pessos", "ARS"), ("AR$", "ARS"), ("$", "ARS"), ("U$D", "USD"), ("us$", "USD"), ("dolraes", "USD"),
        ("dolares est.", "USD"), ("€", "EUR"), ("auros", "EUR"), ("Eur.", "EUR"), ("R$", None), ("GBP", None), ("francos suizos", None), ("puntos", None), ("pesos uruguayos", None),
        ("trueque", None), ("vales", None),
    ],
)
def test_currencies(value, wanted):
    assert c.Matcher(CURRENCIES, c.CURRENCY_ALIASES).match(value) == wanted


def test_shared_words_decide_nothing():
    m = c.Matcher([("Gastos_Casa", None), ("Venta_Casa", None)], {})
    assert m.match("casa") is None and m.match("venta de casa") == "Venta_Casa"


def test_edits():
    assert c.edits("abc", "acb", 2) == 1 and c.edits("abc", "xyz", 1) == 2 and c.edits("", "ab", 2) == 2 and c.similarity("casa", "csa") == 0.75


def test_table(spark):
    def t(cat, cur):
        return ("EXPENSE", 1.0, cur, cat, None, 0, None)

    rows = [
        (1, [t("delivery", "ARS"), None, t(None, " ")], "x"), (2, None, "x"), (3, [], "x"), (4, [t("Bares_Delivery", "ars"), t("x" * 100_000, None)], "x"), (4, [t("\t", "€")], "x"),
    ]
    p = spark.createDataFrame(rows, f"pred_id long, parsed_targets {TARGETS}, field string")
    v = spark.createDataFrame([("category", a, b) for a, b in CATEGORIES] + [("currency", a, b) for a, b in CURRENCIES] + [(None, None, None)], "field string, entry string, label string")
    got = sorted((r["pred_id"], r["target_no"], r["field"], r["canonical"]) for r in c.map_values(p, v).collect())
    assert got == [(1, 1, "category", "Bares_Delivery"), (4, 1, "currency", "ARS"), (4, 1, "currency", "EUR"), (4, 2, "category", "(unmatched)")]
    assert c.unmatched_report(c.map_values(p, v)).count() == 1
    assert c.map_values(p.where("false"), v).count() == 0
    assert {r["canonical"] for r in c.map_values(p, v.where("false")).collect()} == {"(unmatched)"}
