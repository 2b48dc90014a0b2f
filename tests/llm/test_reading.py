"""Reading levels: sentences, held-out accuracy, edges."""

import random

import numpy as np
import pytest

from talliflow.llm import reading

EASY = ["Mi tía pagó el pan", "El chico vio un gato", "Mamá fue al bar hoy"]
PLAIN = ["La familia revisa los gastos del hogar cuando llega fin de mes", "El equipo de ayuda corrige la categoría del registro antes de una compra grande"]
HARD = ["La heterogeneidad terminológica condiciona significativamente la comparabilidad longitudinal", "El procedimiento de normalización presupuestaria intertemporal presupone criterios metodológicos"]


def text(rng, level, n=None):
    pool = {1: EASY, 2: PLAIN, 3: HARD}[level]
    return " ".join(rng.choice(pool) + rng.choice(".!?") for _ in range(n or rng.randint(1, 12)))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    docs = [(i, text(rng, i % 3 + 1), "x") for i in range(300)]
    docs += [(900, None, ""), (901, "  \n", ""), (902, "—!", ""), (903, text(rng, 3, 4000), ""), (904, "[01/02/25, 10:00:00] Ana: " + HARD[0], "")]
    labels = [(i, i % 3 + 1 if rng.random() > 0.08 else 1, "r") for i in range(150)] + [(0, 1, "s"), (900, 3, "r"), (None, 2, "r"), (5, None, "r"), (7777, 2, "r")]
    return spark.createDataFrame(docs, "doc_id long, text string, level string"), spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")


def test_held_out_accuracy(tables):
    rows = {r["doc_id"]: r for r in reading.reading_levels(*tables).collect()}
    held = [i for i in range(150, 300)]
    assert sum(rows[i]["level"] == i % 3 + 1 for i in held) / len(held) > 0.97
    assert all(rows[i]["level"] is None and rows[i]["difficulty"] is None for i in (900, 901, 902))
    assert rows[903]["level"] == 3 and rows[903]["n_sentences"] == 4000 and rows[904]["level"] == 3
    assert rows[2]["difficulty"] > rows[1]["difficulty"] > rows[0]["difficulty"]


def test_edges(tables):
    docs, labels = tables
    assert {r["level"] for r in reading.reading_levels(docs, labels.where("false")).collect()} == {None}
    assert reading.reading_levels(docs.where("false"), labels).count() == 0
    one = reading.reading_levels(docs, labels.where("reading_level = 3"))
    assert {r["level"] for r in one.collect()} == {3, None}
    assert reading.reading_levels(docs.union(docs), labels, most=20).count() == 2 * docs.count()


def test_sentences():
    assert reading.sentences("[01/02/25, 10:00:00] Ana: Hola. ¿Qué tal?\r\n\n- uno\n* dos 1.500,50 pesos!") == ["Hola.", "¿Qué tal?", "uno", "dos 1.500,50 pesos!"]
    assert reading.sentences("") == [] and reading.sentences("...") == []


def test_means_are_those_of_the_features():
    texts = ["Hola mundo, gasté 1.500 pesos", "a", "", "x", "12", "ñandú_y 7b ½ İstanbul", "  ", "字 word" * 50]
    codes = reading.Codes.of(texts)
    w = np.random.default_rng(0).random((reading.DIM, 3))
    assert np.allclose(reading.char_means(w, codes), reading._means(w, reading.char_features(codes)))
    assert np.allclose(reading.word_means(w, codes), reading._means(w, reading.word_features(codes)))
    f = reading.word_features(reading.Codes.of(["uno dos 7 uno", "dos 99"]))
    one, two = f.index[f.bounds[0] : f.bounds[1]].tolist(), f.index[f.bounds[1] : f.bounds[2]].tolist()
    # words are told apart, numbers are alike
    assert one[0] == one[3] != one[1] and one[1] == two[0] and one[2] == two[1]


def test_what_comes_to_the_driver_is_bounded(spark):
    docs = spark.createDataFrame([(1, "Una frase corta. " * 500), (2, "sinfin" * 100_000), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "r"), (2, 3, "r"), (3, 2, "r")], "doc_id long, reading_level int, rater string")
    texts, _ = reading.labelled_sample(docs, labels)
    assert [len(t) for t in texts] == [reading.FIT_SENTENCES, 1] and len(texts[1][0]) == reading.FIT_CHARS
