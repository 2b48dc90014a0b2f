"""Duplicates hidden by formatting: the hash kernel, the two-pointer comparison and the classes, against canonical strings."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talliflow.llm import formatting as f

ALPHABET = "aAbBñÑéÉ1290.,:;/-_ \t\n​́̃﻿ 🙂$€!¿«ßỊ̇字"


def canonical(text):
    """The canonical form written out, which the operator never does."""
    chars = [c for c in text if f.char_class(ord(c)) != f.HIDDEN]
    keep = []
    for i, c in enumerate(chars):
        kind = f.char_class(ord(c))
        inside = 0 < i < len(chars) - 1 and chars[i - 1].isdecimal() and chars[i + 1].isdecimal()
        if kind == f.KEEP or kind == f.MARK and inside:
            keep.append(c)
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", "".join(keep)).casefold())
    return "".join(c for c in out if f.char_class(ord(c)) in (f.KEEP, f.MARK))


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Gasté 10 en Bar", "gasté  10, en «bar»!", True),
        ("11.712,50", "11.71250", False),
        ("a.b", "ab", True),
        ("1 . 2", "12", True),
        ("1​.2", "1.2", True),
        ("1.2", "1,2", False),
        ("gasto", "gastó", False),
        ("hola 🙂", "hola", False),
        ("$5", "5", False),
        ("a b", "b a", False),
        ("", "  ...", True),
        ("x: 1, y: 2", "y: 2 / x: 1", True),
        ("x: 1  y: 2", "Y: 2\nX: 1", True),
        ("desde: a; hacia: b", "desde: b; hacia: a", False),
        ("hola, x: 1, y: 2", "hola, y: 2, x: 1", False),
        ("x: 1, y: 2, x: 1", "x: 1, x: 1, y: 2", True),
        ("x: 1, y:", "y: , x: 1", False),
        ("x: 12:30, y: 2", "y: 2, x: 12:30", True),
        ("*x*: 1, «y :» 2", "y: 2, x: 1", True),
        ("ab: c, d: e", "a: bc, d: e", True),  # white space and marks don't count
        ("ab: c, d: e", "d: e, a: bc", False),
        ("ẹ́", "ẹ́", True),
    ],
)
def test_pairs(a, b, same):
    assert f.same_message(a, b) is same
    l1, l2, m1, m2, labelled = f.hash_texts([a, b])
    equal = l1[0] == l1[1] and l2[0] == l2[1]
    if labelled.all():
        equal = equal or m1[0] == m1[1] and m2[0] == m2[1]
    assert equal == same


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=8))
def test_hashes_follow_the_canonical_form(texts):
    l1, l2, m1, m2, labelled = f.hash_texts(texts)
    forms = [canonical(t) for t in texts]
    for i in range(len(texts)):
        assert (f.fields(texts[i]) is not None) == labelled[i]
        for j in range(i):
            assert ((l1[i], l2[i]) == (l1[j], l2[j])) == (forms[i] == forms[j])
            assert f.same_text(texts[i], texts[j]) == (forms[i] == forms[j])


def brute(rows):
    classes = {}
    for i, t in rows:
        if t is None:
            continue
        parts = f.fields(t)
        key = canonical(t) if parts is None else tuple(sorted(canonical(t[a:b]) + ":" + canonical(t[b:e]) for a, b, e in parts))
        classes.setdefault(key, []).append(i)
    return {(min(c), x) for c in classes.values() for x in c if x != min(c)}


def dress(rng, text):
    if rng.random() < 0.3:
        text = text.upper()
    if rng.random() < 0.3:
        text = text.replace(" ", rng.choice(["  ", " ", "​ \t"]))
    if rng.random() < 0.2:
        text = unicodedata.normalize("NFD", text)
    return text + rng.choice(["", "!", "  ", "…"])


@pytest.mark.parametrize("bits, hot", [(64, None), (5, None), (64, 10)])
def test_classes_against_brute_force(spark, monkeypatch, bits, hot):
    if hot:
        monkeypatch.setattr(f, "HOT_ROWS", hot)
        monkeypatch.setattr(f, "SALT_ROWS", hot)
    rng = random.Random(bits)
    base = [f"gasté {i}.{i % 7}00 en bar Ñandú" for i in range(40)] + [f"monto: {i}, lugar: bar {i % 3}, fecha: 1/2/2025" for i in range(30)]
    rows = []
    for i in range(600):
        t = rng.choice(base) if i % 3 else base[0]  # one message holds a third of all rows
        if ", lugar" in t and rng.random() < 0.5:
            parts = t.split(", ")
            rng.shuffle(parts)
            t = rng.choice([", ", " / ", "\n"]).join(parts)
        rows.append((1000 + i, dress(rng, t), "clash"))
    rows += [(1, None, ""), (2, None, ""), (3, "", ""), (4, " . ", ""), (5, "x" * 300_000, ""), (6, "X" * 300_000 + "!", ""), (7, "unique", "")]
    df = spark.createDataFrame(rows, "conv_id long, input string, kept_id string")
    got = f.same_messages(df, "conv_id", "input", bits)
    assert {(r["kept_id"], r["id"]) for r in got.where("id <> kept_id").collect()} == brute([r[:2] for r in rows])


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "conv_id long, input string")
    return {(r["kept_id"], r["id"]) for r in f.same_messages(df, "conv_id", "input").where("id <> kept_id").collect()}


def test_links_through_every_way_to_cut_fields(spark):
    assert pairs(spark, ["a: bc d: e", "ab: c d: e", "d: e ab: c"]) == {(1, 2), (1, 3)}
    # 1 and 2 are equal as wholes, 2 and 3 as fields, 3 and 4 as wholes, 4 and 5 as fields
    assert pairs(spark, ["a: bc d: ef", "ab: c d: ef", "d: ef ab: c", "de: f ab: c", "ab: c de: f", "other: x, y: z"]) == {(1, k) for k in (2, 3, 4, 5)}


def test_texts_that_collide_under_every_base(spark):
    word = "a"
    for _ in range(11):
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    l1, l2, *_ = f.hash_texts([word, other])
    assert l1[0] == l1[1] and l2[0] == l2[1]
    texts = [word, other, word.upper(), other + "!", "hola", "Hola", word + " ", f"x: {word}, y: 1", f"y: 1, x: {other}", f"y: 1; x: {word}"]
    assert pairs(spark, texts) == {(1, 3), (1, 7), (2, 4), (5, 6), (8, 10)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 9)] + [(20, 30), (40, 30), (50, 50)] + [(100, k) for k in range(101, 300)]
    got = {r["node"]: r["root"] for r in f.components(spark.createDataFrame(edges, "a long, b long"), 1000).collect()}
    assert got == {**dict.fromkeys(range(1, 10), 1), 20: 20, 30: 20, 40: 20, 50: 50, **dict.fromkeys(range(100, 300), 100)}


def test_unlabelled_copy_joins_its_class(spark):
    rows = [(1, "x: 1, y: 2"), (2, "y: 2, x: 1"), (3, "y 2 x 1")]
    df = spark.createDataFrame(rows, "conv_id long, input string")
    assert {(r["kept_id"], r["id"]) for r in f.same_messages(df, "conv_id", "input").collect()} == {(1, 1), (1, 2), (1, 3)}


def test_collapse(spark):
    rows = [(1, "a", 5, "p"), (2, "A!", 6, "q"), (3, None, 7, "r"), (4, None, 8, "s"), (5, "b", 9, "t")]
    df = spark.createDataFrame(rows, "conv_id long, input string, kept_id long, id string")
    out = {r["conv_id"]: (r["n_copies"], r["kept_id"], r["id"]) for r in f.collapse(df, "conv_id", "input").collect()}
    assert out == {1: (2, 5, "p"), 3: (1, 7, "r"), 4: (1, 8, "s"), 5: (1, 9, "t")}
    assert f.collapse(df.where("false"), "conv_id", "input").count() == 0
