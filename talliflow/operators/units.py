"""Quantities recorded in different units: every amount in one currency and scale.

A multi-pattern automaton over the unit terms and the forms people give them finds units beside the numbers of a
message; longest matches win and the words around a number tell amounts from receipt numbers and dates. The
factors of the units found, of the source and of the month's exchange rate are then joined and
applied in decimal arithmetic on the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talliflow.functions.text import MARKED, PLAIN, blank
from talliflow.session import spread

_FOLD = str.maketrans(MARKED, PLAIN)
#: Ways to write a currency that no base form leads to by rule.
EXTRA_CURRENCIES = {
    "ARS": ["ars", "ar$", "a.r.s", "peso arg", "pesos arg", "peso argentino", "pesos argentinos"],
    "USD": ["u$d", "usd", "dolar estadounidense", "dolares estadounidenses", "dollars"],
    "EUR": ["eur", "euro"],
}
#: Words before a number that isn't an amount, and after one.
ID_WORDS = "ticket comprobante ref referencia recibo receipt nro nº numero number cuenta account conta invoice factura n".split()
AFTER_WORDS = "dia dias day days semana semanas week weeks mes meses month months hora horas hour hours".split()
#: More unit terms than this are taken for a wrong table; the automaton goes to every task.
MAX_TERMS = 10_000

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_LAST_WORD = re.compile(r"([^\W\d_]+|nº)[\s:.#(\"*]*\Z")
_NEXT_WORD = re.compile(r"\s+([^\W\d_]+)")


class Term(NamedTuple):
    factor: float
    currency: str | None


def forms(term: str) -> set[str]:
    """A base form, its plural, diminutive and k-for-c spellings, without accents and in lower case."""
    base = term.lower().translate(_FOLD)
    out = {base}
    if not base.isalpha() or len(base) < 3:
        return out
    if base in ("usd", "eur", "mil"):
        return out
    stem = base[:-1] if base[-1] in "aoe" else base
    end = "a" if base[-1] == "a" else "o"
    soft = stem[:-1] + "qu" if stem.endswith("c") else stem + "u" if stem.endswith("g") else stem
    small = {soft + "it" + end, soft + "it" + end + "s"}
    plural = {base + "s"} if base[-1] in "aeiou" else {base + "es", base + "s"}
    out |= plural | small
    return out | {w.replace("c", "k").replace("qu", "k") for w in out}


def aliases(terms: list[tuple[str, float, str | None]]) -> dict[str, Term]:
    """Every written form and the term it stands for."""
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} unit terms; at most {MAX_TERMS} are expected")
    out: dict[str, Term] = {}
    for term, factor, currency in terms:
        if term and term.strip():
            for form in forms(term.strip()):
                out.setdefault(form, Term(float(1 if factor is None else factor), currency))
    known = {t.currency for t in out.values() if t.currency}
    for currency, names in EXTRA_CURRENCIES.items():
        if currency in known:
            for name in names:
                out.setdefault(name, Term(1.0, currency))
    return out


def automaton(names: dict[str, Term]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name, term in names.items():
        found.add_word(name, (len(name), term))
    if names:
        found.make_automaton()
    return found


def parse_number(text: str) -> float:
    """The value of digits with points and commas: the last kind of two kinds is the decimal mark, a single mark is one
    if it isn't followed by exactly three digits, if more than three stand before it or nothing but zeros."""
    marks = [ch for ch in text if ch in ".,"]
    if len(set(marks)) == 2:
        decimal = marks[-1]
    elif len(marks) == 1 and (len(text) - (at := text.index(marks[0])) != 4 or at > 3 or not text[:at].strip("0")):
        decimal = marks[0]
    else:
        decimal = ""
    for ch in ".,":
        if ch != decimal:
            text = text.replace(ch, "")
    return float(text.replace(decimal, ".") if decimal else text)


def _spans(found: ahocorasick.Automaton, text: str) -> list[tuple[int, int, Term]]:
    """Longest non-overlapping unit terms that stand as words of their own (a number may touch them)."""
    hits = []
    for end, (length, term) in found.iter(text):
        start, stop = end - length + 1, end + 1
        if text[start].isalpha() and start and text[start - 1].isalpha():
            continue
        if text[stop - 1].isalnum() and stop < len(text) and text[stop].isalnum():
            continue
        hits.append((start, stop, term))
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    taken: list[tuple[int, int, Term]] = []
    for hit in hits:
        if all(hit[1] <= t[0] or hit[0] >= t[1] for t in taken):
            taken.append(hit)
    return sorted(taken, key=lambda h: h[0])


def mentions(found: ahocorasick.Automaton, message: str) -> list[tuple[float, float, str | None]]:
    """Amounts that a message names, in order: number, factor of its scale words, currency or None."""
    text = message.lower()
    folded = text.translate(_FOLD)
    if len(folded) != len(message):  # a letter whose lower case is longer
        folded = text = folded
    spans = _spans(found, folded)
    starts = {s: (e, t) for s, e, t in spans}
    ends = {e: (s, t) for s, e, t in spans}
    used: set[int] = set()
    out = []
    for m in _NUMBER.finditer(folded):
        s, e = m.span()
        before, after = folded[s - 1 : s], folded[e : e + 1]
        if (before.isalpha() and s not in ends) or before in ("/", "#") and before or after == "/":
            continue
        if after == ":" and folded[e + 1 : e + 2].isdigit() or before == ":" and folded[s - 2 : s - 1].isdigit():
            continue
        if after == "-" and folded[e + 1 : e + 2].isdigit() or before == "-" and folded[s - 2 : s - 1].isdigit():
            continue
        factor, currency, unit = 1.0, None, False
        at = e
        for _ in range(3):  # scale word, currency word
            k = at
            while k < len(folded) and folded[k].isspace():
                k += 1
            if at != e and folded.startswith("de ", k):
                k += 3
            hit = starts.get(k)
            if hit is None:
                break
            follows = _NUMBER.match(folded, hit[0]) or folded[hit[0] : hit[0] + 1] == " " and _NUMBER.match(folded, hit[0] + 1)
            if follows and not hit[1].factor > 1 and not folded[k].isalpha():
                break  # a sign that belongs to the next number
            factor *= hit[1].factor
            currency = currency or hit[1].currency
            unit = True
            used.add(k)
            at = hit[0]
        k = s
        while k and folded[k - 1].isspace() and folded[k - 1] != "\n":
            k -= 1
        left = ends.get(k)
        if left and left[0] not in used and left[1].currency:
            currency = currency if currency and left[1].currency == "ARS" else left[1].currency
            unit = True
        if not unit:
            word = _LAST_WORD.search(folded, max(0, s - 24), s)
            if word and word.group(1) in ID_WORDS:
                continue
            nxt = _NEXT_WORD.match(folded, e)
            if nxt and (nxt.group(1) in AFTER_WORDS or nxt.group(1) == "de" and word and word.group(1) in ("el", "dia", "no", "em")):
                continue
        out.append((parse_number(m.group()), factor, currency))
    return out


_MENTIONS = T.ArrayType(T.StructType().add("number", "double").add("factor", "double").add("currency", "string"))


def amount_terms(terms: DataFrame) -> list[tuple[str, float, str | None]]:
    """The table of terms as rows; it is a fixed dimension, whose size is checked before it is collected."""
    rows = terms.select("term", "factor", "currency").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} unit terms")
    return [tuple(r) for r in rows]


def mention_column(terms: list[tuple[str, float, str | None]], message: Column) -> Column:
    """The amounts that each message names, as array of (number, factor, currency)."""
    names = aliases(terms)

    @F.pandas_udf(_MENTIONS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(names)
        for s in batches:
            yield s.map(lambda x: mentions(found, x) if x and names else [])

    return find(message)


def currency_column(terms: list[tuple[str, float, str | None]], value: Column) -> Column:
    """The currency that a free-typed value means: the longest form found in it; null if blank or not known."""
    names = {k: t for k, t in aliases(terms).items() if t.currency}

    @F.pandas_udf(T.StringType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(names)

        def one(x: str) -> str | None:
            spans = _spans(found, x.lower().translate(_FOLD)) if names else []
            return max(spans, key=lambda h: h[1] - h[0])[2].currency if spans else None

        for s in batches:
            known = {x: one(x) for x in s.dropna().unique()}
            yield s.map(known).astype(object).where(lambda v: v.notna(), None)

    return find(value)


def common_units(
    golden: DataFrame, terms: DataFrame, rates: DataFrame, sources: DataFrame, home: str = "ARS"
) -> DataFrame:
    """One row per target (a null one has no amount): its value in the home currency and how it was found.

    Columns: ``entry_id, target_no`` (from 1, null elements count), ``amount, currency, scale, factor, rate, value``
    (DECIMAL in the home currency), ``centavos``, ``differs`` (the recorded amount isn't the value) and ``reason``, why there is no value: ``amount`` (null, not a
    number or of more than 14 digits before the point), ``rate`` (none is known), ``range`` (a scale, factor or rate has more digits than its decimal
    type, or the value more than 28 before the point). Amounts count to 6 decimal places; no other digit is dropped unseen.
    Unknown sources have the scale 1. The joins are on fixed dimensions, which Spark broadcasts by their
    size; texts cross to Python once per entry.
    """
    rows = amount_terms(terms)
    dims = sources.groupBy("source").agg(F.max("amount_scale").alias("scale"))
    fx = rates.groupBy("rate_month", "currency").agg(F.max("ars_per_unit").alias("rate"))
    entries = spread(
        golden.select(
            "entry_id",
            "input",
            "conversation_date",
            # of the targets the scan reads these two fields only
            F.arrays_zip("targets.amount", "targets.currency").alias("targets"),
            F.col("metadata.source").alias("source"),
        ).where(F.size("targets") > 0)
    )
    entries = entries.join(dims, "source", "left").withColumn("mentions", mention_column(rows, F.col("input")))
    flat = entries.select(
        "entry_id",
        "conversation_date",
        F.coalesce("scale", F.lit(1.0)).alias("scale"),
        "mentions",
        F.size("targets").alias("n"),
        F.posexplode("targets").alias("pos", "target"),
    )
    number = F.col("target.amount")
    place = F.when(F.size("mentions") == F.col("n"), F.get("mentions", F.col("pos")))
    # where the counts differ, the mention that has this very number, else the one in this place
    same = F.filter("mentions", lambda m: (m["number"] == number) | (m["number"] * m["factor"] == number))
    mention = F.coalesce(place, F.get(same, F.lit(0)), F.get("mentions", F.col("pos")))
    flat = flat.select(
        "entry_id",
        (F.col("pos") + 1).alias("target_no"),
        "conversation_date",
        "scale",
        number.alias("amount"),
        F.col("target.currency").alias("recorded"),
        mention.alias("m"),
    )
    scaled = F.col("scale") != 1
    spoken = ~scaled & (F.col("m.factor") != 1) & (F.abs(F.col("m.number") - F.col("amount")) <= 1e-9 * F.abs(F.col("amount")))
    flat = flat.withColumn("factor", F.when(spoken, F.col("m.factor")).otherwise(F.lit(1.0))).withColumn(
        "currency", F.coalesce(currency_column(rows, F.when(~blank(F.col("recorded")), F.col("recorded"))), "m.currency", F.lit(home))
    )
    flat = flat.withColumn("rate_month", F.substring("conversation_date", 1, 7))
    joined = flat.join(fx, ["rate_month", "currency"], "left")
    exact = F.col("amount").try_cast("decimal(20,6)")

    def fitted(c: Column, kind: str) -> Column:
        """A decimal that is the number; null if that has more digits."""
        d = c.try_cast(kind)
        return F.when(d.cast("double") == c.cast("double"), d)

    rate = F.when(F.col("currency") == home, F.lit(1.0)).otherwise(F.col("rate"))
    joined = joined.select(
        "entry_id", "target_no", "amount", "currency", "scale", "factor", rate.alias("rate"), exact.alias("_a"),
        fitted(F.col("scale"), "decimal(12,6)").alias("_s"), fitted(F.col("factor"), "decimal(16,4)").alias("_f"), fitted(rate, "decimal(16,8)").alias("_r"),
    )
    own = F.try_multiply(F.try_multiply("_a", "_s"), F.col("_f")).try_cast("decimal(28,9)")
    joined = joined.withColumn("value", F.try_multiply(own, F.col("_r")))
    reason = F.when(F.col("value").isNotNull(), None).when(F.col("_a").isNull(), "amount").when(F.col("rate").isNull(), "rate").otherwise("range")
    return joined.select(
        "entry_id",
        "target_no",
        "amount",
        "currency",
        "scale",
        "factor",
        F.col("_r").alias("rate"),
        "value",
        F.round(F.col("value") * 100, 0).try_cast("bigint").alias("centavos"),
        (F.col("value") != F.col("_a")).alias("differs"),
        reason.alias("reason"),
    )
