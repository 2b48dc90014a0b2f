"""Free-typed values mapped to the entries of a reference list.

A multi-pattern automaton over the entries' names and aliases finds embedded mentions; the longest non-overlapping
match wins. Values without a decisive mention go to a token-set similarity that allows typing errors and
abbreviations. Matching is a narrow stage: the list travels to the tasks, the values aren't shuffled, so a value
that fills a third of all rows costs no more than others.
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

#: More entries than this are refused, as every task holds the list.
MAX_ENTRIES = 10_000
UNMATCHED = "(unmatched)"
#: Words that say nothing about the entry.
FILLERS = set("rubro cat categoria category gasto gastos ingreso ingresos tipo moneda currency de del la el los las y e en para and of the".split())
#: Names of currencies beside the entry and the words of its label.
CURRENCY_ALIASES = {
    "ARS": ["$", "ar$", "a$", "$ar", "arp", "peso", "pesos", "mango", "mangos", "pesos ar"],
    "USD": ["u$s", "us$", "u$d", "u$", "usd$", "dolar", "dolares", "dollar", "dollars", "verde", "verdes"],
    "EUR": ["€", "euro", "euros", "eu"],
}
#: Least similarity of the words of a value on average, and of each: a clear word bears with a badly spelled one.
MEAN_SIMILARITY = 0.7
WORD_SIMILARITY = 0.4
#: The same for a value that has a single word, which has less to go by.
LONE_SIMILARITY = 0.75

_FOLD = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
_WORD = re.compile(r"[^\W_]*[$€][^\W_]*[$€]?[^\W_]*|[^\W_]+")
_DOTTED = re.compile(r"\b((?:\w\.){2,}\w?)(?!\w)")


def words(value: str) -> list[str]:
    """Lower-case words without accents; dotted initials are one word."""
    text = value.lower().translate(_FOLD)
    return _WORD.findall(_DOTTED.sub(lambda m: m.group().replace(".", ""), text))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def similarity(a: str, b: str) -> float:
    """1 for the same word, 0.9 if ``a`` abbreviates ``b``, else the share of letters that needn't change, 0 under 0.4."""
    if a == b:
        return 1.0
    if len(a) >= 3 and b.startswith(a):
        return 0.9
    n = max(len(a), len(b))
    if min(len(a), len(b)) < 3:
        return 0.0
    d = edits(a, b, n * 3 // 5)
    return 0.0 if d > n * 3 // 5 else 1 - d / n


class Entry(NamedTuple):
    name: str
    tokens: tuple[str, ...]


class Matcher:
    """The automaton and the token sets of one field's entries."""

    def __init__(self, entries: list[tuple[str, str | None]], extra: dict[str, list[str]]) -> None:
        self.entries = []
        # a word of an entry's own name says something
        self.fillers = FILLERS - {w for name, _ in entries for w in words(name) if len(w) > 2}
        phrases: dict[str, set[str]] = {}
        self.alone: dict[str, set[str]] = {}
        for name, label in entries:
            tokens = [w for w in words(name) if w not in self.fillers]
            spoken = [w for w in words(label or "") if w not in self.fillers]
            self.entries.append(Entry(name, tuple(tokens)))
            names = [tokens, tokens[::-1], spoken, ["".join(tokens)], *([words(a) for a in extra.get(name, [])])]
            for n in names:
                if n:
                    phrases.setdefault(" ".join(n), set()).add(name)
            if extra:  # names of one word: the label's words abbreviate together
                self.entries.append(Entry(name, tuple(spoken)))
                self.entries += [Entry(name, (w,)) for a in extra.get(name, []) for w in words(a) if len(w) > 3]
            for w in tokens if not extra else []:
                self.alone.setdefault(w, set()).add(name)
        self.found = ahocorasick.Automaton()
        for phrase, names in phrases.items():
            if len(names) == 1:
                self.found.add_word(f" {phrase} ", (phrase, next(iter(names))))
        for w, names in self.alone.items():
            if len(names) == 1 and f" {w} " not in self.found:
                self.found.add_word(f" {w} ", (w, next(iter(names))))
        self.ready = len(self.found) > 0
        if self.ready:
            self.found.make_automaton()

    def match(self, value: str) -> str | None:
        tokens = [w for w in words(value) if w not in self.fillers]
        if not tokens:
            return None
        return self.mention(tokens) or self.similar(tokens)

    def mention(self, tokens: list[str]) -> str | None:
        """The longest mention, if it has several words or nothing but words of its entry stands beside it."""
        if not self.ready:
            return None
        text = " ".join(["", *tokens, ""])
        hits = sorted(((len(p), end, p, n) for end, (p, n) in self.found.iter(text)), reverse=True)
        taken: list[tuple[int, int, str, str]] = []
        for size, end, phrase, name in hits:
            start = end - size - 1
            if all(end <= s or start >= e for s, e, _, _ in taken):
                taken.append((start, end, phrase, name))
        if not taken:
            return None
        best = taken[0]
        names = {n for _, _, p, n in taken if len(p.split()) == len(best[2].split())}
        covered = sum(len(p.split()) for *_, p, n in taken if n == best[3])
        if len(names) == 1 and (len(best[2].split()) > 1 and best[3] or covered == len(tokens)):
            return best[3]
        return None

    def similar(self, tokens: list[str]) -> str | None:
        """The entry whose words the tokens spell best, each token one word; None if none does or two do alike."""
        scores: dict[str, float] = {}
        for name, own in self.entries:
            left, total = list(own), 0.0
            for t in tokens:
                s, w = max(((similarity(t, w), w) for w in left), default=(0.0, ""))
                if s < WORD_SIMILARITY:
                    total = -1.0
                    break
                total += s
                left.remove(w)
            if total >= (MEAN_SIMILARITY * len(tokens) if len(tokens) > 1 else LONE_SIMILARITY):
                scores[name] = max(scores.get(name, 0.0), total / len(tokens) - 0.01 * len(left))
            if len(tokens) == 1:
                s = similarity(tokens[0], "".join(own))
                if s >= LONE_SIMILARITY and len(own) > 1:
                    scores[name] = max(scores.get(name, 0.0), s)
        best = sorted(scores.items(), key=lambda x: -x[1])[:2]
        if not best or len(best) == 2 and best[0][1] == best[1][1]:
            return None
        return best[0][0]


def reference_list(canonical: DataFrame) -> dict[str, list[tuple[str, str | None]]]:
    """The entries and labels of each field; the list is small, which is checked."""
    rows = canonical.select("field", "entry", "label").where("entry is not null").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} canonical values")
    out: dict[str, list[tuple[str, str | None]]] = {}
    for r in sorted(rows):
        out.setdefault(r["field"], []).append((r["entry"], r["label"]))
    return out


def match_column(entries: list[tuple[str, str | None]], extra: dict[str, list[str]], value: Column) -> Column:
    """The entry that each value means, ``(unmatched)`` if none, null for null."""

    @F.pandas_udf(T.StringType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(entries, extra)
        known: dict[str, str] = {}
        for s in batches:
            if len(known) > 100_000:
                known.clear()
            for x in s.dropna().unique():
                if x not in known:
                    known[x] = matcher.match(x) or UNMATCHED
            yield s.map(known).astype(object).where(lambda v: v.notna(), None)

    return find(value)


def map_values(predictions: DataFrame, canonical: DataFrame) -> DataFrame:
    """``pred_id, target_no, field, value, canonical`` for every free-typed value of the targets.

    Values that are null, blank or exactly an entry aren't free-typed. ``target_no`` counts null targets too. Rows with null or
    empty targets give nothing. A field without entries gives ``(unmatched)`` only.
    """
    lists = reference_list(canonical)
    # of the targets the scan reads these two fields only
    targets = F.arrays_zip("parsed_targets.category", "parsed_targets.currency")
    flat = predictions.select("pred_id", F.posexplode(targets).alias("p", "t")).select(
        "pred_id",
        (F.col("p") + 1).alias("target_no"),
        F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").alias("value")) for f in ("category", "currency")))),
    )
    out = None
    exact = F.lit(False)
    for f, entries in lists.items():
        exact = exact | ((F.col("field") == f) & F.col("value").isin([e for e, _ in entries]))
    free = flat.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"(?U)\A\s*\z") & ~exact)
    hit = F.lit(None).cast("string")
    for f, extra in (("category", {}), ("currency", CURRENCY_ALIASES)):
        own = F.when(F.col("field") == f, F.col("value"))
        hit = F.coalesce(hit, match_column(lists.get(f, []), extra if lists.get(f) else {}, own))
    out = free.withColumn("canonical", hit)
    return out


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """Values that no entry fits, with how often each occurs."""
    return mapped.where(F.col("canonical") == UNMATCHED).groupBy("field", "value").agg(F.count("*").alias("n"))
