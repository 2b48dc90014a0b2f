"""The few Arrow UDFs whose semantics built-in functions can't match: strict JSON, tolerant parsing, text similarity, exact JSON text."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talliflow import schemas

_FIELDS = ["type", "amount", "currency", "category", "description", "date_delta_days", "date_raw_expression"]
_TARGETS = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("amount", T.DoubleType()),
            T.StructField("currency", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("date_delta_days", T.IntegerType()),
            T.StructField("date_raw_expression", T.StringType()),
        ]
    )
)


def strict_score(raw: str | None) -> float:
    """1 if a text is nothing but JSON objects (one or a list of them) with all required keys, or an empty list; else 0."""
    text = (raw or "").strip()
    if not text or "```" in text:
        return 0.0
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return 0.0
    items = [value] if isinstance(value, dict) else value
    if not isinstance(items, list):
        return 0.0
    return float(all(isinstance(x, dict) and all(k in x for k in schemas.REQUIRED_KEYS) for x in items))


def without_fence(raw: str) -> str:
    text = raw.strip()
    for head in ("```json", "```"):
        text = text.removeprefix(head)
    return text.removesuffix("```").strip()


def _text(x: Any) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def tolerant_targets(raw: str | None, skip_bad: bool = False) -> list[dict] | None:
    """Targets of an answer with defaults for missing keys, or None if it can't be understood.

    ``skip_bad`` passes over items that are no objects, keeps the case of types and gives [] for bad JSON; else one such item
    makes the whole answer None. An amount that is no number, which would break a run, counts as not understood.
    """
    nothing: list[dict] | None = [] if skip_bad else None
    if raw is None:
        return nothing
    try:
        value = json.loads(without_fence(raw))
    except (ValueError, RecursionError):
        return nothing
    out = []
    for x in value if isinstance(value, list) else [value]:
        if not isinstance(x, dict):
            if skip_bad:
                continue
            return None
        kind = x.get("type", "EXPENSE")
        try:
            amount = float(x.get("amount", 0) or 0.0)
        except (TypeError, ValueError):
            return nothing
        if not isinstance(kind, str):
            return nothing
        delta = x.get("date_delta_days")
        out.append(
            {
                "type": kind if skip_bad else kind.upper(),
                "amount": amount,
                "currency": _text(x.get("currency", "ARS")),
                "category": _text(x.get("category", "")),
                "description": _text(x.get("description", "")),
                "date_delta_days": int(delta) if isinstance(delta, (int, float)) and abs(delta) < 2**31 else None,
                "date_raw_expression": _text(x.get("date_raw_expression")),
            }
        )
    return out


def string_items(raw: str | None) -> list[str]:
    """The non-blank strings of a JSON array, fenced or not; [] for anything else."""
    try:
        value = json.loads(without_fence(raw or ""))
    except (ValueError, RecursionError):
        return []
    return [x.strip() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else []


def unwrapped_objects(raw: str | None) -> list[str]:
    """Objects of an answer as JSON texts: a list's, those of an object's first list, or the object itself."""
    try:
        value = json.loads(without_fence(raw or ""))
    except (ValueError, RecursionError):
        return []
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), [value])
    return [json.dumps(x, ensure_ascii=False) for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def json_text(targets: Any) -> str | None:
    """A target list as Python writes it: spaces after separators, nulls kept, letters as they are, whole amounts as they are stored."""
    if targets is None:
        return None
    plain = []
    for t in targets:
        if t is None:
            plain.append(None)
            continue
        row = {k: t[k] for k in _FIELDS}
        row["date_delta_days"] = None if pd.isna(row["date_delta_days"]) else int(row["date_delta_days"])
        row["amount"] = None if pd.isna(row["amount"]) else float(row["amount"])
        plain.append(row)
    return json.dumps(plain, ensure_ascii=False)


def _series(fn, kind: T.DataType, *, nulls: bool = True):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fn(x) for x in s], dtype=object) if nulls else s.map(fn, na_action="ignore")

    return run


def strict_json(raw: Column) -> Column:
    return _series(strict_score, T.DoubleType())(raw).cast("double")


def parse_response(raw: Column, skip_bad: bool = False) -> Column:
    return _series(lambda x: tolerant_targets(x, skip_bad), _TARGETS)(raw)


def parse_strings(raw: Column) -> Column:
    return _series(string_items, T.ArrayType(T.StringType()))(raw)


def unwrap_objects(raw: Column) -> Column:
    return _series(unwrapped_objects, T.ArrayType(T.StringType()))(raw)


def dumps(targets: Column) -> Column:
    return _series(json_text, T.StringType())(targets)


def seq_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts; null if either is null."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="Float64")

    return run(a, b)
