"""Rows that fail to parse: typed loading of delimited lines with a quarantine.

From a schema of field kinds one anchored regular expression for whole rows is generated. A row that it
matches is loaded; any other row goes through incremental field-prefix patterns, built from the same
parts, which name the first broken field. All patterns use possessive loops, so they run in
constant stack on very long lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A well-quoted field of any content.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
FIELD = rf'(?:{QUOTED}|[^",]*+)'

_YEAR_DAY = (
    r"(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
    r"|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    r"|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29)"
)


def json_targets(q: str) -> str:
    """A strict JSON list of flat objects with ``type`` EXPENSE or INCOME and a number as ``amount``.

    ``q`` is how a quote is written: ``"`` in a plain text, ``""`` within a quoted field. Objects with nested
    values, repeated keys or escaped keys aren't matched; :func:`_strict_targets` decides on those.
    """
    ws = r"[ \t\n\r]*+"
    string = rf'{q}(?:[^"\\\x00-\x1f]++|\\(?:[\\/bfnrt]|{q}|u[0-9a-fA-F]{{4}}))*+{q}'
    number = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
    scalar = rf"(?:{string}|{number}|true|false|null)"
    other = rf'(?!{q}(?:type|amount){q}){q}[^"\\\x00-\x1f]*+{q}{ws}:{ws}{scalar}{ws}'
    kind = rf"{q}type{q}{ws}:{ws}{q}(?:EXPENSE|INCOME){q}{ws}"
    amount = rf"{q}amount{q}{ws}:{ws}{number}{ws}"
    more = rf"(?:,{ws}{other})*+"

    def both(a: str, b: str) -> str:
        return rf"(?:{other},{ws})*+{a}{more},{ws}{b}{more}"

    obj = rf"\{{{ws}(?:{both(kind, amount)}|{both(amount, kind)})\}}{ws}"
    return rf"{ws}\[{ws}(?:{obj}(?:,{ws}{obj})*+)?+\]{ws}"


def _up_to(limit: int) -> str:
    """Digits, zeros in front or not, whose number is at most ``limit``."""
    n = str(limit)
    same = [rf"{n[:i]}[0-{int(d) - 1}][0-9]{{{len(n) - i - 1}}}" for i, d in enumerate(n) if d != "0"]
    return rf"(?=[0-9])0*+(?:[1-9][0-9]{{0,{len(n) - 2}}}+(?![0-9])|{'|'.join([*same, n])})?+(?![0-9])"


def kind_pattern(kind: str) -> str:
    """The pattern of one field, quoted or not.

    ``digits`` must fit the BIGINT that they load as. Where a field may be blank, it's empty: blanks alone are no value.
    """
    if kind == "digits":
        n = _up_to(2**63 - 1)
        return rf'(?:{n}|"{n}")'
    if kind == "date":
        return rf'(?:{_YEAR_DAY}|"{_YEAR_DAY}")'
    if kind == "decimal":
        n = r"(?:[0-9]++(?:\.[0-9]++)?+)?+"
        return rf'(?:"{n}"|{n})'
    if kind == "targets":
        # without quotes only nothing or an empty list can stand
        return rf'(?:"(?:{json_targets(chr(34) * 2)})?+"|(?:[ \t\n\r]*+\[[ \t\n\r]*+\][ \t\n\r]*+)?+)'
    if kind == "text":
        return FIELD
    raise ValueError(f"no such kind of field: {kind}")


#: The export's columns and their kinds.
PREDICTION_LINE: list[tuple[str, str]] = [
    ("pred_id", "digits"),
    ("model", "text"),
    ("conversation_date", "date"),
    ("input", "text"),
    ("raw_response", "text"),
    ("parsed_targets", "targets"),
    ("latency_seconds", "decimal"),
]


def row_pattern(fields: list[tuple[str, str]]) -> str:
    """The anchored pattern for a whole valid row, one group for each field."""
    return r"\A" + ",".join(f"({kind_pattern(k)})" for _, k in fields) + r"\z"


def prefix_pattern(fields: list[tuple[str, str]], k: int) -> str:
    """The first ``k`` fields valid and ended by a comma or the row's end."""
    return r"\A" + ",".join(kind_pattern(kind) for _, kind in fields[:k]) + r"(?:,|\z)"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def strict_targets(text: str) -> bool:
    """Whether ``text`` is strictly a JSON list of objects with a valid ``type`` and a number as ``amount``."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, list) and all(
        isinstance(x, dict)
        and x.get("type") in ("EXPENSE", "INCOME")
        and isinstance(x.get("amount"), (int, float))
        and not isinstance(x.get("amount"), bool)
        for x in value
    )


@F.pandas_udf(T.BooleanType())
def _strict_targets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(strict_targets, na_action="ignore").astype(object)


def _content(c: Column) -> Column:
    """A field's content: without its quotes, doubled quotes single."""
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(c.startswith('"'), inner).otherwise(c)


def classify_lines(lines: DataFrame, column: str = "line", fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """``lines`` with ``reason`` (null for a valid row) and ``broken_field``, the first field that fails.

    ``reason`` is the first that applies of ``quoting``, ``column_count`` and ``value``. A null line has the reason
    ``column_count``, as an empty one has (one empty column). Other columns pass through. One
    narrow stage without a shuffle; Python sees only target lists that the row pattern can't decide.
    """
    fields = PREDICTION_LINE if fields is None else fields
    n = len(fields)
    line = F.coalesce(F.col(column), F.lit(""))
    targets = [i for i, (_, k) in enumerate(fields) if k == "targets"]
    valid = line.rlike(row_pattern(fields))
    quoted = line.rlike(rf"\A{FIELD}(?:,{FIELD})*+\z")
    counted = line.rlike(rf"\A{FIELD}(?:,{FIELD}){{{n - 1}}}\z")
    out = lines.withColumn("_valid", valid)
    out = out.withColumn("_shape", F.when(F.col("_valid"), F.lit(None)).when(~quoted, "quoting").when(~counted, "column_count"))
    if targets:
        # only rows whose other fields are all valid can be saved by the exact check
        t = targets[0]
        others = r"\A" + ",".join(f"({FIELD})" if i == t else kind_pattern(k) for i, (_, k) in enumerate(fields)) + r"\z"
        open_case = ~F.col("_valid") & F.col("_shape").isNull() & line.rlike(others)
        out = out.withColumn("_exact", _strict_targets(F.when(open_case, _content(F.regexp_extract(line, others, 1)))))
        saved = F.coalesce(F.col("_exact"), F.lit(False))
    else:
        saved = F.lit(False)
    reason = F.when(F.col("_valid") | saved, F.lit(None)).otherwise(F.coalesce(F.col("_shape"), F.lit("value")))
    broken = F.lit(None).cast("string")
    for k in range(n, 0, -1):
        broken = F.when(~line.rlike(prefix_pattern(fields, k)), fields[k - 1][0]).otherwise(broken)
    out = out.withColumn("reason", reason)
    # a row of valid fields that has more columns than the schema breaks after the last field
    out = out.withColumn("broken_field", F.when(F.col("reason").isNotNull(), F.coalesce(broken, F.lit("(end)"))))
    return out.drop("_valid", "_shape", *(["_exact"] if targets else []))


def load_lines(lines: DataFrame, column: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The valid rows of prediction lines as typed rows: the columns in ``keep`` and the export's seven."""
    from talliflow.schemas import TARGETS

    good = classify_lines(lines, column).where("reason is null")
    pattern = r"\A" + ",".join([f"({FIELD})"] * len(PREDICTION_LINE)) + r"\z"
    raw = {name: _content(F.regexp_extract(F.col(column), pattern, i + 1)) for i, (name, _) in enumerate(PREDICTION_LINE)}
    typed = {
        "pred_id": raw["pred_id"].try_cast("bigint"),
        "model": raw["model"],
        "conversation_date": F.to_date(raw["conversation_date"]),
        "input": raw["input"],
        "raw_response": raw["raw_response"],
        "parsed_targets": F.from_json(F.nullif(F.trim(raw["parsed_targets"]), F.lit("")), TARGETS),
        "latency_seconds": raw["latency_seconds"].try_cast("double"),
    }
    return good.select(*(keep or []), *(c.alias(k) for k, c in typed.items()))


def rejected_lines(lines: DataFrame, column: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The rows that can't be loaded, with ``reason`` and ``broken_field``."""
    return classify_lines(lines, column).where("reason is not null").select(*(keep or []), "reason", "broken_field")
