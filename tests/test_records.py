"""Line loading: reasons, first broken fields, typed rows; against a plain reader written field by field."""

import datetime
import json
import re

import pytest

from talliflow.operators import records

OK = '1,m,2025-02-28,hola,raw,"[{""type"": ""EXPENSE"", ""amount"": 1.5}]",0.5'
CASES = {
    OK: (None, None),
    '"7","m, x","2024-02-29","a ""b""\n c",,,': (None, None),
    "1,m,2025-02-28,hola,raw,[ ],": (None, None),
    '1,m,2025-02-28,hola,raw,"[{""amount"": 1, ""x"": {""y"": [1]}, ""type"": ""INCOME""}]",3': (None, None),
    '1,m,2025-02-28,ho"la,raw,,1': ("quoting", "input"),
    '1,m,2025-02-28,"hola" x,raw,,1': ("quoting", "input"),
    '1,m,2025-02-28,"hola,raw,,1': ("quoting", "input"),
    '1,"m,2025-02-28': ("quoting", "model"),
    "1,m,2025-02-28,hola,raw,,1,extra": ("column_count", "(end)"),
    "1,m": ("column_count", "conversation_date"),
    "": ("column_count", "pred_id"),
    "x1,m,2025-02-28,hola,raw,,1": ("value", "pred_id"),
    "1,m,2025-02-29,hola,raw,,1": ("value", "conversation_date"),
    "1,m,20250228,hola,raw,,1": ("value", "conversation_date"),
    '1,m,2025-02-28,hola,raw,,"1,5"': ("value", "latency_seconds"),
    "1,m,2025-02-28,hola,raw,,1e3": ("value", "latency_seconds"),
    "1,m,2025-02-28,hola,raw,, ": ("value", "latency_seconds"),
    '1,m,2025-02-28,hola,raw,"",""': (None, None),
    "1,m,2025-02-28,hola,raw, ,1": ("value", "parsed_targets"),
    "0009223372036854775807,m,2025-02-28,hola,raw,,1": (None, None),
    "9223372036854775808,m,2025-02-28,hola,raw,,1": ("value", "pred_id"),
    "12345678901234567890,m,2025-02-28,hola,raw,,1": ("value", "pred_id"),
    "000,m,2025-02-28,hola,raw,,1": (None, None),
    "1,m,2025-02-28,hola,raw,null,1": ("value", "parsed_targets"),
    '1,m,2025-02-28,hola,raw,"[{""type"": ""EXPENSE"", ""amount"": NaN}]",1': ("value", "parsed_targets"),
    '1,m,2025-02-28,hola,raw,"[{""type"": ""EXPENSE"", ""amount"": true}]",1': ("value", "parsed_targets"),
    '1,m,2025-02-28,hola,raw,"[{""type"": ""gasto"", ""amount"": 1}]",1': ("value", "parsed_targets"),
    '1,m,2025-02-28,hola,raw,"[{""type"": ""EXPENSE""}]",1': ("value", "parsed_targets"),
    '1,m,2025-02-28,hola,raw,"{""type"": ""EXPENSE"", ""amount"": 1}",1': ("value", "parsed_targets"),
    '1,m,2025-02-28,hola,raw,"[{\'type\': \'EXPENSE\', \'amount\': 1}]",1': ("value", "parsed_targets"),
}


def test_reasons_and_broken_fields(spark):
    rows = [(i, k, "clash") for i, k in enumerate(CASES)]
    df = spark.createDataFrame(rows, "line_id int, line string, reason string")
    got = {r["line"]: (r["reason"], r["broken_field"]) for r in records.classify_lines(df).collect()}
    assert got == CASES


def test_null_empty_table_and_long_lines(spark):
    long_text = "x" * 1_000_000
    many = "[" + ", ".join(['{""type"": ""EXPENSE"", ""amount"": 1, ""description"": ""é \\""a\\"" b""}'] * 5000) + "]"
    rows = [(1, None), (2, f'1,m,2025-01-01,"{long_text}",r,"{many}",1'), (3, f'1,m,2025-01-01,"{long_text}'), (4, '"' * 200_001)]
    df = spark.createDataFrame(rows, "line_id int, line string")
    got = {r["line_id"]: r["reason"] for r in records.classify_lines(df).collect()}
    assert got == {1: "column_count", 2: None, 3: "quoting", 4: "quoting"}
    assert records.classify_lines(df.where("false")).collect() == []


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, OK), (2, "bad")], "line_id int, line string")
    (row,) = records.load_lines(df, keep=["line_id"]).collect()
    assert (row["line_id"], row["pred_id"], row["conversation_date"], row["latency_seconds"]) == (1, 1, datetime.date(2025, 2, 28), 0.5)
    assert row["parsed_targets"][0]["type"] == "EXPENSE" and row["parsed_targets"][0]["amount"] == 1.5
    (bad,) = records.rejected_lines(df, keep=["line_id"]).collect()
    assert (bad["line_id"], bad["reason"]) == (2, "column_count")


def by_hand(line):
    """Reason of a line, read letter by letter."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return "quoting"
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            fields.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < len(line) and line[i] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
            i = j
        if i >= len(line):
            break
        i += 1
    if len(fields) != 7:
        return "column_count"
    try:
        date = re.fullmatch(r"\d{4}-\d\d-\d\d", fields[2]) and datetime.date.fromisoformat(fields[2])
        targets = json.loads(fields[5], parse_constant=lambda c: 1 / 0) if fields[5] else []
        good = isinstance(targets, list) and all(
            isinstance(t, dict) and t.get("type") in ("EXPENSE", "INCOME") and type(t.get("amount")) in (int, float) for t in targets
        )
    except (ValueError, ZeroDivisionError):
        return "value"
    fine = date and good and re.fullmatch(r"[0-9]+", fields[0]) and int(fields[0]) < 2**63 and re.fullmatch(r"|[0-9]+(\.[0-9]+)?", fields[6])
    return None if fine else "value"


@pytest.mark.parametrize("table", ["prediction_lines"])
def test_against_a_reader_by_hand(spark, data, table):
    df = spark.read.parquet(f"{data}/{table}.parquet")
    got = {r["line_id"]: r["reason"] for r in records.classify_lines(df).collect()}
    assert got == {r["line_id"]: by_hand(r["line"]) for r in df.collect()}
