"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliflow.operators import nested, records, units
from talliflow.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected_lines(table(spark, d, "prediction_lines"), keep=["line_id"]).select("line_id", "reason")


def p4_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines by reason and first broken field."""
    bad = records.rejected_lines(table(spark, d, "prediction_lines"), keep=["line_id"])
    return bad.groupBy("reason", "broken_field").agg(F.count("*").alias("n"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows."""
    rows = records.load_lines(table(spark, d, "prediction_lines"), keep=["line_id"])
    return rows.withColumn("n_targets", F.size("parsed_targets")).drop("parsed_targets")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(
        table(spark, d, "golden"), table(spark, d, "amount_terms"), table(spark, d, "fx_rates"), table(spark, d, "source_units")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where("differs").select("entry_id", "target_no", F.col("centavos").alias("ars_centavos"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every target's value in pesos with the unit it was recorded in."""
    return _units(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(table(spark, d, "eval_reports")).drop("node", "variant")


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """Items of each kind by variant."""
    return nested.children(table(spark, d, "eval_reports")).groupBy("item_kind", "variant").agg(F.count("*").alias("n"))


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.entry_table(table(spark, d, "eval_reports"))


def _typed(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.typed_table(nested.children(table(spark, d, "eval_reports")), kind)

    return query


QUERIES = {
    "p4_found": p4_found,
    "p4_broken_fields": p4_broken_fields,
    "p4_loaded": p4_loaded,
    "p5_found": p5_found,
    "p5_values": p5_values,
    "p6_found": p6_found,
    "p6_variants": p6_variants,
    "p6_entries": p6_entries,
    **{f"p6_{kind}_table": _typed(kind) for kind in nested.FIELDS},
}


def _present(x: str) -> str:
    return f"CASE WHEN json_type({x}) <> 'NULL' THEN {x} END"


def _member(x: str, *names: str) -> str:
    return "coalesce(" + ", ".join(_present(f"json_extract({x}, '$.{n}')") for n in names) + ")"


def _list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] END"


def _children(kind: str, items: str, source: str = "e", parent: str = "0") -> str:
    return (
        f"SELECT report_id, entry_no, '{kind}' AS item_kind, {parent} AS parent_no, unnest(range(1, len({items}) + 1))::INT AS item_no, unnest({items}) AS node FROM {source}"
    )


#: The items of all reports by DuckDB's JSON functions.
_P6 = f"""WITH r AS (SELECT report_id, {_member('payload::JSON', 'per_entry_results', 'entries')} AS es FROM eval_reports),
l AS (SELECT report_id, {_list('es')} AS es FROM r),
x AS (SELECT report_id, unnest(range(1, len(es) + 1))::INT AS entry_no, unnest(es) AS entry FROM l),
e AS (SELECT report_id, entry_no, {_member('entry', 'parsed_targets', 'target')} AS t, {_member('entry', 'transaction_counts')} AS c,
  {_member('entry', 'error_breakdown')} AS b, {_member(_member('entry', 'conversation'), 'outputs', 'output')} AS o FROM x WHERE json_type(entry) <> 'NULL'),
outs AS ({_children('output', _list('o'))}),
h AS (SELECT report_id, entry_no, item_no AS parent, {_member('node', 'history')} AS hs FROM outs),
every AS ({_children('target', _list('t'))} UNION ALL {_children('error', _list('b'))} UNION ALL SELECT * FROM outs
  UNION ALL {_children('history', _list('hs'), 'h', 'parent')}
  UNION ALL SELECT report_id, entry_no, 'counts', 0, 1, c FROM e WHERE json_type(c) = 'OBJECT')
SELECT report_id, entry_no, item_kind, parent_no::INT AS parent_no, item_no FROM every WHERE json_type(node) <> 'NULL'"""

#: Reasons of rejected lines: the fields cut out by one expression and looked at one by one.
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_ROW = ",".join([f"({_FIELD})"] * 7)


def _content(k: int) -> str:
    raw = f"regexp_extract(line, '^{_ROW}$', {k})"
    return f"CASE WHEN {raw}[1] = '\"' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


#: JSON text without its strings: json_valid lets NaN and commas before a closing bracket pass.
_BARE = """regexp_replace(ts, '"(?:[^"\\\\]|\\\\.)*"', '', 'g')"""
_P4 = f"""WITH l AS (SELECT line_id, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS quoted, regexp_full_match(line, '{_FIELD}(?:,{_FIELD}){{6}}') AS seven FROM prediction_lines),
  f AS (SELECT line_id, quoted, seven, {_content(1)} AS id, {_content(3)} AS day, {_content(6)} AS ts, {_content(7)} AS lat FROM l),
  v AS (SELECT *, CASE WHEN ts = '' THEN true WHEN NOT json_valid(ts) OR regexp_matches({_BARE}, '(NaN|Infinity|,\\s*[\\]}}])') THEN false WHEN json_type(ts::JSON) <> 'ARRAY' THEN false
    ELSE len(list_filter(CAST(ts::JSON AS JSON[]), lambda x: json_type(x) <> 'OBJECT' OR coalesce(x->>'$.type', '') NOT IN ('EXPENSE', 'INCOME')
      OR coalesce(json_type(x, '$.amount'), '') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT'))) = 0 END AS good FROM f)
  SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT seven THEN 'column_count' ELSE 'value' END AS reason FROM v
  WHERE NOT quoted OR NOT seven OR NOT good OR NOT regexp_full_match(id, '[0-9]+') OR try_cast(id AS BIGINT) IS NULL OR NOT regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
    OR try_cast(day AS DATE) IS NULL OR NOT regexp_full_match(lat, '|[0-9]+([.][0-9]+)?')"""
#: The fields of the lines that aren't rejected, as their types.
_P4_LOADED = f"""WITH bad AS ({_P4}) SELECT line_id, {_content(1)}::BIGINT AS pred_id, {_content(2)} AS model, {_content(3)}::DATE AS conversation_date, {_content(4)} AS input,
  {_content(5)} AS raw_response, nullif({_content(7)}, '')::DOUBLE AS latency_seconds, json_array_length(nullif({_content(6)}, ''))::INT AS n_targets
  FROM prediction_lines WHERE line_id NOT IN (SELECT line_id FROM bad)"""
_HEAD, _EVERY = _P6.split("SELECT report_id, entry_no, item_kind, parent_no::INT")[0], "SELECT *"


def _state(kind: str) -> str:
    here = [f"coalesce(json_type(node, '$.{k}'), 'NULL')" for k in nested.FIELDS[kind]]
    lax = [f"coalesce(json_type(node, '$.{k}'), 'NULL') = 'VARCHAR'" for k, t in nested.FIELDS[kind].items() if t in ("int", "double")]
    base = f"CASE WHEN {' AND '.join(f'{h} = {chr(39)}NULL{chr(39)}' for h in here)} THEN 'bare' WHEN {' OR '.join(lax) or 'false'} THEN 'lax' ELSE 'typed' END"
    more = ""
    if kind == "output":
        has = f"len(list_filter({_list(_member('node', 'history'))}, lambda h: json_type(h) <> 'NULL')) > 0"
        more = f" || CASE WHEN {has} THEN '+history' ELSE '' END"
    return f"WHEN '{kind}' THEN CASE WHEN json_type(node) <> 'OBJECT' THEN 'scalar' ELSE {base}{more} END"


_P6_VARIANTS = f"""{_HEAD} SELECT item_kind, CASE item_kind {' '.join(_state(k) for k in nested.FIELDS)} END AS variant, count(*) AS n FROM every WHERE json_type(node) <> 'NULL' GROUP BY 1, 2"""
_P6_ENTRIES = f"""{_HEAD} SELECT report_id, entry_no::INT AS entry_no, CASE json_type(entry) WHEN 'OBJECT' THEN 'record' WHEN 'ARRAY' THEN 'list' WHEN 'BOOLEAN' THEN 'flag'
    WHEN 'VARCHAR' THEN CASE WHEN try_cast(entry->>'$' AS DOUBLE) IS NULL THEN 'text' ELSE 'digits' END ELSE 'number' END AS shape,
  try_cast(entry->>'$.pred_id' AS BIGINT) AS pred_id, entry->>'$.input' AS input, entry->>'$.raw_response' AS raw_response,
  entry->>'$.conversation.conversation_date' AS conversation_date FROM x WHERE json_type(entry) <> 'NULL'"""
SQL: dict[str, str] = {"p4_found": _P4, "p4_loaded": _P4_LOADED, "p6_found": _P6, "p6_variants": _P6_VARIANTS, "p6_entries": _P6_ENTRIES}
