"""SQL of the checks of texts, of parsed answers, chat records and remarks."""

from __future__ import annotations

#: A text that Python's float() takes.
_FLOAT = r"\s*[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*|\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_BODY = _STRIP.format(x=r"regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format(x="raw_response") + r", '^```json', ''), '^```', ''), '```$', '')")
_BARE = r"""regexp_replace(body, '"(?:[^"\\]|\\.)*"', '', 'g')"""
_BAD_ITEM = f"""coalesce(json_type(o), 'NULL') <> 'OBJECT' OR (json_exists(o, '$.type') AND json_type(o, '$.type') <> 'VARCHAR')
  OR CASE json_type(o, '$.amount') WHEN 'VARCHAR' THEN o->>'$.amount' <> '' AND NOT regexp_full_match(o->>'$.amount', '{_FLOAT}')
    WHEN 'ARRAY' THEN json_array_length(o, '$.amount') > 0 WHEN 'OBJECT' THEN len(json_keys(o, '$.amount')) > 0 ELSE false END"""

PARSE_OUTCOMES = f"""WITH b AS (SELECT model, {_BODY} AS body FROM predictions),
  v AS (SELECT model, CASE WHEN body IS NULL OR NOT json_valid(body) OR regexp_matches({_BARE}, ',\\s*[\\]}}]') THEN NULL
    WHEN json_type(body::JSON) = 'ARRAY' THEN CAST(body::JSON AS JSON[]) ELSE [body::JSON] END AS items FROM b)
  SELECT model, CASE WHEN items IS NULL OR len(list_filter(items, lambda o: {_BAD_ITEM})) > 0 THEN 'unparseable' WHEN len(items) = 0 THEN 'empty' ELSE 'targets' END AS outcome, count(*) AS n
  FROM v GROUP BY 1, 2"""

_TWO = "printf('%.2f', a)"
_DOTTED = "regexp_replace(translate(format('{:,.2f}', a), ',.', '.,'), ',00$', '')"
_FOUND = f"""(whole AND contains(translate(input, '., ', ''), n)) OR (whole AND a >= 1000 AND a % 1000 = 0 AND len(list_filter(['mil', 'k', 'lucas', 'palos'],
    lambda w: contains(translate(lower(input), '$ ', ''), (a / 1000)::DECIMAL(20, 0)::VARCHAR || w))) > 0)
  OR contains(input, {_TWO}) OR contains(input, translate({_TWO}, '.', ',')) OR (a >= 1000 AND contains(input, {_DOTTED}))"""
TEXT_QUALITY = f"""WITH g AS (SELECT entry_id, input, targets, targets[1].amount AS a, targets[1].amount = floor(targets[1].amount) AS whole, targets[1].amount::DECIMAL(20, 0)::VARCHAR AS n,
    {_STRIP.format(x="coalesce(input, '')")} AS body FROM golden),
  q AS (SELECT entry_id, CASE WHEN body = '' THEN 'empty' WHEN body[1] IN ('{{', '[') THEN 'json' END AS rejected,
    concat_ws(',', CASE WHEN length(input) > 500 THEN 'long' END, CASE WHEN len(targets) = 1 AND a IS NOT NULL AND NOT ({_FOUND}) THEN 'amount' END,
      CASE WHEN len(list_filter(targets, lambda t: t.currency = 'USD')) > 0 AND NOT regexp_matches(lower(input), '{{usd}}') THEN 'currency' END) AS w FROM g)
  SELECT entry_id, rejected, CASE WHEN rejected IS NULL THEN w ELSE '' END AS warnings FROM q"""

RECOMMENDATIONS = """WITH t AS (SELECT unnest(targets) AS t FROM golden), k AS (SELECT upper(trim(t.type)) AS k, t.category AS c FROM t),
  p AS (SELECT round(100.0 * count(*) FILTER (k = 'EXPENSE') / count(*), 1)::DOUBLE AS e, round(100.0 * count(*) FILTER (k = 'INCOME') / count(*), 1)::DOUBLE AS i,
    count(DISTINCT c) FILTER (k = 'EXPENSE') AS ue, count(DISTINCT c) FILTER (k = 'INCOME') AS ui FROM k),
  d AS (SELECT count(*) FILTER (kind = 'expense') AS ae, count(*) FILTER (kind = 'income') AS ai FROM categories),
  m AS (SELECT count(*) FILTER (len(targets) > 1) AS multi, count(*) AS n FROM golden)
  SELECT 1 AS ord, CASE WHEN e > {skew} OR i > {skew} THEN 'warning' ELSE 'success' END AS kind,
    CASE WHEN e > {skew} THEN 'expenses' WHEN i > {skew} THEN 'incomes' ELSE 'balance' END AS topic, CASE WHEN e <= {skew} AND i > {skew} THEN i ELSE e END AS value FROM p
  UNION ALL SELECT 2, 'info', 'expense_categories', ue FROM p, d WHERE ue < ae * {cover} UNION ALL SELECT 3, 'info', 'income_categories', ui FROM p, d WHERE ui < ai * {cover}
  UNION ALL SELECT 4, 'info', 'several_targets', multi FROM m WHERE multi < n * {multi}"""


def _value(field: str, text: bool = True) -> str:
    return f"coalesce({f'to_json(t.{field})' if text else f't.{field}'}::VARCHAR, 'null')"


_FIELDS = [("type", True), ("amount", False), ("currency", True), ("category", True), ("description", True), ("date_delta_days", False), ("date_raw_expression", True)]
_TARGET = " || ', ' || ".join(f"""'"{k}": ' || {_value(k, text)}""" for k, text in _FIELDS)
_JSON = f"""'[' || coalesce(array_to_string(list_transform(targets, lambda t: CASE WHEN t IS NULL THEN 'null' ELSE '{{' || {_TARGET} || '}}' END), ', '), '') || ']'"""
CHAT_RECORDS = f"""SELECT entry_id, '<|im_start|>system' || chr(10) || 'Extract the transactions.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(input, '')
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {_JSON} || '<|im_end|>' AS text FROM golden"""
