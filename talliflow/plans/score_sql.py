"""SQL of the scores: greedy matching, similarity of expressions, strict JSON and the reports made of them."""

from __future__ import annotations

#: Longest common block of a and b, the first in a and then in b of equal ones: length k, negative places i and j (from 0).
_BLOCK = """list_max(flatten(list_transform(range(0, len(a)), lambda i: list_transform(range(0, len(b)), lambda j:
  {'k': len(list_filter(range(1, least(len(a) - i, len(b) - j) + 1), lambda k: substr(a, i::INT + 1, k::INT) = substr(b, j::INT + 1, k::INT))), 'i': -i, 'j': -j}))))"""


def _text(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def exact(x: str, digits: int = 4) -> str:
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)::DOUBLE"


_SAME = ["x.amount IS NOT DISTINCT FROM y.amount", *(f"{f}({_text('x.' + k)}) = {f}({_text('y.' + k)})" for k, f in (("currency", "upper"), ("type", "upper"), ("category", "lower")))]
_WEIGHTS = [0.35, 0.15, 0.15, 0.15]
ERRORS = ["amount", "currency", "type", "category", "date_delta", "date_expression"]


def _walk(least: str) -> str:
    """The greedy walk over the rows of pair scores as a fold whose state is of the rows' own type."""
    best = f"list_max(list_filter(list_transform(r.line, lambda y, j: {{'s': y.s, 'o': -j, 'f': y.f}}), lambda z: z.s > {least} AND NOT list_contains(acc.used, -z.o)))"
    return f"""list_reduce(list_transform(mx, lambda l: {{'used': []::BIGINT[], 'total': 0.0::DOUBLE, 'errs': [0, 0, 0, 0, 0, 0]::BIGINT[], 'line': l}}),
  lambda acc, r: list_transform([{best}], lambda g: {{'used': CASE WHEN g IS NULL THEN acc.used ELSE list_append(acc.used, (-g.o)::BIGINT) END,
    'total': acc.total + coalesce(g.s, 0.0), 'errs': CASE WHEN g IS NULL THEN acc.errs ELSE list_transform(acc.errs, lambda n, k: (n + g.f[k])::BIGINT) END, 'line': r.line}})[1],
  {{'used': []::BIGINT[], 'total': 0.0::DOUBLE, 'errs': [0, 0, 0, 0, 0, 0]::BIGINT[], 'line': []::STRUCT(s DOUBLE, f INTEGER[])[]}})"""


#: A text that is JSON to Python: no comma before a closing bracket, which DuckDB lets pass.
_BARE = """regexp_replace(raw, '"(?:[^"\\\\]|\\\\.)*"', '', 'g')"""
_KEYS = "len(list_filter(['type', 'amount', 'currency', 'category', 'description', 'date_delta_days', 'date_raw_expression'], lambda k: NOT json_exists({x}, '$.' || k))) = 0"
_STRICT = f"""CASE WHEN raw = '' OR contains(raw, '```') OR NOT json_valid(raw) OR regexp_matches({_BARE}, ',\\s*[\\]}}]') THEN 0.0
  WHEN json_type(raw::JSON) = 'OBJECT' THEN ({_KEYS.format(x='raw::JSON')})::INT::DOUBLE
  WHEN json_type(raw::JSON) = 'ARRAY' THEN (len(list_filter(CAST(raw::JSON AS JSON[]), lambda o: coalesce(json_type(o), 'NULL') <> 'OBJECT' OR NOT {_KEYS.format(x='o')})) = 0)::INT::DOUBLE ELSE 0.0 END"""


def entries(counts: str) -> str:
    """The WITH part that ends in ``s``: every prediction with its scores; ``counts`` are the parts up to ``m`` and ``c``."""
    scores = " + ".join(f"{w} * ({c})::INT::DOUBLE" for w, c in zip(_WEIGHTS, _SAME))
    flags = ", ".join(f"(NOT coalesce({c}, false))::INT" for c in _SAME)
    return f"""RECURSIVE {counts},
  pr AS (SELECT pred_id, i, j, p[i] AS x, e[j] AS y, lower({_text('p[i].date_raw_expression')}) AS a, lower({_text('e[j].date_raw_expression')}) AS b
    FROM m, unnest(range(1, len(p) + 1)) AS u(i), unnest(range(1, len(e) + 1)) AS v(j)),
  w AS (SELECT a AS ka, b AS kb, a, b, {_BLOCK} AS g FROM (SELECT DISTINCT a, b FROM pr WHERE x.date_raw_expression IS NOT NULL AND y.date_raw_expression IS NOT NULL
      AND NOT contains(a, b) AND NOT contains(b, a))
    UNION ALL SELECT ka, kb, a, b, {_BLOCK} FROM (SELECT ka, kb, part.a AS a, part.b AS b FROM (SELECT ka, kb, unnest([{{'a': substr(a, 1, -g.i::INT), 'b': substr(b, 1, -g.j::INT)}},
      {{'a': substr(a, (-g.i + g.k + 1)::INT), 'b': substr(b, (-g.j + g.k + 1)::INT)}}]) AS part FROM w WHERE g.k > 0)) WHERE a <> '' AND b <> ''),
  ratio AS (SELECT ka AS a, kb AS b, 2.0 * sum(g.k) / (len(ka) + len(kb)) AS r FROM w GROUP BY ka, kb),
  ex AS (SELECT pr.*, CASE WHEN x.date_raw_expression IS NULL AND y.date_raw_expression IS NULL THEN 1.0 WHEN x.date_raw_expression IS NULL OR y.date_raw_expression IS NULL THEN 0.0
      WHEN contains(pr.a, pr.b) OR contains(pr.b, pr.a) THEN 1.0 ELSE coalesce(r, 0.0) END::DOUBLE AS ee, (x.date_delta_days IS NOT DISTINCT FROM y.date_delta_days)::INT::DOUBLE AS dd
    FROM pr LEFT JOIN ratio ON pr.a = ratio.a AND pr.b = ratio.b),
  sc AS (SELECT pred_id, i, list({{'s': ({scores} + 0.2 * {exact('0.7 * dd + 0.3 * ee')})::DOUBLE, 'f': [{flags}, (dd < 1)::INT, (ee < 1)::INT]}} ORDER BY j) AS line FROM ex GROUP BY pred_id, i),
  mx AS (SELECT pred_id, list(line ORDER BY i) AS mx FROM sc GROUP BY pred_id),
  st AS (SELECT pred_id AS id, latency_seconds, coalesce(len(list_filter(parsed_targets, lambda t: t IS NULL)) = 0, false) AS clean, regexp_replace(coalesce(raw_response, ''), '^\\s+|\\s+$', '', 'g') AS raw FROM predictions),
  s AS (SELECT c.*, latency_seconds, clean, raw, {_STRICT} AS strict, CASE WHEN np = 0 AND ne = 0 THEN 1.0 WHEN np = 0 OR ne = 0 THEN 0.0 ELSE {_walk('0.0')}.total / greatest(np, ne) END::DOUBLE AS acc,
      coalesce({_walk('-1.0')}.errs, [0, 0, 0, 0, 0, 0]) AS errs, least(np, ne) AS pairs FROM c JOIN st ON c.pred_id = st.id LEFT JOIN mx ON mx.pred_id = c.pred_id)"""


_P, _R = "coalesce(sum(tp) / nullif(sum(np), 0)::DOUBLE, 0)", "coalesce(sum(tp) / nullif(sum(ne), 0)::DOUBLE, 0)"


def prf(p: str = _P, r: str = _R, n: str = "sum(np) + sum(ne)") -> str:
    """Precision, recall and F1 as columns."""
    parts = {"precision": p, "recall": r, "f1_score": f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"}
    return ", ".join(f"{exact(f'CASE WHEN {n} = 0 THEN 1.0 ELSE {x} END')} AS {k}" for k, x in parts.items())


def queries(counts: str) -> dict[str, str]:
    head = f"WITH {entries(counts)}"
    errors = ", ".join(f"(sum(errs[{i}]) + sum(ne - tp))::BIGINT AS {k}_errors" for i, k in enumerate(ERRORS, 1))
    own = prf("coalesce(tp / nullif(np, 0)::DOUBLE, 0)", "coalesce(tp / nullif(ne, 0)::DOUBLE, 0)", "np + ne").split(", format")[-1].rsplit(" AS ", 1)[0]
    latency = ", ".join(f"{exact(f'coalesce(quantile_cont(latency_seconds, {q}), 0)', 3)} AS {k}_seconds" for q, k in ((0.5, "p50"), (0.99, "p99")))
    return {
        "eval_entries": f"{head} SELECT pred_id, strict AS strict_json_score, round(acc, 9) AS entity_accuracy, cm AS category_match, pairs::INT AS pairs FROM s",
        "eval_report": f"""{head} SELECT model, count(*) AS total_entries, {exact('avg(strict)')} AS strict_json_score, {exact('avg(acc)')} AS entity_accuracy, {exact('avg(cm)')} AS category_match,
          sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ne - tp)::BIGINT AS fn, sum(ne)::BIGINT AS expected, sum(pairs)::BIGINT AS matched_pairs,
          count(*) FILTER (strict = 0) AS hard_gate_failures, {errors}, {latency}, {prf()} FROM s GROUP BY model""",
        "eval_error_rates": f"""{head}, r AS (SELECT sum(ne)::BIGINT AS expected, {errors} FROM s) SELECT expected, unnest([{', '.join(f"'{k}'" for k in ERRORS)}]) AS field,
          unnest([{', '.join(f'{k}_errors' for k in ERRORS)}]) AS errors, unnest([{', '.join(f'{k}_errors / nullif(expected, 0)::DOUBLE' for k in ERRORS)}]) AS rate FROM r""",
        "eval_metric": f"""{head}, f AS (SELECT model, CASE WHEN raw = '' OR NOT clean THEN 0.0 ELSE 0.5 * format{own} + 0.5 * acc END AS score FROM s)
          SELECT model, count(*) AS n, round(avg(score), 9) AS score, count(*) FILTER (score < 0.8) AS failures FROM f GROUP BY model""",
    }
