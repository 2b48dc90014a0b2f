"""Queries of the operators on curated data, predictions, conversations and chats, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliflow.functions.udfs import parse_response
from talliflow.operators import balance, chat, generation, profile, quality, roundtrip, scoring, splits, synth, units
from talliflow.plans import score_sql, text_sql
from talliflow.session import table
from talliflow.streaming import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: Shared parts of the SQL: curated entries by message (the last wins) and predictions beside what they should have.
LAST = """last AS (SELECT input, arg_max(targets, entry_id) AS targets, max(entry_id) AS entry_id FROM golden WHERE input IS NOT NULL GROUP BY input)"""
MATCHED = f"""{LAST}, m AS (
  SELECT p.pred_id, p.model, coalesce(p.parsed_targets, []) AS p, coalesce(l.targets, []) AS e
  FROM predictions p LEFT JOIN last l USING (input)),
k AS (SELECT pred_id, model, len(p) AS np, len(e) AS ne,
        list_transform(p, lambda t: coalesce(t.amount::VARCHAR, '-') || '|' || upper(coalesce(t.type, ''))) AS pk,
        list_transform(e, lambda t: coalesce(t.amount::VARCHAR, '-') || '|' || upper(coalesce(t.type, ''))) AS ek,
        list_transform(p, lambda t: lower(trim(coalesce(t.category, ''), E' \\t\\n\\r'))) AS pc,
        list_transform(e, lambda t: lower(trim(coalesce(t.category, ''), E' \\t\\n\\r'))) AS ec FROM m)"""


def _overlap(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), "
        f"len(list_filter({b}, lambda y: y = x))))), 0)"
    )


COUNTS = f"""{MATCHED}, c AS (SELECT pred_id, model, np, ne, {_overlap('pk', 'ek')}::BIGINT AS tp,
  CASE WHEN np = 0 AND ne = 0 THEN 1.0 WHEN np = 0 OR ne = 0 THEN 0.0 ELSE {_overlap('pc', 'ec')} / greatest(np, ne)::DOUBLE END AS cm FROM k)"""
PRF = "SELECT {by} count(*) AS total_entries, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ne - tp)::BIGINT AS fn, " + score_sql.prf() + " FROM c {group}"
SCORES = score_sql.queries(COUNTS)
ITEMS = "t AS (SELECT entry_id, unnest(targets) AS t FROM golden)"


def _golden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    fields = {"amount": "double", "type": "string"}
    rows = scoring.matched_fields(table(spark, d, "predictions"), _golden(spark, d), fields, "pred_id", "model")
    keys = (scoring.transaction_keys(F.col(f"{side}_amount"), F.col(f"{side}_type")) for side in "pe")
    return rows.select("pred_id", "model", scoring.transaction_counts(*keys).alias("transaction_counts"))


def _totals(rows: DataFrame, *by: str) -> DataFrame:
    c = "transaction_counts."
    sums = [F.coalesce(F.sum(c + k), F.lit(0)).alias(a) for k, a in (("true_positives", "tp"), ("false_positives", "fp"), ("false_negatives", "fn"))]
    out = rows.groupBy(*by).agg(F.count("*").alias("total_entries"), *sums)
    return out.select("*", *scoring.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query("WITH " + COUNTS + " SELECT pred_id, np::BIGINT AS predicted, ne::BIGINT AS expected, tp AS true_positives, np - tp AS false_positives, ne - tp AS false_negatives FROM c")
def eval_counts(spark, d):
    rows = _counted(spark, d)
    return rows.select("pred_id", *(F.col(f"transaction_counts.{k}").cast("bigint").alias(k) for k in ("predicted", "expected", "true_positives", "false_positives", "false_negatives")))


@query("WITH " + COUNTS + " " + PRF.replace("{by}", "").replace("{group}", ""))
def eval_prf(spark, d):
    return _totals(_counted(spark, d))


@query("WITH " + COUNTS + " " + PRF.replace("{by}", "model,").replace("{group}", "GROUP BY model"))
def eval_by_model(spark, d):
    return _totals(_counted(spark, d), "model")


@query("WITH " + COUNTS + " SELECT pred_id, round(cm, 9) AS category_match FROM c")
def eval_category(spark, d):
    rows = scoring.matched_fields(table(spark, d, "predictions"), _golden(spark, d), {"category": "string"}, "pred_id")
    return rows.select("pred_id", F.round(scoring.category_match(F.col("p_category"), F.col("e_category")), 9).alias("category_match"))


def _entries(spark, d):
    return scoring.evaluate_entries(table(spark, d, "predictions"), _golden(spark, d).select("entry_id", "input", "targets"))


@query(SCORES["eval_entries"])
def eval_entries(spark, d):
    """All scores of every prediction."""
    rows = _entries(spark, d)
    return rows.select("pred_id", "strict_json_score", F.round("entity_accuracy", 9).alias("entity_accuracy"), "category_match", F.size("error_breakdown").alias("pairs"))


@query(SCORES["eval_report"])
def eval_report(spark, d):
    """Means, micro-averaged scores and error totals by model."""
    return scoring.report(_entries(spark, d), "model")


@query(SCORES["eval_error_rates"])
def eval_error_rates(spark, d):
    """Errors of each field as a share of the expected targets."""
    r = scoring.report(_entries(spark, d))
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"{k}_errors").alias("errors")) for k in scoring.ERRORS))
    return r.select("expected", F.inline(pairs)).withColumn("rate", F.try_divide("errors", "expected"))


@query(SCORES["eval_metric"])
def eval_metric(spark, d):
    """Mean composite metric by model, and rows under 0.8."""
    rows = scoring.composite_metric(_entries(spark, d))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 9).alias("score"), F.count_if(F.col("score") < 0.8).alias("failures"))


@query(
    "SELECT model, round(coalesce(quantile_cont(latency_seconds, 0.5), 0), 3) AS p50_seconds, round(coalesce(quantile_cont(latency_seconds, 0.99), 0), 3) AS p99_seconds "
    "FROM predictions GROUP BY model"
)
def latency_percentiles(spark, d):
    return scoring.latency_percentiles(table(spark, d, "predictions"), "model")


@query(text_sql.PARSE_OUTCOMES)
def parse_outcomes(spark, d):
    """Answers by model that parse to targets, to an empty list or not at all."""
    rows = table(spark, d, "predictions").select("model", parse_response(F.col("raw_response")).alias("t"))
    kind = F.when(F.col("t").isNull(), "unparseable").when(F.size("t") == 0, "empty").otherwise("targets")
    return rows.groupBy("model", kind.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(o.type, 'unknown') AS type, count(*) AS n FROM (SELECT unnest(outputs) AS o FROM conversations) GROUP BY 1")
def stats_conversation_types(spark, d):
    return profile.count_by_type(table(spark, d, "conversations"), "outputs")


@query(f"WITH {ITEMS} SELECT coalesce(t.type, 'unknown') AS type, count(*) AS n FROM t GROUP BY 1")
def stats_golden_types(spark, d):
    return profile.count_by_type(_golden(spark, d), "targets")


@query("SELECT (SELECT count(*) FROM conversations) AS total, count(DISTINCT input) AS saved, (SELECT count(*) FROM conversations) - count(DISTINCT input) AS remaining FROM golden")
def stats_totals(spark, d):
    return profile.totals(table(spark, d, "conversations"), _golden(spark, d))


@query(f"WITH {ITEMS} SELECT t.type AS type, t.category AS category, count(*) AS n FROM t GROUP BY 1, 2")
def category_counts(spark, d):
    return profile.category_counts(_golden(spark, d))


@query(
    f"WITH {ITEMS}, c AS (SELECT t.type AS type, t.category AS category, count(*) AS n FROM t GROUP BY 1, 2) "
    "SELECT type, category, n, round(n / sum(n) OVER (PARTITION BY type), 9) AS share, round(n / max(n) OVER (PARTITION BY type), 9) AS width FROM c"
)
def category_shares(spark, d):
    out = profile.with_shares(profile.category_counts(_golden(spark, d)), "type")
    return out.withColumns({k: F.round(k, 9) for k in ("share", "width")})


@query("SELECT coalesce(len(targets), 0)::INT AS n_targets, count(*) AS n FROM golden GROUP BY 1")
def targets_per_entry(spark, d):
    return profile.targets_per_entry(_golden(spark, d))


@query(
    f"WITH {ITEMS}, a AS (SELECT t.type AS type, t.amount AS amount FROM t WHERE t.amount IS NOT NULL) SELECT type, min(amount) AS low, max(amount) AS high, "
    "round(avg(amount), 4) AS mean, list_sort(list(amount))[len(list(amount)) // 2 + 1] AS upper_median, count(*) AS n FROM a GROUP BY type"
)
def amount_statistics(spark, d):
    return profile.amount_statistics(_golden(spark, d)).withColumn("mean", F.round("mean", 4))


@query(f"WITH {ITEMS} SELECT t.currency AS currency, count(*) AS n FROM t GROUP BY 1")
def currency_counts(spark, d):
    return profile.currency_counts(_golden(spark, d))


@query(
    f"WITH {ITEMS} SELECT count(*) AS targets, round(100.0 * count(*) FILTER (upper(trim(t.type)) = 'EXPENSE') / count(*), 1)::DOUBLE AS expense_pct, "
    "round(100.0 * count(*) FILTER (upper(trim(t.type)) = 'INCOME') / count(*), 1)::DOUBLE AS income_pct FROM t"
)
def type_percentages(spark, d):
    return profile.type_percentages(_golden(spark, d))


@query(text_sql.RECOMMENDATIONS.format(skew=profile.SKEW_PERCENT, cover=profile.COVERAGE_SHARE, multi=profile.MULTI_SHARE))
def recommendations(spark, d):
    return profile.recommendations(_golden(spark, d), table(spark, d, "categories"))


@query("SELECT metadata.source AS source, count(*) AS n, sum(len(targets))::BIGINT AS targets FROM golden GROUP BY 1")
def source_counts(spark, d):
    return profile.source_counts(_golden(spark, d))


@query(
    f"""WITH {ITEMS}, x AS (SELECT t FROM t) SELECT (SELECT count(*) FROM golden) AS entries, count(*) AS targets,
  round(avg(coalesce(upper(trim(t.type)) = 'EXPENSE', false)::INT), 9) AS expense_share,
  round(avg((t.date_delta_days IS NULL AND t.date_raw_expression IS NOT NULL)::INT), 9) AS absolute_date_share,
  round(avg(coalesce(t.date_delta_days = 0, false)::INT), 9) AS today_share, round(avg(coalesce(t.amount < 15000, false)::INT), 9) AS small_share,
  round(avg(coalesce(t.amount > 1000000, false)::INT), 9) AS large_share, round(count(*) / (SELECT count(*) FROM golden), 9) AS complexity FROM x"""
)
def corpus_profile(spark, d):
    out = profile.corpus_profile(_golden(spark, d))
    return out.withColumns({c: F.round(c, 9) for c, t in out.dtypes if t == "double"})


@query(
    """SELECT sum(len(list_filter(targets, lambda t: upper(trim(coalesce(t.currency, ''))) = 'USD')))::BIGINT AS usd,
  count(*) FILTER (coalesce(len(targets), 0) = 0) AS non_transactional, count(*) FILTER (len(targets) = 1) AS single_transaction, count(*) FILTER (len(targets) > 1) AS multi_transaction,
  sum(len(list_filter(targets, lambda t: coalesce(t.date_delta_days, 0) <> 0 OR t.date_raw_expression IS NOT NULL)))::BIGINT AS dated FROM golden"""
)
def features(spark, d):
    return profile.features(_golden(spark, d))


@query(
    """WITH g AS (SELECT entry_id, input FROM golden WHERE coalesce(length(input) <= 500, true) AND
    coalesce(len(list_filter(targets, lambda t: t.amount > 3000000)), 0) = 0)
  SELECT min(entry_id) AS entry_id, input FROM g WHERE input IS NOT NULL GROUP BY input UNION ALL SELECT entry_id, input FROM g WHERE input IS NULL"""
)
def clean_corpus(spark, d):
    return profile.clean_corpus(_golden(spark, d)).select("entry_id", "input")


@query(
    """SELECT entry_id, coalesce(regexp_matches(lower(input), 'usd|dolar|dólares|dolares|usds|dólar'), false) AS says_dollars
  FROM golden WHERE len(list_filter(targets, lambda t: t.currency = 'USD')) > 0"""
)
def dollar_messages(spark, d):
    return profile.dollar_messages(_golden(spark, d))


def _wanted(spark, d):
    """Wanted numbers of the keys: the share of ten thousand targets."""
    t = table(spark, d, "sample_targets")
    return t.select("ord", "target_key", F.round(F.col("share") * 10000).cast("bigint").alias("target"))


GAPS = f"""{ITEMS}, cnt AS (SELECT concat_ws(':', t.type, t.category) AS target_key, count(*) AS n FROM t GROUP BY 1),
gaps AS (SELECT s.ord, s.target_key, round(s.share * 10000)::BIGINT AS target, coalesce(n, 0) AS current,
  greatest(0, round(s.share * 10000)::BIGINT - coalesce(n, 0)) AS gap FROM sample_targets s LEFT JOIN cnt USING (target_key))"""


@query(f"WITH {GAPS} SELECT * FROM gaps")
def category_gaps(spark, d):
    return balance.category_gaps(_golden(spark, d), _wanted(spark, d))


@query(f"WITH {GAPS} SELECT * FROM gaps WHERE gap > 0")
def gap_summary(spark, d):
    return balance.gap_summary(balance.category_gaps(_golden(spark, d), _wanted(spark, d)))


@query(
    f"""WITH {GAPS}, s AS (SELECT concat_ws(':', x.t.type, x.t.category) AS target_key, input, min(entry_id) AS first_entry
    FROM (SELECT entry_id, input, unnest(targets) AS t FROM golden) x WHERE x.t IS NOT NULL AND input IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT s.target_key, s.input, row_number() OVER (PARTITION BY s.target_key ORDER BY first_entry, s.input)::INT AS rn, gap FROM s JOIN gaps USING (target_key) WHERE gap > 0)
  SELECT target_key, input, rn, least(5, gap - 5 * (rn - 1))::BIGINT AS n_variants FROM r WHERE least(5, gap - 5 * (rn - 1)) > 0"""
)
def plan_per_key(spark, d):
    return balance.plan_per_key(_golden(spark, d), balance.category_gaps(_golden(spark, d), _wanted(spark, d)))


def _share_gaps(spark, d):
    """Gaps to each key's share of as many targets as there are."""
    golden = _golden(spark, d)
    return balance.category_gaps(golden, balance.wanted_counts(golden, table(spark, d, "sample_targets")))


SHARE_GAPS = GAPS.replace("s.share * 10000", "s.share * (SELECT count(*) FROM t)")


@query(f"WITH {SHARE_GAPS} SELECT * FROM gaps")
def share_gaps(spark, d):
    return _share_gaps(spark, d)


@query(f"WITH {SHARE_GAPS} SELECT * FROM gaps WHERE gap > 0")
def share_gap_summary(spark, d):
    return balance.gap_summary(_share_gaps(spark, d))


@query(SQL["plan_per_key"].replace(GAPS, SHARE_GAPS))
def share_plan(spark, d):
    return balance.plan_per_key(_golden(spark, d), _share_gaps(spark, d))


@query()
def plan_seeds(spark, d):
    """The plan in which no message serves two keys, for gaps that grow with the table."""
    return balance.plan(_golden(spark, d), _share_gaps(spark, d))


@query(f"WITH {LAST} SELECT conv_id, l.input IS NOT NULL AS saved, coalesce(len(CASE WHEN l.input IS NULL THEN NULL ELSE l.targets END), len(c.outputs), 0)::INT AS n_outputs FROM conversations c LEFT JOIN last l USING (input)")
def saved_status(spark, d):
    """Conversations with whether they are curated; curated targets stand in for outputs."""
    last = scoring.last_wins(_golden(spark, d).select("entry_id", "input", "targets")).select("input", "targets", F.lit(True).alias("saved"))
    rows = table(spark, d, "conversations").select("conv_id", "input", "outputs").join(last, "input", "left")
    return rows.select("conv_id", F.coalesce("saved", F.lit(False)).alias("saved"), F.coalesce(F.size("targets"), F.size("outputs"), F.lit(0)).alias("n_outputs"))


@query("SELECT conv_id FROM conversations WHERE input IS NULL OR input NOT IN (SELECT input FROM golden WHERE input IS NOT NULL)")
def new_conversations(spark, d):
    return quality.new_only(table(spark, d, "conversations").select("conv_id", "input"), _golden(spark, d)).select("conv_id")


@query(f"WITH {LAST} SELECT input, entry_id, len(targets)::INT AS n_targets FROM last")
def last_entries(spark, d):
    return _last(spark, d)


def _last(spark, d):
    rows = _golden(spark, d).select(F.col("entry_id").alias("order"), "entry_id", "input", F.size("targets").alias("n_targets"))
    return scoring.last_wins(rows, "input", "order").drop("order")


@query("SELECT name, count(*) AS n, bool_or(kind = 'expense') AS expense, bool_or(kind = 'income') AS income FROM categories GROUP BY name")
def category_union(spark, d):
    """Distinct categories of both kinds."""
    kinds = [F.bool_or(F.col("kind") == k).alias(k) for k in ("expense", "income")]
    return table(spark, d, "categories").groupBy("name").agg(F.count("*").alias("n"), *kinds)


@query("SELECT DISTINCT input FROM golden WHERE input IS NOT NULL")
def distinct_inputs(spark, d):
    return _golden(spark, d).select("input").where("input is not null").distinct()


_H = r"^[\x{200e}\s]*\[(\d{1,2}/\d{1,2}/\d{2}), (\d{1,2}:\d{2}:\d{2})\] ([^:]+): (.*)$"
MESSAGES = f"""ls AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS line_no
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS s FROM documents WHERE text IS NOT NULL)),
  h AS (SELECT *, regexp_matches(line, '{_H}') AS hd FROM ls),
  n AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS msg_no FROM h),
  msgs AS (SELECT doc_id AS id, msg_no::BIGINT AS msg_no, max(CASE WHEN hd THEN try_strptime(regexp_extract(line, '{_H}', 1) || ' ' || regexp_extract(line, '{_H}', 2), '%d/%m/%y %H:%M:%S') END) AS ts,
    max(CASE WHEN hd THEN regexp_extract(line, '{_H}', 3) END) AS sender,
    string_agg(CASE WHEN hd THEN regexp_extract(line, '{_H}', 4) ELSE line END, chr(10) ORDER BY line_no) AS content FROM n WHERE msg_no > 0 GROUP BY 1, 2)"""


def _messages(spark, d):
    return chat.messages(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {MESSAGES} SELECT id, msg_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, sender, content FROM msgs")
def chat_messages(spark, d):
    return _messages(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"WITH {MESSAGES}, o AS (SELECT *, sender LIKE 'Asistente%' AS is_bot, last_value(CASE WHEN sender NOT LIKE 'Asistente%' THEN msg_no END IGNORE NULLS) OVER "
    "(PARTITION BY id ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM msgs) "
    "SELECT id, owner, count(*) FILTER (is_bot) AS replies FROM o WHERE owner IS NOT NULL GROUP BY 1, 2"
)
def chat_sessions(spark, d):
    """Replies of the assistants by the message that they answer."""
    owned = chat.sessions(_messages(spark, d), F.col("sender").startswith("Asistente"))
    return owned.groupBy("id", "owner").agg(F.count_if("is_bot").alias("replies"))


@query(
    f"WITH {MESSAGES} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT id) AS chats FROM msgs "
    "WHERE ts >= DATE '2025-03-01' AND ts < DATE '2025-09-01' GROUP BY 1"
)
def chat_days(spark, d):
    """Messages per day of half a year."""
    return _daily(_messages(spark, d).where((F.col("ts") >= F.to_date(F.lit("2025-03-01"))) & (F.col("ts") < F.date_add(F.to_date(F.lit("2025-08-31")), 1))))


def _daily(rows):
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("chats"))


@query(f"WITH {MESSAGES} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT id) AS chats FROM msgs GROUP BY 1")
def chat_all_days(spark, d):
    """Messages per day, of all days; those whose time doesn't exist under a null day."""
    return _daily(_messages(spark, d))


@query()
def chat_conversations(spark, d):
    """Users' messages with the assistants' replies to them, of all days."""
    return chat.conversations(_messages(spark, d), F.col("sender").startswith("Asistente"))


@query(
    """SELECT conv_id, pos::INT AS pos, o.type AS type, o.status AS status, nullif(trim(o.description), '') AS description, round(o.amount, 2) AS amount, o.category AS category
  FROM (SELECT conv_id, unnest(outputs) AS o, generate_subscripts(outputs, 1) - 1 AS pos FROM conversations) WHERE o IS NOT NULL"""
)
def bot_replies(spark, d):
    """Outputs written as a bot's reply and read back."""
    rows = table(spark, d, "conversations").select("conv_id", F.posexplode("outputs").alias("pos", "o")).where("o is not null")
    back = rows.select("conv_id", "pos", chat.reply_details(chat.render_reply(F.col("o"))).alias("r"))
    return back.select("conv_id", "pos", *(F.col(f"r.{k}").alias(k) for k in ("type", "status", "description", "amount", "category")))


@query(text_sql.TEXT_QUALITY.replace("{usd}", "|".join(profile.USD_MARKERS)))
def text_quality(spark, d):
    """Curated messages by reason of rejection and warning."""
    rows = _golden(spark, d).select("entry_id", quality.text_flags(F.col("input"), F.col("targets")).alias("q"))
    return rows.select("entry_id", "q.rejected", F.concat_ws(",", "q.warnings").alias("warnings"))


@query(
    """WITH x AS (SELECT entry_id, conversation_date, metadata, coalesce(list_sum(list_transform(targets, lambda t:
      (t.type IS NULL)::INT + (t.amount IS NULL)::INT + (t.currency IS NULL)::INT + (t.category IS NULL)::INT + (t.description IS NULL)::INT
      + (t.date_delta_days IS NULL)::INT + (t.date_raw_expression IS NULL)::INT + (coalesce(t.type, '') NOT IN ('EXPENSE', 'INCOME'))::INT)), 0)
      + (metadata.source IS NULL)::INT + (metadata.num_transactions IS NULL)::INT AS k FROM golden)
  SELECT entry_id, k::INT AS n_errors FROM x"""
)
def schema_errors(spark, d):
    """Errors of the entries written as JSON without nulls."""
    text = F.to_json(F.struct("input", "conversation_date", "targets", "metadata"))
    return _golden(spark, d).select("entry_id", F.size(quality.schema_errors(text)).alias("n_errors"))


def _sorted(x: str) -> str:
    return f"list_sort(list_transform({x}, lambda t, i: {{'a': coalesce(t.amount, 0), 'i': i, 't': t}}))"


def _up(field: str) -> str:
    return " <> ".join(f"upper(coalesce({side}[k].t.{field}, 'None'))" for side in ("o", "x"))


ROUND_TRIPS = f"""WITH {MATCHED}, s AS (SELECT model, len(e) AS ne, len(p) AS np, {_sorted('e')} AS o, {_sorted('p')} AS x FROM m),
  r AS (SELECT model, CASE WHEN ne <> np THEN 'length' ELSE list_filter(list_transform(range(1, ne + 1), lambda k:
    CASE WHEN {_up('type')} THEN 'type'
    WHEN CASE WHEN o[k].a > 0 THEN abs(o[k].a - x[k].a) / o[k].a > 0.05 AND abs(o[k].a - x[k].a) > 10 ELSE abs(o[k].a - x[k].a) > 0.1 END THEN 'amount'
    WHEN {_up('currency')} THEN 'currency' WHEN {_up('category')} THEN 'category'
    WHEN coalesce(o[k].t.date_delta_days, 0) <> coalesce(x[k].t.date_delta_days, 0) THEN 'date_delta' END), lambda z: z IS NOT NULL)[1] END AS reason FROM s)
  SELECT model, reason, count(*) AS n FROM r GROUP BY 1, 2"""


@query(ROUND_TRIPS)
def round_trips(spark, d):
    """Predicted against curated targets as a round trip, by model and reason of failure."""
    rows = scoring.matched(table(spark, d, "predictions").select("pred_id", "model", "input", "parsed_targets"), _golden(spark, d).select("entry_id", "input", "targets"))
    checked = roundtrip.validate(rows, "expected", "predicted")
    return checked.groupBy("model", "reason").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT entry_id, row_number() OVER (ORDER BY md5('42|' || entry_id::VARCHAR), entry_id) AS k, count(*) OVER () AS n FROM golden)
  SELECT entry_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS part FROM r"""
)
def split_parts(spark, d):
    return splits.split(_golden(spark, d).select("entry_id"), "entry_id", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query("SELECT entry_id FROM golden ORDER BY md5('42|' || entry_id::VARCHAR), entry_id LIMIT 100")
def sample_entries(spark, d):
    """A sample of a hundred entries."""
    return splits.sample(_golden(spark, d).select("entry_id"), "entry_id", 100)


def _numbered(rows):
    return rows.select("entry_id", F.posexplode("examples").alias("p", "x")).select("entry_id", "x.example_id", (F.col("p") + 1).alias("k"))


@query(
    """WITH c AS (SELECT entry_id AS e, row_number() OVER (ORDER BY md5('42|' || entry_id::VARCHAR), entry_id) AS rank FROM golden WHERE len(targets) > 0),
  h AS (SELECT entry_id, n, list_transform([n - 3, n - 2, n - 1, n], lambda j:
    ('0x' || substr(md5('42|draw|' || entry_id::VARCHAR || '|' || j::VARCHAR), 1, 15))::BIGINT % j + 1) AS t FROM golden, (SELECT count(*) AS n FROM c)),
  h2 AS (SELECT *, [t[1], CASE WHEN t[2] = t[1] THEN n - 2 ELSE t[2] END] AS s2 FROM h),
  h3 AS (SELECT *, list_append(s2, CASE WHEN list_contains(s2, t[3]) THEN n - 1 ELSE t[3] END) AS s3 FROM h2),
  d AS (SELECT entry_id, unnest(list_append(s3, CASE WHEN list_contains(s3, t[4]) THEN n ELSE t[4] END)) AS rank FROM h3),
  r AS (SELECT entry_id, e, row_number() OVER (PARTITION BY entry_id ORDER BY md5('42|' || entry_id::VARCHAR || '|' || e::VARCHAR), e) AS k
    FROM d JOIN c USING (rank) WHERE e <> entry_id)
  SELECT entry_id, e AS example_id, k::INT AS k FROM r WHERE k <= 3"""
)
def few_shot_all(spark, d):
    """Three examples for every entry, out of all entries with targets."""
    return _numbered(splits.few_shot(_golden(spark, d), 3))


@query(SQL["few_shot_all"])
def few_shot_examples(spark, d):
    """The same under its first name."""
    return few_shot_all(spark, d)


@query(text_sql.CHAT_RECORDS)
def chat_records(spark, d):
    """Entries as chat-format records."""
    record = splits.chat_record("Extract the transactions.", F.col("input"), F.col("targets"))
    return _golden(spark, d).select("entry_id", splits.chatml(record).alias("text"))


@query()
def random_intents(spark, d):
    """Random intents, as many as curated entries (some of several items)."""
    return synth.intents(_golden(spark, d).select("entry_id"), "entry_id", table(spark, d, "categories"), "2026-01-31")


@query()
def targeted_intents(spark, d):
    """Random intents for what the corpus lacks, as many as curated entries; the scarcest two expense categories are boosted."""
    golden, categories = _golden(spark, d), table(spark, d, "categories")
    names = categories.where("kind = 'expense'").select(F.col("name").alias("category")).distinct()
    counts = names.join(profile.category_counts(golden).groupBy("category").agg(F.sum("n").alias("n")), "category", "left")
    few = [r["category"] for r in counts.orderBy(F.coalesce("n", F.lit(0)), "category").limit(2).collect()]
    return synth.intents(golden.select("entry_id"), "entry_id", categories, "2026-01-31", targeted=True, boosted=tuple(few))


@query()
def forward_yield(spark, d):
    """Yield by tone of messages made from as many random intents as there are curated entries."""
    made = generation.forward(random_intents(spark, d), units.amount_terms(table(spark, d, "amount_terms")))
    return generation.yields(made, "tone")


@query()
def planned_variants(spark, d):
    """Variants of curated messages that the plan asks for, by key, with rejected ones and warnings; gaps grow with the table."""
    made = generation.variants(share_plan(spark, d), _golden(spark, d))
    return made.groupBy("target_key").agg(
        F.count("*").alias("generated"), F.count_if(F.col("rejected").isNotNull()).alias("rejected"), F.sum(F.size("warnings")).alias("warnings")
    )


@query()
def plan_dry_run(spark, d):
    """What the plan would generate, before it does."""
    return balance.dry_run(plan_seeds(spark, d), _golden(spark, d))


@query()
def non_transactional_messages(spark, d):
    """Messages without a transaction, as many as there are curated entries without targets."""
    return generation.non_transactional(_golden(spark, d).where(F.coalesce(F.size("targets"), F.lit(0)) < 1))


@query("SELECT DISTINCT input FROM conversations WHERE input IS NOT NULL")
def stream_first_messages(spark, d):
    """Distinct messages by a stream with state."""
    return pipelines.run_once(pipelines.first_messages(pipelines.table_stream(spark, d, "conversations")), "first-messages")


@query("SELECT strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS conversations, sum(coalesce(len(outputs), 0))::BIGINT AS outputs FROM conversations GROUP BY 1")
def stream_daily_counts(spark, d):
    """Conversations per day of arrival by a stream."""
    return pipelines.run_once(pipelines.daily_counts(pipelines.table_stream(spark, d, "conversations")), "daily-counts", "complete")
