"""Checks of generated texts and entries, and of requests to save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliflow.functions.text import dotted_thousands, strip
from talliflow.operators.profile import USD_MARKERS

#: Keys of an entry, of its targets and of its metadata.
TOP_KEYS = ["input", "targets", "metadata", "conversation_date"]
TARGET_KEYS = ["type", "amount", "currency", "category", "description", "date_delta_days", "date_raw_expression"]
META_KEYS = ["source", "num_transactions"]


def amount_in_text(text: Column, amount: Column) -> Column:
    """Whether an amount stands in a text: its digits, thousands with a scale word, two decimals, or with separators.

    This is the strict form; the lenient one takes every text for plausible.
    """
    whole = amount == F.floor(amount)
    n = F.when(whole, amount.try_cast("decimal(20,0)").cast("string"))
    k = F.when(whole & (amount >= 1000) & (amount % 1000 == 0), (amount / 1000).try_cast("decimal(20,0)").cast("string"))
    bare = F.translate(text, "., ", "")
    low = F.translate(F.lower(text), "$ ", "")
    two = F.replace(F.format_number(amount, 2), F.lit(","))  # rounds the binary value
    dotted = dotted_thousands(amount)
    dotted = F.when(dotted.endswith(",00"), F.substring(dotted, F.lit(1), F.length(dotted) - 3)).otherwise(dotted)
    hits = [bare.contains(n), *(low.contains(F.concat(k, F.lit(s))) for s in ("mil", "k", "lucas", "palos")), text.contains(two)]
    hits += [text.contains(F.translate(two, ".", ",")), F.when(amount >= 1000, text.contains(dotted))]
    return F.exists(F.array(*(F.coalesce(h, F.lit(False)) for h in hits)), lambda h: h)


def text_flags(text: Column, targets: Column, strict_amount: bool = True) -> Column:
    """Struct of ``rejected`` (a reason or null) and ``warnings`` of a generated message.

    Empty texts and texts that look like JSON are rejected. Warnings: over 500 characters, the only target's amount isn't found, a
    dollar target without a word for dollars.
    """
    body = strip(F.coalesce(text, F.lit("")))
    looks = body.startswith("{") | body.startswith("[")
    rejected = F.when(body == "", "empty").when(looks, "json")
    low = F.lower(text)
    says = F.exists(F.array(*(F.lit(m) for m in USD_MARKERS)), lambda m: F.contains(low, m))
    usd = F.coalesce(F.exists(targets, lambda t: F.coalesce(t["currency"] == "USD", F.lit(False))), F.lit(False))
    first = F.get(targets, F.lit(0))
    found = amount_in_text(text, first["amount"]) if strict_amount else F.lit(True)
    warnings = F.array_compact(
        F.array(
            F.when(F.length(text) > 500, "long"),
            F.when((F.size(targets) == 1) & first["amount"].isNotNull() & ~found, "amount"),
            F.when(usd & ~says, "currency"),
        )
    )
    return F.struct(rejected.alias("rejected"), F.when(rejected.isNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def schema_errors(entry: Column) -> Column:
    """Array of what an entry's JSON text lacks: top keys (nothing else is looked at if one is missing), keys and types of targets, keys of metadata.

    A text that is no JSON object has the error ``not an object``.
    """
    v = F.try_parse_json(entry)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    top = F.transform(F.array_except(F.array(*(F.lit(k) for k in TOP_KEYS)), keys), lambda k: F.concat(F.lit("missing "), k))
    targets = F.coalesce(F.try_variant_get(v, "$.targets", "array<variant>"), F.array().cast("array<variant>"))

    def of(t: Column, i: Column) -> Column:
        have = F.map_keys(F.try_variant_get(t, "$", "map<string,variant>"))
        missing = F.transform(
            F.array_except(F.array(*(F.lit(k) for k in TARGET_KEYS)), F.coalesce(have, F.array().cast("array<string>"))),
            lambda k: F.concat(F.lit("target "), i.cast("string"), F.lit(" missing "), k),
        )
        bad = ~F.coalesce(F.try_variant_get(t, "$.type", "string").isin("EXPENSE", "INCOME"), F.lit(False))
        return F.concat(missing, F.when(bad, F.array(F.concat(F.lit("target "), i.cast("string"), F.lit(" invalid type")))).otherwise(F.array().cast("array<string>")))

    meta = F.coalesce(F.map_keys(F.try_variant_get(v, "$.metadata", "map<string,variant>")), F.array().cast("array<string>"))
    meta_missing = F.transform(F.array_except(F.array(*(F.lit(k) for k in META_KEYS)), meta), lambda k: F.concat(F.lit("metadata missing "), k))
    return (
        F.when(keys.isNull(), F.array(F.lit("not an object")))
        .when(F.size(top) > 0, top)
        .otherwise(F.concat(F.flatten(F.transform(targets, of)), meta_missing))
    )


def save_request(requests: DataFrame) -> DataFrame:
    """Requests to save (all fields as text but ``targets``, an array of structs of text) with ``error`` and the ``entry`` to store.

    The first missing field is the error. Of a target's date, an empty expression is null, and an empty or missing delta is 0 without an expression
    and null with one. Types are stored in upper case, amounts and deltas as numbers; what isn't a number is an error.
    """
    def date_parts(t: Column) -> tuple[Column, Column]:
        expr = F.nullif(t["date_raw_expression"], F.lit(""))
        delta = F.nullif(t["date_delta_days"], F.lit(""))
        return F.when(delta.isNotNull(), delta.try_cast("int")).when(expr.isNull(), 0), expr

    def target(t: Column) -> Column:
        delta, expr = date_parts(t)
        return F.struct(
            F.upper(t["type"]).alias("type"), t["amount"].try_cast("double").alias("amount"), t["currency"].alias("currency"), t["category"].alias("category"),
            t["description"].alias("description"), delta.alias("date_delta_days"), expr.alias("date_raw_expression"),
        )

    def lacks(name: str) -> Column:
        return F.exists("targets", lambda t: t[name].isNull())

    error = F.when(F.col("input").isNull(), "missing input").when(F.col("conversation_date").isNull(), "missing conversation_date").when(
        F.col("targets").isNull(), "missing targets"
    )
    for name in ("type", "amount", "currency", "category", "description"):
        error = error.when(lacks(name), f"missing {name}")
    error = error.when(F.exists("targets", lambda t: t["amount"].try_cast("double").isNull()), "amount is no number")
    entry = F.struct("input", "conversation_date", F.transform("targets", target).alias("targets"), F.size("targets").alias("num_transactions"))
    out = requests.withColumn("error", error)
    return out.withColumn("entry", F.when(F.col("error").isNull(), entry))


def new_only(entries: DataFrame, golden: DataFrame, key: str = "input") -> DataFrame:
    """Entries whose message isn't curated yet. Null messages are kept, as they equal nothing."""
    return entries.join(golden.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
