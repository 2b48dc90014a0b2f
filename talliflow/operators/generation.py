"""Generating labelled messages: forward from random intents with a round trip, and in reverse as variants of curated messages.

A language model is a function over batches, run by ``mapInPandas`` (:func:`with_model`). The functions here that need no model render and read messages by
rules, so the pipelines run, and are tested, without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliflow.functions.text import dotted_thousands
from talliflow.operators import quality, roundtrip, units
from talliflow.operators.synth import DATES
from talliflow.schemas import TARGETS

Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: Characters that a generated message may have.
LONGEST = 500
#: How variants begin and end.
OPENINGS = ["", "hola! ", "che, ", "anotá: ", "buenas, ", "perdón la demora, "]
ENDINGS = ["", " gracias", "!", ".", " por favor"]

#: What messages without a transaction ask or say.
SMALL_TALK = ["cómo estás?", "qué podés hacer?", "quién sos?", "cómo te uso?", "después te escribo", "no era nada", "todo bien por allá?", "me ayudás con otra cosa?"]


def with_model(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """Rows run through a model in batches, as many at once as there are partitions."""
    return rows.mapInPandas(model, schema)


def intent_lists(intents: DataFrame) -> DataFrame:
    """``id, tone, original``: the items of each intent as a target list, in order."""
    t = F.struct(
        "type", "amount", "currency", "category", F.lit("").alias("description"), "date_delta_days", "date_raw_expression"
    )
    items = F.array_sort(F.collect_list(F.struct("item", t.alias("t"))))
    return intents.groupBy("id", "tone").agg(F.transform(items, lambda x: x["t"]).alias("original"))


def _spoken(t: Column, slang: Column) -> Column:
    amount = t["amount"]
    whole = amount == F.floor(amount)
    plain = dotted_thousands(amount)
    plain = F.when(whole, F.substring(plain, F.lit(1), F.length(plain) - 3)).otherwise(plain)
    lucas = F.concat((amount / 1000).cast("bigint").cast("string"), F.lit(" lucas"))
    number = F.when(slang & whole & (amount >= 1000) & (amount % 1000 == 0), lucas).otherwise(plain)
    verb = F.when(t["type"] == "INCOME", "cobré ").otherwise("gasté ")
    unit = F.when(t["currency"] == "USD", " usd").otherwise("")
    when = F.coalesce(F.concat(F.lit(" "), t["date_raw_expression"]), F.lit(""))
    return F.concat(verb, number, unit, F.lit(" en "), F.coalesce(t["category"], F.lit("")), when)


def render(lists: DataFrame) -> DataFrame:
    """``lists`` with ``text``: a message that names the items in order."""
    slang = F.col("tone") == "SLANG_CHAOTIC"
    return lists.withColumn("text", F.array_join(F.transform("original", lambda t: _spoken(t, slang)), " y "))


def read_back(rows: DataFrame, terms: list[tuple[str, float, str | None]]) -> DataFrame:
    """``rows`` with ``extracted``: the targets that ``text`` names, read by rules.

    Amounts and currencies come from the unit terms, types from the verb, categories from the word after ``en`` and dates from what follows.
    """
    deltas = F.create_map(*(F.lit(x) for d, e, _ in DATES if d is not None and e for x in (e, d)))
    parts = F.split("text", r" y (?=gasté|cobré)")
    found = rows.withColumn("_m", units.mention_column(terms, F.col("text"))).withColumn("_p", parts)

    def target(p: Column, m: Column) -> Column:
        when = F.nullif(F.regexp_extract(p, r" en \S* (.+)$", 1), F.lit(""))
        return F.struct(
            F.when(p.startswith("cobré"), "INCOME").otherwise("EXPENSE").alias("type"),
            (m["number"] * m["factor"]).alias("amount"),
            F.coalesce(m["currency"], F.lit("ARS")).alias("currency"),
            F.regexp_extract(p, r" en (\S*)", 1).alias("category"),
            F.lit("").alias("description"),
            F.when(when.isNull(), 0).otherwise(deltas[when]).alias("date_delta_days"),
            when.alias("date_raw_expression"),
        )

    return found.withColumn("extracted", F.zip_with("_p", "_m", target).cast(TARGETS)).drop("_m", "_p")


def forward(intents: DataFrame, terms: list[tuple[str, float, str | None]]) -> DataFrame:
    """``id, tone, text, original, extracted, reason, final_targets``: messages made from intents and what is wrong with them.

    ``reason`` is ``length of text`` for an empty or too long message, else the round trip's; null for a valid message.
    """
    rows = read_back(render(intent_lists(intents)), terms)
    checked = roundtrip.validate(rows, "original", "extracted")
    fits = F.length("text").between(1, LONGEST)
    return checked.withColumn("reason", F.when(~fits, "length of text").otherwise(F.col("reason")))


def yields(generated: DataFrame, *by: str) -> DataFrame:
    """Attempts, valid messages and their percentage."""
    ok = F.count_if(F.col("reason").isNull())
    return generated.groupBy(*by).agg(F.count("*").alias("attempts"), ok.alias("valid"), F.round(F.lit(100.0) * ok / F.count("*"), 1).alias("yield_pct"))


def variants(plan: DataFrame, golden: DataFrame) -> DataFrame:
    """``target_key, text, targets, rejected, warnings``: as many variants of each planned message as the plan says.

    A variant is the message with another opening and ending, chosen by its number and the message's digest. The targets are those of the
    message's first entry.
    """
    first = golden.where("input is not null").groupBy("input").agg(F.min_by("targets", "entry_id").alias("targets"))
    rows = plan.join(first, "input").select("target_key", "input", "targets", F.explode(F.sequence(F.lit(1), F.col("n_variants").cast("int"))).alias("k"))

    def pick(options: list[str], salt: int) -> Column:
        return F.element_at(F.array(*(F.lit(o) for o in options)), (F.pmod(F.xxhash64("input", F.lit(salt)) + F.col("k"), F.lit(len(options))) + 1).cast("int"))

    text = F.concat(pick(OPENINGS, 1), F.col("input"), pick(ENDINGS, 2))
    flags = quality.text_flags(F.col("text"), F.col("targets"), strict_amount=False)
    out = rows.withColumn("text", text).withColumn("q", flags)
    return out.select("target_key", "text", "targets", "q.rejected", "q.warnings")


def non_transactional(rows: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """``id, text, targets, rejected, warnings``: a message without a transaction, with no targets, for every row.

    Opening, words and ending are chosen by the row's id. A model's texts take the place of these by :func:`with_model`.
    """
    def pick(options: list[str], salt: int) -> Column:
        return F.element_at(F.array(*(F.lit(o) for o in options)), (F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(len(options))) + 1).cast("int"))

    text = F.concat(pick(OPENINGS, 3), pick(SMALL_TALK, 4), pick(ENDINGS, 5))
    made = rows.select(F.col(id_col).alias("id"), text.alias("text"), F.array().cast(TARGETS).alias("targets"))
    return made.withColumn("q", quality.text_flags(F.col("text"), F.col("targets"))).select("id", "text", "targets", "q.rejected", "q.warnings")


def entries_of(accepted: DataFrame, source: str, day: str) -> DataFrame:
    """Curated entries from accepted texts: ``input, conversation_date, targets, metadata``."""
    meta = F.struct(F.lit(source).alias("source"), F.size("targets").alias("num_transactions"))
    return accepted.where("rejected is null").select(F.col("text").alias("input"), F.lit(day).alias("conversation_date"), "targets", meta.alias("metadata"))
