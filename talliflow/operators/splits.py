"""Samples, splits, few-shot examples and chat-format records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.functions.udfs import dumps

#: Rows of one bucket of a ranking, about, and hexadecimal digits of the digest that make the buckets, at most.
BUCKET_ROWS, MAX_DIGITS = 100_000, 5


def digest(seed: str, *ids: Column) -> Column:
    """A text that is in random order for different seeds: the MD5 of seed and ids."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(i.cast("string") for i in ids)))


def shuffled_rank(rows: DataFrame, seed: str, id_col: str, n: int) -> DataFrame:
    """``rows``, about ``n`` of them, with ``rank``, from 1, in a random order of all rows.

    Buckets by the first digits of the digest are ranked apart and the sizes of the buckets before added, so no task sorts the table. Rows
    with the same id come in any order.
    """
    digits = min(MAX_DIGITS, max(1, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16)))) if n > BUCKET_ROWS else 1
    h = rows.withColumn("_d", digest(seed, F.col(id_col))).withColumn("_b", F.substring("_d", 1, digits))
    sizes = h.groupBy("_b").agg(F.count("*").alias("_n"))
    # at most 16 ** MAX_DIGITS rows of two numbers
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = h.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_d", id_col)))
    out = inside.join(F.broadcast(before), "_b")
    return out.select(*rows.columns, (F.col("_o") + F.col("_r")).alias("rank"))


def split(rows: DataFrame, id_col: str, shares: dict[str, float], seed: str = "42") -> DataFrame:
    """``rows`` with ``part``: exact sizes, each share rounded down, the rest to the last part."""
    n = rows.count()
    ranked = shuffled_rank(rows, seed, id_col, n)
    part, upto, names = None, 0, list(shares)
    for name in names[:-1]:
        upto += math.floor(n * shares[name])
        cond = F.col("rank") <= upto
        part = F.when(cond, name) if part is None else part.when(cond, name)
    part = F.lit(names[-1]) if part is None else part.otherwise(names[-1])
    return ranked.withColumn("part", part).drop("rank")


def sample(rows: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows at random: the same ones whenever it runs."""
    return rows.orderBy(digest(seed, F.col(id_col)), id_col).limit(n)


def distinct_numbers(k: int, n: int, seed: str, *ids: Column) -> Column:
    """``k`` distinct numbers from 1 to ``n`` (all if there are fewer), every set of them as likely: Floyd's algorithm over digests."""
    if n < 1:
        return F.array().cast("array<bigint>")
    upto = F.sequence(F.lit(max(1, n - k + 1)).cast("bigint"), F.lit(n).cast("bigint"))
    # 60 bits of the digest
    number = lambda j: F.conv(F.substring(digest(seed, F.lit("draw"), *ids, j), 1, 15), 16, 10).cast("bigint") % j + 1
    drawn = F.transform(upto, lambda j: F.struct(j.alias("j"), number(j).alias("t")))
    return F.aggregate(
        drawn,
        F.array().cast("array<bigint>"),
        lambda found, x: F.concat(found, F.array(F.when(F.array_contains(found, x["t"]), x["j"]).otherwise(x["t"]))),
    )


def few_shot(rows: DataFrame, k: int, seed: str = "42") -> DataFrame:
    """``entry_id, examples``: ``k`` other entries with targets for every entry, in a random order of its own.

    All entries with targets are candidates. They are numbered once; every entry draws one number more than it needs, in case its own is among them,
    and numbers are joined to candidates.
    """
    candidates = rows.where(F.size("targets") > 0).select("entry_id", "input")
    n = candidates.count()
    ranked = shuffled_rank(candidates, seed, "entry_id", n).select("rank", F.col("entry_id").alias("example_id"), "input")
    own = F.col("entry_id")
    draws = rows.select("entry_id", F.explode_outer(distinct_numbers(k + 1, n, seed, own)).alias("rank"))
    other = F.struct(digest(seed, own, F.col("example_id")).alias("d"), "example_id", "input")
    found = draws.join(ranked, "rank", "left").withColumn("x", F.when(F.col("example_id") != own, other))
    return found.groupBy("entry_id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("examples"))


def chat_record(system: str, message: Column, targets: Column) -> Column:
    """Three turns: system, user and the assistant's targets as JSON text. Null targets answer with an empty list."""
    turns = [("system", F.lit(system)), ("user", F.coalesce(message, F.lit(""))), ("assistant", F.coalesce(dumps(targets), F.lit("[]")))]
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def chatml(messages: Column) -> Column:
    """Messages as one plain text with role marks."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>")))
    return F.array_join(parts, "\n")


def prompt(system: str | None, examples: Column | None, message: Column) -> Column:
    """Prompt turns: system (if any), user and assistant turns of examples (arrays of structs input, answer), the message."""
    def turn(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    parts = [F.array(turn("system", F.lit(system)))] if system else []
    if examples is not None:
        parts.append(F.flatten(F.transform(examples, lambda x: F.array(turn("user", x["input"]), turn("assistant", x["answer"])))))
    return F.concat(*parts, F.array(turn("user", message)))
