"""Weighted random intents, decided by digests of a row's id, so that a lost task draws the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of tone, number of items, type, amount band, currency and date of a random intent.
TONES = [("SLANG_CHAOTIC", 0.6), ("CASUAL_EXACT", 0.2), ("FORMAL_BANK_COPY", 0.2)]
MULTI_SHARE = 0.20
EXPENSE_SHARE = {False: 0.73, True: 0.90}
BANDS = [(50, 2000, 0.15), (2000, 15000, 0.25), (15000, 80000, 0.25), (80000, 300000, 0.20), (300000, 1000000, 0.10), (1000000, 5000000, 0.05)]
WHOLE_SHARE = {"SLANG_CHAOTIC": 0.8, "CASUAL_EXACT": 0.5, "FORMAL_BANK_COPY": 0.0}
ARS_SHARE = 0.8
DATES = [
    (0, None, 0.29), (0, "hoy", 0.10), (-1, "ayer", 0.15), (-2, "anteayer", 0.08), (-3, "hace 3 dias", 0.05), (-5, "hace 5 dias", 0.04),
    (-7, "hace una semana", 0.08), (-10, "hace 10 dias", 0.04), (-14, "hace dos semanas", 0.05), (-30, "el mes pasado", 0.04),
    (None, "natural", 0.03), (None, "short", 0.02), (None, "long", 0.03),
]
#: Weights of the dates in their order, and expense categories with their weight, where intents are targeted; lengths of messages.
TARGETED_DATES = [0.0, 0.0, 0.20, 0.12, 0.10, 0.08, 0.15, 0.08, 0.10, 0.05, 0.05, 0.03, 0.04]
BOOSTED, BOOST = ("Hogar_Mascotas", "Deporte_Fitness"), 5
LENGTHS = [("SHORT", 0.70), ("MEDIUM", 0.20), ("LONG", 0.10)]
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def uniform(name: str, *ids: Column) -> Column:
    """A number in [0, 1) from the MD5 of a name and ids."""
    text = F.concat_ws("|", F.lit(name), *(i.cast("string") for i in ids))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def choose(u: Column, options: list[tuple]) -> Column:
    """The option (all of a tuple but its last part, the weight) under which a uniform number falls."""
    out, upto = None, 0.0
    for *value, weight in options:
        upto += weight
        v = value[0] if len(value) == 1 else F.struct(*(x if isinstance(x, Column) else F.lit(x) for x in value))
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(u < round(upto, 10), v) if out is None else out.when(u < round(upto, 10), v)
    *value, _ = options[-1]
    return out.otherwise(value[0] if len(value) == 1 else F.struct(*(F.lit(x) for x in value)))


def intents(
    ids: DataFrame, id_col: str, categories: DataFrame, anchor: str, targeted: bool = False, boosted: tuple[str, ...] = BOOSTED
) -> DataFrame:
    """``id, item, tone, length, type, amount, currency, category, date_delta_days, date_raw_expression``: one to three intents per row of ``ids``.

    Absolute dates lie 1 to 90 days before ``anchor``. Categories are chosen evenly among those of the type; their list is a small dimension.
    ``targeted`` intents are mostly expenses, never of today, and ``boosted`` expense categories come ``BOOST`` times as often as others.
    """
    i = F.col(id_col)
    tone = choose(uniform("tone", i), TONES)
    n = F.when(uniform("multi", i) < MULTI_SHARE, F.when(uniform("items", i) < 0.5, 2).otherwise(3)).otherwise(1)
    length = choose(uniform("length", i), LENGTHS)
    rows = ids.select(i.alias("id"), tone.alias("tone"), length.alias("length"), F.explode(F.sequence(F.lit(1), n)).alias("item"))
    key = (F.col("id"), F.col("item"))
    rows = rows.withColumn("type", F.when(uniform("type", *key) < EXPENSE_SHARE[targeted], "EXPENSE").otherwise("INCOME"))
    band = choose(uniform("band", *key), [(float(a), float(b), w) for a, b, w in BANDS])
    names = ["low", "high"]
    rows = rows.withColumn("_b", band).withColumn("_b", F.col("_b").cast("struct<" + ",".join(f"{k}:double" for k in names) + ">"))
    raw = F.round(F.col("_b.low") + uniform("amount", *key) * (F.col("_b.high") - F.col("_b.low")), 2)
    whole = uniform("whole", *key) < F.element_at(F.create_map(*(F.lit(x) for kv in WHOLE_SHARE.items() for x in kv)), F.col("tone"))
    rows = rows.withColumn("amount", F.when(whole, F.floor(raw).cast("double")).otherwise(raw))
    rows = rows.withColumn("currency", F.when(uniform("currency", *key) < ARS_SHARE, "ARS").otherwise("USD"))
    lists = categories.groupBy(F.upper("kind").alias("type")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    if targeted and boosted:
        repeated = F.transform("names", lambda x: F.array_repeat(x, F.when(x.isin(*boosted) & (F.col("type") == "EXPENSE"), BOOST).otherwise(1)))
        lists = lists.withColumn("names", F.flatten(repeated))
    rows = rows.join(F.broadcast(lists), "type", "left")
    pick = F.floor(uniform("category", *key) * F.size("names")).cast("int")
    rows = rows.withColumn("category", F.get("names", pick))
    dates = [(*x[:-1], w) for x, w in zip(DATES, TARGETED_DATES)] if targeted else DATES
    date = choose(uniform("date", *key), dates).cast("struct<delta:int,expr:string>")
    day = F.date_sub(F.to_date(F.lit(anchor)), (F.floor(uniform("day", *key) * 90) + 1).cast("int"))
    month = F.element_at(F.array(*(F.lit(m) for m in MONTHS)), F.month(day))
    rows = rows.withColumn("_d", date)
    expr = (
        F.when(F.col("_d.delta").isNotNull(), F.col("_d.expr"))
        .when(F.col("_d.expr") == "short", F.date_format(day, "d/MM"))
        .when(F.col("_d.expr") == "long", F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.concat(F.lit("el "), F.day(day).cast("string"), F.lit(" de "), month))
    )
    return rows.select(
        "id", "item", "tone", "length", "type", "amount", "currency", "category", F.col("_d.delta").alias("date_delta_days"), expr.alias("date_raw_expression")
    )
