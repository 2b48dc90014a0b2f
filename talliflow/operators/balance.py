"""Gaps between wanted and present numbers of categories, and a plan of seeds to fill them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.operators.profile import items
from talliflow.session import shared_path

#: Variants of one seed, at most.
PER_SEED = 5
#: Entries of one range in which a key's seeds are numbered.
RANGE_ENTRIES = 100_000


def key_of(t: Column) -> Column:
    """``TYPE:Category`` of a target."""
    return F.concat_ws(":", t["type"], t["category"])


def wanted_counts(golden: DataFrame, shares: DataFrame) -> DataFrame:
    """``ord, target_key, target``: each key's share of as many targets as the table has."""
    n = items(golden, "targets", ["type"]).agg(F.count("*").alias("n"))
    return shares.crossJoin(F.broadcast(n)).select("ord", "target_key", F.round(F.col("share") * F.col("n")).cast("bigint").alias("target"))


def category_gaps(golden: DataFrame, wanted: DataFrame) -> DataFrame:
    """``ord, target_key, target, current, gap`` of every wanted key; counts of other keys are dropped, absent ones are 0."""
    counts = items(golden, "targets", ["type", "category"]).groupBy(key_of(F.col("t")).alias("target_key")).agg(F.count("*").alias("n"))
    out = wanted.join(counts, "target_key", "left").withColumn("current", F.coalesce("n", F.lit(0)))
    return out.select("ord", "target_key", "target", "current", F.greatest(F.lit(0), F.col("target") - F.col("current")).alias("gap"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Open gaps, the largest first, equal ones in the order of the targets."""
    return gaps.where("gap > 0").orderBy(F.desc("gap"), "ord")


def seeds(golden: DataFrame, keys: DataFrame) -> DataFrame:
    """``target_key, input, first_entry``: distinct messages of the wanted keys with the entry that names them first."""
    rows = golden.where("input is not null").select("entry_id", "input", F.explode(F.arrays_zip("targets.type", "targets.category")).alias("t"))
    rows = rows.select("entry_id", "input", key_of(F.col("t")).alias("target_key")).join(keys.select("target_key"), "target_key", "left_semi")
    return rows.groupBy("target_key", "input").agg(F.min("entry_id").alias("first_entry"))


def first_seeds(found: DataFrame, open_gaps: DataFrame) -> DataFrame:
    """``target_key, input, rn, n_variants``: each key's gap spread over its seeds in order, at most ``PER_SEED`` each.

    A key's seeds are numbered within ranges of entries, and the sizes of the ranges before added. An entry is a key's seed once at most, so no
    task ranks more than ``RANGE_ENTRIES`` seeds of a key, however large its gap.
    """
    rows = found.withColumn("_b", F.floor(F.col("first_entry") / RANGE_ENTRIES))
    before = W.partitionBy("target_key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("target_key", "_b").agg(F.count("*").alias("_n"))
    ranges = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranges = ranges.join(open_gaps.select("target_key", "gap"), "target_key").where(F.col("_o") * PER_SEED < F.col("gap"))
    inside = rows.join(ranges, ["target_key", "_b"])
    rank = F.row_number().over(W.partitionBy("target_key", "_b").orderBy("first_entry", "input"))
    ranked = inside.withColumn("rn", F.col("_o") + rank)
    n = F.least(F.lit(PER_SEED), F.col("gap") - PER_SEED * (F.col("rn") - 1))
    return ranked.select("target_key", "input", F.col("rn").cast("int").alias("rn"), n.alias("n_variants")).where("n_variants > 0")


def plan_per_key(golden: DataFrame, gaps: DataFrame) -> DataFrame:
    """``target_key, input, rn, n_variants``: the seeds of every key. Keys are looked at one by one, so a message may serve two keys."""
    open_gaps = gaps.where("gap > 0")
    return first_seeds(seeds(golden, open_gaps), open_gaps)


def plan(golden: DataFrame, gaps: DataFrame, most_keys: int = 1000) -> DataFrame:
    """``step, target_key, input, n_variants``: keys by falling gap, and no message serves two keys.

    One step for each open gap, of which there are as many as wanted keys; a step ranks only the seeds that can still be used. The
    message of a seed is taken by the first key that reaches it. Seeds and the steps' plans are written tables, as both grow with the data.
    """
    spark = golden.sparkSession
    open_gaps = gaps.where("gap > 0")
    todo = gap_summary(gaps).select("target_key", "gap").limit(most_keys + 1).collect()
    if len(todo) > most_keys:
        raise ValueError(f"more than {most_keys} keys to fill")
    columns = "target_key string, input string, n_variants int"
    if not todo:
        return spark.createDataFrame([], f"step int, {columns}")
    path = shared_path(spark, f"seeds-{uuid.uuid4().hex}")
    seeds(golden, open_gaps).write.partitionBy("target_key").parquet(f"{path}/seeds")
    own = spark.read.schema("input string, first_entry bigint, target_key string").parquet(f"{path}/seeds")

    def planned() -> DataFrame:
        return spark.read.schema(f"{columns}, step int").parquet(f"{path}/plan").select("step", "target_key", "input", "n_variants")

    for step, g in enumerate(todo, 1):
        mine = own.where(F.col("target_key") == g["target_key"])
        if step > 1:
            mine = mine.join(planned().select("input"), "input", "left_anti")
        gap = spark.createDataFrame([(g["target_key"], g["gap"])], "target_key string, gap long")
        part = first_seeds(mine, gap).select("target_key", "input", F.col("n_variants").cast("int"))
        part.write.parquet(f"{path}/plan/step={step}")
    return planned()


def dry_run(planned: DataFrame, golden: DataFrame, width: int = 60) -> DataFrame:
    """``key, start, n_variants``: what a plan would generate, by the first target of the message's first entry and the message's first characters."""
    rows = golden.where("input is not null")
    first = rows.groupBy("input").agg(F.min_by(F.struct(F.get("targets", F.lit(0)).alias("t"), (F.size("targets") > 0).alias("some")), "entry_id").alias("f"))
    part = [F.when(F.col("f.some"), F.col(f"f.t.{k}")).otherwise(other) for k, other in (("type", "N/A"), ("category", "non-tx"))]
    key = F.concat_ws(":", *part).alias("key")
    return planned.join(first, "input").select(key, F.substring("input", 1, width).alias("start"), "n_variants")
