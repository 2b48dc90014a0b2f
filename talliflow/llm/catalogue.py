"""Queries of the training-text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliflow.functions.text import loose_key
from talliflow.llm import canonical, defects, formatting, mixing, packing, reading, sampling
from talliflow.session import table


#: Size of the sample as a part of all usable targets.
SAMPLE_FRACTION = 0.2


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.matching_sample(table(spark, d, "golden"), table(spark, d, "sample_targets"), SAMPLE_FRACTION, refill=True)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("short").select("target_key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and drawn numbers of every key."""
    return _sample(spark, d)[1]


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn targets."""
    return _sample(spark, d)[0].select("entry_id", "target_no", "target_key", "picked")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = formatting.same_messages(table(spark, d, "conversations"), "conv_id", "input")
    return pairs.where("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One conversation per message with its number of copies."""
    rows = table(spark, d, "conversations").select("conv_id", "chat_id", "input")
    return formatting.collapse(rows, "conv_id", "input")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(table(spark, d, "predictions")).where("defect is not null").select("pred_id", "defect")


def p3_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each model by kind of defect and, for truncated ones, by what tells it."""
    rows = table(spark, d, "predictions")
    found = defects.find_defects(rows)
    return found.join(rows.select("pred_id", "model"), "pred_id").groupBy("model", "defect", "evidence").agg(F.count("*").alias("n"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "predictions"), table(spark, d, "canonical_values"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("pred_id", "target_no", "field", "canonical")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that fit no entry, with how often each occurs."""
    return canonical.unmatched_report(_mapped(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("piece_no = 2").select(F.col("id").alias("doc_id")).distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text or part of a text and its container."""
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.packing_report(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of the sources."""
    return _mixed(spark, d)[1]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mix and their places in it."""
    return _mixed(spark, d)[0]


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level = 3").select("doc_id")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by level."""
    docs = table(spark, d, "documents").select("doc_id", loose_key(F.col("source")).alias("source"))
    return _levels(spark, d).join(docs, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_sample": p1_sample,
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_by_model": p3_by_model,
    "p8_found": p8_found,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_mix": p9_mix,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
}


def _loose(x: str) -> str:
    return f"regexp_replace(lower(trim({x}, E' \\t\\n\\r')), '[\\s_-]+', '_', 'g')"


SQL: dict[str, str] = {
    "p1_found": f"""WITH t AS (SELECT unnest(targets) AS t FROM golden),
  k AS (SELECT target_key, share, min_rows, {_loose("split_part(target_key, ':', 1)")} AS a, {_loose("split_part(target_key, ':', 2)")} AS b FROM sample_targets),
  u AS (SELECT k.target_key FROM t JOIN k ON {_loose('t.type')} = a AND {_loose('t.category')} = b),
  c AS (SELECT target_key, count(*) AS n FROM u GROUP BY 1)
  SELECT k.target_key FROM k LEFT JOIN c USING (target_key)
  WHERE coalesce(n, 0) < share * {SAMPLE_FRACTION} * (SELECT count(*) FROM u) OR coalesce(n, 0) < min_rows""",
}
