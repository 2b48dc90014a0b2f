"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliflow import schemas
from talliflow.operators import chat
from talliflow.operators.scoring import last_wins

BAD_LINE = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """One row per non-blank line. ``strict`` fails at a bad line, else bad lines come with their text in ``_corrupt_record``.

    A missing file is an error, or an empty table with ``missing_ok``.
    """
    reader = spark.read.option("ignoreNullFields", "false")
    try:
        if strict:
            return reader.schema(schema).option("mode", "FAILFAST").json(path)
        full = f"{schema}, {BAD_LINE} string"
        return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).json(path)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema if strict else f"{schema}, {BAD_LINE} string")
        raise


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: lines of text files in order; files are spread, the lines of one stay in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``at, line``: lines of text files that many tasks read, with what orders them: file, start of the block and place in it.

    A task reads a block's lines in order, so its running number orders those of one block.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return spark.read.text(path).select(at.alias("at"), F.col("value").alias("line"))


def golden(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """Curated entries of either form: the older single ``target`` becomes a list of one."""
    rows = jsonl(spark, path, schemas.GOLDEN, strict=False, missing_ok=missing_ok).where(f"{BAD_LINE} is null")
    targets = F.coalesce("targets", F.when(F.col("target").isNotNull(), F.array("target")))
    return rows.select("input", "conversation_date", targets.alias("targets"), "metadata")


def golden_map(spark: SparkSession, path: str) -> DataFrame:
    """Curated entries by message, the last line of a message wins; a bad line or a missing file is an error."""
    lines = lines_in_order(spark, path).where(F.trim("line") != "")
    parsed = lines.select("at", F.from_json("line", schemas.GOLDEN, {"mode": "FAILFAST"}).alias("r")).select("at", "r.*")
    return last_wins(parsed, "input", "at").drop("at", "target")


def usable_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Curated lines that have a message and targets, and one row with the numbers of all and of skipped lines."""
    rows = jsonl(spark, path, schemas.GOLDEN, strict=False)
    good = F.col(BAD_LINE).isNull() & F.col("input").isNotNull() & F.col("targets").isNotNull()
    # the reader may not be asked for the bad text alone, so the counts take a parsed column along
    counts = rows.select(good.alias("good"), "input").agg(F.count("*").alias("lines"), F.count_if(~F.col("good")).alias("skipped"))
    return rows.where(good).drop(BAD_LINE, "target"), counts


def tentative(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of a document with a list under ``conversations``."""
    doc = f"metadata string, conversations array<struct<input:string,conversation_date:string,outputs:array<{schemas.OUTPUT}>>>"
    return spark.read.schema(doc).option("multiLine", "true").json(path).select(F.inline("conversations"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """``kind, name, description`` of a document with the lists ``expense`` and ``income``."""
    item = "array<struct<name:string,description:string>>"
    doc = spark.read.schema(f"expense {item}, income {item}").option("multiLine", "true").json(path)
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("xs")) for k in ("expense", "income")))
    return doc.select(F.inline(pairs)).select("kind", F.inline("xs"))


def chat_export(spark: SparkSession, path: str, bot: str, start: str | None = None, end: str | None = None, system: list[str] | None = None) -> DataFrame:
    """Conversations of chat exports: a message of a user with the bot's structured replies."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return chat.conversations(chat.messages(texts, "file", "value"), F.col("sender") == bot, start, end, system)
