"""Writers. Tables are written by the executors; only reports of one row pass the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with nulls kept, appended to or in place of what is there."""
    rows.write.mode("overwrite" if overwrite else "append").option("ignoreNullFields", "false").json(path)


def split_sink(rows: DataFrame, valid: str, good: str, bad: str) -> None:
    """Rows with a true ``valid`` appended to one place, all others (null, too) to another."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    rows = rows.persist()
    try:
        append_jsonl(rows.where(ok), good)
        append_jsonl(rows.where(~ok), bad)
    finally:
        rows.unpersist()


def envelope(conversations: DataFrame, path: str, source: str, filters: dict[str, str], stamp: str, note: str = "") -> None:
    """Conversations as JSON lines under ``conversations`` and one line of metadata with their number under ``metadata``."""
    append_jsonl(conversations, f"{path}/conversations", overwrite=True)
    meta = conversations.agg(F.count("*").alias("total_conversations")).select(
        F.lit(source).alias("source_file"),
        "total_conversations",
        F.create_map(*(F.lit(x) for kv in filters.items() for x in kv)).alias("filters") if filters else F.lit(None).cast("map<string,string>").alias("filters"),
        F.lit(stamp).alias("export_timestamp"),
        F.lit(note).alias("note"),
    )
    append_jsonl(meta, f"{path}/metadata", overwrite=True)


def report_name(model: str, stamp: str) -> str:
    return f"results_{model.replace('/', '_')}_{stamp}"


def failures(rows: DataFrame, path: str, below: float = 0.8) -> bool:
    """Rows that score below ``below``, written only if there are any."""
    bad = rows.where(F.col("score") < below)
    if bad.isEmpty():
        return False
    append_jsonl(bad, path, overwrite=True)
    return True


def percent(n: str, d: str):
    """``12.3%`` or ``N/A`` where nothing was counted."""
    share = F.try_divide(F.col(n) * F.lit(100.0), F.col(d))
    return F.when(share.isNull(), "N/A").otherwise(F.format_string("%.1f%%", share))


def comparison(report: DataFrame) -> DataFrame:
    """Evaluation reports by model as lines of a Markdown table, in order."""
    cells = [F.col("model"), *(F.format_string("%.4f", F.col(k)) for k in ("f1_score", "precision", "recall", "entity_accuracy"))]
    head = "| model | F1 | precision | recall | entity accuracy |"
    rows = report.select(F.lit(2).alias("part"), "model", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    top = report.sparkSession.createDataFrame([(0, "", head), (1, "", "| - | - | - | - | - |")], "part int, model string, line string")
    return top.union(rows).orderBy("part", "model").select("line")
