"""Chat exports: lines to messages, messages to conversations, and what a bot's reply says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.functions.text import first_line_after, latin_number, strip

#: Fixed value: the first line of a message, ``[d/m/yy, H:M:S] sender: text``.
HEADER = r"(?U)^[\u200e\s]*\[(\d{1,2}/\d{1,2}/\d{2}), (\d{1,2}:\d{2}:\d{2})\] ([^:]+): (.*)$"
#: A reply's marks and labels.
SAVED = ["✅ Guardado correctamente", "✅ *Guardado correctamente*"]
BUTTONS = ["✅ Confirmar", "❌ Cancelar"]
EXPENSE, INCOME = "📤 *Gasto*", "📥 *Ingreso*"
LABELS = {"description": r"📝 \*Descripción:\*", "category": r"🏷️ \*Categoría:\*", "bot_recorded_date": r"🗓️ \*Fecha:\*"}
AMOUNT = r"(?U)💰 \*Monto:\* ([\d.,]+) (\w+)"
LINKED = "✅ *¡Cuenta vinculada exitosamente!*"
MEDIA = "<Media omitted>"


def lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line``: the lines of every text in order, whatever its line ends."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("line_no", "line"))


def messages(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, msg_no, ts, sender, content``: a header line starts a message, further lines belong to it.

    Lines before the first header are dropped; a text without headers gives nothing. A time that doesn't exist is null. Rows of one text stay
    together, texts are spread.
    """
    head = F.col("line").rlike(HEADER)
    rows = lines(texts.where(F.col(text_col).isNotNull()), id_col, text_col).withColumn("is_header", head)
    upto = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("msg_no", F.sum(F.col("is_header").cast("int")).over(upto)).where("msg_no > 0")
    part = [F.regexp_extract("line", HEADER, k) for k in (1, 2, 3, 4)]
    body = F.when(F.col("is_header"), part[3]).otherwise(F.col("line"))
    grouped = rows.groupBy("id", "msg_no").agg(
        F.max(F.when(F.col("is_header"), F.concat_ws(" ", part[0], part[1]))).alias("stamp"),
        F.max(F.when(F.col("is_header"), part[2])).alias("sender"),
        F.array_sort(F.collect_list(F.struct("line_no", body.alias("body")))).alias("ls"),
    )
    return grouped.select(
        "id",
        "msg_no",
        F.try_to_timestamp("stamp", F.lit("d/M/yy H:mm:ss")).alias("ts"),
        "sender",
        F.array_join(F.transform("ls", lambda x: x["body"]), "\n").alias("content"),
    )


def sessions(msgs: DataFrame, is_bot: Column) -> DataFrame:
    """Messages with ``owner``: for a bot's message the number of the message before its run that isn't the bot's.

    Bot messages at the start of a text have no owner and are left out; every other message owns itself.
    """
    before = W.partitionBy("id").orderBy("msg_no").rowsBetween(W.unboundedPreceding, 0)
    owned = msgs.withColumn("is_bot", is_bot).withColumn("owner", F.last(F.when(~F.col("is_bot"), F.col("msg_no")), ignorenulls=True).over(before))
    return owned.where("owner is not null")


def reply_details(content: Column) -> Column:
    """Struct of what a bot's reply says, null for other texts.

    In this order: saved, waiting for confirmation, error, account linked. A saved or waiting reply without a type is null; a number that can't
    be read is null.
    """
    kind = F.when(content.contains(EXPENSE), "expense").when(content.contains(INCOME), "income")
    saved = content.contains(SAVED[0]) | content.contains(SAVED[1])
    waits = content.contains(BUTTONS[0]) & content.contains(BUTTONS[1])
    number = F.nullif(F.regexp_extract(content, AMOUNT, 1), F.lit(""))
    fields = {k: strip(first_line_after(content, v)) for k, v in LABELS.items()}
    none = F.lit(None).cast("string")

    def details(type_: Column, status: Column, message: Column, full: bool) -> Column:
        return F.struct(
            type_.alias("type"),
            (fields["description"] if full else none).alias("description"),
            (latin_number(number) if full else F.lit(None).cast("double")).alias("amount"),
            (F.nullif(F.regexp_extract(content, AMOUNT, 2), F.lit("")) if full else none).alias("currency"),
            (fields["category"] if full else none).alias("category"),
            (fields["bot_recorded_date"] if full else none).alias("bot_recorded_date"),
            status.alias("status"),
            message.alias("message"),
        )

    return (
        F.when(saved, F.when(kind.isNotNull(), details(kind, none, none, True)))
        .when(waits, F.when(kind.isNotNull(), details(kind, F.lit("pending_confirmation"), none, True)))
        .when(content.contains("❌"), details(F.lit("error"), none, strip(content), False))
        .when(content.contains(LINKED), details(F.lit("account_linked"), none, strip(content), False))
    )


def render_reply(o: Column) -> Column:
    """The text of a bot's reply for an output, the inverse of :func:`reply_details`."""
    amount = F.translate(F.format_number(o["amount"], 2), ",.", ".,")
    kind = F.when(o["type"] == "expense", EXPENSE).otherwise(INCOME)
    head = F.when(o["status"].isNull(), SAVED[1]).otherwise(" ".join(BUTTONS))
    parts = [
        head,
        kind,
        F.concat(F.lit("📝 *Descripción:* "), o["description"]),
        F.concat(F.lit("💰 *Monto:* "), amount, F.lit(" "), o["currency"]),
        F.concat(F.lit("🏷️ *Categoría:* "), o["category"]),
        F.concat(F.lit("🗓️ *Fecha:* "), o["bot_recorded_date"]),
    ]
    return F.concat_ws("\n", *parts)


def conversations(
    msgs: DataFrame, is_bot: Column, start: str | None = None, end: str | None = None, system: list[str] | None = None
) -> DataFrame:
    """``id, msg_no, input, conversation_date, outputs``: users' messages with the bot's structured replies to them.

    Owners outside of the days, system senders, media and button presses are dropped after replies are assigned, so their replies go with
    them; a reply outside of the days stays with an owner inside. Both days are inclusive.
    """
    owned = sessions(msgs, is_bot)
    d = reply_details(F.col("content"))
    replies = owned.where("is_bot").select("id", "owner", "msg_no", d.alias("d")).where(F.col("d.type").isin("expense", "income"))
    outputs = replies.groupBy("id", "owner").agg(F.array_sort(F.collect_list(F.struct("msg_no", "d"))).alias("ds"))
    users = owned.where("not is_bot")
    users = users.where(~F.col("content").contains(MEDIA) & ~strip(F.col("content")).isin(BUTTONS) & ~F.col("sender").isin(system or []))
    if start:
        users = users.where(F.col("ts") >= F.to_date(F.lit(start)))
    if end:
        users = users.where(F.col("ts") < F.date_add(F.to_date(F.lit(end)), 1))
    out = users.join(outputs.withColumnRenamed("owner", "msg_no"), ["id", "msg_no"])
    return out.select(
        "id",
        "msg_no",
        strip(F.col("content")).alias("input"),
        F.date_format("ts", "yyyy-MM-dd").alias("conversation_date"),
        F.transform("ds", lambda x: x["d"].dropFields("message")).alias("outputs"),
    )
