"""Deeply nested reports as flat tables that keep parent-child links.

Payloads are parsed once into variants. A bottom-up tree automaton, written as column expressions, gives every node a state from the
states of its members: absent or null ones are ``none``, others a list, a scalar or a record, and a record's state is made of its
members' (:func:`node_state`). The state alone decides: members that are lists or records become children, nodes in state ``none`` are dropped, and
every other node goes to the typed table of its variant, which is its state. All variants share one supertype table of keys and
parent links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliflow.functions.text import let

LIST = "array<variant>"
OBJECT = "map<string,variant>"

#: Typed fields of each kind of item, all read leniently (a number may be written as text).
FIELDS: dict[str, dict[str, str]] = {
    "target": {
        "type": "string", "amount": "double", "currency": "string", "category": "string", "description": "string",
        "date_delta_days": "int", "date_raw_expression": "string",
    },
    "counts": {
        "predicted": "int", "expected": "int", "true_positives": "int", "false_positives": "int", "false_negatives": "int",
    },
    "error": {
        "amount_error": "boolean", "currency_error": "boolean", "type_error": "boolean", "category_error": "boolean",
        "date_delta_error": "boolean", "date_expression_error": "boolean",
    },
    "output": {
        "type": "string", "description": "string", "amount": "double", "currency": "string", "category": "string",
        "bot_recorded_date": "string", "status": "string",
    },
    "history": {"status": "string", "at": "string"},
}


def present(v: Column) -> Column:
    """``v`` if it is neither absent nor a JSON null."""
    return F.when(~F.is_variant_null(v), v)


def field(v: Column, *names: str) -> Column:
    """The first of the named members that is present; absent where ``v`` is no object."""
    return F.coalesce(*(present(F.try_variant_get(v, f"$.{n}", "variant")) for n in names))


def as_list(v: Column) -> Column:
    """A list's elements; an object stands for a list of itself; anything else has no elements."""
    return let(
        v,
        lambda x: F.coalesce(F.try_variant_get(x, "$", LIST), F.when(F.try_variant_get(x, "$", OBJECT).isNotNull(), F.array(x))),
    )


def members(v: Column, *names: str) -> Column:
    """A struct of the named members of an object, all read at once; null where ``v`` is no object."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


def one_of(m: Column, *names: str) -> Column:
    """The first of the members that is present."""
    return F.coalesce(*(present(m[n]) for n in names))


#: States of a record: what its members' states make of it. ``typed``: some expected member is present and numbers are numbers; ``lax``: a number
#: stands as text; ``bare``: no expected member is present. An output with items in its history has ``+history`` behind.
RECORD_STATES = ["typed", "lax", "bare"]


def variants(kind: str) -> list[str]:
    """All states that the automaton accepts for items of a kind, each of which has its table."""
    own = RECORD_STATES + ([f"{x}+history" for x in RECORD_STATES] if kind == "output" else [])
    return own if kind == "counts" else [*own, "scalar"]


def node_state(kind: str, v: Column, m: Column, below: Column | None = None) -> Column:
    """State of a node from the states of its members ``m``; ``below`` is whether a list among them has items."""
    seen = [present(m[n]) for n in FIELDS[kind]]
    numbers = [present(m[n]) for n, t in FIELDS[kind].items() if t in ("int", "double")]
    as_text = [F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)) for x in numbers]
    record = F.when(F.coalesce(*seen).isNotNull(), F.when(_any(as_text), "lax").otherwise("typed")).otherwise("bare")
    if below is not None:
        record = F.concat(record, F.when(below, "+history").otherwise(""))
    return F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), "none").when(m.isNull(), "scalar").otherwise(record)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def leaf_state(v: Column) -> Column:
    """State of a node by its own kind: none, list, record, number, flag, digits (a number as text) or text."""
    text = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    return (
        F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), "none")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "record")
        .when(kind == "BOOLEAN", "flag")
        .when(kind == "STRING", F.when(text.try_cast("double").isNotNull(), "digits").otherwise("text"))
        .otherwise("number")
    )


def record_state(kind: str, v: Column) -> Column:
    """Which members a child has, in more detail than its variant says.

    ``empty`` (no member is present), ``full`` (every expected member is), ``part``; with ``+text`` where a number stands as text
    and ``+more`` where members go beyond the expected ones; ``scalar`` for a child that is no object.
    """
    members = F.try_variant_get(v, "$", OBJECT)
    names = F.map_keys(F.map_filter(members, lambda _, x: ~F.is_variant_null(x)))
    expected = F.array(*(F.lit(n) for n in FIELDS[kind]))
    have = F.size(F.array_intersect(names, expected))
    numbers = [n for n, t in FIELDS[kind].items() if t in ("int", "double")]
    as_text = F.lit(False)
    for n in numbers:
        as_text = as_text | (F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING")
    more = F.size(F.array_except(names, F.concat(expected, F.array(F.lit("history"))))) > 0
    base = F.when(F.size(names) == 0, "empty").when(have == len(FIELDS[kind]), "full").otherwise("part")
    return F.when(members.isNull(), "scalar").otherwise(
        F.concat(base, F.when(F.coalesce(as_text, F.lit(False)), "+text").otherwise(""), F.when(more, "+more").otherwise(""))
    )


def parse_reports(reports: DataFrame) -> DataFrame:
    """``report_id, report``: the payload as a variant, null where it is no JSON."""
    return reports.select("report_id", F.try_parse_json("payload").alias("report"))


def entries(reports: DataFrame) -> DataFrame:
    """``report_id, entry_no, entry``: the non-null entries of each report, numbered over all elements.

    Entries stand under ``per_entry_results`` or, in older reports, ``entries``; one object stands for a list.
    """
    names = ("per_entry_results", "entries")
    listed = reports.select("report_id", let(members(F.try_parse_json("payload"), *names), lambda m: as_list(one_of(m, *names))).alias("es"))
    return listed.select("report_id", F.posexplode("es").alias("p", "entry")).where(present(F.col("entry")).isNotNull()).select(
        "report_id", (F.col("p") + 1).alias("entry_no"), "entry"
    )


def _item(kind: str, parent: Column, no: Column, node: Column, state: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("item_kind"), parent.cast("int").alias("parent_no"), no.cast("int").alias("item_no"), node.alias("node"), state.alias("variant")
    )


def _items(kind: str, listed: Column, parent: Column) -> Column:
    """Links, nodes and states of a list's elements as an array of structs."""
    return F.transform(
        F.coalesce(listed, F.array().cast(LIST)),
        lambda x, i: let(members(x, *FIELDS[kind]), lambda m: _item(kind, parent, i + 1, x, node_state(kind, x, m))),
    )


def _accepted(items: Column) -> Column:
    return F.filter(items, lambda s: s["variant"] != "none")


def children(reports: DataFrame) -> DataFrame:
    """The supertype table: every child of every entry with its links, its node and its variant.

    Columns ``report_id, entry_no, item_kind, parent_no, item_no, node, variant``. ``parent_no`` is the number of the output for
    ``history``, else 0. Null elements are no items, yet they count in the numbers. An object in place of a list is
    item 1, as is ``counts``. Reports that aren't JSON, have no entries or are null give no rows.
    No shuffle; each payload is parsed once and each node's members are read once.
    """
    zero, none = F.lit(0), F.array().cast(LIST)

    def output(x: Column, i: Column) -> Column:
        def with_history(m: Column) -> Column:
            return let(
                _accepted(_items("history", as_list(present(m["history"])), i + 1)),
                lambda hs: F.concat(F.array(_item("output", zero, i + 1, x, node_state("output", x, m, F.size(hs) > 0))), hs),
            )

        return let(members(x, *FIELDS["output"], "history"), with_history)

    def all_items(m: Column) -> Column:
        talk = let(members(present(m["conversation"]), "outputs", "output"), lambda c: as_list(one_of(c, "outputs", "output")))
        counts = let(
            present(m["transaction_counts"]),
            lambda x: let(members(x, *FIELDS["counts"]), lambda c: F.when(c.isNotNull(), F.array(_item("counts", zero, F.lit(1), x, node_state("counts", x, c))))),
        )
        return F.concat(
            _items("target", as_list(one_of(m, "parsed_targets", "target")), zero),
            F.coalesce(counts, F.slice(_items("counts", none, zero), 1, 0)),
            _items("error", as_list(present(m["error_breakdown"])), zero),
            F.flatten(F.transform(F.coalesce(talk, none), output)),
        )

    parts = ("parsed_targets", "target", "transaction_counts", "error_breakdown", "conversation")
    rows = entries(reports).select("report_id", "entry_no", let(members(F.col("entry"), *parts), lambda m: _accepted(all_items(m))).alias("items"))
    return rows.select("report_id", "entry_no", F.inline("items"))


def variant_table(items: DataFrame, kind: str, variant: str) -> DataFrame:
    """The subtype table of one variant: links, typed fields and the raw node as text.

    Numbers of a ``lax`` record are read from texts, too; ``bare`` records and scalars have no fields but ``raw``. A field that can't be
    read as its type is null; ``raw`` keeps it.
    """
    node = F.col("node")
    record, lax = not variant.startswith(("bare", "scalar")), variant.startswith("lax")
    cols = []
    for name, t in FIELDS[kind].items():
        value = F.try_variant_get(node, f"$.{name}", t) if record else F.lit(None).cast(t)
        if lax and t in ("int", "double"):
            value = F.coalesce(value, F.try_variant_get(node, f"$.{name}", "string").try_cast(t))
        cols.append(value.alias(name))
    keys = ["report_id", "entry_no", "parent_no", "item_no", "variant"]
    return items.where((F.col("item_kind") == kind) & (F.col("variant") == variant)).select(*keys, *cols, F.to_json(node).alias("raw"))


def typed_table(items: DataFrame, kind: str) -> DataFrame:
    """All variants of ``kind`` in one table: links, variant, which members there are (``shape``), typed fields and the raw node as text.

    A field that can't be read as its type is null; ``raw`` keeps it.
    """
    node = F.col("node")
    cols = []
    for name, t in FIELDS[kind].items():
        value = F.try_variant_get(node, f"$.{name}", t)
        if t in ("int", "double"):
            value = F.coalesce(value, F.try_variant_get(node, f"$.{name}", "string").try_cast(t))
        cols.append(value.alias(name))
    return items.where(F.col("item_kind") == kind).select(
        "report_id", "entry_no", "parent_no", "item_no", "variant", record_state(kind, node).alias("shape"), *cols, F.to_json(node).alias("raw")
    )


def write_variants(items: DataFrame, path: str) -> None:
    """Every variant's items in a folder of their own under ``path``, by kind and variant, in one pass: keys, parent links and the raw node."""
    items.withColumn("raw", F.to_json("node")).drop("node").write.partitionBy("item_kind", "variant").parquet(path)


def entry_table(reports: DataFrame) -> DataFrame:
    """One row per entry: links to the report and the entry's own scalar fields."""
    e = F.col("entry")
    return entries(reports).select(
        "report_id",
        "entry_no",
        leaf_state(e).alias("shape"),
        F.try_variant_get(e, "$.pred_id", "bigint").alias("pred_id"),
        F.try_variant_get(e, "$.input", "string").alias("input"),
        F.try_variant_get(e, "$.raw_response", "string").alias("raw_response"),
        F.try_variant_get(e, "$.conversation.conversation_date", "string").alias("conversation_date"),
    )


def unparsed(reports: DataFrame) -> DataFrame:
    """Reports whose payload is null or no JSON."""
    return parse_reports(reports).where("report is null").select("report_id")
