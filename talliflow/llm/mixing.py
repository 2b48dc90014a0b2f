"""Mixing sources to target weights.

Temperature mixing: the sources' token shares are exponentiated, here in a family that runs from the natural shares (exponent 0) to the target
shares (exponent 1), as each source has a share of its own to meet. The exponent is bisected to the repetition limits: it's the
largest at which no source is used more often than it may be. The sources that stop it there give all they have, and the exponent of the
others is searched for anew, until it can be 1. The weights are realised as budgeted block permutations: each pass over a source takes its blocks in
another order, and the texts of a block too, and the last pass stops where the budget ends.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.functions.text import loose_key
from talliflow.operators import ranks
from talliflow.llm.tokens import VOCABULARY, token_count
from talliflow.session import shared_path, spread

#: Tokens of a block, about, and blocks that a source is cut into at least.
BLOCK_TOKENS, MIN_BLOCKS = 4_000_000, 64
#: More wanted sources than this are refused, as their totals come to the driver.
MAX_SOURCES = 100_000


class Source(NamedTuple):
    name: str
    share: float
    max_repeats: int
    tokens: int
    texts: int

    @property
    def limit(self) -> int:
        """Tokens that the source can give."""
        return self.tokens * self.max_repeats


def weights(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """Normalised natural ** (1 - exponent) * target ** exponent."""
    raw = [n ** (1 - exponent) * t**exponent if n > 0 and t > 0 else 0.0 for n, t in zip(natural, target)]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def bisected(over, steps: int = 60) -> float:
    """The largest exponent below 1 up to which nothing is over its limit, if that is so at 0 and not at 1."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if not over(mid) else (low, mid)
    return low


def allocated(sources: list[Source], size: int) -> tuple[list[float], list[float | None]]:
    """Tokens that each source gives to a mix of ``size`` tokens, and the exponent at which it was stopped by its limit (None: it wasn't).

    As long as the target shares (exponent 1) of the sources left take one of them over its limit, the exponent is bisected; those that
    stop it give their limit, and the rest of the size goes to the others. The mix is smaller than ``size`` only if all sources are at their limits.
    """
    out, stopped = [0.0] * len(sources), [None] * len(sources)
    rest = [i for i, s in enumerate(sources) if s.share > 0]
    while rest:
        left = size - sum(out[i] for i in range(len(sources)) if stopped[i] is not None)
        natural, target = [float(sources[i].tokens) for i in rest], [sources[i].share for i in rest]

        def over(e: float) -> list[int]:
            return [i for i, w in zip(rest, weights(natural, target, e)) if w * left > sources[i].limit * (1 + 1e-12)]

        # a source without tokens has no weight at any exponent
        none = [i for i in rest if sources[i].limit == 0]
        at_target = over(1.0)
        if not none and not at_target:
            for i, w in zip(rest, weights(natural, target, 1.0)):
                out[i] = w * left
            break
        if none or over(0.0):
            exponent, full = 0.0, none or [i for i in over(0.0) if i in at_target] or at_target
        else:
            exponent = bisected(over)
            full = [i for i in over(exponent + 1e-9) if i in at_target] or at_target
        for i in full:
            out[i], stopped[i] = float(sources[i].limit), exponent
        rest = [i for i in rest if i not in full]
    return out, stopped


def mix_exponent(sources: list[Source], size: int) -> float:
    """The exponent at which all sources that have tokens serve a mix of ``size`` within their limits; 0 if there is none."""
    some = [s for s in sources if s.limit > 0 and s.share > 0]
    natural, target = [float(s.tokens) for s in some], [s.share for s in some]

    def over(e: float) -> bool:
        return any(w * size > s.limit * (1 + 1e-12) for s, w in zip(some, weights(natural, target, e)))

    return 1.0 if not over(1.0) else 0.0 if over(0.0) else bisected(over)


def budgets(sources: list[Source], size: int) -> tuple[list[float], float]:
    """Tokens that each source gives to a mix of ``size`` tokens, and the exponent of the whole mix."""
    return allocated(sources, size)[0], mix_exponent(sources, size)


def _sized(documents: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, list[Source], int]:
    """Written sizes of the wanted sources' texts, the sources and the tokens of all documents."""
    spark = documents.sparkSession
    keys = targets.where("source is not null").select(F.col("source").alias("name"), loose_key(F.col("source")).alias("_key"))
    path = shared_path(spark, f"sizes-{uuid.uuid4().hex}")
    texts = spread(documents.select("doc_id", "source", "text").where("text is not null"))
    sized = texts.select(
        "doc_id", loose_key(F.col("source")).alias("_key"), token_count(F.col("text"), vocabulary).alias("n")
    )
    sized.join(keys, "_key", "left").select("doc_id", F.col("name").alias("source"), "n").write.parquet(path)
    sizes = spark.read.parquet(path)
    size = sizes.agg(F.sum("n")).first()[0] or 0
    by = {
        r["source"]: (r["t"], r["k"])
        for r in sizes.where("source is not null").groupBy("source").agg(F.sum("n").alias("t"), F.count("*").alias("k")).collect()
    }
    wanted = targets.where("source is not null").select("source", "share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = [
        Source(r["source"], r["share"] or 0.0, max(0, 1 if r["max_repeats"] is None else r["max_repeats"]), *by.get(r["source"], (0, 0)))
        for r in sorted(wanted)
    ]
    return sizes.where("source is not null"), listed, size


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix and the report on its sources.

    The mix has ``doc_id, source, copy_no, n_tokens, place``: sorted by ``place``, every stretch of it has about the
    wanted shares. It is as large as all documents together (those of unlisted sources, too). A text is used at most
    ``max_repeats`` times; sources match when case, blanks at the ends and separators are ignored. Null texts aren't used, texts without tokens
    add none. Rows with the same id are texts of their own. A null or missing ``max_repeats`` is 1, a null share 0. Report:
    ``source, share, max_repeats, texts, tokens, wanted_tokens, budget, exponent, stopped_at, mixed_tokens, actual_share, short`` with the exponent at
    which all sources would be within their limits, the one at which this source was stopped by its limit, and ``short`` where the source was stopped below
    its share: its texts, each used ``max_repeats`` times, have fewer tokens.
    """
    sizes, sources, size = _sized(documents, targets, vocabulary)
    given, stopped = allocated(sources, size)
    exponent = mix_exponent(sources, size)
    spark = documents.sparkSession
    plan = []
    for s, b, at in zip(sources, given, stopped):
        whole = min(int(b // s.tokens), s.max_repeats) if s.tokens else 0
        n_blocks = max(MIN_BLOCKS, -(-s.tokens // BLOCK_TOKENS))
        plan.append((s.name, s.share, s.max_repeats, s.texts, s.tokens, s.share * size, b, exponent, at, whole, b - whole * s.tokens, n_blocks))
    plan_df = spark.createDataFrame(
        plan,
        "source string, share double, max_repeats int, texts long, tokens long, wanted_tokens double, budget double, exponent double, "
        "stopped_at double, whole int, part double, n_blocks long",
    )
    # passes over each source: at most max_repeats rows a source
    passes = plan_df.where("budget > 0 and tokens > 0").select(
        "source", "tokens", "budget", "whole", "part", F.explode(F.sequence(F.lit(1), F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0))).alias("copy_no")
    )
    # blocks are made by a hash of the ids; Spark broadcasts the plan, a row a source, by its size
    cut = sizes.join(plan_df.select("source", "n_blocks"), "source")
    cut = cut.withColumn("_block", F.floor(ranks.fraction(seed, F.col("source"), F.col("doc_id")) * F.col("n_blocks"))).drop("n_blocks")
    # the blocks of each pass in an order of its own; the table has a row per block and pass
    blocks = cut.groupBy("source", "_block").agg(F.sum("n").alias("_t"))
    blocks = blocks.join(passes, "source").withColumn("_o", F.xxhash64(F.lit(seed), "source", "copy_no", "_block"))
    before = W.partitionBy("source", "copy_no").orderBy("_o", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    # blocks that a partial pass doesn't reach need no rows
    blocks = blocks.where((F.col("copy_no") <= F.col("whole")) | (F.col("_before") < F.col("part")))
    # and the texts of a block in an order of the pass
    rows = cut.join(blocks, ["source", "_block"]).withColumn("_i", F.xxhash64(F.lit(seed), "copy_no", "doc_id"))
    inside = W.partitionBy("source", "copy_no", "_block").orderBy("_i", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.where((F.col("copy_no") <= F.col("whole")) | (F.col("_at") + F.col("n") / 2 <= F.col("part")))
    place = ((F.col("copy_no") - 1) * F.col("tokens") + F.col("_at")) / F.col("budget")
    out = rows.select("doc_id", "source", "copy_no", F.col("n").alias("n_tokens"), place.alias("place"))
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    report = plan_df.drop("whole", "part", "n_blocks").join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    report = report.withColumn("actual_share", F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(W.partitionBy())))
    short = F.col("stopped_at").isNotNull() & (F.col("budget") < F.col("wanted_tokens")) & (F.col("mixed_tokens") < F.col("wanted_tokens"))
    return out, report.withColumn("short", short)
