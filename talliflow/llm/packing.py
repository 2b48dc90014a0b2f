"""Filling containers of fixed capacity with texts.

Pattern packing by non-negative least squares: sizes are counted in a histogram of classes, patterns of a few documents
that fill a block exactly are enumerated, their repeat counts are fitted to the histogram, rounded down to
what the histogram has, and the rest is packed greedily by classes. The plan is made of classes and
numbers only; every document finds its container from its rank within its class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliflow.operators import ranks
from talliflow.llm.tokens import VOCABULARY, token_count
from talliflow.session import shared_path, spread

CAPACITY = 2048
#: Tokens of one size class: a class holds the sizes up to its multiple of this.
UNIT = 8
#: Documents in one pattern, at most.
DEPTH = 4
#: Steps of the fit.
STEPS = 1500


class Run(NamedTuple):
    """Consecutive ranks of one class: ``per`` of them go into each of the bins from ``first_bin`` on."""

    size: int
    first_rank: int
    n: int
    per: int
    first_bin: int


def patterns(total: int, depth: int, sizes: np.ndarray) -> np.ndarray:
    """All multisets of at most ``depth`` of the given sizes that sum up to ``total``, padded with 0, one a row."""
    have = np.zeros(total + 1, bool)
    have[sizes[sizes <= total]] = True
    out: list[np.ndarray] = []
    heads = np.zeros((1, 0), np.int64)  # sizes so far, falling
    left = np.full(1, total)
    for k in range(depth):
        last = heads[:, -1] if k else np.full(len(heads), total)
        done = (left > 0) & (left <= last) & have[left]
        out.append(np.pad(np.c_[heads[done], left[done]], ((0, 0), (0, depth - k - 1))))
        if k == depth - 1:
            break
        slots = depth - k
        grown_heads, grown_left = [], []
        for s in sizes[sizes < total].tolist():
            ok = (s <= last) & (s < left) & (left - s <= s * (slots - 1))
            grown_heads.append(np.c_[heads[ok], np.full(ok.sum(), s)])
            grown_left.append(left[ok] - s)
        if not grown_heads:
            break
        heads, left = np.concatenate(grown_heads), np.concatenate(grown_left)
    return np.concatenate(out)


def fit(found: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that make the squares of (used - histogram) least: an accelerated projected gradient."""
    if not len(found):
        return np.zeros(0)
    scale = max(histogram.max(), 1)
    h = histogram / scale

    def used(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        for k in range(found.shape[1]):
            out += np.bincount(found[:, k], x, len(h))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[found].sum(1)

    v = np.ones(len(found))
    norm = 1.0
    for _ in range(30):
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - h) / (1.01 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def _use(pattern: list[int], most: int, left: np.ndarray) -> int:
    """How often a pattern can be repeated with what is left."""
    sizes, counts = np.unique([s for s in pattern if s], return_counts=True)
    return int(min(most, (left[sizes] // counts).min()))


class Plan(NamedTuple):
    """Runs of documents into blocks and containers, runs of blocks into containers, and the numbers of both."""

    to_block: list[Run]
    to_container: list[Run]
    blocks: list[Run]
    n_blocks: int
    n_containers: int


def make_plan(histogram: np.ndarray, total: int, depth: int = DEPTH) -> Plan:
    """Pack ``histogram[s]`` items of each size ``s`` (1..total) into containers of ``total``.

    Blocks are containers, or halves, quarters ... of them, so that a block holds about ``depth`` documents at most.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    n = int(left.sum())
    mean = float((left * np.arange(len(left))).sum()) / max(n, 1)
    parts = 1
    while total % (2 * parts) == 0 and mean > 0 and total / parts / mean > depth:
        parts *= 2
    block = total // parts
    sizes = np.flatnonzero(left[: block + 1])
    found = patterns(block, depth, sizes[sizes > 0])
    x = fit(found, left[: block + 1])
    to_block: list[Run] = []
    n_blocks = 0
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        reps = _use(found[k].tolist(), int(round(x[k])), left)
        n_blocks += _place(found[k].tolist(), reps, left, taken, to_block, n_blocks)
    # what the fit leaves, together with the blocks, the largest first
    blocks_left = n_blocks
    block_runs: list[Run] = []
    to_container: list[Run] = []
    bins = 0
    while left.sum() or blocks_left:
        free, pattern, n_block = total, [], 0
        trial = left.copy()
        while free:
            fits = np.flatnonzero(trial[: free + 1])
            s = int(fits[-1]) if len(fits) else 0
            if blocks_left > n_block and block <= free and block > s:
                free -= block
                n_block += 1
            elif s:
                free -= s
                pattern.append(s)
                trial[s] -= 1
            else:
                break
        reps = _use(pattern, n, left) if pattern else n
        if n_block:
            reps = min(reps, blocks_left // n_block)
            block_runs.append(Run(block, n_blocks - blocks_left, reps * n_block, n_block, bins))
            blocks_left -= reps * n_block
        _place(pattern, reps, left, taken, to_container, bins)
        bins += reps
    return Plan(to_block, to_container, block_runs, n_blocks, bins)


def _place(pattern: list[int], reps: int, left: np.ndarray, taken: np.ndarray, runs: list[Run], first_bin: int) -> int:
    if reps > 0:
        for s, per in zip(*np.unique([s for s in pattern if s], return_counts=True)):
            runs.append(Run(int(s), int(taken[s]), reps * int(per), int(per), first_bin))
            taken[s] += reps * per
            left[s] -= reps * per
    return max(reps, 0)


class Finder:
    """Bins of (size, rank) by binary search in the runs."""

    def __init__(self, runs: list[Run]) -> None:
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.keys = self.runs[:, 0] * 2**44 + self.runs[:, 1]

    def bins(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """-1 where no run has the rank."""
        if not len(self.runs):
            return np.full(len(size), -1)
        k = np.maximum(np.searchsorted(self.keys, size * 2**44 + rank, "right") - 1, 0)
        r = self.runs[k]
        at = rank - r[:, 1]
        ok = (r[:, 0] == size) & (at >= 0) & (at < r[:, 2])
        return np.where(ok, r[:, 4] + at // r[:, 3], -1)


def pieces(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, piece_no, start_token, n_tokens``: each text, or its parts if it alone exceeds the capacity.

    A text is cut into full containers and one rest. Null texts are no pieces; a text without tokens is a piece of size 0.
    """
    texts = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null"))
    sized = texts.select("id", token_count(F.col("text"), vocabulary).alias("n"))
    count = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    out = sized.select("id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    start = F.col("k").cast("bigint") * capacity
    return out.select("id", (F.col("k") + 1).alias("piece_no"), start.alias("start_token"), F.least(F.col("n") - start, F.lit(capacity)).alias("n_tokens"))


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, seed: int = 0
) -> DataFrame:
    """``container, id, piece_no, start_token, n_tokens``: every piece in one container, none over the capacity.

    Repeated ids are packed as often as they occur. The histogram that the plan is made of has at most ``capacity / UNIT``
    rows. An empty table gives no rows.
    """
    if capacity % UNIT:
        raise ValueError(f"the capacity must be a multiple of {UNIT}")
    spark = documents.sparkSession
    path = shared_path(spark, f"pieces-{uuid.uuid4().hex}")
    size = F.greatest(F.ceil(F.col("n_tokens") / UNIT), F.lit(1)).cast("int")
    pieces(documents, id_col, text_col, capacity, vocabulary).withColumn("size", size).write.parquet(path)
    items = spark.read.parquet(path)
    total = capacity // UNIT
    histogram = np.zeros(total + 1, np.int64)
    for r in items.groupBy("size").agg(F.count("*").alias("k")).collect():
        histogram[r["size"]] = r["k"]
    plan = make_plan(histogram, total)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, direct, whole = Finder(plan.to_block), Finder(plan.to_container), Finder(plan.blocks)
        block_size = plan.blocks[0].size if plan.blocks else 0
        for b in batches:
            s, r = b["size"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64) - 1
            block = blocks.bins(s, r)
            via = whole.bins(np.full(len(s), block_size), block)
            b["container"] = np.where(block >= 0, via, direct.bins(s, r))
            yield b[["container", "id", "piece_no", "start_token", "n_tokens"]]

    order = ranks.ranked(items, "size", ["id", "piece_no"], int(histogram.max()), seed)
    kind = dict(items.dtypes)["id"]
    return order.mapInPandas(place, f"container bigint, id {kind}, piece_no int, start_token bigint, n_tokens bigint")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, the fullest container and the share of space that is used."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return each.agg(
        F.count("*").alias("containers"),
        F.sum("k").alias("pieces"),
        F.sum("t").alias("tokens"),
        F.max("t").alias("fullest"),
        (F.sum("t") / F.count("*") / capacity).alias("used_share"),
    )
