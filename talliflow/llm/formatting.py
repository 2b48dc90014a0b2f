"""Duplicates hidden by formatting differences.

Texts stream through a skip-and-fold lookup table into rolling polynomial hashes, whole Arrow batches at a time;
canonical strings are never made. Rows whose hashes collide are verified by a two-pointer comparison that skips and
folds while it runs. Two messages are the same if they differ only in white space, invisible characters, letter case,
punctuation (a mark between two digits belongs to the number), Unicode composition or, in
messages made only of ``label: value`` fields, the order of the fields.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliflow.session import shared_path, spread

#: Classes of characters.
SPACE, HIDDEN, MARK, KEEP = 0, 1, 2, 3
#: Flags of kept characters: digit, part of a word, combining.
DIGIT, WORD, COMBINING = 1, 2, 4
COLON = ord(":")
#: Invisible characters that aren't of the categories C and Z: joiners, fillers, blank pattern; then ranges of selectors.
HIDDEN_CHARS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0}
HIDDEN_RANGES = ((0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
#: Characters that one pass of the hash kernel takes at most (a longer text makes a pass of its own). A pass needs about 120 bytes a character.
CHUNK_CHARS = 1_000_000
#: Rows of one class that one task of the verifying join gets at most.
SALT_ROWS = 50_000
#: A group of this many rows is hot and its head broadcast; of more than ``MAX_HOT`` such groups only the larger ones are: those of more
#: than that part of all rows, of which there can't be more.
HOT_ROWS, MAX_HOT = 50_000, 100_000


def char_class(cp: int) -> int:
    if cp in HIDDEN_CHARS or any(a <= cp <= b for a, b in HIDDEN_RANGES):
        return HIDDEN
    ch = chr(cp)
    if ch.isspace():
        return SPACE
    kind = unicodedata.category(ch)
    return {"Z": SPACE, "C": HIDDEN, "P": MARK}.get(kind[0], KEEP)


def fold(cp: int) -> tuple[int, ...]:
    """Decomposed, case-folded code points of one character, without those to skip."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", chr(cp)).casefold())
    return tuple(c for c in map(ord, text) if char_class(c) in (KEEP, MARK))


class Table:
    """The skip-and-fold table, filled for the code points that occur."""

    def __init__(self) -> None:
        n = 0x110000
        self.known = np.zeros(n, bool)
        self.kind = np.zeros(n, np.uint8)
        self.flags = np.zeros(n, np.uint8)
        self.first = np.zeros(n, np.uint32)  # the folded code point, or where the list of several is
        self.count = np.zeros(n, np.uint8)
        self.lists: dict[int, tuple[int, ...]] = {}

    def learn(self, points: np.ndarray) -> None:
        for cp in points[~self.known[points]].tolist():
            if 0xD800 <= cp <= 0xDFFF:
                kind, seq = KEEP, (cp,)
            else:
                kind, seq = char_class(cp), fold(cp)
            self.known[cp] = True
            self.kind[cp] = kind
            if kind in (KEEP, MARK):
                seq = seq or (cp,)
                self.count[cp] = len(seq)
                self.first[cp] = seq[0]
                if len(seq) > 1:
                    self.lists[cp] = seq
                ch = chr(cp)
                cat = unicodedata.category(ch)
                self.flags[cp] = (DIGIT if cat == "Nd" else 0) | (WORD if cat[0] in "LMN" else 0) | (
                    COMBINING if any(unicodedata.combining(chr(c)) for c in seq) else 0
                )


_TABLE: Table | None = None


def lookup() -> Table:
    global _TABLE
    if _TABLE is None:
        _TABLE = Table()
    return _TABLE


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _base(seed: int) -> np.uint64:
    return _mix(np.array([2 * seed + 0x9E37], np.uint64))[0] | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 between consecutive bounds."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _hash_chunk(texts: list[str], seed: int) -> tuple[np.ndarray, ...]:
    """Linear hashes and field hashes of texts, with a flag for those made only of labelled fields."""
    table = lookup()
    m = len(texts)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in texts), np.int64, m)
    table.learn(np.flatnonzero(np.bincount(raw, minlength=1)) if len(raw) else np.zeros(0, np.int64))
    owner = np.repeat(np.arange(m, dtype=np.int32), lengths)
    kind = table.kind[raw]
    seen = kind != HIDDEN
    cp, owner, kind = raw[seen], owner[seen], kind[seen]
    n = len(cp)
    flags = table.flags[cp]
    digit = (flags & DIGIT) > 0
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        same = owner[1:] == owner[:-1]
        before[1:] = digit[:-1] & same
        after[:-1] = digit[1:] & same
    inside = before & after
    keep = (kind == KEEP) | ((kind == MARK) & inside)
    at = np.flatnonzero(keep)

    # labelled fields: a word, perhaps marks or blanks, and a colon that isn't part of a number
    colon = np.flatnonzero((cp == COLON) & ~inside)
    index = np.arange(n)
    word = (flags & WORD) > 0
    filled = np.maximum.accumulate(np.where(kind == KEEP, index, -1)) if n else index
    other = np.maximum.accumulate(np.where(~word, index, -1)) if n else index
    start_of = np.searchsorted(owner, np.arange(m + 1))
    last = np.where(colon > 0, filled[np.maximum(colon - 1, 0)], -1) if len(colon) else colon
    low = start_of[owner[colon]] if len(colon) else colon
    good = (last >= low) & word[np.maximum(last, 0)] if len(colon) else np.zeros(0, bool)
    colon, last, low = colon[good], last[good], low[good]
    begin = np.maximum(other[last] + 1, low) if len(colon) else colon
    f_owner = owner[colon] if len(colon) else np.zeros(0, np.int32)
    n_fields = np.bincount(f_owner, minlength=m)

    # folded units of the kept characters
    count = table.count[cp[at]].astype(np.int64)
    unit = np.repeat(table.first[cp[at]], count) if (count != 1).any() else table.first[cp[at]]
    source = np.repeat(at, count)
    if (count > 1).any():
        offset = np.cumsum(count) - count
        many = np.flatnonzero(count > 1)
        points = cp[at[many]]
        for p in np.unique(points).tolist():
            where = offset[many[points == p]]
            for k, c in enumerate(table.lists[p]):
                unit[where + k] = c
    unit_bounds = np.searchsorted(source, start_of)
    rank = np.arange(len(unit)) - np.repeat(unit_bounds[:-1], np.diff(unit_bounds))
    top = int(rank.max()) + 2 if len(rank) else 1

    first_kept = np.full(m, -1)
    has = np.diff(unit_bounds) > 0
    if len(source):
        first_kept[has] = source[unit_bounds[:-1][has]]
    labelled = n_fields >= 2
    if len(colon):
        edge = np.r_[True, f_owner[1:] != f_owner[:-1]]
        labelled[f_owner[edge]] &= begin[edge] == first_kept[f_owner[edge]]
        field_end = np.r_[np.where(f_owner[1:] == f_owner[:-1], begin[1:], start_of[f_owner[:-1] + 1]), start_of[f_owner[-1] + 1]]
        value_units = np.searchsorted(source, field_end) - np.searchsorted(source, colon)
        bad = np.unique(f_owner[value_units <= 0])
        labelled[bad] = False
    else:
        field_end = colon

    linear, fielded = [], []
    for k in (0, 1):
        s = 2 * seed + k
        value = _mix(unit.astype(np.uint64) + np.uint64((s + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        powers = _powers(_base(s), top)
        linear.append(_sums(value * powers[rank], unit_bounds) if len(unit) else np.zeros(m, np.uint64))
        total = np.zeros(m, np.uint64)
        use = labelled[f_owner] if len(colon) else np.zeros(0, bool)
        if use.any():
            lo = np.searchsorted(source, begin[use])
            mid = np.searchsorted(source, colon[use])
            hi = np.searchsorted(source, field_end[use])
            spans = np.stack([lo, hi], 1).ravel()
            # a field's terms have the ranks of the message, so they are divided by the power at its start: the base is odd
            terms = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[rank], dtype=np.uint64)])
            shift = _inverse_powers(_base(s), top)[rank[np.minimum(lo, len(rank) - 1)]]
            one = (terms[spans[1::2]] - terms[spans[0::2]]) * shift
            one = _mix(one + _mix((mid - lo).astype(np.uint64) + np.uint64(s + 77)))
            np.add.at(total, f_owner[use], one)
        fielded.append(total)
    disordered = _disordered(unit, unit_bounds)
    return linear[0], linear[1], fielded[0], fielded[1], labelled, disordered


def _inverse_powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(np.uint64(pow(int(base), -1, 2**64)), n)


def _disordered(unit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts whose combining marks may stand in another order than the canonical one."""
    out = np.zeros(len(bounds) - 1, bool)
    marks = np.flatnonzero((unit >= 0x300) & (unit < 0x1F000))
    pairs = marks[np.r_[False, np.diff(marks) == 1]] if len(marks) else marks
    for i in pairs.tolist():
        a, b = (unicodedata.combining(chr(int(unit[i - 1]))), unicodedata.combining(chr(int(unit[i]))))
        if a > b > 0:
            out[np.searchsorted(bounds, i, "right") - 1] = True
    return out


def hash_texts(texts: list[str], seed: int = 0) -> tuple[np.ndarray, ...]:
    """``(l1, l2, m1, m2, labelled)`` of each text: 128 bits of the whole, 128 of its fields in any order."""
    parts, chunk, size = [], [], 0
    for t in texts:
        if chunk and size + len(t) > CHUNK_CHARS:
            parts.append(_chunk(chunk, seed))
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    parts.append(_chunk(chunk, seed))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _chunk(texts: list[str], seed: int) -> tuple[np.ndarray, ...]:
    *out, disordered = _hash_chunk(texts, seed)
    if disordered.any():
        k = np.flatnonzero(disordered)
        *again, _ = _hash_chunk([unicodedata.normalize("NFD", texts[i]) for i in k.tolist()], seed)
        for a, b in zip(out, again):
            a[k] = b
    return tuple(out)


# two-pointer comparison


def _visible(text: str) -> Iterator[tuple[int, int]]:
    """Class and code point of the characters that aren't invisible."""
    table = lookup()
    for cp in map(ord, text):
        if not table.known[cp]:
            table.learn(np.array([cp]))
        kind = table.kind[cp]
        if kind != HIDDEN:
            yield int(kind), cp


def units(text: str, start: int = 0, stop: int | None = None) -> Iterator[int]:
    """Folded units of a text, one by one; the pointer skips what doesn't count."""
    table = lookup()
    if any(unicodedata.combining(a) > unicodedata.combining(b) > 0 for a, b in zip(text, text[1:])):
        text = unicodedata.normalize("NFD", text)
    was_digit = False
    waiting: int | None = None  # a mark after a digit: it counts if a digit follows
    for kind, cp in _visible(text[start:stop]):
        digit = bool(table.flags[cp] & DIGIT)
        if waiting is not None:
            if digit:
                yield from table.lists.get(waiting, (int(table.first[waiting]),))
            waiting = None
        if kind == KEEP:
            yield from table.lists.get(cp, (int(table.first[cp]),))
        elif kind == MARK and was_digit:
            waiting = cp
        was_digit = digit


def same_text(a: str, b: str) -> bool:
    return a == b or all(x == y for x, y in zip_longest(units(a), units(b)))


def fields(text: str) -> list[tuple[int, int, int]] | None:
    """Start, colon and end of the labelled fields, or None if the text isn't made only of such."""
    if text.count(":") < 2:
        return None
    table = lookup()
    seen = [(i, *x) for i, ch in enumerate(text) for x in _visible(ch)]
    found = []
    for k, (i, _, cp) in enumerate(seen):
        if cp != COLON:
            continue
        if 0 < k < len(seen) - 1 and all(table.flags[seen[j][2]] & DIGIT for j in (k - 1, k + 1)):
            continue
        j = k - 1
        while j >= 0 and seen[j][1] != KEEP:
            j -= 1
        if j < 0 or not table.flags[seen[j][2]] & WORD:
            continue
        while j > 0 and table.flags[seen[j - 1][2]] & WORD:
            j -= 1
        found.append((seen[j][0], i))
    if len(found) < 2 or next(units(text[: found[0][0]]), None) is not None:
        return None
    ends = [s for s, _ in found[1:]] + [len(text)]
    out = [(s, c, e) for (s, c), e in zip(found, ends)]
    return None if any(next(units(text[c:e]), None) is None for _, c, e in out) else out


def same_fields(a: str, b: str) -> bool:
    """Whether two texts are made of the same labelled fields, in any order."""
    fa, fb = fields(a), fields(b)
    if fa is None or fb is None or len(fa) != len(fb):
        return False

    def parts(text: str, spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[tuple[str, str]]]:
        out: dict[tuple[int, int], list[tuple[str, str]]] = {}
        for s, c, e in spans:
            label, value = text[s:c], text[c:e]
            h = 0
            for u in units(value):
                h = (h * 1_000_003 + u) % (2**61 - 1)
            out.setdefault((sum(units(label)), h), []).append((label, value))
        return out

    pa_, pb = parts(a, fa), parts(b, fb)
    if {k: len(v) for k, v in pa_.items()} != {k: len(v) for k, v in pb.items()}:
        return False
    for key, mine in pa_.items():
        rest = list(pb[key])
        for label, value in mine:
            hit = next((x for x in rest if same_text(label, x[0]) and same_text(value, x[1])), None)
            if hit is None:
                return False
            rest.remove(hit)
    return True


def same_message(a: str, b: str) -> bool:
    """Whether two texts are one message: the same units in order, or the same fields in any order."""
    return same_text(a, b) or same_fields(a, b)


def same_row(a: str, b: str) -> bool:
    """Whether two texts have the same units in order and, if either is made of fields, the same fields."""
    return a == b or same_text(a, b) and (same_fields(a, b) or fields(a) is fields(b) is None)


#: What is compared for rows of a group, for groups with equal wholes and for groups with equal fields.
SAME = {"row": same_row, "text": same_text, "fields": same_fields}


# Spark


def hashed(rows: DataFrame, id_col: str, text_col: str, seed: int = 0, bits: int = 64) -> DataFrame:
    """``id, l1, l2, m1, m2`` of the rows with a text; ``m1, m2`` are null unless it is made only of labelled fields.

    ``bits`` under 64 weakens the hashes, for tests of the verification.
    """
    mask = np.uint64(2**bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l1, l2, m1, m2, labelled = hash_texts(batch.column(1).to_pylist(), seed)
            out = [pa.array((x & mask).view(np.int64)) for x in (l1, l2)]
            out += [pa.array((x & mask).view(np.int64), mask=~labelled) for x in (m1, m2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["id", "l1", "l2", "m1", "m2"])

    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return spread(texts).mapInArrow(run, "id bigint, l1 bigint, l2 bigint, m1 bigint, m2 bigint")


def _attach(rows: DataFrame, heads: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``heads``, whose column ``size`` counts the rows of each key.

    Keys of ``HOT_ROWS`` rows or more, of which there are ``MAX_HOT`` at most, are broadcast, so no task gets the rows of a hot key.
    """
    hot_from = max(HOT_ROWS, total // MAX_HOT)
    hot = F.broadcast(heads.where(F.col(size) >= hot_from))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(heads.where(F.col(size) < hot_from), keys)
    return rows.join(hot, keys).unionByName(cold)


def _checked(items: DataFrame, texts: DataFrame) -> DataFrame:
    """``items`` (level, id, head, root, n) other than heads, with ``ok``: whether the texts of ``id`` and ``head`` are the same in the sense of the level.

    ``n`` is the size of the head's group; where it is large, the head's text is repeated under as many salts as its group
    needs, so a hot group is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, ta, tb = (batch.column(k).to_pylist() for k in ("level", "ta", "tb"))
            ok = pa.array([SAME[k](x, y) for k, x, y in zip(levels, ta, tb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("level", "id", "head", "root")] + [ok], ["level", "id", "head", "root", "ok"])

    pairs = items.where("id <> head")
    parts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    left = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int"))
    heads = pairs.groupBy("head").agg(F.max(parts).alias("parts"))
    heads = heads.join(texts.select(F.col("id").alias("head"), F.col("text").alias("tb")), "head")
    heads = heads.select("head", "tb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    both = left.join(texts.select("id", F.col("text").alias("ta")), "id").join(heads, ["head", "salt"])
    return both.select("level", "id", "head", "root", "ta", "tb").mapInArrow(run, "level string, id bigint, head bigint, root bigint, ok boolean")


def _written(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.parquet(_write(df, df.sparkSession, name))


def _write(df: DataFrame, spark, name: str) -> str:
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def components(edges: DataFrame, total: int) -> DataFrame:
    """``node, root`` of every node of ``edges`` (a, b): the smallest node that it is connected with, over any number of edges."""
    both = _written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "format-edges")
    labels = _written(both.groupBy("a").agg(F.count("*").alias("k")).select(F.col("a").alias("node"), F.col("a").alias("root"), "k"), "format-labels")
    while True:
        told = _attach(both, labels.withColumnRenamed("node", "a"), ["a"], "k", total).groupBy("b").agg(F.min("root").alias("low"))
        new = labels.join(told.withColumnRenamed("b", "node"), "node")
        new = _written(new.select("node", F.least("root", "low").alias("root"), "k", (F.col("low") < F.col("root")).alias("moved")), "format-labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels.select("node", "root")


def _settled(checked: DataFrame, texts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (level, id, head, root) that hold and the heads (level, id, root) that came anew, after all refuted rows have found their like.

    Of the rows that aren't what their head is, the smallest becomes the next head of its group, until nothing is refuted.
    """
    sure, fresh = [checked.where("ok").drop("ok")], []
    while not (bad := checked.where("not ok")).isEmpty():
        heads = _written(bad.groupBy("level", "root").agg(F.min("id").alias("next"), F.count("*").alias("n")), "format-heads")
        fresh.append(heads.select("level", F.col("next").alias("id"), "root"))
        items = _attach(bad.select("level", "id", "root"), heads, ["level", "root"], "n", total)
        checked = _written(_checked(items.withColumnRenamed("next", "head"), texts), "format-checked")
        sure.append(checked.where("ok").drop("ok"))
    none = texts.sparkSession.createDataFrame([], "level string, id bigint, root bigint")
    return functools.reduce(DataFrame.union, sure), functools.reduce(DataFrame.union, fresh, none)


def _links(groups: DataFrame, total: int) -> DataFrame:
    """Groups of rows that share the hash of the whole or of their fields with others, each with the first of those."""

    def level(name: str, some: DataFrame, keys: list[str]) -> DataFrame:
        heads = _written(some.groupBy(*keys).agg(F.min("p").alias("head"), F.count("*").alias("k")).where("k > 1"), "format-heads")
        out = _attach(some.select("p", *keys), heads, keys, "k", total)
        return out.select(F.lit(name).alias("level"), F.col("p").alias("id"), "head", F.col("head").alias("root"), F.col("k").alias("n"))

    return level("text", groups, ["l1", "l2"]).union(level("fields", groups.where("labelled"), ["m1", "m2"]))


def same_messages(rows: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """``id, kept_id`` of every row with another one of the same message; ``kept_id`` is the smallest id.

    Rows are grouped by both hashes: of the whole and of the fields in any order. Groups with equal wholes or equal fields are linked, and
    messages are the connected components, so a text that can be cut into fields in two ways links all that equal it under either.
    Every row is compared with its group's first one, every group with the first of those it is linked with. Rows that a comparison
    refutes are compared among themselves, so a collision neither joins nor loses rows and leaves all other groups as they are.

    Null texts are no messages. Texts without a counting character (empty, blank, punctuation) are one message. Ids are unique.
    """
    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    hashes = _written(hashed(texts, "id", "text", 0, bits), "format-hashes")
    total = hashes.count()
    # texts without fields have no second hash
    m1, m2 = (F.coalesce(m, F.lit(0)).alias(m) for m in ("m1", "m2"))
    hashes = hashes.select("id", "l1", "l2", m1, m2, F.col("m1").isNotNull().alias("labelled"))
    by = ["l1", "l2", "m1", "m2", "labelled"]
    groups = _written(hashes.groupBy(*by).agg(F.min("id").alias("p"), F.count("*").alias("n")), "format-groups")
    own = _attach(hashes, groups.where("n > 1"), by, "n", total)
    own = own.select(F.lit("row").alias("level"), "id", F.col("p").alias("head"), F.col("p").alias("root"), "n")
    checked = _written(_checked(own.union(_links(groups, total)), texts), "format-checked")
    refuted = not checked.where("not ok").isEmpty()
    sure = checked.drop("ok")
    if refuted:
        of_rows, fresh = _settled(checked.where("level = 'row'"), texts, total)
        fresh = fresh.join(groups.drop("n").withColumnRenamed("p", "root"), "root").select(*by, F.col("id").alias("p"), F.lit(1).cast("bigint").alias("n"))
        links = _written(_checked(_links(_written(groups.union(fresh), "format-groups"), total), texts), "format-checked")
        sure = _written(of_rows.union(_settled(links, texts, total)[0]), "format-sure")

    # groups with the same fields meet in their first one; what is left to connect are equal wholes
    meet = sure.where("level = 'fields'").select(F.col("id").alias("p"), F.col("head").alias("c"))
    edges = sure.where("level = 'text'").select("id", "head")
    edges = edges.join(meet.withColumnRenamed("p", "id"), "id", "left").select(F.coalesce("c", "id").alias("a"), "head")
    edges = edges.join(meet.withColumnRenamed("p", "head"), "head", "left").select("a", F.coalesce("c", "head").alias("b")).where("a <> b")
    edges = _written(edges, "format-links")
    firsts = sure.where("level <> 'row'").select(F.explode(F.array("id", "head")).alias("p")).distinct().join(meet, "p", "left")
    firsts = firsts.select("p", F.coalesce("c", "p").alias("kept"))
    if not edges.isEmpty():
        roots = components(edges, total)
        firsts = firsts.join(roots, F.col("kept") == F.col("node"), "left").select("p", F.coalesce("root", "kept").alias("kept"))
    pairs = sure.where("level = 'row'").select("id", F.col("head").alias("p"))
    sizes = pairs.groupBy("p").agg(F.count("*").alias("n")).join(firsts, "p", "full").select("p", F.coalesce("kept", "p").alias("kept"), F.coalesce("n", F.lit(0)).alias("n"))
    sizes = _written(sizes, "format-kept")
    out = _attach(pairs, sizes, ["p"], "n", total).select("id", F.col("kept").alias("kept_id"))
    return out.union(sizes.select(F.col("p").alias("id"), "kept"))


def collapse(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One record per message, the one with the smallest id, with ``n_copies``; other columns pass through, whatever their names.

    Rows with a null text stay as they are, each with one copy. A column ``n_copies`` of the input is replaced.
    """
    classes = same_messages(rows, id_col, text_col).select(F.col("id").alias("__id"), F.col("kept_id").alias("__kept"))
    counts = classes.groupBy("__kept").agg(F.count("*").alias("__n"))
    copies = classes.where("__id <> __kept").select("__id")
    left = rows.drop("n_copies").join(copies, F.col(id_col) == F.col("__id"), "left_anti")
    out = left.join(counts, F.col(id_col) == F.col("__kept"), "left")
    return out.withColumn("n_copies", F.coalesce("__n", F.lit(1))).drop("__kept", "__n")
