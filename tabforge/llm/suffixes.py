r"""Repeated passages by a sparse suffix array over the whole corpus.

Words are runs of characters outside ``[\x20\x09-\x0D]``, with A-Z lower-cased.
A window is MIN_WORDS consecutive words; it is repeated when another document holds
the same words.  Repeated windows of a document that overlap are joined, which makes
its passages: exactly the words that lie in some run of MIN_WORDS words or more that
another document has too (but for collisions of 64-bit hashes).

Retained suffixes.  The seed of a window is the position of the least (leftmost of
equals) of the hashes of the GRAM words from each of its first WINDOW positions: a
choice made by content, so equal windows have their seed at the same place, and its
first SHARED words lie in the window.  Only suffixes at seeds are retained.  Those whose
SHARED words no other document has, have no neighbour to be compared with and are left
out; where all suffixes with the same SHARED words agree in their whole surroundings
(LEFT words before, MIN_WORDS from the seed on), these are repeated as they stand.

Array.  Of the others, each different surroundings is one entry, which carries the
hashes of its words.  The entries are sorted by the SHARED words, then word by word to the
right, then word by word to the left: split by range at any word, so a prefix of a third
of all rows is many tasks.  Every entry is compared with the nearest entry of another
document on both sides, across the borders of the ranges too, and the match is extended
to the right and to the left.  A neighbour has the longest match to the right.

Other partners.  A partner that matches less to the right may match more to the left.
An entry is open when its longest match to the right leaves room for a window that no
neighbour's match covers; then the windows of all entries with its SHARED words are
compared by their hashes, made from the entries.

Minima and maxima of document handles per key are combined before the shuffle and
joined back to the rows, so a passage in a third of all documents meets in no single
task, and the work grows with the number of words.

Defined results: null or empty texts and texts of fewer than MIN_WORDS words have no
row; a passage that repeats within one document only is none; equal rows count as
one document and get a row each; rows that share a doc_id but not the text, or have
no doc_id, are documents of their own and carry their doc_id in the result; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .jaccard_join import marked, mix
from .shingling import word_hashes

GRAM, WINDOW, SHARED = 8, 26, 24
MIN_WORDS = 50
LEFT, RIGHT = WINDOW - 1, MIN_WORDS - SHARED
#: Entries of a range, and most ranges: four entries of each go through the driver, 30 MB at most.
RANGE_ROWS, MOST_RANGES = 50_000, 16_384
FLUSH_ROWS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Blocks:
    """Hashes of blocks of a text's words, from prefix sums of the words' hashes times
    powers of one odd base."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.concatenate([[np.uint64(1)], np.full(n, _BASE)]).cumprod(dtype=np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], (h * power[:n]).cumsum(dtype=np.uint64)])
        self.inverse = np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]).cumprod(dtype=np.uint64)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # dividing by the odd power of start makes equal words equal wherever they stand
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def seeds_of_windows(blocks: Blocks, n: int) -> np.ndarray:
    """For each window of a text of ``n`` words, by its first word, where its seed stands."""
    at = np.arange(n - MIN_WORDS + WINDOW)
    grams = np.lib.stride_tricks.sliding_window_view(blocks.hashes(at, at + GRAM), WINDOW)
    return np.arange(len(grams)) + grams.argmin(1)


SEEDS = pa.schema([("handle", pa.int64()), ("around", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()),
                   ("before", pa.int8()), ("after", pa.int8())])
SEEDS_SQL = "handle long, around long, rid long, pos int, before byte, after byte"
ENTRIES = pa.schema([("handle", pa.int64()), ("around", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                     ("right", pa.binary()), ("left", pa.binary()), ("before", pa.int8()), ("after", pa.int8()),
                     ("first", pa.int8()), ("last", pa.int8())])
ENTRIES_SQL = ("handle long, around long, low long, high long, right binary, left binary, before byte, after byte, "
               "first byte, last byte")
MATCHES = pa.schema([("handle", pa.int64()), ("around", pa.int64()), ("l", pa.int8()), ("r", pa.int8()), ("open", pa.bool_())])
MATCHES_SQL = "handle long, around long, l byte, r byte, open boolean"
WINDOWS = pa.schema([("handle", pa.int64()), ("group", pa.int64()), ("around", pa.int64()), ("o", pa.int8()),
                     ("low", pa.int64()), ("high", pa.int64())])
WINDOWS_SQL = "handle long, group long, around long, o byte, low long, high long"


def texts_words(texts: pa.Array) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts)
    ends = counts.cumsum()
    return (words[e - n:e] for e, n in zip(ends.tolist(), counts.tolist()))


def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to its seeds: hash of the SHARED words, hash of the surroundings and of the
    seed's place in them, words before and from the seed on."""
    for batch in batches:
        parts = []
        for rid, h in zip(batch.column(0).to_pylist(), texts_words(batch.column(1))):
            n = len(h)
            if n < MIN_WORDS:
                continue
            blocks = Blocks(h)
            seeds = np.unique(seeds_of_windows(blocks, n))
            before, after = np.minimum(seeds, LEFT), np.minimum(n - seeds, MIN_WORDS)
            around = mix(blocks.hashes(seeds - before, seeds + after) + before.astype(np.uint64))
            parts.append((blocks.hashes(seeds, seeds + SHARED).view(np.int64), around.view(np.int64),
                          np.full(len(seeds), rid, np.int64), seeds.astype(np.int32),
                          before.astype(np.int8), after.astype(np.int8)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=SEEDS)


def fixed_bytes(words: np.ndarray) -> pa.Array:
    """Each row of 64-bit words as one binary value."""
    n, width = words.shape[0], words.shape[1] * 8
    limits = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(limits), pa.py_buffer(words.tobytes())])


def entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, asked: pos, handle, around, low, high of the entries taken from it) to entries.
    ``right`` holds the words behind the SHARED ones, ``left`` those before the seed, the
    nearest first; ``first`` to ``last`` say how many words before the seed its windows start."""
    for batch in batches:
        for h, asked in zip(texts_words(batch.column(0)), batch.column(1)):
            fields = asked.values.flatten()
            pos, handle, around, low, high = (f.to_numpy(zero_copy_only=False) for f in fields)
            n = len(h)
            seeds = seeds_of_windows(Blocks(h), n)
            padded = np.concatenate([np.zeros(LEFT, np.uint64), h, np.zeros(MIN_WORDS, np.uint64)])
            for s in range(0, len(pos), FLUSH_ROWS // 10):
                cut = slice(s, s + FLUSH_ROWS // 10)
                p = pos[cut].astype(np.int64)
                right = padded[LEFT + p[:, None] + SHARED + np.arange(RIGHT)]
                left = padded[LEFT + p[:, None] - 1 - np.arange(LEFT)]
                last = p - np.searchsorted(seeds, p)
                first = p - (np.searchsorted(seeds, p, "right") - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(handle[cut]), pa.array(around[cut]), pa.array(low[cut]), pa.array(high[cut]),
                     fixed_bytes(right), fixed_bytes(left), pa.array(np.minimum(p, LEFT).astype(np.int8)),
                     pa.array(np.minimum(n - p, MIN_WORDS).astype(np.int8)), pa.array(first.astype(np.int8)),
                     pa.array(last.astype(np.int8))], schema=ENTRIES)


def column(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def word_matrix(rows: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    values = rows.column(name)
    _, limits, data = values.buffers()
    start = np.frombuffer(limits, np.int32)[values.offset] if len(values) else 0
    return np.frombuffer(data, np.uint64, len(values) * width, start).reshape(-1, width)


def run_starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where runs of entries of one single document begin; an entry that several documents
    have is a run of its own, so neighbouring runs always hold different documents."""
    low, high = column(rows, "low"), column(rows, "high")
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (low[1:] != high[1:]) | (low[:-1] != high[:-1])
    return np.flatnonzero(new)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts, ENTRIES).combine_chunks().to_batches()[0]


def border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range: the first entry of its first two runs and the last entry of its last two
    (one of each where it is one run), as one row."""
    head, tail = None, None
    for batch in batches:
        if batch.num_rows:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=ENTRIES)
            head = batch if head is None else joined([head, batch])
            head = head.take(run_starts(head)[:2])
            tail = batch if tail is None else joined([tail, batch])
            starts = run_starts(tail)
            tail = tail.take(np.append(starts[1:] - 1, tail.num_rows - 1)[-2:])
    if head is not None:
        packed = [pa.Table.from_batches([x]).to_pylist() for x in (head, tail)]
        kind = pa.list_(pa.struct(list(ENTRIES)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array(packed[:1], kind), pa.array(packed[1:], kind)], ["part", "head", "tail"])


def one_document(entry: dict, other: dict) -> bool:
    return entry["low"] == entry["high"] == other["low"] == other["high"]


def beyond(borders: dict[int, list[dict]], parts) -> dict[int, list[dict]]:
    """For each of ``parts`` in turn the nearest entry outside it and the nearest one of another
    run than that; ``borders``: a range's own two, the nearest first."""
    out, carry = {}, []
    for p in parts:
        out[p] = carry
        own = borders.get(p, [])
        if len(own) == 1:
            own = own + [c for c in carry if not one_document(c, own[0])][:1]
        carry = own or carry
    return out


def matched(rows: pa.RecordBatch, right: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """Words to the left and right of their seeds on which entries ``a`` and ``b`` agree
    (none unless they share the SHARED words; ``b`` -1: no neighbour)."""
    handle, before, after = (column(rows, c) for c in ("handle", "before", "after"))
    same = (b >= 0) & (handle[a] == handle[b])
    to_right = SHARED + np.logical_and.accumulate(right[a] == right[b], 1).sum(1)
    to_left = np.logical_and.accumulate(left[a] == left[b], 1).sum(1)
    return (np.where(same, np.minimum(to_left, np.minimum(before[a], before[b])), 0),
            np.where(same, np.minimum(to_right, np.minimum(after[a], after[b])), 0))


def matches_of(rows: pa.RecordBatch, starts: np.ndarray, pick: np.ndarray) -> pa.RecordBatch:
    """Extent of the repeated words around the entries ``pick``, and whether they are open."""
    run = np.searchsorted(starts, pick, "right") - 1
    right, left = word_matrix(rows, "right", RIGHT), word_matrix(rows, "left", LEFT)
    previous = starts[run] - 1
    after_run = np.append(starts[1:], -1)[run]
    several = (column(rows, "low") != column(rows, "high"))[pick]
    own_l, own_r = column(rows, "before")[pick], column(rows, "after")[pick]
    first, last = column(rows, "first")[pick], column(rows, "last")[pick]
    sides = [matched(rows, right, left, pick, previous), matched(rows, right, left, pick, after_run)]
    sides.append((np.where(several, own_l, 0), np.where(several, own_r, 0)))
    longest = np.maximum.reduce([r for _, r in sides])
    o = np.arange(WINDOW)[None, :]
    room = (o >= first[:, None]) & (o <= last[:, None]) & (o >= MIN_WORDS - longest[:, None])
    l = r = np.zeros(len(pick), np.int8)
    for to_left, to_right in sides:
        room &= (o > to_left[:, None]) | (o < MIN_WORDS - to_right[:, None])
        whole = to_left + to_right >= MIN_WORDS
        l = np.maximum(l, np.where(whole, to_left, 0))
        r = np.maximum(r, np.where(whole, to_right, 0))
    # two entries with the same SHARED words, both seen here, have no other partner
    handle = column(rows, "handle")
    limits = np.concatenate([[0], np.flatnonzero(handle[1:] != handle[:-1]) + 1, [len(handle)]])
    group = np.searchsorted(limits, pick, "right") - 1
    begin, end = limits[group], limits[group + 1]
    alone = (end - begin <= 2) & (begin > 0) & (end < len(handle))
    return pa.RecordBatch.from_arrays(
        [pa.array(handle[pick]), pa.array(column(rows, "around")[pick]), pa.array(l.astype(np.int8)),
         pa.array(r.astype(np.int8)), pa.array(room.any(1) & ~several & ~alone)], schema=MATCHES)


def neighbour_maker(before: dict[int, list[dict]], behind: dict[int, list[dict]]):
    """Entries of a sorted range to matches with their neighbours.  Held at a time: a batch
    and the last run, which is one document's."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def outside(entries: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(entries, ENTRIES)

        held = outside(before.get(part, [])[::-1])
        mine = np.zeros(held.num_rows, bool)
        incoming = ((pa.RecordBatch.from_arrays(b.columns, schema=ENTRIES), True) for b in batches)
        for batch, ours in incoming:
            if not batch.num_rows:
                continue
            held, mine = joined([held, batch]), np.append(mine, np.full(batch.num_rows, ours))
            starts = run_starts(held)
            settled = np.flatnonzero(mine[:starts[-1]])
            if len(settled):
                yield matches_of(held, starts, settled)
            keep = max(starts[-1] - 1, 0)
            mine[:starts[-1]] = False
            held, mine = held.slice(keep), mine[keep:]
        rest = outside(behind.get(part, []))
        if mine.any():
            held, mine = joined([held, rest]), np.append(mine, np.zeros(rest.num_rows, bool))
            yield matches_of(held, run_starts(held), np.flatnonzero(mine))
    return compare


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries to the hashes of their seeds' windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.RecordBatch.from_arrays(batch.columns, schema=ENTRIES)
        sides = []
        for name, width in (("left", LEFT), ("right", RIGHT)):
            words = word_matrix(rows, name, width)
            hashed = np.zeros((len(words), width + 1), np.uint64)
            for k in range(width):
                hashed[:, k + 1] = mix(hashed[:, k] * _BASE + words[:, k] + np.uint64(1))
            sides.append(hashed)
        o = np.arange(WINDOW)
        hashed = mix(mix(sides[0] * _BASE + sides[1][:, RIGHT - o]) + column(rows, "handle").view(np.uint64)[:, None] * _BASE
                     + o.astype(np.uint64))
        at, o = np.nonzero((o >= column(rows, "first")[:, None]) & (o <= column(rows, "last")[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashed[at, o].view(np.int64)), pa.array(column(rows, "handle")[at]), pa.array(column(rows, "around")[at]),
             pa.array(o.astype(np.int8)), pa.array(column(rows, "low")[at]), pa.array(column(rows, "high")[at])], schema=WINDOWS)


def in_two(rows: DataFrame, low: str, high: str, *more) -> DataFrame:
    """Handles that occur in more than one document."""
    return (rows.groupBy("handle").agg(F.min(low).alias("low"), F.max(high).alias("high"), *more)
            .where("low <> high").drop("low", "high"))


def sorted_entries(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The sparse suffix array: its partitions are ranges in order, sorted inside."""
    groups = hits.groupBy("handle", "around").agg(F.min("rid").alias("low"), F.max("rid").alias("high"),
                                                  F.min(F.struct("rid", "pos")).alias("at"))
    # one document's entries are as many as its own words at most
    asked = groups.groupBy(F.col("at.rid").alias("rid")).agg(
        F.collect_list(F.struct("at.pos", "handle", "around", "low", "high")).alias("asked"))
    asked = materialise(asked.withColumnRenamed("rid", "handle"), "suffix-asked")
    held = marked(texts.withColumnRenamed("rid", "handle"), asked.select("handle")).join(asked, "handle")
    entries = materialise(held.select("text", "asked").mapInArrow(entry_rows, ENTRIES_SQL), "suffix-entries")
    ranges = min(MOST_RANGES, entries.count() // RANGE_ROWS + 1)
    order = ["handle", "right", "left"]
    return entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order).checkpoint()


def repeated_around(array: DataFrame) -> DataFrame:
    """(handle, around, l, r): words before the seed and from it on that are repeated."""
    kind = f"array<struct<{ENTRIES_SQL.replace(' ', ':').replace(',:', ',')}>>"
    borders = array.mapInArrow(border_rows, f"part int, head {kind}, tail {kind}").collect()
    heads = {b["part"]: [e.asDict() for e in b["head"]] for b in borders}
    tails = {b["part"]: [e.asDict() for e in b["tail"]][::-1] for b in borders}
    parts = sorted(heads)
    compare = neighbour_maker(beyond(tails, parts), beyond(heads, parts[::-1]))
    matches = materialise(array.mapInArrow(compare, MATCHES_SQL), "suffix-matches")
    open_at = materialise(matches.where("open").select("handle").distinct(), "suffix-open")
    entries = marked(array, open_at).join(open_at, "handle", "left_semi")
    windows = materialise(entries.select(ENTRIES.names).mapInArrow(window_rows, WINDOWS_SQL), "suffix-windows")
    found = materialise(in_two(windows, "low", "high"), "suffix-found")
    # all windows of a seed hold it, so their union is one run
    others = marked(windows, found).join(found, "handle").select(
        F.col("group").alias("handle"), "around", F.col("o").alias("l"), (MIN_WORDS - F.col("o")).cast("byte").alias("r"))
    return (matches.where("r > 0").drop("open").union(others)
            .groupBy("handle", "around").agg(F.max("l").alias("l"), F.max("r").alias("r")))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(rid, start, end) of repeated words, none shorter than MIN_WORDS; spans may overlap."""
    seeds = materialise(texts.mapInArrow(seed_rows, SEEDS_SQL), "suffix-seeds")
    differ = (F.min("around") != F.max("around")).alias("differ")
    shared = materialise(in_two(seeds, "rid", "rid", differ), "suffix-shared")
    hits = materialise(marked(seeds, shared.select("handle")).join(shared, "handle"), "suffix-hits")
    alike = hits.where("not differ").select("rid", "pos", F.col("before").alias("l"), F.col("after").alias("r"))
    others = hits.where("differ").drop("before", "after")
    # a table of its own, so that the join's hot groups can be split
    found = materialise(repeated_around(sorted_entries(texts, others)), "suffix-around")
    spans = alike.union(others.join(found, ["handle", "around"]).select("rid", "pos", "l", "r")).where(f"l + r >= {MIN_WORDS}")
    return spans.select("rid", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document with a repeated passage: doc_id, n_passages, repeated_words and
    passages (start and end in words, end exclusive)."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # stable wherever a task runs; equal rows (same id or none, same text) are one document
    handle = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text")
    texts = numbered.select(handle.alias("rid"), "doc_id", "text")
    names = materialise(texts.select("rid", "doc_id"), "suffix-names")
    passages = repeated_spans(texts.select("rid", "text")).distinct()      # once for equal rows
    # union of a document's intervals
    order = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = passages.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1))
    spans = (spans.withColumn("k", F.sum("new").over(order)).groupBy("rid", "k")
             .agg(F.min("start").alias("start"), F.max("end").alias("end")))
    per_doc = spans.groupBy("rid").agg(
        F.count("*").alias("n_passages"), F.sum(F.col("end") - F.col("start")).cast("long").alias("repeated_words"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("passages"))
    return per_doc.join(names, "rid").select("doc_id", "n_passages", "repeated_words", "passages")
