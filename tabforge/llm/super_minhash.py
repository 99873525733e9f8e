r"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set is its distinct 4-word shingles (words are runs outside
``[\x20\x09-\x0D]``, A-Z lower-cased).  Documents link when
100 * |A & B| >= 80 * |A | B|, always confirmed on the whole sets.

Signature: every shingle walks through its own random permutation of the VALUES
slots (a Fisher-Yates shuffle driven by hashes of the shingle) and offers slot
p(j) the value j + fraction at step j; a slot keeps the least offer.  Two sets agree in
a slot with a probability equal to their similarity, and because ranks of a shingle are
a permutation the slots are negatively correlated, so the estimate has less
variance than independent minima.  A document stops early: once all its slots hold
values below j no later step can change one.  Steps run over all shingles of an Arrow
batch at once.

Banding: BANDS bands of ROWS slots; documents that agree in a whole band meet.  At a
similarity of 0.8 a pair agrees in no band with a probability of
(1 - 0.8 ** ROWS) ** BANDS, 1.2e-7.  Copies of a set are one class.

Verification, without making a band's pairs:

1. Each class of a band meets the band's hub, the class with the most company over all
   its bands (the centre of a group of copies).
2. Where classes of a band are still in different components, the band is cut into
   blocks of BLOCK_ROWS classes.  Every two blocks meet in one task, which passes on for
   each class only its most similar candidate in another component.
3. What is still apart meets once more in blocks, now with whole sets: a union-find
   inside the task confirms links and passes on only those that join components.

Sets are compared only where their signatures agree in LEAST_SLOTS slots or more; a pair
at 0.8 falls below that with a probability of about 1e-13.

Defined results: null or empty text, or text without words, has n_shingles 0 and its
own doc_id as component; fewer than 4 words are one shingle; repeated rows are rows
of one class and share its component; a null doc_id is no component's smallest unless
alone, and is kept only then; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialise, partitions, text_or_empty
from .jaccard_join import KEPT_BYTES, marked_sets, merged, shared
from .shingling import mix, shingle_sets, slices

WORDS = 4
BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
LEAST_SLOTS = 115
CHUNK = 1 << 15                  # shingles whose permutations are in memory at once
SEEN_CLASSES = 200_000
_GOLDEN = 0x9E3779B97F4A7C15
_STEPS = [np.uint64((k + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF) for k in range(VALUES)]


# --- sets and signatures ------------------------------------------------------
def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash values (sets x VALUES): the step in the upper 32 bits, the fraction below."""
    full = np.iinfo(np.uint64).max
    out = np.full(len(sets) * VALUES, full, np.uint64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(flat), CHUNK):
        shingle, own = flat[at:at + CHUNK], owner[at:at + CHUNK]
        first, last = own[0], own[-1] + 1
        row = np.arange(len(shingle))
        order = np.tile(np.arange(VALUES, dtype=np.uint8), (len(shingle), 1))
        for j in range(VALUES):
            draw = mix(shingle[row] + _STEPS[j])
            k = j + ((draw >> np.uint64(32)) * np.uint64(VALUES - j) >> np.uint64(32)).astype(np.int64)
            slot = order[row, k]
            order[row, k] = order[row, j]
            np.minimum.at(out, own[row] * VALUES + slot, (draw & np.uint64(0xFFFFFFFF)) + np.uint64(j << 32))
            top = out[first * VALUES:last * VALUES].reshape(-1, VALUES).max(1)
            row = row[(top >= np.uint64(j + 1 << 32))[own[row] - first]]
            if not len(row):
                break
    return out.reshape(-1, VALUES)


def band_keys(values: np.ndarray) -> np.ndarray:
    """Keys (sets x BANDS) of the bands."""
    cells = values.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), cells.shape[:2])
    for k in range(ROWS):
        key = mix(key * _STEPS[0] + cells[:, :, k])
    return key


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


DOCS = pa.schema([("doc_id", pa.int64()), ("handle", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()),
                  ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
DOCS_SQL = "doc_id long, handle long, sig long, n long, keys array<long>, sketch binary"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, handle) to class and size of each document; the first of a class in
    a task also has the bands' keys and the low byte of every slot."""
    seen: set[int] = set()
    for b in batches:
        found = slices(*shingle_sets(b.column(1), WORDS))
        sigs = [class_of(s) for s in found]
        if len(seen) > SEEN_CLASSES:
            seen.clear()
        new = []
        for i, (s, sig) in enumerate(zip(found, sigs)):
            if len(s) and sig not in seen:
                seen.add(sig)
                new.append(i)
        values = signatures([found[i] for i in new])
        sketch = (values & np.uint64(255)).astype(np.uint8)
        held = np.zeros(len(found), np.int64)
        held[new] = BANDS
        offsets = np.concatenate([[0], held.cumsum()])
        gone = held == 0
        low = [None] * len(found)
        for row, i in enumerate(new):
            low[i] = sketch[row].tobytes()
        keys = pa.ListArray.from_arrays(pa.array(np.where(np.append(gone, False), None, offsets), pa.int32()),
                                        pa.array(band_keys(values).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(np.asarray(sigs, np.uint64).view(np.int64), pa.int64()),
             pa.array([len(s) for s in found], pa.int64()), keys, pa.array(low, pa.binary())], schema=DOCS)


# --- comparison of pairs ------------------------------------------------------
@F.arrow_udf(T.LongType())
def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Slots in which two sketches agree."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, VALUES) for v in (a, b))
    return pa.array((x == y).sum(1, dtype=np.int64), pa.int64())


def with_sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    for end in ("a", "b"):
        named = table.select(F.col("sig").alias(end), F.col("n").alias(f"n_{end}"), F.col(column).alias(f"x_{end}"))
        pairs = pairs.join(named, end)
    return pairs


def similar(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sizes and signatures leave a link possible."""
    both = with_sides(pairs, sketches, "sketch")
    sizes = (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))
    return both.where(sizes & (agreeing("x_a", "x_b") >= LEAST_SLOTS)).select("a", "b")


def confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs that link, by their whole sets."""
    both = with_sides(pairs, members, "members")
    return both.where(9 * shared("x_a", "x_b") >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


MEMBERS = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])
MEMBERS_SQL = "sig long, n long, members binary"


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size and shingles (40 bits each) of each text."""
    for b in batches:
        found = slices(*shingle_sets(b.column(0), WORDS))
        short = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes() for s in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray([class_of(s) for s in found], np.uint64).view(np.int64), pa.int64()),
             pa.array([len(s) for s in found], pa.int64()), pa.array(short, pa.binary())], schema=MEMBERS)


def members_of(asked: DataFrame, rows: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Whole sets of the classes ``asked`` (sig), each from one of its documents."""
    shown = rows.join(asked, "sig").groupBy("sig").agg(F.min("handle").alias("handle")).checkpoint()
    made = marked_sets(texts, shown.select("handle"), sets, MEMBERS_SQL)
    return materialise(made.join(shown, "sig", "left_semi").dropDuplicates(["sig"]), name)


# --- bands that are not one component -----------------------------------------
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20


def dealt(band: DataFrame, width) -> DataFrame:
    """Rows of bands (key, sig, root, ...) to every pair (i, j) of their band's blocks, sorted
    by it inside a task.  A block has about BLOCK_ROWS rows or BLOCK_BYTES of ``width``."""
    size = (band.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                    F.count("*").alias("rows"), F.sum(width).alias("bytes"))
            .where("x <> y").select("key", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS),
                                                      F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    spread = (band.join(size, "key").withColumn("block", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}))
    return (spread.repartition(partitions(band.sparkSession), "key", "i", "j")
            .sortWithinPartitions("key", "i", "j").select(*band.columns, "i", "j", "block"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one (key, i, j): two blocks of one band."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            mine = tuple(c[start] for c in columns)
            if held and mine != last:
                yield pa.Table.from_batches(held)
                held = []
            last = mine
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


class Blocks:
    """Two blocks of a band: which rows may link with a row."""

    def __init__(self, t: pa.Table):
        self.sig, self.size, self.block = (t[c].to_numpy() for c in ("sig", "n", "block"))
        self.sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, VALUES)
        self.across = t["i"][0].as_py() != t["j"][0].as_py()

    def candidates(self, k: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Later rows in other components that may link with row k, and the slots agreeing."""
        later = np.arange(k + 1, len(root))
        ok = (root[k + 1:] != root[k]) & (5 * self.size[k + 1:] >= 4 * self.size[k])
        ok &= 5 * self.size[k] >= 4 * self.size[k + 1:]
        if self.across:
            ok &= self.block[k + 1:] != self.block[k]
        later = later[ok]
        slots = (self.sketch[later] == self.sketch[k]).sum(1)
        near = slots >= LEAST_SLOTS
        return later[near], slots[near]


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of two blocks its most similar candidate in another component."""
    for t in runs(batches):
        here, root = Blocks(t), t["root"].to_numpy()
        best, with_whom = np.zeros(len(root), np.int64), np.full(len(root), -1)
        for k in range(len(root)):
            other, slots = here.candidates(k, root)
            if len(other):
                better = other[slots > best[other]]
                with_whom[better], best[better] = k, slots[slots > best[other]]
                if slots.max() > best[k]:
                    best[k], with_whom[k] = slots.max(), other[slots.argmax()]
        found = np.flatnonzero(with_whom >= 0)
        if len(found):
            x, y = here.sig[found], here.sig[with_whom[found]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], schema=PAIRS)


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig) of the classes that have a candidate in another component."""
    for t in runs(batches):
        here, root = Blocks(t), t["root"].to_numpy()
        open_ = np.zeros(len(root), bool)
        for k in range(len(root)):
            other, _ = here.candidates(k, root)
            open_[other] = True
            open_[k] |= len(other) > 0
        if open_.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(open_.sum(), t["key"][0].as_py(), np.int64)),
                                              pa.array(here.sig[open_])], ["key", "sig"])


def wide(members: bytes) -> np.ndarray:
    out = np.zeros((len(members) // KEPT_BYTES, 8), np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(members, np.uint8).reshape(-1, KEPT_BYTES)
    return out.reshape(-1).view("<u8")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect components, from whole sets: at most one per class of two blocks."""
    for t in runs(batches):
        here, root = Blocks(t), t["root"].to_numpy().copy()
        codes = [wide(m) for m in t["members"].to_pylist()]
        low = [(c & np.uint64(0xFFFF)).astype(np.uint16) for c in codes]
        mine, links = np.zeros(1 << 16, bool), []
        for k in range(len(root)):
            mine[low[k]] = True
            for o in here.candidates(k, root)[0].tolist():
                need = -(-4 * int(here.size[k] + here.size[o]) // 9)
                # shingles whose low 16 bits the other set has are no fewer than those in common
                if root[o] != root[k] and np.count_nonzero(mine[low[o]]) >= need:
                    if len(np.intersect1d(codes[k], codes[o], assume_unique=True)) >= need:
                        links.append((max(here.sig[k], here.sig[o]), min(here.sig[k], here.sig[o])))
                        root[root == root[o]] = root[k]
            mine[low[k]] = False
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIRS)


def rooted(band: DataFrame, roots: DataFrame) -> DataFrame:
    return (band.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
            .withColumn("root", F.coalesce("root", "sig")).select("key", "sig", "root"))


def several_roots(band: DataFrame) -> DataFrame:
    """Rows of the bands (key, sig, root) that lie in more than one component."""
    split = (band.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"))
             .where("x <> y").select("key"))
    return band.join(split, "key")


# --- groups -------------------------------------------------------------------
def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of documents: doc_id, sig, n; rows node, root: components of classes)."""
    # a document is found again by its id, or by a hash of its text where it has none
    handle = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()))
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), handle.alias("handle"))
    made = materialise(texts.mapInArrow(signed, DOCS_SQL), "superminhash-docs")
    rows = made.select("doc_id", "handle", "sig", "n")
    one_each = made.where("sketch is not null").dropDuplicates(["sig"])
    sketches = materialise(one_each.select("sig", "n", "sketch", "keys"), "superminhash-classes")
    banded = sketches.select(F.explode("keys").alias("key"), "sig")
    sketches = sketches.select("sig", "n", "sketch")
    company = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(banded.join(company, "key"), "superminhash-bands")
    # the hub of a band: the class with the most company over all its bands
    score = met.groupBy("sig").agg(F.sum("size").alias("score"))
    hubs = (met.join(score, "sig").groupBy("key").agg(F.max(F.struct("score", "sig")).alias("top"))
            .select("key", F.col("top.sig").alias("hub")))
    met = materialise(met.select("key", "sig").join(hubs, "key").where("sig <> hub"), "superminhash-met")
    pairs = met.select(F.greatest("sig", "hub").alias("a"), F.least("sig", "hub").alias("b")).distinct()
    pairs = similar(pairs, sketches).checkpoint()
    either = lambda p: p.select(F.col("a").alias("sig")).union(p.select(F.col("b").alias("sig"))).distinct()
    members = members_of(either(pairs), rows, texts, "superminhash-sets")
    roots = components(confirmed(pairs, members)).checkpoint()
    # every class has met its bands' hubs; the rest of a band in several components has not met
    left = materialise(several_roots(rooted(met, roots)).join(sketches, "sig"), "superminhash-left")
    best = dealt(left, F.lit(VALUES)).mapInArrow(likely, "a long, b long").distinct().checkpoint()
    if best.isEmpty():
        return rows, roots
    members = members_of(either(best), rows, texts, "superminhash-sets")
    roots = merged(roots, confirmed(best, members).checkpoint()).checkpoint()
    left = several_roots(rooted(left.select("key", "sig"), roots)).join(sketches, "sig")
    open_ = dealt(left, F.lit(VALUES)).mapInArrow(possible, "key long, sig long").distinct().checkpoint()
    if open_.isEmpty():
        return rows, roots
    members = members_of(open_.select("sig").distinct(), rows, texts, "superminhash-sets")
    whole = rooted(open_, roots).join(sketches, "sig").join(members.select("sig", "members"), "sig")
    links = dealt(whole, F.octet_length("members")).mapInArrow(joined, "a long, b long").distinct().checkpoint()
    return rows, roots if links.isEmpty() else merged(roots, links).checkpoint()


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows, roots = classes(docs)
    named = (rows.where("n > 0").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
             .select("doc_id", "n", F.coalesce("root", "sig").alias("root")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "root").select("doc_id", "n", "component_id")
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                   F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
