"""N-gram Jaccard self-join by a size-aware heavy-light split, and its components.

A document's set is its distinct 5-word shingles.  Two documents link when
100 * |A & B| >= 80 * |A | B|, that is when they share at least
t = ceil(4 (|A| + |B|) / 9) shingles or, equally, differ in at most (|A| + |B|) / 9.

Light sets (at most LIGHT shingles): for every size a partner may have, the
subsets of the t shingles that a link needs are enumerated; two sets of those sizes
with a common subset link, without further check.  LIGHT is the largest size at which
this takes at most COST times the rows of the other way.

Heavy sets: inverted lists are scanned.  Sizes fall into classes whose limits
grow by 5/4, so partners are in the same or the next class.  For a pair of
classes, k is the most shingles in which partners can differ; the hash range is
cut into k + 1 + e blocks and a list is kept per (block, shingles in it): linked
sets agree in at least 1 + e blocks.  Lists over blocks take the place of lists
over single shingles because a passage that many documents share would put
unrelated documents into one list.  For the same reason common shingles (by a
sample; any choice of them is right) are left out of the blocks: sets that differ
in k shingles differ in at most k of the others.  Sets with more than e empty
blocks, the only ones that may agree in empty blocks alone, are entered once more
with all their shingles, and then under each block that is still empty.

A set shares at least 1 + e - (its empty blocks) lists with any set it links with;
classes that share fewer with all others together are left out.

Copies of a set are one class.  Within a list each class is compared with the
list's smallest and largest class only: by a histogram of hashes first, whose distance is at
most the number of differing shingles, then shingle by shingle.  Where the comparison with the smallest
fails, the class is still compared with every class of that list's group that is not
yet in its component and that the triangle inequality of the Jaccard distance leaves
possible.  So no
link between components is lost, and no group's pairs are all made.

Defined results: null or empty text, or text without words, has no shingles and
its own doc_id as component; fewer than 5 words are one shingle; repeated rows
are rows of one class; a null doc_id is no component's smallest unless alone;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, held, materialise, text_or_empty
from .shingling import mix, shingle_sets, slices

WORDS = 5
COST = 4
SEEN_CLASSES = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)   # salts of the block keys


def signature(s: np.ndarray) -> int:
    """A class id: hash of all shingles of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes())


def need(a: int, b: int) -> int:
    """Shingles that sets of these sizes must share to link."""
    return -(-4 * (a + b) // 9)


def partners(n: int) -> range:
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def light_rows(n: int) -> int:
    return sum(math.comb(n, need(n, m)) for m in partners(n) if need(n, m) <= min(n, m))


def differ(last: int) -> int:
    """Most shingles in which linked sets differ when the smaller has at most ``last``."""
    return (last + 5 * last // 4) // 9


def blocks(last: int) -> int:
    """Blocks of a size class: a quarter of them may be empty."""
    return -(-4 * (differ(last) + 1) // 3)


@lru_cache(None)
def limits(light: int) -> tuple[int, ...]:
    """Lower limits of the size classes of heavy sets."""
    out = [-(-4 * (light + 1) // 5)]
    while out[-1] < 1 << 31:
        out.append(5 * out[-1] // 4 + 1)
    return tuple(out)


@lru_cache(None)
def boundary(cost: float = COST) -> int:
    n = 1
    while light_rows(n + 1) <= cost * 2 * blocks(5 * (n + 1) // 4):
        n += 1
    return n


def block_keys(s: np.ndarray, group: int, m: int, stripped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks that hold shingles of ``s``, and the numbers of those blocks."""
    if not len(s):
        return np.zeros(0, np.uint64), s
    block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    salt = np.uint64(((2 * group + stripped) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return mix(np.add.reduceat(mix(s ^ _M1), at) + mix(block[at] + salt)), block[at]


def list_keys(s: np.ndarray, light: int, common: np.ndarray) -> list[tuple[int, np.ndarray, int, int]]:
    """A set's lists as (kind, keys, family, least): subsets for partners of its own size
    (SAME) or another (CROSS), and blocks (LIST).  Of the lists of one family it shares
    ``least`` or more with any set that it links with through that family."""
    n = len(s)
    same, cross = [], []
    if n <= light:
        for m in partners(n):
            t = need(n, m)
            if t <= min(n, m) and m <= light:
                head = f"{min(n, m)},{max(n, m)}".encode()
                for c in itertools.combinations(range(n), n - t):
                    (same if m == n else cross).append(xxhash.xxh3_64_intdigest(head + np.delete(s, list(c)).tobytes()))
    out = [(SAME, np.asarray(same, np.uint64), 0, 1), (CROSS, np.asarray(cross, np.uint64), 0, 1)]
    bounds = limits(light)
    if n >= bounds[0]:
        rare = s
        if len(common):
            rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
        own = int(np.searchsorted(bounds, n, "right")) - 1
        for group in (own, own - 1):
            if group < 0:
                continue
            last = bounds[group + 1] - 1
            m = blocks(last)
            spare = m - differ(last) - 1
            keys, held = block_keys(rare, group, m, True)
            out.append((LIST, keys, 2 * group + 1, max(1, spare + 1 - m + len(held))))
            if m - len(held) > spare:
                keys, held = block_keys(s, group, m, False)
                if m - len(held) > spare:
                    gone = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
                    keys = np.concatenate([keys, mix(mix(gone + np.uint64((group << 32) + 1)) ^ _M2)])
                out.append((LIST, keys, 2 * group, max(1, spare + 1 - m + len(held))))
    return [x for x in out if len(x[1])]


ROWS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()),
                  ("doc_id", pa.int64()), ("handle", pa.int64())])
# rows of lists carry the least number of shared lists as doc_id and their family as handle
ROWS_SQL = "kind int, key long, sig long, n long, doc_id long, handle long"
DOC, SAME, CROSS, LIST = 0, 1, 2, 3


def list_maker(common: np.ndarray):
    """The mapper of ``list_rows`` with the common shingles (sorted) bound."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from list_rows(batches, common)
    return rows


def list_rows(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, handle) to a DOC row per document and, once per class and task, a
    row for each list the class is in."""
    held("jaccard")
    light, seen = boundary(), set()
    for batch in batches:
        rows = []                                     # kind, keys, class, size, doc_id, handle
        if len(seen) > SEEN_CLASSES:
            seen.clear()
        found = slices(*shingle_sets(batch.column(1), WORDS))
        for doc_id, s, handle in zip(batch.column(0).to_pylist(), found, batch.column(2).to_pylist()):
            sig = signature(s)
            spread = np.asarray([sig ^ (handle & 0xFFFFFFFFFFFFFFFF)], np.uint64)
            rows.append((DOC, mix(spread), sig, len(s), doc_id, handle))
            if len(s) and sig not in seen:
                seen.add(sig)
                rows += [(kind, keys, sig, len(s), least, family)
                         for kind, keys, family, least in list_keys(s, light, common)]
        if rows:
            kind, keys, sig, size, doc_id, handle = zip(*rows)
            per = np.asarray([len(k) for k in keys])
            missing = np.asarray([d is None for d in doc_id])
            ids = np.asarray([d or 0 for d in doc_id], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(kind, np.int32), per)),
                 pa.array(np.concatenate(keys).view(np.int64)),
                 pa.array(np.repeat(np.asarray(sig, np.uint64).view(np.int64), per)),
                 pa.array(np.repeat(np.asarray(size, np.int64), per)),
                 pa.array(np.repeat(ids, per), mask=np.repeat(missing, per)),
                 pa.array(np.repeat(np.asarray(handle, np.int64), per))], schema=ROWS)


MEMBERS = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("members", pa.binary()), ("histogram", pa.binary())])
MEMBERS_SQL = "sig long, n long, members binary, histogram binary"
BINS = 512
KEPT_BYTES = 5                   # of a shingle's hash, in comparisons of two sets


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size, shingles (40 bits each) and histogram of hashes of each text."""
    for batch in batches:
        found = slices(*shingle_sets(batch.column(0), WORDS))
        sigs = np.asarray([signature(s) for s in found], np.uint64).view(np.int64)
        short = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes() for s in found]
        bins = [np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BINS), 255)
                .astype(np.uint8).tobytes() for s in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sigs, pa.int64()), pa.array([len(s) for s in found], pa.int64()),
             pa.array(short, pa.binary()), pa.array(bins, pa.binary())], schema=MEMBERS)


@F.arrow_udf(T.LongType())
def apart(a: pa.Array, b: pa.Array) -> pa.Array:
    """Least number of differing shingles that two histograms allow."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for v in (a, b))
    return pa.array(np.abs(x - y).sum(1, dtype=np.int64), pa.int64())


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT_BYTES, 8), np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BYTES)
    return out.reshape(-1).view("<u8")


@F.arrow_udf(T.LongType())
def shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shingles that two sets have in common."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        both = np.concatenate([_wide(x), _wide(y)])
        both.sort()
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def side(members: DataFrame, name: str, column: str) -> DataFrame:
    return members.select(F.col("sig").alias(name), F.col("n").alias(f"n_{name}"), F.col(column).alias(f"x_{name}"))


def exact(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with linked, and least and most: their Jaccard distance twice."""
    total = F.col("n_a") + F.col("n_b")
    both = (pairs.select("a", "b").join(side(members, "a", "members"), "a").join(side(members, "b", "members"), "b")
            .select("a", "b", "n_a", "n_b", shared("x_a", "x_b").alias("both")))
    return (both.withColumn("least", 1 - F.col("both") / (total - F.col("both")))
            .select("a", "b", (9 * F.col("both") >= 4 * total).alias("linked"), "least", F.col("least").alias("most")))


def compare(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with linked, and least and most: bounds of their Jaccard distance.
    Shingles are compared only where the histograms leave a link possible."""
    total = F.col("n_a") + F.col("n_b")
    gap = (pairs.join(side(members, "a", "histogram"), "a").join(side(members, "b", "histogram"), "b")
           .select("a", "b", "n_a", "n_b", apart("x_a", "x_b").alias("gap")))
    gap = materialise(gap, "jaccard-gaps")
    near = F.col("gap") * 9 <= total
    far = gap.where(~near).select("a", "b", F.lit(False).alias("linked"),
                                  (2 * F.col("gap") / (total + F.col("gap"))).alias("least"), F.lit(1.0).alias("most"))
    return exact(gap.where(near), members).union(far)


SAMPLE_DOCS, SAMPLE_SHARE, SAMPLE_TIMES, MOST_COMMON = 20_000, 64, 4, 500_000


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_lists(texts: pa.Array) -> pa.Array:
    held("jaccard")
    flat, ends = shingle_sets(texts, WORDS)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that occur in SAMPLE_TIMES or more documents of a sample, the most common
    MOST_COMMON at most.  The lists are right whatever this returns; it only keeps
    shared passages from making long lists of unrelated documents."""
    rows = texts.count()
    one_in = max(1, min(SAMPLE_SHARE, rows // SAMPLE_DOCS))
    sampled = texts.where(F.pmod(F.xxhash64("handle", F.lit(5)), F.lit(one_in)) == 0)
    times = (sampled.select(F.explode(shingle_lists("text")).alias("shingle")).groupBy("shingle").count()
             .where(F.col("count") >= SAMPLE_TIMES))
    found = times.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle").toPandas()
    return np.sort(found["shingle"].to_numpy(np.int64).view(np.uint64))


MOST_BITS = 1 << 27


def bitmap(wanted: DataFrame) -> np.ndarray:
    """A bitmap of hashed handles, 16 bits a handle and 16 MB at most."""
    n = wanted.count()
    bits = min(MOST_BITS, 1 << max(15, (16 * n).bit_length()))
    parts = (wanted.select((place(bits) + 1).alias("at"))
             .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    table = np.zeros(bits // 8, np.uint8)
    for p in parts:                                          # at most MOST_BITS / 32768 rows
        start = (p["bucket"] - 1) * 4096
        table[start:start + 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)[:len(table) - start]
    return table


def place(bits: int) -> Column:
    """The bit of a handle."""
    return F.pmod(F.xxhash64("handle", F.lit(9)), F.lit(bits))


def is_set(table: np.ndarray, places: pa.Array) -> pa.Array:
    p = places.to_numpy(zero_copy_only=False)
    return pa.array((table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)


def marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose handle may be in ``wanted``: a bitmap spares the shuffle of
    the other texts.  Rows that pass by chance are left out by the join on the class that
    follows."""
    table = bitmap(wanted)

    @F.arrow_udf("boolean")
    def may_be(places: pa.Array) -> pa.Array:
        return is_set(table, places)

    return texts.where(may_be(place(8 * len(table))))


def marked_sets(texts: DataFrame, wanted: DataFrame, make, schema: str) -> DataFrame:
    """``make`` (batches of texts to batches of their sets) over the texts of ``marked``.
    The bitmap is asked by the worker that makes the sets: a filter by a Python function
    below it would hold a second worker for every task, and Spark keeps those workers."""
    table = bitmap(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        found = (b.filter(is_set(table, b.column(1))) for b in batches)
        yield from make(b for b in found if b.num_rows)

    return texts.select("text", place(8 * len(table)).alias("place")).mapInArrow(rows, schema)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of documents: doc_id, sig, n; rows node, root: components of classes)."""
    # a document is found again by its id, or by a hash of its text where it has none
    handle = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()))
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), handle.alias("handle"))
    listed = texts.mapInArrow(list_maker(common_shingles(texts)), ROWS_SQL)
    # lists of a single class are left behind
    here = Window.partitionBy("kind", "key")
    scanned = listed.withColumns({"hub": F.min("sig").over(here), "top": F.max("sig").over(here),
                                  "least": F.min("n").over(here), "most": F.max("n").over(here)})
    # a subset for partners of two sizes joins its list only if both sizes are there: then
    # each set of one size links with each of the other
    sizes = (F.col("kind") != CROSS) | (F.col("least") != F.col("most"))
    scanned = scanned.where((F.col("kind") == DOC) | ((F.col("hub") != F.col("top")) & sizes))
    scanned = materialise(scanned.select("kind", "key", "sig", "n", "doc_id", "handle", "hub"), "jaccard-lists")
    rows = scanned.where(F.col("kind") == DOC).select("doc_id", "handle", "sig", "n")
    certain = (scanned.where(F.col("kind").isin(SAME, CROSS) & (F.col("sig") != F.col("hub")))
               .select(F.col("sig").alias("a"), F.col("hub").alias("b")).distinct())
    pairs = hub_pairs(scanned.where(F.col("kind") == LIST)
                      .select("key", "sig", F.col("handle").alias("family"), F.col("doc_id").alias("least")))
    pairs = pairs.checkpoint()
    # shingles of the classes in question, from one document of each
    asked = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    shown = rows.join(asked, "sig").groupBy("sig").agg(F.min("handle").alias("handle")).checkpoint()
    made = marked_sets(texts, shown.select("handle"), sets, MEMBERS_SQL)
    members = materialise(made.join(shown, "sig", "left_semi").dropDuplicates(["sig"]), "jaccard-sets")
    judged = compare(pairs.select("a", "b"), members).join(pairs, ["a", "b"])
    judged = materialise(judged, "jaccard-pairs")
    roots = components(judged.where("linked").select("a", "b").union(certain)).checkpoint()
    # groups of a hub that are not one component: classes that failed against the hub are
    # compared with the classes of the group in other components
    group = (judged.where("low").select(F.col("b").alias("hub"), F.col("a").alias("node"), "least", "most", "linked"))
    later = exact(unsettled(group, roots, members), members).where("linked").select("a", "b").checkpoint()
    return rows, roots if later.isEmpty() else merged(roots, later).checkpoint()


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(a, b, low) with a > b: each class of a list with the list's smallest class (low)
    and with its largest.  Classes that share fewer lists than any link needs are out."""
    enough = (lists.groupBy("sig", "family").agg(F.count("*").alias("lists"), F.max("least").alias("least"))
              .where("lists >= least").select("sig", "family"))
    here = Window.partitionBy("key")
    kept = lists.select("key", "sig", "family").join(enough, ["sig", "family"]).withColumns(
        {"first": F.min("sig").over(here), "last": F.max("sig").over(here)}).where("first <> last")
    ends = F.array(F.struct(F.col("sig").alias("a"), F.col("first").alias("b"), F.lit(True).alias("low")),
                   F.struct(F.col("last").alias("a"), F.col("sig").alias("b"), F.lit(False).alias("low")))
    return (kept.select(F.explode(ends).alias("e")).select("e.*").where("a <> b")
            .groupBy("a", "b").agg(F.max("low").alias("low")))


BLOCK_ROWS = 256


def unsettled(group: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class that failed against its hub and a class of the hub's group
    in another component, where size, triangle inequality and histograms leave a link
    possible.  A group is cut into blocks of about BLOCK_ROWS classes and every two
    blocks meet in one task, which passes on only the pairs that remain: no task holds
    a group and no join makes its pairs."""
    known = group.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = (known.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows"))
             .where("x <> y").select("hub", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (known.join(split, "hub").withColumn("block", block)
             .join(members.select(F.col("sig").alias("node"), F.col("n").alias("size"), "histogram"), "node")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                     "node", "root", "size", "least", "most", "linked", "histogram"))
    return dealt.groupBy("hub", "i", "j").applyInArrow(possible_links, "a long, b long").distinct().checkpoint()


def possible_links(rows: pa.Table) -> pa.Table:
    """Pairs of two blocks (or of one) that may link; see ``unsettled``."""
    column = lambda name: rows[name].to_numpy()
    node, root, size, block = column("node"), column("root"), column("size"), column("block")
    least, most, failed = column("least"), column("most"), ~column("linked").astype(bool)
    bins = np.frombuffer(b"".join(rows["histogram"].to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
    across = rows["i"][0].as_py() != rows["j"][0].as_py()
    out_a, out_b = [], []
    for k in np.flatnonzero(failed):
        x = (root != root[k]) & (5 * size >= 4 * size[k]) & (5 * size[k] >= 4 * size)
        x &= (least - most[k] <= 0.2 + 1e-9) & (least[k] - most <= 0.2 + 1e-9)
        x &= ~failed | (np.arange(len(node)) > k)               # two failed classes meet once
        if across:
            x &= block != block[k]
        x = np.flatnonzero(x)
        gap = np.abs(bins[x] - bins[k]).sum(1, dtype=np.int64)
        x = x[9 * gap <= size[x] + size[k]]
        out_a.append(np.maximum(node[x], node[k]))
        out_b.append(np.minimum(node[x], node[k]))
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(out_a + none), "b": np.concatenate(out_b + none)})


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after the components that ``edges`` connect have become one."""
    at = edges
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}"))
        at = at.join(own, end, "left").withColumn(f"r_{end}", F.coalesce(f"r_{end}", end))
    joint = components(at.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))).checkpoint()
    fresh = joint.join(roots, "node", "left_anti")
    moved = roots.join(joint.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return moved.select("node", F.coalesce("to", "root").alias("root")).union(fresh.select("node", "root"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, roots = classes(docs)
    named = (rows.where("n > 0").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
             .select("doc_id", "n", F.coalesce("root", "sig").alias("root")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(empty)


def dropped_ids(docs: DataFrame) -> DataFrame:
    """doc_ids of all but the smallest document of each group (ids must be unique)."""
    return groups(docs).where("doc_id <> component_id").select("doc_id")
