"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and split into words at everything that is neither letter
nor digit.  A document is contaminated by a benchmark item when, on one
alignment of the two, a window of WINDOW words (the whole item, where it is
shorter) agrees in all but MISSES[window] words.

A spaced seed is a fixed mask over consecutive words that looks at some
positions and ignores the others.  MASKS is lossless for these windows: however
the allowed substitutions fall, one of the masks fits between them (tests try
every case).  Every position of every item and of every document is hashed under
both masks; the hashes join, each hit names a document, an item and an
alignment, and the words around it are then compared one by one.

The items' hashes are broadcast when their words, counted first, make at most
BROADCAST_BYTES; a larger benchmark is joined by a shuffle.  Only hashes and
positions of documents enter that join.

Defined results: null or empty texts and items match nothing; items of fewer
than MIN_WORDS words are too short to tell from chance and match nothing; an item
that repeats under other ids is reported under each; repeated rows or rows that
share a doc_id give one result for that doc_id and item; a null doc_id or item_id
is kept as null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

WINDOW = 13
#: Words that may differ, by the number of words compared.
MISSES = {9: 0, 10: 1, 11: 1, 12: 1, 13: 2}
MIN_WORDS = min(MISSES)
SHORTEST = 5
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORT_MASK = tuple(range(SHORTEST))
BROADCAST_BYTES = 64 << 20
SEED_BYTES = 64                     # of a broadcast seed: hash, item, position and the table's own


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _hash(array: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(array, at + k) for k in mask))


def seeds(array: Column, masks) -> Column:
    """For each position an array with its hash under every mask; masks that reach past
    the end give hashes that no item has (items' seeds always lie inside)."""
    return F.transform(array, lambda _, i: F.array(*(_hash(array, i, m, k) for k, m in enumerate(masks))))


def item_words(items: DataFrame) -> DataFrame:
    found = F.filter(words(text_or_empty()), lambda w: w != "")
    return (items.select("item_id", found.alias("item")).where(F.size("item") >= SHORTEST)
            .withColumn("n", F.size("item")))


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, at) for every mask that lies inside an item; short items have one
    seed, at their start."""
    reach = F.array(*(F.lit(m[-1]) for m in (*MASKS, SHORT_MASK)))
    placed = items.select("item_id", "n", F.posexplode(seeds(F.col("item"), (*MASKS, SHORT_MASK))).alias("at", "hashes"))
    each = placed.select("item_id", "n", "at", F.posexplode("hashes").alias("mask", "seed"))
    short = F.col("n") < MIN_WORDS
    asked = (short & (F.col("mask") == len(MASKS)) & (F.col("at") == 0)) | (
        ~short & (F.col("mask") < len(MASKS)) & (F.col("at") + F.get(reach, F.col("mask")) < F.col("n")))
    return each.where(asked).select("seed", "item_id", "at").distinct()


def agreement(doc: Column, item: Column, shift: Column) -> Column:
    """Largest number of agreeing words in a window of an alignment (item word j against
    document word shift + j)."""
    same = F.transform(item, lambda w, j: F.coalesce((F.get(doc, shift + j) == w).cast("int"), F.lit(0)))
    width = F.least(F.size(item), F.lit(WINDOW))
    totals = F.transform(F.sequence(F.lit(0), F.size(item) - width),
                         lambda s: F.aggregate(F.slice(same, s + 1, width), F.lit(0), lambda a, b: a + b))
    return F.array_max(totals)


def matches(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, start (word of the
    document under the item's first), n_words (of the item), agree and compared (words
    of the best window)."""
    known = item_words(items)
    lookup = item_seeds(known)
    size = known.agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    if (size["n"] or 0) * len(MASKS) * SEED_BYTES <= broadcast_bytes:
        lookup = F.broadcast(lookup)
    masks = MASKS if (size["least"] or MIN_WORDS) >= MIN_WORDS else (*MASKS, SHORT_MASK)
    text = docs.select("doc_id", words(text_or_empty()).alias("doc"))
    spots = text.select("doc_id", F.posexplode(seeds(F.col("doc"), masks)).alias("pos", "hashes"))
    spots = spots.select("doc_id", "pos", F.explode("hashes").alias("seed"))
    hits = spots.join(lookup, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
    hits = materialise(hits.distinct(), "seed-hits")
    return verified(docs, hits, known)


def verified(docs: DataFrame, hits: DataFrame, known: DataFrame) -> DataFrame:
    """The alignments of ``hits`` that agree well enough, the best of each pair."""
    by_id = known.select(F.col("item_id").alias("known_id"), "item")
    marked = (hits.join(by_id, F.col("item_id").eqNullSafe(F.col("known_id")))
              .select(F.col("doc_id").alias("hit_id"), "item_id", "shift", "item"))
    # texts of documents with a hit are split into words below the join: in a projection above
    # it the optimizer would move the split into the lambda, once per word of each item
    wanted = hits.select(F.col("doc_id").alias("hit_id")).distinct()
    texts = (docs.select("doc_id", text_or_empty().alias("text"))
             .join(wanted, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
             .select("doc_id", words(F.col("text")).alias("doc")))
    judged = (texts.join(marked, F.col("doc_id").eqNullSafe(F.col("hit_id")))
              .select("doc_id", "item_id", "shift", F.size("item").alias("n_words"),
                      F.least(F.size("item"), F.lit(WINDOW)).alias("compared"),
                      agreement(F.col("doc"), F.col("item"), F.col("shift")).alias("agree")))
    allowed = F.create_map(*(F.lit(x) for pair in sorted(MISSES.items()) for x in pair))
    misses = F.coalesce(F.try_element_at(allowed, F.col("compared")), F.lit(0))
    kept = judged.where(F.col("agree") >= F.col("compared") - misses)
    best = F.struct(F.col("agree"), (-F.col("shift")).alias("early"), "n_words", "compared")
    return (kept.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
            .select("doc_id", "item_id", (-F.col("b.early")).cast("long").alias("start"),
                    F.col("b.n_words").cast("long").alias("n_words"), F.col("b.agree").cast("long").alias("agree"),
                    F.col("b.compared").cast("long").alias("compared")))


def contaminated_ids(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items).select("doc_id").distinct()
