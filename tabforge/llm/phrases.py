r"""Phrases of 2 to 4 words that stand together more often than their parts explain.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into
words ``[^\x20\x09]+``.  Everything is per lang (null: ``und``).  f(phrase) counts its
occurrences inside pieces, overlaps included; candidates have f >= MIN_COUNT.

Counting.  A first pass over the texts counts hashes of words and of pairs of words; a
phrase can only be a candidate when all its words and pairs reach MIN_COUNT, so a
bitmap of the hashes that do is handed to the second pass, which counts words
and phrases themselves and leaves out what the bitmap rules out.  The bitmap has no
false negatives, so counts are exact and complete; its size is limited to MOST_BITS, and
a fuller one only lets more rows through.

Streams.  The counts that reach MIN_COUNT are kept in two orders, by words and by words
read backwards.  Each order is cut into ranges, and one pass over a range walks it in
lockstep with the phrases that are open, on a stack: in the first order all
extensions to the right follow a phrase, so the stack holds the counts of a
phrase's first 1, 2, 3 words, and a phrase that closes knows its most frequent
extension; the second order gives the counts of the last words and the extensions to
the left.  A phrase that is open where a range begins is carried into it, so
ranges can be cut anywhere, also inside one very frequent first word.  The two results
are sorted and merge-joined.  A phrase lies in a longer candidate of at least 80 % of its
count exactly when a candidate of one word more, to its left or right, has that count.

Defined results: null or empty texts and pieces without words count nothing; repeated
rows count each; a lang without candidates has no row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, text_or_empty
from .shingling import GOLDEN, LOWER, mix, run_hashes, text_bytes

MIN_COUNT = 30
LONGEST = 4
REPORTED = 2000
SHARE = 80                       # percent of a phrase's count that a longer one must reach to replace it
SCALE = 2_000_000
MOST_BITS = 1 << 28
FLUSH_WORDS = 1 << 20

_BYTE = np.arange(256)
_CUT = np.isin(_BYTE, list(b".,;:!?\n\v\f\r"))
_BLANK = np.isin(_BYTE, list(b" \t"))


class Words:
    """The words of a batch of texts: their bytes, where each begins, its piece and text."""

    def __init__(self, texts: pa.Array):
        body, limits = text_bytes(texts)
        cut = _CUT[body]
        inside = np.flatnonzero(~(cut | _BLANK[body]))
        begins = np.zeros(len(body) + 1, bool)
        begins[limits[:-1]] = True                   # a text begins a word and a piece
        self.start = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1] + 1])[:len(inside)] | begins[inside])
        self.body = LOWER[body[inside]]
        at = inside[self.start]
        self.piece = (cut | begins[:-1]).cumsum(dtype=np.int64)[at]
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, limits)))

    def hashes(self) -> np.ndarray:
        return run_hashes(self.body, self.start) if len(self.start) else np.zeros(0, np.uint64)

    def strings(self, kept: np.ndarray) -> pa.Array:
        ends = pa.py_buffer(np.append(self.start, len(self.body)).astype(np.int64))
        every = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, ends, pa.py_buffer(self.body)])
        return every.filter(pa.array(kept))


def lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = np.asarray([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()] + [0], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def hashed(words: Words, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of each pair with the next word (0 where there is none)."""
    single = mix(words.hashes() ^ lang_hashes(langs)[words.text])
    pair = np.zeros(len(single), np.uint64)
    near = np.flatnonzero(words.piece[1:] == words.piece[:-1])
    pair[near] = mix(single[near] * GOLDEN + single[near + 1])
    return single, pair


HASHES = pa.schema([("hash", pa.int64()), ("n", pa.int64())])


def hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of the hashes of words and pairs, summed over many texts."""
    held, size = [], 0

    def flushed():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], schema=HASHES)

    for b in batches:
        single, pair = hashed(Words(b.column(1)), b.column(0))
        held += [single, pair[pair != 0]]
        size += len(single)
        if size > FLUSH_WORDS:
            yield flushed()
            held, size = [], 0
    if size:
        yield flushed()


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap (16 bits a hash, MOST_BITS at most) of a column ``hash``."""
    n = hashes.count()
    bits = min(MOST_BITS, 1 << max(15, (16 * n).bit_length()))
    at = F.expr(f"hash & {bits - 1}L") + 1
    parts = (hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    table = np.zeros(bits // 8, np.uint8)
    for p in parts:                                  # at most MOST_BITS / 32768 rows
        start = (p["bucket"] - 1) * 4096
        table[start:start + 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)[:len(table) - start]
    return table


COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
COUNTS_SQL = "lang string, size int, phrase string, f long"


def counter(table: np.ndarray):
    """(lang, text) to counts of the phrases that ``table`` leaves possible, and of all
    words of a lang (size 0)."""
    top = np.uint64(len(table) * 8 - 1)
    space = pa.scalar(" ", pa.large_string())

    def marked(h: np.ndarray) -> np.ndarray:
        at = (h & top).astype(np.int64)
        return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, size, total = [], 0, 0

        def flushed():
            words = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            lang, run = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            per_lang = sum(np.bincount(h[3], minlength=len(names)) for h in held)
            listed = pa.array(list(names), pa.string())
            code, ids, n = np.unique(lang * len(words.dictionary) + words.indices.to_numpy(),
                                     return_inverse=True, return_counts=True)
            text = words.dictionary.take(pa.array(code % max(1, len(words.dictionary)))).cast(pa.large_string())
            of = code // max(1, len(words.dictionary))
            seen = np.flatnonzero(per_lang)
            yield rows(listed, seen, 0, pa.nulls(len(seen), pa.string()), per_lang[seen])
            yield rows(listed, of, 1, text, n)
            single, last, at, k = text, ids, np.arange(len(ids)), max(1, len(of))
            for wide in range(2, LONGEST + 1):
                # a phrase goes on where its last pair is possible too
                on = run[at + wide - 2]
                at, last = at[on], last[on]
                code, last, n = np.unique(last * k + ids[at + wide - 1], return_inverse=True, return_counts=True)
                text = pc.binary_join_element_wise(text.take(pa.array(code // k)), single.take(pa.array(code % k)), space)
                # the lang of a phrase is that of its last word
                yield rows(listed, of[code % k], wide, text, n)

        def rows(listed, of, wide, text, n):
            return pa.RecordBatch.from_arrays(
                [listed.take(pa.array(of)), pa.array(np.full(len(of), wide, np.int32)), text.cast(pa.string()),
                 pa.array(n.astype(np.int64))], schema=COUNTS)

        for b in batches:
            words = Words(b.column(1))
            single, pair = hashed(words, b.column(0))
            coded = b.column(0).dictionary_encode()
            own = np.asarray([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            lang = own[coded.indices.to_numpy(zero_copy_only=False)][words.text] if len(words.text) else np.zeros(0, np.int64)
            kept = marked(single)
            # whether a kept word goes on to the next one: both are kept, as is their pair
            run = kept & np.append(kept[1:], False)[:len(kept)] & (pair != 0) & marked(pair)
            held.append((words.strings(kept), lang[kept], run[kept], lang))
            size += len(single)
            if size > FLUSH_WORDS:
                yield from flushed()
                held, size = [], 0
        if size:
            yield from flushed()
    return count


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f: words and phrases with f >= MIN_COUNT; lang, n: all words)."""
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    seen = texts.mapInArrow(hash_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    often = materialise(seen.where(F.col("n") >= MIN_COUNT).select("hash"), "phrase-hashes")
    counted = texts.mapInArrow(counter(bitmap(often)), COUNTS_SQL).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    kept = materialise(counted.where((F.col("f") >= MIN_COUNT) | (F.col("size") == 0)), "phrase-counts")
    return (kept.where("size > 0"), kept.where("size = 0").select("lang", F.col("f").alias("n")))


# --- streams in order ---------------------------------------------------------
DEALT_SQL = "part int, carried boolean, lang string, key string, size int, f long"
DEALT = pa.schema([("part", pa.int32()), ("carried", pa.bool_()), ("lang", pa.string()), ("key", pa.string()),
                   ("size", pa.int32()), ("f", pa.int64())])
CUT_ROWS = 64                    # rows sampled per range to choose its limits


def limits(stream: DataFrame, ranges: int) -> list[tuple[bytes, bytes]]:
    """At most ``ranges`` - 1 limits (lang, key) that cut the stream evenly."""
    one_in = max(1, stream.count() // (CUT_ROWS * ranges))
    sampled = stream.where(F.pmod(F.xxhash64("lang", "key"), F.lit(one_in)) == 0).select("lang", "key")
    found = sorted((r.lang.encode(), r.key.encode()) for r in sampled.toLocalIterator())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)} if found else set())


def dealer(cuts: list[tuple[bytes, bytes]]):
    """(lang, key, size, f) to its range and, carried, to the ranges that begin inside its
    extensions."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                lang, key = row[0].encode(), row[1].encode()
                at = bisect_right(cuts, (lang, key))
                out.append((at, False, *row))
                while at < len(cuts) and cuts[at][0] == lang and cuts[at][1].startswith(key):
                    at += 1
                    out.append((at, True, *row))
            columns = list(zip(*out)) or [()] * len(DEALT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DEALT)], schema=DEALT)
    return deal


WALKED_SQL = "carried boolean, lang string, key string, size int, f long, parts array<long>, longer long"
WALKED = pa.schema([("carried", pa.bool_()), ("lang", pa.string()), ("key", pa.string()), ("size", pa.int32()),
                    ("f", pa.int64()), ("parts", pa.list_(pa.int64())), ("longer", pa.int64())])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges to the phrases that close: counts of their beginnings by length, and
    of their most frequent extension by a word (0 for none)."""
    def emit(rows):
        columns = list(zip(*rows)) or [()] * len(WALKED)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WALKED)], schema=WALKED)

    open_, out, last = [], [], None

    def close(down_to):
        while len(open_) > down_to:
            carried, lang, key, size, f, parts, longer = open_.pop()
            if size > 1 and (not carried or longer):
                out.append((carried, lang, key, size, f, parts, longer))

    for b in batches:
        for part, carried, lang, key, size, f in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (part, lang) != last:
                close(0)
                last = part, lang
            while open_ and not key.startswith(open_[-1][2]):
                close(len(open_) - 1)
            if open_ and open_[-1][3] == size - 1 and not carried:
                open_[-1][6] = max(open_[-1][6], f)
            open_.append([carried, lang, key, size, f, [o[4] for o in open_], 0])
        if len(out) > 5000:
            yield emit(out)
            out.clear()
    close(0)
    yield emit(out)


def walked(kept: DataFrame, key, name: str) -> DataFrame:
    """Phrases with ``name``_parts and ``name``_longer from the stream in the order of ``key``."""
    stream = kept.select("lang", key.alias("key"), "size", "f")
    ranges = partitions(kept.sparkSession)
    ordered = (stream.mapInArrow(dealer(limits(stream, ranges)), DEALT_SQL).repartition(ranges, "part")
               .sortWithinPartitions("part", "lang", "key"))
    rows = materialise(ordered.mapInArrow(walk, WALKED_SQL), f"phrase-{name}")
    # what a carried phrase met in other ranges; at most LONGEST rows a range
    met = rows.where("carried").groupBy("lang", "key").agg(F.max("longer").alias("met"))
    return (rows.where("not carried").join(met, ["lang", "key"], "left")
            .select("lang", "key", "size", "f", F.col("parts").alias(f"{name}_parts"),
                    F.greatest("longer", "met").alias(f"{name}_longer")))


def phrases(docs: DataFrame) -> DataFrame:
    """The first REPORTED phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    kept, totals = counts(docs)
    backwards = F.concat(F.array_join(F.reverse(F.split("phrase", " ")), " "), F.lit(" "))
    first = walked(kept, F.concat("phrase", F.lit(" ")), "first").withColumn("phrase", F.rtrim("key", F.lit(" ")))
    last = walked(kept, backwards, "last")
    last = last.select("lang", F.array_join(F.reverse(F.split(F.rtrim("key", F.lit(" ")), " ")), " ").alias("phrase"),
                       "last_parts", "last_longer")
    both = first.hint("merge").join(last, ["lang", "phrase"])
    cuts = F.expr(f"""array_min(transform(sequence(1, size - 1), k -> struct(
        cast(({SCALE} * cast(f as decimal(20, 0))) div
             (cast(first_parts[k - 1] as decimal(20, 0)) + last_parts[size - k - 1]) as bigint) as score,
        k, first_parts[k - 1] as l, last_parts[size - k - 1] as r)))""")
    free = F.lit(100) * F.greatest("first_longer", "last_longer") < F.lit(SHARE) * F.col("f")
    scored = both.where(free).select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REPORTED))
    return (ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                               "n", "score"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
grams as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase
  from starts, (values (1), (2), (3), (4)) as sizes(size) where i + size - 1 <= len(w)),
f as (select lang, size, phrase, count(*) as f from grams group by all),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 30),
cuts as (
  select c.lang, c.phrase, c.size, c.a, k, l.f as l, r.f as r,
         (2000000::hugeint * c.a) // (l.f + r.f) as score
  from (select *, unnest(range(1, size)) as k from candidates) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, array_to_string(w[i:i + len - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, size + 1)) as i from candidates), (values (2), (3)) as lens(len)
  where len < size and i + len - 1 <= size group by all),
free as (
  select x.* from lowest x left join inner_parts p on p.lang = x.lang and p.phrase = x.phrase
  where p.longer is null or 100 * p.longer < 80 * x.a),
totals as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free)
select lang, rank::bigint as rank, phrase, a, l, r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
