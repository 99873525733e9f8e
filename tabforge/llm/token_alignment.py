r"""Alignment of two tokenizers over the bytes of a text, by sparse matrix products.

Both tokenizers cut the same bytes (a space and the text), so tokens are intervals of
bytes.  With rows for tokens and columns for bytes, A and B are incidence matrices; the
product A Bt, row by row (Gustavson), links every A token to the B tokens that it
overlaps, weighted by common bytes.  Neighbouring tokens that a B token ties together are
one group, so groups end where A and B tokens both end.  Token x group incidences give
the shared-group links in the same way; on the main path their rows are an id's
occurrences instead of single tokens, so a long group costs its distinct ids, not its
pairs of tokens.  Matrices are compressed rows (CSR) in plain NumPy arrays.

A text is cut into units before every space or line feed that follows a character which
is not white space.  Neither tokenizer joins or looks across these places (checked
from the models: A's pattern is the byte-level one, and no piece of B has a line feed or
a space behind another character), so both have a token end there, and groups, links and
counts of a text are the sums of its units'.  Units are aligned once and remembered
within bounds; a document's links are one more product, documents x units by
units x links.  Other models get whole texts as units.

How many documents hold an id pair is counted over the corpus.  The table of counts is
handed to the tasks when its counted size is at most BROADCAST_BYTES, and joined beyond.

Defined results: a null or empty text, or one whose tokens of either side do not join to
its bytes (for example U+2581, which B reads as a space), has no tokens: zeros and an
empty groups_sha256; repeated rows and rows that share a doc_id, or have none, count as
a document each and keep their doc_id; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BROADCAST_BYTES = 64 << 20
PAIR_BYTES = 17                  # of a row of the table of counts: pair, documents, whether it is its id's best
MEMO_UNITS, MEMO_BYTES = 400_000, 48 << 20
FLUSH_PAIRS = 1 << 21


# --- compressed rows ----------------------------------------------------------
@dataclass
class Csr:
    """A sparse matrix: the entries of row r are at ``at[r]:at[r + 1]``."""
    at: np.ndarray
    column: np.ndarray
    value: np.ndarray
    columns: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def csr(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> Csr:
    """Entries in any order to compressed rows; equal places add up."""
    place = row * columns + column
    order = np.argsort(place, kind="stable")
    place, value = place[order], value[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(place)), bool), place[1:] != place[:-1]]))
    place, value = place[first], np.add.reduceat(value, first) if len(first) else value
    at = np.searchsorted(place, np.arange(rows + 1) * columns)
    return Csr(at, place % columns, value, columns)


def product(x: Csr, y: Csr) -> Csr:
    """x y by rows: every entry of a row of x brings in a scaled row of y."""
    size = np.diff(y.at)[x.column]
    within = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
    there = np.repeat(y.at[x.column], size) + within
    return csr(np.repeat(x.rows(), size), y.column[there], np.repeat(x.value, size) * y.value[there],
               len(x.at) - 1, y.columns)


def transposed(x: Csr) -> Csr:
    return csr(x.column, x.rows(), x.value, x.columns, len(x.at) - 1)


def token_bytes(length: np.ndarray) -> Csr:
    """Tokens x bytes of tokens that follow one another."""
    at = np.concatenate([[0], length.cumsum()])
    return Csr(at, np.arange(at[-1]), np.ones(at[-1], np.int64), int(at[-1]))


def overlaps(a: np.ndarray, b: np.ndarray) -> Csr:
    """A tokens x B tokens, the value their common bytes, from the tokens' lengths."""
    return product(token_bytes(a), transposed(token_bytes(b)))


def grouped(links: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A token and of each B token of overlap links."""
    if not len(links.column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = links.column[links.at[:-1]], links.column[links.at[1:] - 1]
    group = np.concatenate([[0], (first[1:] > last[:-1]).cumsum()])
    of_b = np.zeros(links.columns, np.int64)
    of_b[links.column] = group[links.rows()]
    return group, of_b


def shared_groups(group_a: np.ndarray, group_b: np.ndarray) -> Csr:
    """A tokens x B tokens that share a group."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    one = lambda g: Csr(np.arange(len(g) + 1), g, np.ones(len(g), np.int64), n)
    return product(one(group_a), transposed(one(group_b)))


# --- the two tokenizers -------------------------------------------------------
def byte_letters() -> dict[str, int]:
    """The letters that byte-level tokenizers write bytes with: printable Latin-1 for
    themselves, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # Spark spreads the work
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(named)]
        self.length_a = np.asarray([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.asarray([len(x) for x in self.bytes_b], np.int64)
        self.columns = len(self.bytes_b)
        spec = json.loads(byte_level)
        split = spec.get("pre_tokenizer") or {}
        self.by_unit = (not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split["add_prefix_space"]
                        and split.get("use_regex", True) and not any("\n" in p or "▁" in p.lstrip("▁") for p in named)
                        and self.b.encode("\n\n") == [*self.b.encode("\n"), *self.b.encode("\n")[-1:]])

        self.ranked = None
        made = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["merges"]]
        if self.by_unit and all(made["vocab"][x + y] == 256 + i for i, (x, y) in enumerate(merges)):
            # ids are the order of merges, so tiktoken gives the same ids from them, several times faster
            import tiktoken
            own = {self.bytes_a[i]: i for i in range(256 + len(merges))}
            self.ranked = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=own, special_tokens={})

    def plain(self, unit: str) -> bool:
        """Whether the fast encoder may have it: no white space at its end, and below U+0250,
        where all releases of Unicode agree on letters and digits."""
        return self.ranked is not None and max(unit) < "\u0250" and not unit[-1].isspace()

    def ids_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has; plain units come first."""
        first = sum(map(self.plain, units))
        together, rest = units[:first], units[first:]
        flat = np.asarray(self.ranked.encode_ordinary("".join(together)) if together else [], np.int64)
        ends = np.cumsum([len(u.encode("utf-8")) for u in together], dtype=np.int64)
        cuts = np.searchsorted(self.length_a[flat].cumsum(), ends) + 1
        single = [e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)]
        return (np.concatenate([flat, *(np.asarray(x, np.int64) for x in single)]),
                np.concatenate([np.diff(cuts, prepend=0), np.asarray([len(x) for x in single], np.int64)]))

    def ids_b(self, units: list[str]) -> list[list[int]]:
        if self.by_unit:
            # behind a line feed, which no piece holds, the model's own space is not in the way
            return [x[2:] for x in self.b.encode(["\n" + u for u in units], num_threads=1)]
        return self.b.encode([u[1:] for u in units], num_threads=1)


#: The pattern of byte-level pre-tokenisers (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BREAK = re.compile(r"(?<=\S)(?=[ \n])")
_RUN = re.compile(r"\s\s")


def units_of(text: str) -> list[str]:
    """Units of a space and ``text``, without the space of those that begin with a single one."""
    if not text[0].isspace() and not _RUN.search(text):
        return text.replace("\n", " \n").split(" ")
    parts = _BREAK.split(" " + text)
    return [u if u[0] == "\n" or u[1:2] in (" ", "\n") else u[1:] for u in parts]


def whole_unit(key: str) -> str:
    return key if key[:1] in (" ", "\n") else " " + key


class Aligner:
    """Alignments of units, remembered."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.length_a, self.length_b = pair.length_a, pair.length_b
        # an id in digits, with what may follow it
        most = max(len(pair.bytes_a), len(pair.bytes_b))
        self.digits = [f"{i}{after}" for after in ",|;" for i in range(most)]
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.text: list[str | None] = []             # groups of a unit in digits, None where bytes differ
        self.sizes = np.zeros((0, 4), np.int64)      # tokens of A, of B, groups, links
        self.links = Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                         len(self.length_a) * self.pair.columns)
        self.held = 0

    def numbers(self, keys: list[str]) -> list[int]:
        return list(map(self.known.__getitem__, keys))

    def learn(self, keys: set[str]):
        new = list(keys.difference(self.known))
        if self.pair.by_unit:
            new.sort(key=lambda k: not self.pair.plain(whole_unit(k)))
        units = [whole_unit(k) for k in new] if self.pair.by_unit else new
        for k in new:
            self.known[k] = len(self.known)
        if not new:
            return
        self.held += sum(map(len, units))
        a, n_a = self.pair.ids_a(units)
        b = self.pair.ids_b(units)
        plain = [u.encode("utf-8") for u in units]
        total = np.concatenate([[0], self.length_a[a].cumsum()])[np.concatenate([[0], n_a.cumsum()])]
        right = (np.diff(total) == [len(u) for u in plain]).tolist()
        of_b = self.pair.bytes_b
        right = [ok and b"".join([of_b[i] for i in x]) == u for ok, x, u in zip(right, b, plain)]
        a, n_a = a[np.repeat(right, n_a)], np.where(right, n_a, 0)
        n_b = np.asarray([len(x) if ok else 0 for x, ok in zip(b, right)], np.int64)
        b = np.asarray([i for x, ok in zip(b, right) if ok for i in x], np.int64)
        group_a, group_b = grouped(overlaps(self.length_a[a], self.length_b[b]))
        unit_a, unit_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        # occurrences of a unit's ids by group, and the product over groups
        rows, row = np.unique(unit_a * len(self.length_a) + a, return_inverse=True)
        by_a = csr(row, group_a, np.ones(len(a), np.int64), len(rows), max(1, n))
        by_group = csr(group_b, b, np.ones(len(b), np.int64), max(1, n), self.pair.columns)
        shared = product(by_a, by_group)
        entry = rows[shared.rows()]
        links = csr(entry // len(self.length_a), entry % len(self.length_a) * self.pair.columns + shared.column,
                    shared.value, len(new), self.links.columns)
        totals = np.concatenate([[0], links.value.cumsum()])
        first = np.concatenate([np.ones(min(1, len(a)), bool), group_a[1:] != group_a[:-1]])
        groups = np.bincount(unit_a[first], minlength=len(new))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, groups, totals[links.at[1:]] - totals[links.at[:-1]]], 1)])
        self.links = Csr(np.concatenate([self.links.at, self.links.at[-1] + links.at[1:]]),
                         np.concatenate([self.links.column, links.column]),
                         np.concatenate([self.links.value, links.value]), links.columns)
        self.text += self.written(a, b, group_a, group_b, unit_a, unit_b, right)

    def written(self, a, b, group_a, group_b, unit_a, unit_b, right) -> list[str | None]:
        """Groups of each unit as text: ids of A, a bar, ids of B, a semicolon."""
        side = 2 * np.concatenate([group_a, group_b]) + np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(side, kind="stable")
        side, unit = side[order], np.concatenate([unit_a, unit_b])[order]
        after = np.full(len(side), 2)
        after[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] // 2 == side[:-1] // 2, 1, 2))
        code = np.concatenate([a, b])[order] + after * (len(self.digits) // 3)
        parts = list(map(self.digits.__getitem__, code.tolist()))
        ends = np.searchsorted(unit, np.arange(len(right) + 1)).tolist()
        return ["".join(parts[s:e]) if ok else None for s, e, ok in zip(ends[:-1], ends[1:], right)]


ALIGNED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                     ("pairs", pa.binary()), ("times", pa.binary())])
ALIGNED_SQL = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
               "pairs binary, times binary")
_ALIGNERS: dict[int, Aligner] = {}


def aligner(byte_level: str, pieces: bytes) -> Aligner:
    key = hash((byte_level, pieces))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(Pair(byte_level, pieces))
    return _ALIGNERS[key]


def align(batches: Iterator[pa.RecordBatch], here: Aligner) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) to sizes and digest of each document, and its linked id pairs
    (ascending, 64-bit integers) with their numbers of links (32-bit)."""
    for b in batches:
        if len(here.known) > MEMO_UNITS or here.held > MEMO_BYTES:
            here.forget()
        texts = b.column(2).to_pylist()
        split = units_of if here.pair.by_unit else lambda t: [" " + t]
        keys = [split(t) if t else [] for t in texts]
        here.learn({k for ks in keys for k in ks})
        numbers = [here.numbers(ks) for ks in keys]
        written = [[here.text[i] for i in x] for x in numbers]
        kept = [bool(x) and None not in w for x, w in zip(numbers, written)]
        digest = [hashlib.sha256("".join(w)[:-1].encode()).hexdigest() if ok else "" for w, ok in zip(written, kept)]
        numbers = [x if ok else [] for x, ok in zip(numbers, kept)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in numbers], dtype=np.int64)])
        flat = np.asarray([i for x in numbers for i in x], np.int64)
        sizes = np.concatenate([np.zeros((1, 4), np.int64), here.sizes[flat].cumsum(0)])
        sizes = sizes[at[1:]] - sizes[at[:-1]]
        linked = product(Csr(at, flat, np.ones(len(flat), np.int64), len(here.known)), here.links)
        spans = list(zip(linked.at[:-1].tolist(), linked.at[1:].tolist()))
        column, value = linked.column.astype("<i8"), linked.value.astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(sizes[:, i]) for i in range(4)), pa.array(digest, pa.string()),
             pa.array([column[s:e].tobytes() for s, e in spans], pa.binary()),
             pa.array([value[s:e].tobytes() for s, e in spans], pa.binary())], schema=ALIGNED)


# --- counts over the corpus ---------------------------------------------------
def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pairs) to how many of a task's documents hold each pair."""
    held, size = [], 0

    def flushed():
        pair, n = np.unique(np.frombuffer(b"".join(held), "<i8"), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    for b in batches:
        held += b.column(0).to_pylist()
        size += sum(map(len, held[-b.num_rows:])) // 8 if b.num_rows else 0
        if size > FLUSH_PAIRS:
            yield flushed()
            held, size = [], 0
    if held:
        yield flushed()


def judged(table: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """(doc columns, pairs, times) to n_best and count_sum by the table of counts."""
    pair, n, best = table

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, times = (b.column(i).to_pylist() for i in (6, 7))
            at = np.concatenate([[0], np.cumsum([len(p) // 8 for p in pairs], dtype=np.int64)])
            row = np.searchsorted(pair, np.frombuffer(b"".join(pairs), "<i8"))
            each = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
            out = []
            for weight in (best, n):
                total = np.concatenate([[0], (each * weight[row]).cumsum()]) if len(row) else np.zeros(1, np.int64)
                out.append(pa.array(total[at[1:]] - total[at[:-1]]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), *out], RESULT)
    return judge


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
RESULT_SQL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "n_best long, count_sum long")


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, pairs, times) to a row per pair."""
    for b in batches:
        pairs, times = (b.column(i).to_pylist() for i in (1, 2))
        rid = np.repeat(b.column(0).to_numpy(), [len(p) // 8 for p in pairs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid), pa.array(np.frombuffer(b"".join(pairs), "<i8").astype(np.int64)),
             pa.array(np.frombuffer(b"".join(times), "<u4").astype(np.int64))], ["rid", "pair", "times"])


def alignments(docs: DataFrame, byte_level: str, pieces: bytes, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    columns = Pair(byte_level, pieces).columns

    def mapper(batches):
        yield from align(batches, aligner(byte_level, pieces))

    rows = materialise(texts.mapInArrow(mapper, ALIGNED_SQL), "aligned-docs")
    counted = rows.select("pairs").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("a", F.expr(f"pair div {columns}L")), "aligned-pairs")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    table = counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    plain = rows.select(*RESULT[:6], "pairs", "times")
    if counted.count() * PAIR_BYTES <= broadcast_bytes:
        found = table.orderBy("pair").toPandas()
        held = tuple(found[c].to_numpy(np.int64) for c in ("pair", "n", "best"))
        return plain.mapInArrow(judged(held), RESULT_SQL)
    each = rows.select("rid", "pairs", "times").mapInArrow(exploded, "rid long, pair long, times long")
    sums = (each.join(table, "pair").groupBy("rid")
            .agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "rid", "left").select(*RESULT[:6], zero("n_best"), zero("count_sum"))
