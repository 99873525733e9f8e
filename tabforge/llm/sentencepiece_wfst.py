"""SentencePiece encoding and decoding with weighted finite-state transducers.

Compiled from the bytes of a SentencePiece model:

* normaliser: a transducer that puts the dummy prefix before a text and writes
  every space as U+2581;
* pieces: a transducer from characters to piece ids, weight = -score;
* byte fallback: an arc from every character that no piece covers to the ids of
  its UTF-8 bytes, dearer than any piece;
* merge order: a BPE model's segmentation is not the cheapest sum of scores, it
  is what merging by score leaves.  That set is regular: a sequence of pieces is
  the BPE result exactly when merging the text of each piece gives that piece
  and merging the text of each two neighbours gives those two.  (Until a first
  merge across a border the symbols on both sides evolve as they do alone, so a
  border that no pair crosses is crossed by none.)  The acceptor of allowed
  neighbours is built lazily, a pair at a time.  Unigram models have no such
  acceptor.

A text is composed with the three and the path of least weight in the tropical
(min, +) semiring is taken.  When no piece holds U+2581 after another character,
every path passes the border before a run of U+2581, so the shortest path is the
concatenation of the shortest paths between such borders; these are memoised per
word.  Decoding inverts the piece and byte arcs and the normaliser.

Defined results: null or empty text has no ids and decodes to ''; a literal
U+2581 decodes as a space (as it does in the library), so ``lossless`` is false
there; repeated rows are encoded each; extra columns are ignored; a model with a
character map or user-defined pieces raises ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6   # piece types of the file format
UNIGRAM, BPE = 1, 2                                                       # model types of the file format
UNKNOWN_PENALTY = 10.0
MEMO_UNITS = 1_200_000
MEMO_PAIRS = 1_000_000
MEMO_LENGTH = 48


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


class Transducer:
    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.type: list[int] = []
        self.bpe, self.dummy_prefix = False, True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece[1].decode("utf-8"))
                self.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.type.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(fields(value)).get(3, UNIGRAM)
                if kind not in (UNIGRAM, BPE):
                    raise ValueError(f"model type {kind} is neither unigram nor BPE")
                self.bpe = kind == BPE
            elif number == 3:
                rules = dict(fields(value))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only the identity normaliser that keeps all spaces is supported")
                self.dummy_prefix = bool(rules.get(3, 1))
        if USER_DEFINED in self.type:
            raise ValueError("user-defined pieces are not supported")
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.type)) if k == NORMAL}
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.type) if k == BYTE}
        # the piece transducer: pieces that merging can make, and by their first two
        # characters the lengths that occur, longest first
        self.arc = {t: i for t, i in self.id.items() if not self.bpe or self.merged(t) == [t]}
        lengths: dict[str, set[int]] = {}
        for t in self.arc:
            lengths.setdefault(t[:2], {1}).add(len(t))
        self.lengths = {head: sorted(found, reverse=True) for head, found in lengths.items()}
        self.unknown = UNKNOWN_PENALTY - min(self.score[i] for i in self.id.values())
        self.emit = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode("utf-8")
                     if k == NORMAL else b"" for t, k in zip(self.text, self.type)]
        inner = any(SPACE in t.lstrip(SPACE) for t in self.id)
        line = "" if any("\n" in t for t in self.id) else "\n"
        self.units = (re.compile(r"(?s).+") if inner else
                      re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + ("|\n" if line else "")))
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}          # last piece * pieces + next piece

    def merged(self, text: str) -> list[str]:
        """Symbols that merging by score, leftmost first, leaves of a short text."""
        symbols, rank = list(text), self.id
        while True:
            best = None
            for i in range(len(symbols) - 1):
                p = rank.get(symbols[i] + symbols[i + 1])
                if p is not None and (best is None or self.score[p] > best[0]):
                    best = (self.score[p], i)
            if best is None:
                return symbols
            symbols[best[1]:best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]

    def allowed(self, a: int, b: int) -> bool:
        """Whether the merge acceptor lets piece b follow piece a."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        ok = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        self.pairs[a * len(self.text) + b] = ok
        return ok

    def only_path(self, unit: str) -> list[int]:
        """The accepted path of a BPE model; piece -1 is the byte arc of a character that
        no piece covers.  The merge acceptor leaves one path, which is therefore the one
        of least weight; it is found depth first, long arcs first, and a state
        (position, last piece) that leads nowhere is not entered again."""
        n, size, arc, pairs, lengths = len(unit), len(self.text), self.arc, self.pairs, self.lengths
        at, last, k, trail, dead = 0, -1, 0, [], set()
        while at < n:
            options = lengths.get(unit[at:at + 2], (1,))
            while k < len(options):
                end = at + options[k]
                k += 1
                if end > n:
                    continue
                piece = arc.get(unit[at:end])
                if piece is None:
                    if end > at + 1:
                        continue
                    piece = -1
                elif last >= 0:
                    ok = pairs.get(last * size + piece)
                    if not (self.allowed(last, piece) if ok is None else ok):
                        continue
                if dead and (end, piece) in dead:
                    continue
                trail.append((at, last, k, piece))
                at, last, k = end, piece, 0
                break
            else:
                dead.add((at, last))
                at, last, k, _ = trail.pop()
        return [step[3] for step in trail]

    def least_path(self, unit: str) -> list[int]:
        """The path of least weight of a unigram model, by relaxing positions in order."""
        best: list = [(0.0, None, None)] + [None] * len(unit)
        for at in range(len(unit)):
            for length in self.lengths.get(unit[at:at + 2], (1,)):
                piece = self.arc.get(unit[at:at + length], -1 if length == 1 else None)
                if piece is None or at + length > len(unit):
                    continue
                total = best[at][0] + (self.unknown if piece < 0 else -self.score[piece])
                if best[at + length] is None or total < best[at + length][0]:
                    best[at + length] = (total, at, piece)
        path, at = [], len(unit)
        while at:
            _, at, piece = best[at]
            path.append(piece)
        return path[::-1]

    def shortest(self, unit: str) -> list[int]:
        """Ids on the shortest path through the composition with ``unit``."""
        path = self.only_path(unit) if self.bpe else self.least_path(unit)
        ids, at = [], 0
        for piece in path:
            if piece >= 0:
                ids.append(piece)
                at += len(self.text[piece])
            else:
                ids += [self.bytes[b] for b in unit[at].encode("utf-8")] if self.bytes else [self.type.index(UNKNOWN)]
                at += 1
        return ids

    def _unit(self, unit: str) -> bytes:
        ids = np.asarray(self.shortest(unit), "<i4").tobytes()
        if len(unit) <= MEMO_LENGTH:
            if len(self.memo) > MEMO_UNITS:
                self.memo.clear()
            self.memo[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        units = self.units.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))
        get, make = self.memo.get, self._unit
        return b"".join([get(u) or make(u) for u in units])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.emit.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, compiled once in each Python worker."""
    kept = held("sentencepiece")
    if model not in kept:
        kept[model] = Transducer(model)
    return kept[model]


def encoder(model: bytes):
    """Column function text -> struct(ids, lossless): lossless says whether decoding the
    ids gives the text back."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])

    @F.arrow_udf("ids array<int>, lossless boolean")
    def encode(texts: pa.Array) -> pa.Array:
        t = compiled(model)
        ids, same = [], []
        for text in texts.to_pylist():
            found = np.frombuffer(t.encode(text), "<i4")
            ids.append(found)
            same.append(t.decode(found.tolist()) == text)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], fields=list(kind))

    return encode


def decoder(model: bytes):
    """Column function ids -> text."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        t = compiled(model)
        return pa.array([t.decode(x or []) for x in ids.to_pylist()], pa.string())

    return decode


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, lossless."""
    done = docs.select("doc_id", encoder(model)(text_or_empty()).alias("e"))
    return done.select("doc_id", F.col("e.ids").alias("ids"), F.size("e.ids").cast("long").alias("n_tokens"),
                       F.col("e.lossless").alias("lossless"))
