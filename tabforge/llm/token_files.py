"""Token-id files: patched frame-of-reference blocks.

File format (all integers little-endian)::

    magic "PFR1" | u32 block length | u64 documents | u64 ids | u64 blocks
    i64 doc_id of each document | u8 1 where that id is null | u32 ids of each document
    u64 byte offset of each block's start within the block area | block area

A block holds up to ``block length`` ids: u32 minimum, u8 width, u16 number of
ids, u16 number of exceptions, then the ids less the minimum packed at ``width``
bits (the smallest width that fits the 90th percentile), then a u16 position and a
u32 remainder (the bits above ``width``) of each exception.  The offsets index
block starts, so a range of ids is read without unpacking the rest.

Documents are encoded where they are read, a range of ascending ids per task is
written as files of about FILE_IDS ids (a document is never split), and ids are
then read back from the files alone.  A file is written under a name of its own
attempt and moved to its final name, which depends on the range only: a task that
runs again replaces the file by the same bytes.

A text is encoded piece by piece: the tokenizer's pattern never joins characters
across white space, and words of printable ASCII and Latin letters without an apostrophe
are cut where that pattern cuts them, at changes between letters, digits and others.
Arrow numbers the pieces of a batch, and each is encoded once by the tokenizers library
and remembered.  Printable ASCII needs no normaliser beyond lower-casing, so the library's
model sees it directly; any other word goes through the whole tokenizer.  Texts in which an
added token could span white space are encoded whole.

Defined results: null text counts as empty and has the end id alone; null
doc_ids come first; rows that share a doc_id are ordered by their ids' bytes; an
empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, partitions, text_or_empty
from .shingling import text_bytes

BLOCK = 1024
PERCENTILE = 90
FILE_IDS = 4 << 20
END_ID = 1
MEMO_WORDS = 1_000_000
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQQQ")
BLOCK_HEAD = struct.Struct("<IBHH")


# --- blocks -------------------------------------------------------------------
def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, lowest bit first."""
    if not width or not len(values):
        return b""
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits, axis=None, bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    at = np.arange(n, dtype=np.int64) * width
    first = at >> 3
    word = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        word |= padded[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    fits = int(np.partition(rest, k := (len(rest) - 1) * PERCENTILE // 100)[k])
    width = fits.bit_length()
    above = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return b"".join([
        BLOCK_HEAD.pack(low, width, len(ids), len(above)), pack(rest, width),
        above.astype("<u2").tobytes(), (rest[above] >> np.uint32(min(width, 31))).astype("<u4").tobytes()])


def unpack_block(data: bytes, at: int) -> np.ndarray:
    low, width, n, k = BLOCK_HEAD.unpack_from(data, at)
    at += BLOCK_HEAD.size
    size = (n * width + 7) // 8
    values = unpack(data[at:at + size], width, n)
    if k:
        where = np.frombuffer(data, "<u2", k, at + size)
        values[where] |= np.frombuffer(data, "<u4", k, at + size + 2 * k) << np.uint32(width)
    return values + np.uint32(low)


# --- files --------------------------------------------------------------------
def write_file(doc_ids: list, lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = [pack_block(ids[at:at + block]) for at in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join([
        HEAD.pack(MAGIC, block, len(doc_ids), len(ids), len(blocks)),
        np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.asarray(lengths, "<u4").tobytes(), np.asarray(starts, "<u8").tobytes(), *blocks])


class TokenFile:
    """Reads a file's bytes: documents, and any range of ids through the block index."""

    def __init__(self, data: bytes):
        magic, self.block, docs, self.n_ids, self.n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.data, at = data, HEAD.size
        ids = np.frombuffer(data, "<i8", docs, at).tolist()
        null = data[at + 8 * docs:at + 9 * docs]
        self.doc_ids = [None if gone else d for d, gone in zip(ids, null)]
        self.lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
        self.index = np.frombuffer(data, "<u8", self.n_blocks, at + 13 * docs)
        self.area = at + 13 * docs + 8 * self.n_blocks

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first = start // self.block
        parts = [unpack_block(self.data, self.area + int(self.index[b]))
                 for b in range(first, (end - 1) // self.block + 1)]
        return np.concatenate(parts)[start - first * self.block:end - first * self.block]


# --- encoding -----------------------------------------------------------------
_TOKENIZERS: dict[str, tuple] = {}
#: The normaliser and split that lower-case and drop white space, so that words can be
#: encoded one by one; any other tokenizer gets whole texts.
LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
          "behavior": "Removed", "invert": True}
#: SPLITS for lower-case printable ASCII without white space.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(rb"[!-~]+")


def by_words(model: str) -> bool:
    spec = json.loads(model)
    normaliser, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    rest = (splitter.get("pretokenizers") or [None])[1:]
    return (normaliser.get("normalizers") == LOWERS and (splitter.get("pretokenizers") or [None])[0] == SPLITS
            and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest))


def word_encoder(tokenizer):
    """Function from a word of printable ASCII and the memo to its ids."""
    tokens, little = tokenizer.model.tokenize, sys.byteorder == "little" and array("I").itemsize == 4

    def piece(p: bytes) -> bytes:
        ids = [t.id for t in tokens(p.decode("ascii"))]
        return array("I", ids).tobytes() if little else np.asarray(ids, "<u4").tobytes()

    def encode(word: bytes, memo: dict[bytes, bytes]) -> bytes:
        if word.isalpha():
            return piece(word.lower())
        pieces = PIECES.findall(word.lower())
        return b"".join([memo.get(p) or piece(p) for p in pieces])

    return encode


_BYTE = np.arange(256)
#: Class of a byte: blank, letter (also of U+00C0 to U+017F in UTF-8), digit, other.
CLASS = np.full(256, 3, np.uint8)
CLASS[(_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))] = 0
CLASS[((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 0x80)] = 1
CLASS[(_BYTE >= 48) & (_BYTE <= 57)] = 2
#: Bytes whose word stays whole: apostrophes, control characters, UTF-8 beyond U+017F ...
WHOLE = (_BYTE == 39) | (_BYTE < 32) | (_BYTE == 127) | ((_BYTE >= 0xC0) & ~np.isin(_BYTE, (0xC3, 0xC4, 0xC5)))
#: ... and pairs: the signs U+00D7 and U+00F7, letters with more than one letter or none of
#: their own as lower case, and what an added token begins with.
PAIRS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0xC5, 0x89), (0xC5, 0xBF), (ord("<"), ord("|"))]
SECOND = np.isin(_BYTE, [y for _, y in PAIRS])
JOINED = np.asarray([x << 8 | y for x, y in PAIRS])


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces and whole words of all texts in order, where each text begins and ends among
    them)."""
    body, limits = text_bytes(texts)
    classes = CLASS[body]
    inside = np.flatnonzero(classes)
    body, classes = body[inside], classes[inside]
    texts_at = np.searchsorted(inside, limits)
    start = np.ones(len(body), bool)
    start[1:] = inside[1:] != inside[:-1] + 1
    start[texts_at[:-1][texts_at[:-1] < len(body)]] = True
    if len(body):
        whole = WHOLE[body]
        second = np.flatnonzero(SECOND[body[1:]])
        whole[second + 1] |= np.isin(body[second].astype(np.int64) << 8 | body[second + 1], JOINED)
        words = np.flatnonzero(start)
        whole = np.repeat(np.logical_or.reduceat(whole, words), np.diff(np.append(words, len(body))))
        cut = classes == 2
        cut[1:] |= classes[1:] != classes[:-1]
        start |= cut & ~whole
    ends = np.append(np.flatnonzero(start), len(body))
    cut = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return cut, np.searchsorted(ends[:-1], texts_at)


def byte_strings(a: pa.Array) -> list[bytes]:
    _, offsets, data = a.buffers()
    ends = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[s:e] for s, e in zip(ends, ends[1:])]


def encode_batch(model: str, texts: pa.Array, kind: str = "<u4") -> pa.Array:
    """Ids (little-endian, of type ``kind``, with the end id) of each text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # Spark spreads the work
    from tokenizers import Tokenizer
    if model not in _TOKENIZERS:
        tokenizer = Tokenizer.from_str(model)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        spans = any(any(c.isspace() for c in content) for content in added)
        plain = word_encoder(tokenizer) if all("<|" in content for content in added) else None
        _TOKENIZERS[model] = (tokenizer, {}, spans or not by_words(model), plain)
    tokenizer, memo, entire, plain = _TOKENIZERS[model]
    narrow = lambda ids: np.frombuffer(ids, "<u4").astype(kind)
    whole = lambda xs: [np.asarray(e.ids, "<u4").tobytes()
                        for e in tokenizer.encode_batch_fast(xs, add_special_tokens=False)]
    texts, end = pc.fill_null(texts, ""), np.asarray([END_ID], "<u4").tobytes()
    if entire:
        return pa.array([narrow(x + end).tobytes() for x in whole(texts.to_pylist())], pa.binary())
    if len(memo) > MEMO_WORDS:                   # the older half; what is frequent comes back at once
        for w in list(islice(memo, len(memo) // 2)):
            del memo[w]
    # lower-casing ASCII texts first halves the words to encode; an added token's own
    # spelling matters, so texts that could hold one keep their case
    lower = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    cut, limits = units(pc.if_else(lower, pc.ascii_lower(texts), texts))
    numbered = cut.dictionary_encode()
    known = byte_strings(numbered.dictionary)
    ids, rest = list(map(memo.get, known)), []
    for i, x in enumerate(ids):
        if x is None:
            w = known[i]
            if plain and (w.isalpha() or PRINTABLE.fullmatch(w) and b"<|" not in w):
                ids[i] = memo[w] = plain(w, memo)
            else:
                rest.append(i)
    for i, x in zip(rest, whole([known[i].decode("utf-8") for i in rest])):
        ids[i] = memo[known[i]] = x
    ids.append(end)
    size = np.dtype(kind).itemsize
    ends = np.cumsum([0, *map(len, ids)]) // 4 * size
    values = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(narrow(b"".join(ids)))])
    codes = np.insert(numbered.indices.to_numpy(), limits[1:], len(known))     # the end id behind each text
    taken = values.take(pa.array(codes))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[taken.offset + limits + np.arange(len(limits))]
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), data]).cast(pa.binary())


def encode_texts(model: str, texts: list[str]) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit, with the end id) of each text."""
    return encode_batch(model, pa.array(texts, pa.string())).to_pylist()


ENCODED_SQL = "part long, doc_id long, ids binary"


def shuffled_type(model: str) -> str:
    """Type of an id between encoding and writing: 16 bits where all ids fit."""
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_str(model).get_vocab_size() <= 1 << 16 else "<u4"


def encoder(model: str, cuts: list[int], kind: str):
    """(doc_id, text) to (part, doc_id, ids): part is the range of ids a row falls in."""
    limits = np.asarray(cuts, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_batch(model, b.column(1), kind)
            lowest = np.iinfo(np.int64).min
            part = np.searchsorted(limits, np.asarray(b.column(0).fill_null(lowest)), "left")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), b.column(0), ids],
                                             ["part", "doc_id", "ids"])
    return encode


# --- writing and reading ------------------------------------------------------
MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("name", pa.string()),
                      ("docs", pa.int64()), ("ids", pa.int64())])
MANIFEST_SQL = "part long, file long, name string, docs long, ids long"


def file_writer(folder: str, file_ids: int, kind: str):
    size = np.dtype(kind).itemsize

    def put(fs, base, part, number, docs):
        ids = np.frombuffer(b"".join(d[1] for d in docs), kind).astype(np.uint32)
        name = f"part-{part:06d}-{number:06d}.pfor"
        attempt = f"{base}/_{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            out.write(write_file([d[0] for d in docs], [len(d[1]) // size for d in docs], ids))
        fs.move(attempt, f"{base}/{name}")
        return part, number, name, len(docs), len(ids)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        rows, docs, held, number, current = [], [], 0, 0, None
        for b in batches:
            for part, doc_id, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                if docs and (part != current or held + len(ids) // size > file_ids):
                    rows.append(put(fs, base, current, number, docs))
                    docs, held, number = [], 0, number + 1
                if part != current:
                    current, number = part, 0
                docs.append((doc_id, ids))
                held += len(ids) // size
        if docs:
            rows.append(put(fs, base, current, number, docs))
        columns = list(zip(*rows)) or [()] * len(MANIFEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MANIFEST)], schema=MANIFEST)
    return write


def write_files(docs: DataFrame, model: str, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files of ``docs`` under ``folder`` (a URI); the manifest: part, file, name,
    docs, ids and start (ids in all files before), one row per file."""
    spark = docs.sparkSession
    ranges = partitions(spark)
    # limits of the ranges from the ids alone, so texts are encoded once
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        accuracy = min(100 * ranges, 1_000_000)
        cuts = sorted(set(docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares, accuracy)).first()[0]
                          or []))
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    kind = shuffled_type(model)
    encoded = texts.mapInArrow(encoder(model, cuts, kind), ENCODED_SQL)
    ordered = encoded.repartition(ranges, "part").sortWithinPartitions(
        F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("ids"))
    manifest = materialise(ordered.mapInArrow(file_writer(folder, file_ids, kind), MANIFEST_SQL), "token-manifest")
    # files before a file in its range, and the ids of all lower ranges
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    per_part = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    lower = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("lower"))
    return (manifest.withColumn("own", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(before, "part")
            .select("part", "file", "name", "docs", "ids", (F.col("own") + F.col("lower")).alias("start")))


READ_SQL = "name string, at long, doc_id long, n_tokens long, ids_crc32 long"


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            f = TokenFile(content.as_buffer().to_pybytes())
            ends = np.cumsum(f.lengths, dtype=np.int64)
            starts = ends - f.lengths
            ids = f.ids(0, f.n_ids).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([os.path.basename(path)] * len(crc), pa.string()), pa.array(starts, pa.int64()),
                 pa.array(f.doc_ids, pa.int64()), pa.array(f.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                ["name", "at", "doc_id", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, file."""
    content = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(folder)
               .select("path", "content"))
    return (content.mapInArrow(read_documents, READ_SQL).join(manifest.select("name", "start"), "name")
            .select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                    F.col("name").alias("file")))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Writes the token files of ``docs`` in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    elif "://" not in folder:
        folder = "file://" + os.path.abspath(folder)
    manifest = materialise(write_files(docs, model, folder), "token-starts")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return read_files(spark, folder, manifest)
