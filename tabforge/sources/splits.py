"""Records of text files that span lines, read by many tasks.

A file is cut into splits at line ends (CSV) or behind closing braces (JSON),
wherever they stand.  Whether a split begins inside quotes, and how deep, is not known
inside it, so a first pass makes one summary row per split (how it changes that
state) and the states at the splits' starts are a running sum over each file's summary
rows.  In a second pass every task cuts its own records; a record over a border leaves a
piece in each split, at most two pieces a split, which are put together afterwards.

The tables of starts have one row of about START_BYTES per split, so their size is
bounded by the input's size over the split size; they are broadcast, which keeps the
lines of a split in order.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

START_BYTES = 200
WHOLE, HEAD, TAIL, MIDDLE, WRONG = range(5)
PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()),
                    ("first", pa.bool_()), ("text", pa.string())])
PIECES_SQL = "file string, block long, kind int, at long, first boolean, text string"


def split_rows(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, block, value): the text between ``end``s, with the split it was read in."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


class Cutter:
    """Pieces of records of the splits that one task reads."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.key, self.held, self.head, self.first, self.at = None, [], False, False, 0

    def begin(self, key: tuple, inside: bool) -> None:
        self.key, self.held, self.head, self.first, self.at = key, [], inside, key[1] == 0, 0

    def put(self, kind: int, text: str) -> None:
        self.rows.append((*self.key, kind, self.at, self.first, text))
        self.at, self.first, self.head, self.held = self.at + 1, False, False, []

    def done(self, text: str) -> None:
        self.put(HEAD if self.head else WHOLE, text)

    def rest(self, text: str) -> None:
        self.put(MIDDLE if self.head else TAIL, text)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(PIECES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def put_together(pieces: DataFrame, between: str) -> DataFrame:
    """(file, first, text) of all records: the whole ones, and a tail with the middles and
    the head that follow it in the next splits."""
    ordered = Window.partitionBy("file").orderBy("block", "at")      # two rows a split at most
    parts = pieces.where(F.col("kind") != WHOLE)
    parts = parts.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("long")).over(ordered))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda x: x["text"])
    joined = parts.groupBy("file", "chain").agg(F.max("first").alias("first"), F.array_join(texts, between).alias("text"))
    return (pieces.where(F.col("kind") == WHOLE).select("file", "first", "text")
            .unionByName(joined.select("file", "first", "text")))


# --- CSV ------------------------------------------------------------------------
def quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def cut_csv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd: quotes open at the split's start, value) to pieces of records."""
    cutter, inside = Cutter(), False

    def leave():
        if cutter.held:
            cutter.rest("\n".join(cutter.held))

    for b in batches:
        for file, block, odd, line in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (file, block) != cutter.key:
                leave()
                inside = bool(odd)
                cutter.begin((file, block), inside)
            cutter.held.append(line)
            if line.count('"') & 1:
                inside = not inside
            if not inside:
                text = "\n".join(cutter.held)
                cutter.done(text[:-1] if text.endswith("\r") else text)
        yield cutter.batch()
    leave()
    yield cutter.batch()


def csv_records(lines: DataFrame, parity: DataFrame) -> DataFrame:
    """(file, first, text): records of CSV lines; ``first`` marks each file's header."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    starts = F.broadcast(parity.select("file", "block", odd.alias("odd")))
    placed = lines.join(starts, ["file", "block"]).select("file", "block", "odd", "value")
    return put_together(placed.mapInArrow(cut_csv, PIECES_SQL), "\n")


def column_names(header: str, sep: str) -> list[str]:
    """Names of a header record; empty ones are numbered and repeated ones too."""
    names = next(csv.reader([header.lstrip("﻿")], delimiter=sep), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else n + str(i) if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, options: dict, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, read by splits.  Files without line
    ends inside quotes are left to Spark's own reader."""
    lines = split_rows(spark, path, "\n")
    n = quotes(F.col("value"))
    parity = lines.groupBy("file", "block").agg((F.sum(n) % 2).alias("odd"), F.sum(n % 2).alias("open"))
    reader = spark.read.options(**options).option("header", True).option("escape", '"')
    if not (parity.agg(F.sum("open")).first()[0] or 0):
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    records = csv_records(lines, parity)
    if schema is None:
        header = records.where("first").orderBy("file").first()["text"]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in column_names(header, options.get("sep", ","))])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    asked = {k: str(v) for k, v in options.items() if k != "header"} | {"escape": '"', "mode": "PERMISSIVE"}
    body = records.where(~F.col("first") & (F.trim("text") != ""))
    return body.select(F.from_csv("text", ddl, asked).alias("r")).select("r.*")


# --- JSON -----------------------------------------------------------------------
_ESCAPE = re.compile(r"\\.", re.S)
_BETWEEN = " \t\r\n,"
SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("root", pa.string()), ("in0", pa.bool_()),
                     ("deep0", pa.int64()), ("in1", pa.bool_()), ("deep1", pa.int64())])
SUMMARY_SQL = "file string, block long, root string, in0 boolean, deep0 long, in1 boolean, deep1 long"


def structure(text: str, inside: bool) -> tuple[bool, int]:
    """State after a piece and the brace behind it: whether in a string, and the change of depth."""
    parts = _ESCAPE.sub("", text).split('"')
    plain = "".join(parts[inside::2])
    deeper = plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")
    inside ^= len(parts) % 2 == 0
    return inside, deeper - (not inside)


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value) to one row per split: its end for either state at its start."""
    rows, now = [], None
    for b in batches:
        for file, block, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if now is None or now[:2] != [file, block]:
                if now:
                    rows.append(now)
                now = [file, block, "", False, 0, True, 0]
            now[2] = now[2] or (text.lstrip("﻿" + " \t\r\n") + "}")[:1]
            for k, at in ((3, 3), (5, 5)):
                now[k], change = structure(text, now[at])
                now[k + 1] += change
    if now:
        rows.append(now)
    columns = list(zip(*rows)) or [()] * len(SUMMARY)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMMARY)], schema=SUMMARY)


STARTS_SQL = "file string, block long, inside boolean, depth long, base long"


def state_at_starts(splits: pa.Table) -> pa.Table:
    """Summary rows of one file to the states at its splits' starts."""
    out, inside, depth, base = [], False, 0, 0
    for i, s in enumerate(sorted(splits.to_pylist(), key=lambda s: s["block"])):
        if i == 0:
            base = {"[": 1, "{": 0}.get(s["root"], -1)          # -1: neither an array nor objects
        out.append((s["file"], s["block"], inside, depth, base))
        depth += s["deep1"] if inside else s["deep0"]
        inside = s["in1"] if inside else s["in0"]
    return pa.table(dict(zip(("file", "block", "inside", "depth", "base"), map(list, zip(*out)))))


def cut_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, inside, depth, base, value) to pieces of objects."""
    cutter, inside, depth, base = Cutter(), False, 0, 0

    def leave():
        if not cutter.held:
            return
        text = "".join(cutter.held)
        if inside or depth > base:
            cutter.rest(text)
        elif text.strip(_BETWEEN + "[]}﻿"):                # values that are no objects
            cutter.put(WRONG, text[:200])

    for b in batches:
        for file, block, started, deep, root, text in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (file, block) != cutter.key:
                leave()
                inside, depth, base = started, deep, root
                cutter.begin((file, block), inside or depth > base)
                if base < 0:
                    cutter.put(WRONG, text[:200])
            if base < 0:
                continue
            cutter.held.append(text + "}")
            inside, change = structure(text, inside)
            depth += change
            if not inside and depth == base:
                cutter.done("".join(cutter.held))
        yield cutter.batch()
    leave()
    yield cutter.batch()


def json_lines(spark: SparkSession, path: str) -> str:
    """Cuts the objects of arrays (or of JSON Lines) at ``path`` and writes one per line to
    the shared folder; the folder written."""
    pieces = split_rows(spark, path, "}")
    starts = pieces.mapInArrow(summarise, SUMMARY_SQL).groupBy("file").applyInArrow(state_at_starts, STARTS_SQL)
    placed = pieces.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "depth", "base", "value")
    cut = placed.mapInArrow(cut_json, PIECES_SQL)
    kept = scratch_path(spark, "json-pieces")
    cut.write.parquet(kept)
    cut = spark.read.schema(PIECES_SQL).parquet(kept)
    # line ends inside an object only stand between its tokens
    text = F.regexp_replace(F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", ""), r"[\r\n]+", " ")
    objects = put_together(cut.where(F.col("kind") != WRONG), "").select("file", text.alias("value"))
    wrong = (cut.where(F.col("kind") == WRONG).select("file")
             .union(objects.where(~F.startswith("value", F.lit("{"))).select("file")).agg(F.min("file")).first()[0])
    if wrong:
        raise ValueError(f"{wrong}: a JSON source needs an array of objects at its top level")
    out = scratch_path(spark, "json-lines")
    objects.select("value").write.text(out)
    return out
