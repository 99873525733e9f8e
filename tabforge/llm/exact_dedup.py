"""Exact dedup by distributed most-significant-digit radix partitioning.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.  The digits
of a text are successive runs of its normalised UTF-8 bytes.

1. Each input task groups the texts it reads by the same radix recursion, in
   chunks of bounded size, and passes on one body per group with the group's
   count and best row: a text that fills a third of the table reaches the
   shuffle once per chunk.
2. Prefixes are split by further bytes as long as the bodies below one of them
   add up to more than ``leaf_bytes``.  A level reads only the bodies below the
   prefixes that the level before split, from a written table, and numbers the
   prefixes that it splits itself on the executors: nothing of them passes through the
   driver and no level repeats the ones before.
3. Bodies go to the task of their leaf (deepest split prefix and next digit),
   sorted by leaf; each leaf is split by successive bytes until its groups are
   singletons or have ended.  Bodies are compared by their bytes alone; a leaf
   whose digit has ended holds equal bodies, of which one is kept in memory.

Defined results: null text counts as empty; empty texts form one group; of rows
that tie on code points and doc_id (repeated rows) one stays; a null doc_id
sorts after all others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialise, partitions, text_or_empty

BLANKS = b" \t\n\v\f\r"
LEAF_BYTES = 1 << 20
CHUNK_BYTES = 6 << 20            # several copies of a chunk are in memory at once: here, in Arrow and in the JVM
FIRST_DIGIT = 16
NO_ID = (1 << 63) - 1


def radix_groups(bodies: list[bytes], offset: int = 0, width: int = FIRST_DIGIT) -> list[list[int]]:
    """Indexes of equal bodies, grouped by splitting on successive digits: bytes
    [offset, offset + width), then twice as many, and so on."""
    done, todo = [], [(list(range(len(bodies))), offset, width)]
    while todo:
        members, at, wide = todo.pop()
        split: dict[bytes, list[int]] = {}
        for i in members:
            split.setdefault(bodies[i][at:at + wide], []).append(i)
        for digit, group in split.items():
            if len(group) == 1 or len(digit) < wide:
                done.append(group)
            else:
                todo.append((group, at + wide, 2 * wide))
    return done


ROWS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("ncp", pa.int64()), ("lead", pa.int64()),
                  ("body", pa.binary()), ("n", pa.int64()), ("best_ncp", pa.int64()),
                  ("best_id", pa.int64()), ("best_rid", pa.int64())])
ROWS_SQL = ("rid long, doc_id long, ncp long, lead long, body binary, n long, best_ncp long, "
            "best_id long, best_rid long")


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id, row): most code points, then smallest id, then row."""
    return min(a, b, key=lambda x: (-x[0], x[1], x[2]))


def group_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, text) to rows with their local leader; a leader also carries
    its body and its group's count and best row."""
    def flush(rows):
        out = [[] for _ in ROWS]
        for group in radix_groups([r[3] for r in rows]):
            lead, best = rows[group[0]][0], None
            for i in group:
                rid, doc_id, ncp, _ = rows[i]
                mine = (ncp, NO_ID if doc_id is None else doc_id, rid)
                best = mine if best is None else _better(best, mine)
            for k, i in enumerate(group):
                rid, doc_id, ncp, body = rows[i]
                tail = (body, len(group), *best) if k == 0 else (None,) * 5
                for column, value in zip(out, (rid, doc_id, ncp, lead, *tail)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ROWS)], schema=ROWS)

    held("exact_dedup")
    rows, size = [], 0
    for batch in batches:
        for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append((rid, doc_id, len(text), text.encode("utf-8").translate(None, BLANKS)))
            size += len(rows[-1][3]) + 200
            if size > CHUNK_BYTES:
                yield flush(rows)
                rows, size = [], 0
    if rows:
        yield flush(rows)


GROUPS = pa.schema([("lead", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()),
                    ("group_size", pa.int64()), ("sha", pa.binary())])
GROUPS_SQL = "lead long, keep_id long, keep_rid long, group_size long, sha binary"


def split_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders sorted by leaf (node, digit) to the final group of each."""
    def close(leaf):
        for group in radix_groups(leaf["bodies"], leaf["offset"]):
            members = [x for i in group for x in leaf["rows"][i]]
            size, best = sum(m[1] for m in members), members[0][2]
            for m in members[1:]:
                best = _better(best, m[2])
            sha = hashlib.sha256(leaf["bodies"][group[0]]).digest()
            for m in members:
                yield m[0], None if best[1] == NO_ID else best[1], best[2], size, sha

    def emit(rows):
        columns = list(zip(*rows)) or [()] * len(GROUPS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, GROUPS)],
                                          schema=GROUPS)

    held("exact_dedup")
    leaf, key, out = None, None, []
    for batch in batches:
        for node, digit, offset, width, lead, body, n, ncp, doc_id, rid in zip(
                *(batch.column(i).to_pylist() for i in range(10))):
            if (node, digit) != key:
                if leaf:
                    out.extend(close(leaf))
                key, leaf = (node, digit), {"bodies": [], "rows": [], "offset": offset}
            row = (lead, n, (ncp, doc_id, rid))
            if len(digit) < width and leaf["bodies"]:        # ended: equal to the one held
                leaf["rows"][0].append(row)
            else:
                leaf["bodies"].append(body)
                leaf["rows"].append([row])
            if len(out) >= 5000:
                yield emit(out)
                out = []
    if leaf:
        out.extend(close(leaf))
    yield emit(out)


LEVEL_BITS = 56                  # of a prefix's number, below its level


def leaves(leaders: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Leaders with node (deepest split prefix), offset and width of their next digit."""
    total = leaders.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    most = max(leaf_bytes, total // (8 * partitions(leaders.sparkSession)))
    columns = [*leaders.columns, "node", "offset", "width"]
    cur = leaders.withColumns({"node": F.lit(0).cast("long"), "offset": F.lit(0), "width": F.lit(FIRST_DIGIT)})
    offset, width, level, settled = 0, FIRST_DIGIT, 1, []
    digit = lambda: F.substring(F.col("body"), F.lit(offset + 1), F.lit(width))
    while True:
        heavy = (cur.groupBy("node", digit().alias("digit"))
                 .agg(F.sum(F.octet_length("body")).alias("held"), F.count("*").alias("k"))
                 .where((F.col("held") > most) & (F.col("k") > 1) & (F.octet_length("digit") == width)))
        number = F.lit(level << LEVEL_BITS) + F.monotonically_increasing_id()
        heavy = materialise(heavy.select(F.col("node").alias("s_node"), F.col("digit").alias("s_digit"),
                                         number.alias("s_id")), "radix-splits")
        if heavy.isEmpty():
            break
        below = (F.col("node") == F.col("s_node")) & (digit() == F.col("s_digit"))
        settled.append(cur.join(heavy, below, "left_anti").select(columns))
        deeper = cur.join(heavy, below).withColumn("node", F.col("s_id"))
        offset, width, level = offset + width, 2 * width, level + 1
        deeper = deeper.withColumns({"offset": F.lit(offset), "width": F.lit(width)}).select(columns)
        cur = materialise(deeper, "radix-level")
    for part in settled:
        cur = cur.union(part)
    return cur


def groups(docs: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"),
                           text_or_empty().alias("text"))
    rows = materialise(numbered.mapInArrow(group_locally, ROWS_SQL), "radix-rows")
    leaders = leaves(rows.where("body is not null").select("lead", "body", "n", "best_ncp", "best_id", "best_rid"),
                     leaf_bytes)
    digit = F.substring(F.col("body"), F.col("offset") + 1, F.col("width"))
    placed = (leaders.select("node", digit.alias("digit"), "offset", "width", "lead", "body", "n", "best_ncp",
                             "best_id", "best_rid")
              .repartition(partitions(spark), "node", "digit").sortWithinPartitions("node", "digit"))
    found = placed.mapInArrow(split_leaves, GROUPS_SQL)
    return (rows.select("rid", "doc_id", "lead").join(found, "lead")
            .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def dropped_ids(docs: DataFrame) -> DataFrame:
    """doc_ids that a longer or earlier equal text replaces (ids must be unique)."""
    return groups(docs).where(~F.col("kept")).select("doc_id")
