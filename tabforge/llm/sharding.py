"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; a row's
fractional rank is (rank - 1/2) / rows of its source.  All rows sorted by
fractional rank interleave the sources in proportion, so cutting that order into
shards of equal row counts gives every shard the whole table's mixture (law
``rows``: counts at most one apart).

No source is ranked in one task.  Each order is a sort by range, whose last key tells equal
rows apart, so neither a source nor a repeated or missing doc_id is bound to a task.  A
row's position is its place in its range plus the rows of the ranges before, and its rank
within the source that position less the rows of the sources before.

Defined results: null text has size 16 and the crc32 of an empty text; a null
source is a source of its own; rows that tie in hash (repeated ids) are ordered by
text size and crc32, equal rows arbitrarily; an empty table gives no rows; fewer
rows than shards leave the last shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

SHARDS = 40
SEED = "shards-1"
RANGE_ROWS = 100_000


def _before(counts: DataFrame, key: str) -> DataFrame:
    """``counts`` (one row a range, or a source) with the sum of n over lower keys."""
    lower = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0)))


def _positions(rows: DataFrame, total: int, range_rows: int, *order: str) -> DataFrame:
    """``rows`` with ``position``, from 0, in the order of the columns named."""
    ranges = max(1, -(-total // range_rows))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).checkpoint()
    # ids count from 0 in every partition, above 33 bits that hold its number
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    dealt = dealt.withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    before = _before(dealt.groupBy("part").agg(F.count("*").alias("n")), "part").select("part", "before")
    return dealt.join(before, "part").withColumn("position", F.col("before") + F.col("at")).drop("part", "at", "before")


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, position."""
    text = text_or_empty()
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))   # null apart from any name
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        stratum.alias("stratum"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"),
        F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "shard-rows")
    total = rows.count()
    last = ("h", "doc_id", "size", "text_crc32", "row")
    sources = _before(rows.groupBy("stratum").agg(F.count("*").alias("n")), "stratum").withColumnRenamed("n", "of_source")
    ranked = (_positions(rows, total, range_rows, "stratum", *last).join(sources, "stratum")
              .withColumn("fraction", (F.col("position") - F.col("before") + 0.5) / F.col("of_source"))
              .drop("position", "before", "of_source"))
    ranked = materialise(ranked, "shard-ranks")
    placed = _positions(ranked, total, range_rows, "fraction", "stratum", *last)
    # the first (total mod shards) shards have one row more
    low, more = divmod(total, shards)
    edge = more * (low + 1)
    shard = F.when(F.col("position") < edge, F.floor(F.col("position") / (low + 1))).otherwise(
        more + F.floor((F.col("position") - edge) / max(low, 1)))
    slot = F.when(F.col("position") < edge, F.col("position") % (low + 1)).otherwise(
        (F.col("position") - edge) % max(low, 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "position")


#: The same rows in DuckDB: crc32 is folded byte by byte over a table made by its rule
#: (reflected polynomial 0xEDB88320); the interleaving needs no ranges there.
ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
rows_ AS (
  SELECT doc_id::BIGINT AS doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         xor(4294967295::BIGINT, list_reduce(
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                          lambda x: ('0x' || x)::BIGINT),
           lambda a, b: xor(a >> 8, crc.t[xor(a, b) % 256 + 1]), 4294967295::BIGINT)) AS text_crc32,
         coalesce('s' || source, '') AS stratum,
         ('0x' || substr(md5('shards-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents, crc),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY stratum) AS fraction FROM rows_),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id, size, text_crc32) - 1 AS position,
         count(*) OVER () // 40 AS low, count(*) OVER () % 40 AS more FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law,
       (CASE WHEN position < more * (low + 1) THEN position // (low + 1)
             ELSE more + (position - more * (low + 1)) // greatest(low, 1) END)::INTEGER AS shard,
       (CASE WHEN position < more * (low + 1) THEN position % (low + 1)
             ELSE (position - more * (low + 1)) % greatest(low, 1) END)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, source, position::BIGINT AS position
FROM placed
"""
