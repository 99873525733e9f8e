"""Helpers shared by the training-data operators: table access, shared scratch
tables, row identity and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir, ship_package

#: Rows per Arrow batch handed to Python: at 10 KB a text this is about 5 MB.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, package importable on executors, small Arrow batches
    (so that a batch of long texts stays within a Python worker's memory)."""
    shared_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared folder and read it back:
    lineage is cut, columns stay prunable, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What the stage ``owner`` keeps in this Python worker between its tasks.  Spark gives a
    worker to later stages too, so what other stages kept there is let go."""
    for other in [k for k in _HELD if k != owner]:
        del _HELD[other]
    return _HELD.setdefault(owner, {})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_remainder(modulus: int, col: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def unique_ids(docs: DataFrame) -> bool:
    """True when every doc_id is present and occurs once."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    return repeated.isEmpty()


def filter_rows(docs: DataFrame, decide) -> DataFrame:
    """Rows of ``docs`` that ``decide`` keeps.

    ``decide`` maps a frame (doc_id, text) to the doc_ids to drop (one column
    ``doc_id``).  Where ids repeat or are null, rows get stand-in ids that keep
    the order of doc_id (nulls last), so every row is judged on its own and one
    of several equal rows can stay.
    """
    columns = docs.columns
    if unique_ids(docs):
        dropped = decide(docs.select("doc_id", "text"))
        return docs.join(dropped, "doc_id", "left_anti").select(columns)
    row = fresh_name(docs, "__row")
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(row, F.monotonically_increasing_id())
    rows = materialise(ordered, "rows")
    dropped = decide(rows.select(F.col(row).alias("doc_id"), "text"))
    return rows.join(dropped.withColumnRenamed("doc_id", row), row, "left_anti").select(columns)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest
    node of the component.

    Alternating large-star and small-star steps: every step is a minimum per
    node (combined before the shuffle) joined back to the edges, so a node with
    very many neighbours is never gathered; the joins are plain sort-merge joins
    whose large partitions Spark splits.  Each round is checkpointed.  It ends when all
    edges are stars: every node has larger neighbours only, or one neighbour.
    """
    cur = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .where("u <> v").distinct().checkpoint())
    while True:
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = cur.select(F.explode(ends).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).checkpoint()
        if low.where("m < u and k > 1").isEmpty():
            break
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))))
        cur = small.where("u <> v").distinct().checkpoint()
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
