"""Batch planning: sizes, row ranges, seeded keys, default texts.

Plans are DataFrames.  A spec table (one row per dataset) is exploded into
batches in two steps, first into chunks of CHUNK_BATCHES batches, which are
spread over the cluster, then each chunk into its batches: no array and no
task holds a whole plan.  The batch table is tiny next to the rows it
describes (rows / batch size), and it is repartitioned by batch before it is
exploded further into per-row seeds, so the row-level work is spread over
the cluster instead of staying in the task that held the spec row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import BATCH_SIZE_TIERS, BATCH_SIZE_WIDEST

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Default quality instructions used when none are given.
DEFAULT_CRITERIA = (
    "Generate realistic, diverse, and internally consistent data. "
    "Values must reflect real-world distributions and relationships between columns. "
    "Avoid repetitive patterns, placeholder text, or sequential values. "
    "Ensure all fields have appropriate formats and plausible value ranges."
)
DESCRIPTION_FIELDS = 6        # columns named in the default description
# ---------------------------------------------------------------------------


CHUNK_BATCHES = 100_000


# C1
def batch_size(num_columns: Column) -> Column:
    """Rows per call from the column count (no contract counts as 0 columns)."""
    expr = None
    for limit, size in BATCH_SIZE_TIERS:
        expr = F.when(num_columns <= limit, size) if expr is None else expr.when(num_columns <= limit, size)
    return expr.otherwise(BATCH_SIZE_WIDEST)


# C2
def plan_batches(specs: DataFrame, rows_col: str = "rows", width_col: str = "num_columns",
                 name_col: str = "dataset_name") -> DataFrame:
    """specs(dataset_name, rows, num_columns) -> one row per batch:
    (dataset_name, batch_num, batch_size, target_rows, start_idx, end_idx)."""
    size = batch_size(F.coalesce(F.col(width_col), F.lit(0)))
    with_size = specs.select(F.col(name_col).alias("dataset_name"), F.col(rows_col).cast("long").alias("rows"),
                             size.cast("long").alias("batch_size"))
    n = F.ceil(F.col("rows") / F.col("batch_size"))
    last = F.call_function("div", n.cast("long") - 1, F.lit(CHUNK_BATCHES).cast("long"))
    chunks = with_size.select("dataset_name", "rows", "batch_size", n.cast("long").alias("__n"),
                              F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__chunk"))
    low = F.col("__chunk") * CHUNK_BATCHES
    exploded = chunks.where("__n > 0").repartition("dataset_name", "__chunk").select(
        "dataset_name", "rows", "batch_size",
        F.explode(F.sequence(low + 1, F.least(low + CHUNK_BATCHES, F.col("__n")))).alias("batch_num"))
    first = (F.col("batch_num") - 1) * F.col("batch_size") + 1
    target = F.least(F.col("batch_size"), F.col("rows") - (F.col("batch_num") - 1) * F.col("batch_size"))
    return exploded.select("dataset_name", "batch_num", "batch_size",
                           target.alias("target_rows"), first.alias("start_idx"),
                           (first + target - 1).alias("end_idx"))


def plan_single(spark: SparkSession, rows: int, num_columns: int, dataset_name: str = "dataset",
                partitions: int | None = None) -> DataFrame:
    """Plan for one request: batches straight from ``spark.range`` (spread over
    partitions from the start, no explode in one task)."""
    from ..spec import batch_size_for
    size = batch_size_for(num_columns)
    n = -(-rows // size)
    parts = partitions or max(1, min(n // 50_000 + 1, 1000))
    b = spark.range(1, n + 1, numPartitions=parts).select(F.col("id").alias("batch_num"))
    first = (F.col("batch_num") - 1) * size + 1
    target = F.least(F.lit(size).cast("long"), F.lit(rows).cast("long") - (F.col("batch_num") - 1) * size)
    return b.select(F.lit(dataset_name).alias("dataset_name"), "batch_num", F.lit(size).cast("long").alias("batch_size"),
                    target.alias("target_rows"), first.alias("start_idx"), (first + target - 1).alias("end_idx"))


# C4
def key_prefix(pk: str) -> str:
    return pk.replace(" ", "").upper()


def seed_key(prefix: Column | str, idx: Column) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.lit("-"), idx.cast("string"))


def seed_keys(plan: DataFrame, pk: str | Column, partitions: int | None = None) -> DataFrame:
    """One row per planned row: (dataset_name, batch_num, row_idx, seed_key) with
    seed_key = UPPER(pk without spaces) || '-' || global row index."""
    prefix = F.upper(F.replace(pk if isinstance(pk, Column) else F.lit(pk), F.lit(" "), F.lit("")))
    spread = plan.repartition(partitions, "dataset_name", "batch_num") if partitions else \
        plan.repartition("dataset_name", "batch_num")
    rows = spread.select("dataset_name", "batch_num", prefix.alias("_p"),
                         F.explode(F.sequence("start_idx", "end_idx")).alias("row_idx"))
    return rows.select("dataset_name", "batch_num", "row_idx", seed_key(F.col("_p"), F.col("row_idx")).alias("seed_key"))


# C6
def readable_name(name: Column) -> Column:
    """'_' and '-' to spaces, stripped, title case with Python's rule."""
    from ..functions.text import py_strip, py_title
    return py_title(py_strip(F.translate(name, "_-", "  ")))


def default_texts(contract_cat: DataFrame) -> DataFrame:
    """(dataset_name, description, ai_criteria) per table of a catalog
    (table_name, ordinal, column_name): 'Realistic synthetic {Name} dataset
    containing fields: first 6[ and N more].'"""
    g = contract_cat.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("cols"))
    names = F.transform("cols", lambda s: s["column_name"])
    n = F.size(names)
    summary = F.array_join(F.slice(names, 1, DESCRIPTION_FIELDS), ", ")
    summary = F.when(n > DESCRIPTION_FIELDS,
                     F.concat(summary, F.lit(" and "), (n - DESCRIPTION_FIELDS).cast("string"), F.lit(" more"))
                     ).otherwise(summary)
    desc = F.concat(F.lit("Realistic synthetic "), readable_name(F.col("table_name")), F.lit(" dataset"),
                    F.when(n > 0, F.concat(F.lit(" containing fields: "), summary, F.lit("."))).otherwise(F.lit(".")))
    return g.select(F.col("table_name").alias("dataset_name"), desc.alias("description"),
                    F.lit(DEFAULT_CRITERIA).alias("ai_criteria"))
