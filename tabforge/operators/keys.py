"""Keys: detection over a contract catalog and key-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import ColumnContract
from . import validate


# B1: what makes a column a key candidate, best first.  A rule takes (lower-case name,
# lower-case type) and is written with operators that mean the same for strings and Columns.
KEY_RULES = [lambda name, kind: kind == "uuid",
             lambda name, kind: name == "id",
             lambda name, kind: name.endswith("_id")]


def key_priority(column_name: Column, semantic: Column) -> Column:
    """Number of the first KEY_RULES rule that holds; null = not a candidate."""
    name, kind = F.lower(column_name), F.lower(semantic)
    return F.coalesce(*(F.when(rule(name, kind), i) for i, rule in enumerate(KEY_RULES)))


def detect_keys(contract_cat: DataFrame) -> DataFrame:
    """One row per table: (table_name, primary_key) with null when none is found.

    ``contract_cat`` has table_name, ordinal, column_name, semantic_type; it is
    metadata-sized, so the per-table window is cheap."""
    cand = contract_cat.withColumn("priority", key_priority(F.col("column_name"), F.col("semantic_type")))
    w = Window.partitionBy("table_name").orderBy("priority", "ordinal")
    best = (cand.where(F.col("priority").isNotNull())
            .withColumn("rn", F.row_number().over(w)).where("rn = 1")
            .select("table_name", F.col("column_name").alias("primary_key")))
    tables = contract_cat.select("table_name").distinct()
    return tables.join(best, "table_name", "left")


def detect_primary_key(contract: list[ColumnContract] | None) -> str | None:
    """Driver-side form of B1 for a single contract: least (rule, ordinal)."""
    ranked = [(rank, at, c.name) for at, c in enumerate(contract or [])
              for rank, rule in enumerate(KEY_RULES) if rule(c.name.lower(), (c.type or "").lower())]
    return min(ranked)[2] if ranked else None


def _missing(df: DataFrame, pk: str) -> Column:
    dt = df.schema[pk].dataType
    k = F.col(f"`{pk}`")
    cond = k.isNull()
    if isinstance(dt, T.StringType):
        cond = cond | (k == "")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        cond = cond | F.isnan(k)
    return cond


def key_quality_parts(df: DataFrame, pk: str):
    """Aggregate columns and the report columns over them (shared with profile).
    For float keys NaN is folded into null first: pandas treats both as one
    missing value when it looks for duplicates."""
    k = F.col(f"`{pk}`")
    if isinstance(df.schema[pk].dataType, (T.FloatType, T.DoubleType)):
        k = F.when(~F.isnan(k), k)
    aggs = [F.count(F.lit(1)).alias("__kq_total"),
            F.count_distinct(k).alias("__kq_distinct"),
            F.max(k.isNull()).cast("long").alias("__kq_has_null"),
            F.count_if(_missing(df, pk)).alias("__kq_nulls")]
    dup = F.col("__kq_total") - F.col("__kq_distinct") - F.coalesce(F.col("__kq_has_null"), F.lit(0))
    report = [F.lit(pk).alias("primary_key_column"),
              dup.alias("duplicates_found"),
              F.col("__kq_nulls").alias("nulls_found"),
              ((dup == 0) & (F.col("__kq_nulls") == 0)).alias("is_valid")]
    return aggs, report


def key_quality(df: DataFrame, pk: str | None) -> DataFrame | None:
    """(primary_key_column, duplicates_found, nulls_found, is_valid), one row.

    duplicates = rows after the first of each value with nulls counted as one
    value (pandas ``duplicated``); nulls = null + NaN + ''.  One aggregate:
    the distinct count is planned as a two-phase aggregate with map-side
    combine, so a hot key collapses before the shuffle.  None when pk is not
    a column (no report, as in the reference)."""
    if not pk or pk not in df.columns:
        return None
    aggs, report = key_quality_parts(df, pk)
    return df.agg(*aggs).select(*report)


SKETCH_BITS = 12              # 4,096 registers: a standard error under 1.7 percent
SKETCH_GROUPS = 256           # groups of partitions whose sketches are merged first
CLEARLY_BELOW = 0.75          # 15 standard errors below the row count
KEY_SCHEMA = "column_name string, total_rows bigint, is_unique boolean"


def distinct_sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per group of partitions (part): rows, and per column i its non-null values ``n<i>`` and
    a mergeable sketch ``s<i>`` of its distinct values.  One scan; the sketches of files or days
    can be stored and merged later (``merged_sketches``)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        aggs += [F.count(f"c{i}").alias(f"n{i}"), F.hll_sketch_agg(F.xxhash64(f"c{i}"), SKETCH_BITS).alias(f"s{i}")]
    part = (F.spark_partition_id() % SKETCH_GROUPS).alias("part")
    return df.select(part, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).groupBy("part").agg(*aggs)


def merged_sketches(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, non-null values and estimated distinct values (``d<i>``) of each column;
    no row for an empty table."""
    aggs = [F.sum("rows").alias("rows")]
    for i in range(len(columns)):
        aggs += [F.sum(f"n{i}").alias(f"n{i}"), F.hll_sketch_estimate(F.hll_union_agg(f"s{i}")).alias(f"d{i}")]
    return sketches.groupBy(F.lit(0).alias("all")).agg(*aggs).drop("all")


def verify_candidate_keys(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Is each candidate really a key?  (column_name, total_rows, is_unique); a column of
    an empty table is.

    One scan of all candidates rules out those with a null and those whose sketch lies
    clearly below the row count (by 15 standard errors).  Only the others are judged exactly:
    different hashes prove different values, and values are compared only where a hash
    repeats (``digests``), so a long key is not shuffled."""
    candidates = list(dict.fromkeys(candidates))
    spark = df.sparkSession
    seen = merged_sketches(distinct_sketches(df, candidates), candidates).first() if candidates else None
    rows = []
    for i, c in enumerate(candidates):
        total = seen["rows"] if seen else 0
        open_ = seen is not None and seen[f"n{i}"] == total and seen[f"d{i}"] >= CLEARLY_BELOW * total
        unique = seen is None or bool(
            open_ and validate.duplicate_rows(df.select(F.col(f"`{c}`").alias("k")), long_values=True).isEmpty())
        rows.append((c, total, unique))
    return spark.createDataFrame(rows, KEY_SCHEMA)
