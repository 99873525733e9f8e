"""Cleaning, shortfall, retry and assembly (F1-F8).

First-wins dedup is a ``row_number() = 1`` filter: Spark plans it with a
partial WindowGroupLimit before the shuffle, so each map task forwards at
most one row per key - a key holding a third of all rows collapses to one
row per map partition before it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import BASE_TEMPERATURE, MAX_ATTEMPTS, TEMPERATURE_STEP
from . import digests

ORDER_COLS = ["batch_num", "attempt", "pos"]


def _key_present(df: DataFrame, pk: str) -> Column:
    k = F.col(f"`{pk}`")
    cond = k.isNotNull()
    kind = dict(df.dtypes)[pk]
    if kind == "string":
        cond = cond & (k != "")
    if kind in ("double", "float"):
        cond = cond & ~F.isnan(k)
    return cond


# F1
def drop_missing_keys(df: DataFrame, pk: str | None) -> DataFrame:
    """Drop null and '' keys; no-op when pk is unset or not a column."""
    if not pk or pk not in df.columns:
        return df
    return df.where(_key_present(df, pk))


def _first_per(df: DataFrame, partition: list[str], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in partition]).orderBy(
        *[F.col(f"`{c}`") if isinstance(c, str) else c for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


# F2
def dedup_within_batch(df: DataFrame, pk: str, order: list[str] | None = None) -> DataFrame:
    """First occurrence of each key inside each batch."""
    order = order or ["attempt", "pos"]
    return _first_per(df, ["batch_num", pk], order)


# F3
def dedup_global(df: DataFrame, pk: str | list[str], order: list[str | Column] | None = None,
                 long_values: bool = False) -> DataFrame:
    """A key is claimed once over all batches: the survivor is the lowest
    (batch_num, attempt, pos) - deterministic, unlike dropDuplicates.

    With ``long_values`` (texts as keys) rows whose key's hash is theirs alone are kept
    where they are read, and only the rest is shuffled by key (see ``digests``)."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    if long_values and digests.hashable(df, keys):
        settled, repeated = digests.settled_and_repeated(df, keys)
        return settled.unionByName(_first_per(repeated, keys, order or ORDER_COLS))
    return _first_per(df, keys, order or ORDER_COLS)


# F3b
def exclude_claimed(new: DataFrame, claimed: DataFrame, pk: str, claimed_pk: str | None = None) -> DataFrame:
    """Rows whose key was already claimed go (left anti join; AQE broadcasts the
    claimed side only when its measured size is under the threshold)."""
    ck = claimed_pk or pk
    right = claimed.select(F.col(f"`{ck}`").alias("__claimed")).distinct()
    return new.join(right, F.col(f"`{pk}`") == F.col("__claimed"), "left_anti")


# F4
def dropped_duplicates(df: DataFrame, pk: str, long_values: bool = False) -> DataFrame:
    """(rows_in, rows_kept, dropped_duplicates) for a first-wins dedup on pk, from one
    aggregate (rows after F1 minus distinct keys) - no need to run the dedup.

    With ``long_values`` only keys whose hash repeats are counted by value (see ``digests``)."""
    present = drop_missing_keys(df, pk)
    if long_values and digests.hashable(df, [pk]):
        flagged = digests.flag_repeated(present.select(F.col(f"`{pk}`").alias("k")), ["k"])
        # a row without an equal is one key; of the others each distinct value is one
        parts = (flagged.groupBy(F.when(F.col("__again"), F.col("k")).alias("k"), "__again")
                 .agg(F.count(F.lit(1)).alias("n")))
        one = F.when(F.col("__again"), F.lit(1)).otherwise(F.col("n"))
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_in"),
                         F.coalesce(F.sum(one), F.lit(0)).cast("bigint").alias("rows_kept")) \
            .withColumn("dropped_duplicates", F.col("rows_in") - F.col("rows_kept"))
    return present.agg(F.count(F.lit(1)).alias("rows_in"),
                       F.count_distinct(F.col(f"`{pk}`")).alias("rows_kept")) \
        .withColumn("dropped_duplicates", F.col("rows_in") - F.col("rows_kept"))


# F5
def shortfall(plan: DataFrame, kept: DataFrame) -> DataFrame:
    """Per batch: target - kept (negative when over-delivered).  ``kept`` holds one
    row per kept record with batch_num; counted with a partial aggregate, then
    a left join onto the (batch-sized) plan."""
    counts = kept.groupBy("batch_num").agg(F.count(F.lit(1)).alias("kept_rows"))
    return (plan.join(counts, "batch_num", "left")
            .withColumn("kept_rows", F.coalesce(F.col("kept_rows"), F.lit(0)).cast("long"))
            .withColumn("shortfall", F.col("target_rows") - F.col("kept_rows")))


def temperature(attempt: Column) -> Column:
    return F.round(F.lit(BASE_TEMPERATURE) + F.lit(TEMPERATURE_STEP) * attempt, 2)


# F6
def retry_plan(plan: DataFrame, kept_idx: DataFrame, attempt: int, prefix: str | None = None) -> DataFrame:
    """Batches still short after ``attempt`` get one more attempt (at most 4 in all):
    rows = target - kept rows, start = start_idx + kept, and the seeds are the first
    that many planned row indexes not yet kept (planned keys anti-join kept keys), so a
    lost row in the middle is re-seeded rather than the batch tail.  A batch that
    delivered enough rows under keys of its own is not asked again.

    ``kept_idx`` has (batch_num, row_idx) of kept rows; row_idx is null for a row whose
    key is none of the planned ones."""
    if attempt + 1 >= MAX_ATTEMPTS:
        return plan.limit(0).select(
            "batch_num", F.lit(attempt + 1).alias("attempt"), F.lit(0).cast("long").alias("target_rows"),
            "start_idx", "end_idx", temperature(F.lit(attempt + 1)).alias("temperature"),
            F.array().cast("array<bigint>").alias("seed_idx"))
    planned = plan.select("batch_num", F.explode(F.sequence("start_idx", "end_idx")).alias("row_idx"))
    missing = planned.join(kept_idx.select("batch_num", "row_idx"), ["batch_num", "row_idx"], "left_anti")
    seeds = missing.groupBy("batch_num").agg(F.array_sort(F.collect_list("row_idx")).alias("unused"))
    kept_n = kept_idx.groupBy("batch_num").agg(F.count(F.lit(1)).alias("kept_rows"))
    kept = F.coalesce(F.col("kept_rows"), F.lit(0))
    short = F.col("end_idx") - F.col("start_idx") + 1 - kept
    out = (plan.select("batch_num", "start_idx", "end_idx").join(seeds, "batch_num")
           .join(kept_n, "batch_num", "left").where(short > 0)
           .select("batch_num", F.lit(attempt + 1).alias("attempt"), short.cast("long").alias("target_rows"),
                   (F.col("start_idx") + kept).alias("start_idx"),
                   "end_idx", temperature(F.lit(attempt + 1)).alias("temperature"),
                   F.slice("unused", F.lit(1), short.cast("int")).alias("seed_idx")))
    if prefix is not None:
        out = out.withColumn("seed_keys", F.transform(
            "seed_idx", lambda i: F.concat(F.lit(prefix), F.lit("-"), i.cast("string"))))
    return out


# F7
def assemble(frames: list[DataFrame]) -> DataFrame | None:
    """Concatenate by column name (union of columns, missing -> null); order is
    carried in (batch_num, attempt, pos) and applied only at the sink."""
    frames = [f for f in frames if f is not None]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# F8
def trim_to_rows(df: DataFrame, batch_col: str, order: list[str], target: Column | int) -> DataFrame:
    """Keep at most ``target`` rows per batch (the requested count; the reference
    never trims an over-delivered batch).  row_number <= n is planned with a
    partial WindowGroupLimit, so a huge batch is cut map-side before the shuffle."""
    w = Window.partitionBy(batch_col).orderBy(*order)
    t = F.lit(target) if isinstance(target, int) else target
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= t).drop("__rn")
