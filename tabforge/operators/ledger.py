"""Job ledger: an append-only Parquet table of job records.

Every save appends rows with a ``written_at`` time; the current state of a
job is its latest write (``row_number`` over job_id, planned with a partial
WindowGroupLimit), so concurrent writers never rewrite files and a repeated
job id is an upsert on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DEFAULT_STATUS, DOWNLOAD_PREFIX, HISTORY_ROWS, HISTORY_TTL_SECONDS

LEDGER_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("format", T.StringType()),
    T.StructField("columns", T.StringType()),        # JSON array text
    T.StructField("file_path", T.StringType()),
    T.StructField("s3_key", T.StringType()),
    T.StructField("generated_at", T.StringType()),   # ISO text
    T.StructField("status", T.StringType()),
    T.StructField("ttl", T.LongType()),              # epoch seconds
    T.StructField("written_at", T.TimestampType()),
])


def ntz_epoch_seconds(c: Column) -> Column:
    """Epoch seconds of a timestamp_ntz read as UTC wall time, independent of the
    session time zone (a plain cast to timestamp would apply it)."""
    return (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            + F.second(c)).cast("long")


def job_records(jobs: DataFrame) -> DataFrame:
    """Normalise records for the ledger: status defaults to 'success', s3_key kept only
    when set, ttl = written_at + 90 days (epoch seconds) unless given."""
    cols = set(jobs.columns)
    if "written_at" in cols and dict(jobs.dtypes)["written_at"] == "timestamp_ntz":
        written = F.timestamp_seconds(ntz_epoch_seconds(F.col("written_at")))
    elif "written_at" in cols:
        written = F.col("written_at").cast("timestamp")
    else:
        written = F.current_timestamp()
    ttl = F.col("ttl") if "ttl" in cols else F.unix_seconds(written) + F.lit(HISTORY_TTL_SECONDS)
    s3 = F.col("s3_key") if "s3_key" in cols else F.lit(None).cast("string")
    gen = F.col("generated_at") if "generated_at" in cols else F.lit(None)
    status = F.coalesce(F.col("status"), F.lit(DEFAULT_STATUS)) if "status" in cols else F.lit(DEFAULT_STATUS)
    return jobs.select(
        F.col("job_id").cast("string").alias("job_id"), F.col("dataset_name").cast("string").alias("dataset_name"),
        F.col("rows").cast("long").alias("rows"), F.col("format").cast("string").alias("format"),
        F.col("columns").cast("string").alias("columns"), F.col("file_path").cast("string").alias("file_path"),
        F.when(s3 != "", s3).alias("s3_key"), gen.cast("string").alias("generated_at"),
        status.alias("status"), ttl.cast("long").alias("ttl"), written.alias("written_at"))


# I1
def save_jobs(jobs: DataFrame, ledger_path: str) -> None:
    job_records(jobs).write.mode("append").parquet(ledger_path)


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)


def current_jobs(ledger: DataFrame) -> DataFrame:
    """Last write wins per job_id (ties: the larger ttl, then the larger path)."""
    w = Window.partitionBy("job_id").orderBy(F.col("written_at").desc(), F.col("ttl").desc_nulls_last(),
                                             F.col("file_path").desc_nulls_last())
    return ledger.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def decode_columns(c: Column) -> Column:
    return F.from_json(c, "array<string>")


# I2
def get_job(ledger: DataFrame, job_id: str) -> DataFrame:
    """One record or nothing; the filter is on the window's partition key, so
    Catalyst pushes it below the window into the Parquet scan."""
    return current_jobs(ledger).where(F.col("job_id") == job_id) \
        .withColumn("columns", decode_columns(F.col("columns")))


# I3
def latest_jobs(ledger: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """Newest ``generated_at`` first (missing sorts as ''), ttl dropped, columns
    decoded; ORDER BY + LIMIT plans as TakeOrderedAndProject (top-n per task)."""
    cur = current_jobs(ledger)
    return (cur.orderBy(F.coalesce(F.col("generated_at"), F.lit("")).desc(), F.col("job_id"))
            .limit(n).drop("ttl").withColumn("columns", decode_columns(F.col("columns"))))


# I4
def expire_jobs(ledger: DataFrame, now_epoch: int) -> DataFrame:
    return current_jobs(ledger).where(F.col("ttl") > F.lit(now_epoch))


# I5
def artifact_key(s3_key: Column, file_path: Column) -> Column:
    """s3_key, else file_path; only keys under 'datasets/' resolve (else null)."""
    key = F.coalesce(F.nullif(s3_key, F.lit("")), file_path)
    return F.when(key.startswith(DOWNLOAD_PREFIX), key)


def resolve_artifacts(ledger: DataFrame) -> DataFrame:
    return current_jobs(ledger).select("job_id", artifact_key(F.col("s3_key"), F.col("file_path")).alias("artifact"))
