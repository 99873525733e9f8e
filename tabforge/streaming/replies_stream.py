"""Structured Streaming form of reply handling.

Replies arriving as files are parsed (E1-E4), cleaned (F1) and each key is
claimed once: ``dropDuplicates([pk])`` keeps every key in the state store (RocksDB, so
on disk and not in the heap), or, when replies carry an arrival time,
``dropDuplicatesWithinWatermark`` bounds that state.  The sink is ``foreachBatch`` writing one directory per epoch
with overwrite, so a replayed epoch after a failure rewrites the same
output (exactly-once with the checkpoint).

``stream_claims`` does not depend on arrival: a key's state is the rank (batch, attempt, pos)
of the best row so far, a better row that comes later is written as an update, and
``current_claims`` reads the best row of each key, which is F3 over everything that arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.assemble import ORDER_COLS, dedup_global, drop_missing_keys
from ..operators.replies import parse_csv_replies

REPLY_FILE_SCHEMA = T.StructType([
    T.StructField("batch_num", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("response", T.StringType()),
])


STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of new queries in RocksDB, unless the session names a provider itself."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(conf, ""):
        spark.conf.set(conf, STATE_PROVIDER)


def claimed_rows_stream(replies: DataFrame, columns: list[str], pk: str,
                        event_time: str | None = None, watermark: str = "1 hour") -> DataFrame:
    rows = parse_csv_replies(replies, columns, carry=[event_time] if event_time else None).rows
    clean = drop_missing_keys(rows, pk)
    if event_time:
        return clean.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([pk])
    return clean.dropDuplicates([pk])


def stream_replies(spark: SparkSession, source_dir: str, columns: list[str], pk: str,
                   sink_dir: str, checkpoint_dir: str, files_per_trigger: int | None = None,
                   schema: T.StructType = REPLY_FILE_SCHEMA, event_time: str | None = None,
                   watermark: str = "1 hour") -> None:
    """Run the stream over everything available now (``availableNow``) and stop."""
    use_rocksdb(spark)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    claimed = claimed_rows_stream(reader.parquet(source_dir), columns, pk, event_time, watermark)

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}")

    q = (claimed.writeStream.foreachBatch(write_epoch)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_DAYS = 7                      # a key's state goes this long after its last row


def _better_claims(ttl_ms: int):
    """The state function of ``stream_claims``: rows pass only when they improve their key's
    rank.  Made here so that it is shipped by value and needs no package on executors."""
    order = list(ORDER_COLS)

    def better(key, pieces, state):
        if state.hasTimedOut:
            state.remove()
            return
        top = tuple(state.get) if state.exists else None
        row = None
        for pdf in pieces:                       # pieces of a hot key, never the whole of it
            ranks = [tuple(map(int, r)) for r in zip(*(pdf[c].tolist() for c in order))]
            rank = min(ranks)
            if top is None or rank < top:
                at = ranks.index(rank)
                top, row = rank, pdf if len(ranks) == 1 else pdf.iloc[at:at + 1]
        if row is not None:
            state.update(top)
            yield row
        state.setTimeoutDuration(ttl_ms)

    return better


RANK_SCHEMA = T.StructType([T.StructField("batch_num", T.LongType()), T.StructField("attempt", T.IntegerType()),
                            T.StructField("pos", T.IntegerType())])


def stream_claims(spark: SparkSession, source_dir: str, columns: list[str], pk: str, sink_dir: str,
                  checkpoint_dir: str, files_per_trigger: int | None = None,
                  schema: T.StructType = REPLY_FILE_SCHEMA, state_days: float = STATE_DAYS) -> None:
    """Run the claims over everything available now and stop.  The sink gets a row (batch_num,
    attempt, pos, columns) whenever a key's best row changes.

    State is three numbers a key, kept in RocksDB, and goes ``state_days`` after the key's last row.  A
    worse row that comes after that is written once more, and ``current_claims`` ignores it."""
    use_rocksdb(spark)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = drop_missing_keys(parse_csv_replies(reader.parquet(source_dir), columns).rows, pk)
    rows = rows.select(*ORDER_COLS, *columns)
    out = T.StructType([*RANK_SCHEMA, *(T.StructField(c, T.StringType()) for c in columns)])
    claims = rows.groupBy(pk).applyInPandasWithState(
        _better_claims(int(state_days * 86_400_000)), out, RANK_SCHEMA, "update",
        GroupStateTimeout.ProcessingTimeTimeout)

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}")

    # a query with timeouts would run batches without data for ever instead of stopping
    before = spark.conf.get(NO_DATA_BATCHES, "true")
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        q = (claims.writeStream.outputMode("update").foreachBatch(write_epoch)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


def current_claims(spark: SparkSession, sink_dir: str, pk: str) -> DataFrame:
    """The row that holds each key now: the lowest (batch_num, attempt, pos) written."""
    return dedup_global(spark.read.parquet(sink_dir).drop("epoch"), pk)


def shortfall_stream(spark: SparkSession, source_dir: str, columns: list[str], pk: str, plan: DataFrame,
                     sink_dir: str, checkpoint_dir: str, files_per_trigger: int | None = None,
                     schema: T.StructType = REPLY_FILE_SCHEMA, event_time: str | None = None,
                     watermark: str = "1 hour") -> None:
    """F5 as replies arrive: claimed rows (each key once) are counted per batch in
    the state store (``update`` mode: only batches that changed are emitted);
    each epoch joins its updates with the static plan and writes them, so the
    latest row per batch is the current shortfall (``current_shortfall``).  Batches
    outside the plan are written with a target of 0 (``unplanned_batches``).  With an
    arrival time the keys kept as state are bounded by the watermark."""
    use_rocksdb(spark)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    counts = claimed_rows_stream(reader.parquet(source_dir), columns, pk, event_time, watermark) \
        .groupBy("batch_num").agg(F.count(F.lit(1)).alias("kept_rows"))
    targets = plan.select("batch_num", "target_rows")

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.join(targets, "batch_num", "left")
         .withColumn("target_rows", F.coalesce(F.col("target_rows"), F.lit(0)).cast("long"))
         .withColumn("shortfall", F.col("target_rows") - F.col("kept_rows"))
         .withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}"))

    q = (counts.writeStream.outputMode("update").foreachBatch(write_epoch)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_counts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The newest (batch_num, kept_rows) of every batch."""
    return spark.read.parquet(sink_dir).groupBy("batch_num").agg(F.max_by("kept_rows", "epoch").alias("kept_rows"))


def unplanned_batches(spark: SparkSession, sink_dir: str, plan: DataFrame) -> DataFrame:
    """(batch_num, kept_rows) of answered batches that the plan does not know."""
    return latest_counts(spark, sink_dir).join(plan.select("batch_num"), "batch_num", "left_anti")


def current_shortfall(spark: SparkSession, sink_dir: str, plan: DataFrame) -> DataFrame:
    """The latest update per batch; batches never answered count as fully short."""
    latest = latest_counts(spark, sink_dir)
    return (plan.select("batch_num", "target_rows").join(latest, "batch_num", "left")
            .withColumn("kept_rows", F.coalesce(F.col("kept_rows"), F.lit(0)).cast("long"))
            .withColumn("shortfall", F.col("target_rows") - F.col("kept_rows")))
