"""A whole generation job as Spark jobs (the reference's generate request).

Rule-based mode: the contract-driven generator (group D), already exact and
reproducible.  Offline mode: plan (C2) -> prompts (C5) -> completion
(C7, or replies produced elsewhere) -> parse (E) -> claim keys (F1-F3b) ->
shortfall / retry plan (F5, F6), at most four attempts -> assemble + trim
(F7, F8) -> key report (B3) -> ordered write (H) -> ledger record (I1).

Each attempt's replies and kept rows are written to the shared folder, so a
retry round reads a short lineage and a lost executor recomputes at most
one attempt.  The driver only holds the spec, row counts and the report.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assemble, generate, keys, ledger, replies
from ..operators.validate import key_suffix
from ..session import output_dir, scratch_path
from ..sources import sinks
from ..spec import MAX_ATTEMPTS, DatasetSpec, batch_size_for
from . import batches, prompts

ORDER = ["batch_num", "attempt", "pos"]


@dataclass
class JobResult:
    job_id: str
    path: str
    rows_generated: int
    status: str                     # success | partial | empty
    attempts: int
    quality: dict | None
    rows: DataFrame                 # the written dataset, read back
    generated_at: str = ""          # ISO time the result was written


def _contract_cols(spec: DatasetSpec) -> list[str]:
    return [c.name for c in spec.columns or []]


def _kept_rows(spark: SparkSession, kept_dirs: list[str]) -> DataFrame | None:
    if not kept_dirs:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*kept_dirs)


class OfflineJob:
    """A generation job driven by replies that arrive from outside (a batch
    inference service, or ``complete_prompts``).  All state is in ``work`` on
    the shared folder - the raw replies and kept rows of every attempt - so a
    job resumes after a driver restart and a lost executor recomputes at most
    one attempt's step.

        job = OfflineJob(spark, spec, work)
        job.export_prompts(0, path)          # JSON Lines for the service
        job.ingest(0, read_replies(...))     # parse, claim keys, keep rows
        job.pending()                        # what attempt 1 must ask for
        ...
        job.finish(base, ledger_path)        # trim, write, key report, ledger
    """

    def __init__(self, spark: SparkSession, spec: DatasetSpec, work: str | None = None,
                 samples: list[dict] | None = None, job_id: str | None = None):
        self.spark, self.spec, self.samples = spark, spec, samples
        self.job_id = job_id or str(uuid.uuid4())
        self.work = work or scratch_path(spark, f"job-{self.job_id}")
        self.plan = batches.plan_single(spark, spec.rows, spec.num_columns, spec.dataset_name)
        self.n_batches = -(-spec.rows // batch_size_for(spec.num_columns))
        cols = _contract_cols(spec)
        self.columns = cols
        self.pk = spec.primary_key if spec.primary_key and (not cols or spec.primary_key in cols) else None
        self.prefix = batches.key_prefix(self.pk) if self.pk else None

    # state on the shared folder ------------------------------------------------
    def _kept_dir(self, attempt: int) -> str:
        return f"{self.work}/kept/attempt={attempt}"

    def _done_attempts(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.work}/kept")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        out = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if name.startswith("attempt=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name.split("=", 1)[1]))
        return sorted(out)

    def kept(self, before: int | None = None) -> DataFrame | None:
        dirs = [self._kept_dir(a) for a in self._done_attempts() if before is None or a < before]
        return _kept_rows(self.spark, dirs)

    # steps ---------------------------------------------------------------------
    def todo(self, attempt: int) -> DataFrame:
        """The batches attempt ``attempt`` must ask for (the full plan first; then
        the retry plan from everything kept so far; empty after 4 attempts)."""
        if attempt >= MAX_ATTEMPTS:
            return self.plan.withColumn("attempt", F.lit(attempt)).limit(0)
        kept = self.kept(before=attempt) if attempt else None
        if kept is None:                         # first attempt, or nothing ingested yet
            return self.plan.withColumn("attempt", F.lit(attempt))
        if self.pk and self.pk in kept.columns:
            idx = key_suffix(F.col(self.pk))
            mine = F.col(self.pk).startswith(F.lit(self.prefix + "-"))
            kept_idx = kept.select("batch_num", F.when(mine, idx).alias("row_idx"))
            return assemble.retry_plan(self.plan, kept_idx, attempt - 1, self.prefix)
        sf = assemble.shortfall(self.plan, kept.select("batch_num")).where(F.col("shortfall") > 0)
        return sf.select("dataset_name", "batch_num", F.col("shortfall").alias("target_rows"),
                         (F.col("start_idx") + F.col("kept_rows")).alias("start_idx"), "end_idx",
                         F.lit(attempt).alias("attempt"))

    def pending(self) -> DataFrame:
        done = self._done_attempts()
        return self.todo(done[-1] + 1 if done else 0)

    def prompts(self, attempt: int) -> DataFrame:
        todo = self.todo(attempt)
        if self.spec.columns:
            return prompts.render_csv_prompts(todo, self.spec, self.samples)
        return prompts.render_json_prompts(todo, self.spec, self.samples)

    def export_prompts(self, attempt: int, path: str) -> str:
        """The attempt's prompts as JSON Lines: batch_num, attempt, prompt,
        temperature (0.3 + 0.1 * attempt) and max_tokens, for a batch service."""
        from ..spec import MAX_OUTPUT_TOKENS
        p = self.prompts(attempt)
        (p.select("batch_num", F.lit(attempt).alias("attempt"), "prompt",
                  assemble.temperature(F.lit(attempt)).alias("temperature"),
                  F.lit(MAX_OUTPUT_TOKENS).alias("max_tokens"))
         .write.mode("overwrite").json(path))
        return path

    def ingest(self, attempt: int, reply_table: DataFrame) -> int:
        """Parse an attempt's replies, drop missing keys, keep the first row per key
        and drop keys claimed by earlier attempts; write the kept rows.  Returns
        the number of rows kept by this attempt."""
        rpath = f"{self.work}/replies/attempt={attempt}"
        reply_table.write.mode("overwrite").parquet(rpath)
        got = self.spark.read.parquet(rpath)
        if "error" in got.columns:
            got = got.where(F.col("error").isNull())
        new = (replies.parse_csv_replies(got, self.columns).rows if self.spec.columns
               else replies.parse_json_replies(got))
        if self.pk and self.pk in new.columns:
            new = assemble.dedup_global(assemble.drop_missing_keys(new, self.pk), self.pk)
            previous = self.kept(before=attempt)
            if previous is not None and self.pk in previous.columns:
                new = assemble.exclude_claimed(new, previous, self.pk)
        new.write.mode("overwrite").parquet(self._kept_dir(attempt))
        return self.spark.read.parquet(self._kept_dir(attempt)).count()

    def finish(self, base: str | None = None, ledger_path: str | None = None) -> "JobResult":
        kept = self.kept()
        attempts = len(self._done_attempts())
        if kept is None:
            data = self.spark.createDataFrame([], "batch_num bigint, attempt int, pos int")
        else:
            data = trim_to_plan(kept, self.plan, batch_size_for(self.spec.num_columns))
            data.write.mode("overwrite").parquet(f"{self.work}/final")
            data = self.spark.read.parquet(f"{self.work}/final")
        n = data.count()
        return _write_result(self.spark, self.spec, data, n, self.spec.rows - n, attempts,
                             base or self.spec.target_location or output_dir(self.spark), ledger_path,
                             self.job_id, ordered=True)


def run_offline(spark: SparkSession, spec: DatasetSpec, model_fn: Callable[[str, float, int], str],
                job: OfflineJob) -> None:
    """The attempt loop with a callable model: prompts -> completion -> ingest,
    until nothing is pending or four attempts are used."""
    for attempt in range(MAX_ATTEMPTS):
        ptable = job.prompts(attempt)
        if ptable.isEmpty():
            break
        # complete_prompts spreads the prompts over the worker cap
        job.ingest(attempt, prompts.complete_prompts(ptable, model_fn, spec.rows, job.n_batches))


def trim_to_plan(rows: DataFrame, plan: DataFrame, batch_size: int) -> DataFrame:
    """F8 with each batch's own target (the last batch may be smaller).  A first
    cut to the batch size is a literal row limit, so Spark pre-limits map-side
    (WindowGroupLimit) and a batch whose replies run away never lands whole
    in one task; the exact per-batch target is applied after."""
    rows = assemble.trim_to_rows(rows, "batch_num", ["attempt", "pos"], batch_size)
    t = rows.join(plan.select("batch_num", "target_rows"), "batch_num")
    w = Window.partitionBy("batch_num").orderBy("attempt", "pos")
    return t.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.col("target_rows")) \
        .drop("__rn", "target_rows")


def _write_result(spark: SparkSession, spec: DatasetSpec, data: DataFrame, n: int, shortfall_total: int,
                  attempts: int, base: str, ledger_path: str | None, job_id: str, ordered: bool) -> JobResult:
    out_cols = [c for c in data.columns if c not in ORDER]
    status = "empty" if n == 0 else ("partial" if shortfall_total > 0 else "success")
    path = sinks.dataset_path(base, spec.dataset_name, spec.format)
    if n and not ordered:
        # spark.range partitions hold contiguous ascending row ranges, so part files
        # written partition by partition are already in row order: no sort needed.
        sinks.write_dataset(data, path, spec.format, keep=out_cols)
    elif n:
        sinks.write_dataset(data, path, spec.format, order_by=ORDER, keep=out_cols)
    rows = sinks.read_dataset(spark, path, spec.format, schema=data.select(*out_cols).schema) if n else data
    quality = None
    if spec.primary_key and spec.primary_key in out_cols and n:
        # B3 over what was written (a one-column read, not a recomputation)
        quality = keys.key_quality(rows, spec.primary_key).first().asDict()
    generated_at = datetime.now().isoformat()
    if ledger_path:
        rec = spark.createDataFrame(
            [(job_id, spec.dataset_name, n, spec.format, json.dumps(out_cols), path,
              sinks.published_key(path) if "/datasets/" in path else "", generated_at, status)],
            "job_id string, dataset_name string, rows long, format string, columns string, file_path string, "
            "s3_key string, generated_at string, status string")
        ledger.save_jobs(rec, ledger_path)
    return JobResult(job_id, path, n, status, attempts, quality, rows, generated_at)


def synthesize(spark: SparkSession, spec: DatasetSpec, model_fn: Callable[[str, float, int], str] | None = None,
               samples: list[dict] | None = None, base: str | None = None, ledger_path: str | None = None,
               job_id: str | None = None) -> JobResult:
    """A whole job: rule-based without ``model_fn``, else the offline attempt loop."""
    job_id = job_id or str(uuid.uuid4())
    if model_fn is None:
        data = generate.generate(spark, spec).withColumn("attempt", F.lit(0)) \
            .withColumnRenamed("row_idx", "pos")
        return _write_result(spark, spec, data, spec.rows, 0, 1, base or spec.target_location or output_dir(spark),
                             ledger_path, job_id, ordered=False)
    job = OfflineJob(spark, spec, samples=samples, job_id=job_id)
    run_offline(spark, spec, model_fn, job)
    return job.finish(base, ledger_path)
