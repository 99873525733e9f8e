"""Compacted job ledger (I1): appended records merged into buckets per job id.

A save writes its records as a folder of its own under ``log``.  ``compact`` merges all
complete log folders into the buckets (hash of the job id) that they touch, writes these
under a new generation and publishes a manifest that names the folder of each bucket and
the log folders merged so far.  Buckets that no record touches stay where they are.

Readers go by the newest readable manifest, so a crash at any point loses nothing: a log
folder counts once Spark has marked it complete, files of a generation without a manifest
are never read, and the log folders they came from are still pending.  The manifest's name
can be created once only, so of two compactions at a time one fails and has no effect.
Nothing is deleted; superseded folders are listed by ``superseded``.

Buckets hold one row a job, so a lookup reads one bucket without a shuffle or a window when
nothing is pending; pending records are compared with the buckets' rows of their jobs alone.

Defined results: a ledger without records is empty; equal records count once; a null job
id is a job like any other; the order of records is that of ``ledger.current_jobs``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import LEDGER_SCHEMA, current_jobs, decode_columns, job_records

BUCKETS = 64


class CompactedLedger:
    """``buckets`` is fixed by the first compaction: about one for each 128 MB of current
    records expected."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- files ------------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _publish(self, number: int, manifest: dict) -> None:
        path, fs = self._path(f"manifest/{number:012d}.json")
        out = fs.create(path, False)                       # fails where the name is taken
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    def _manifest(self) -> dict:
        for name in reversed(self._names("manifest")):
            row = self.spark.read.text(f"{self.root}/manifest/{name}", wholetext=True).first()
            try:
                return json.loads(row[0] if row else "")
            except ValueError:                             # torn by a crash: never published
                continue
        return {"count": self.buckets, "buckets": {}, "merged": []}

    # --- writes -----------------------------------------------------------------------
    def save(self, jobs: DataFrame) -> None:
        job_records(jobs).write.parquet(f"{self.root}/log/{uuid.uuid4().hex}")

    def compact(self) -> int:
        """Merge the pending records; the number of buckets written."""
        manifest = self._manifest()
        pending = self._pending(manifest)
        if not pending:
            return 0
        number = max([int(n.split(".")[0]) for n in self._names("manifest")], default=0) + 1
        bucket = self._bucket(F.col("job_id"), manifest)
        added = self._log(pending).withColumn("bucket", bucket)
        touched = added.select("bucket").distinct()
        kept = self._base(manifest).join(F.broadcast(touched), "bucket", "left_semi").select(LEDGER_SCHEMA.names)
        # one row a job before the shuffle by bucket
        merged = current_jobs(kept.unionByName(added.drop("bucket"))).withColumn("bucket", bucket)
        # a name of its own: a crashed or losing compaction leaves its folder unread
        generation = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        merged.repartition(min(manifest["count"], 10_000), "bucket").write.partitionBy("bucket").parquet(
            f"{self.root}/base/gen={generation}")
        written = [n for n in self._names(f"base/gen={generation}") if n.startswith("bucket=")]
        at = {**manifest["buckets"], **{n.split("=")[1]: generation for n in written}}
        # names of folders that were removed since need not be kept
        merged_logs = set(manifest["merged"]).intersection(self._names("log")).union(pending)
        self._publish(number, {"count": manifest["count"], "buckets": at, "merged": sorted(merged_logs)})
        return len(written)

    def superseded(self) -> list[str]:
        """Folders that the newest manifest no longer needs (older readers may)."""
        manifest = self._manifest()
        live = set(manifest["buckets"].items())
        old = [f"log/{n}" for n in manifest["merged"] if self._exists(f"log/{n}")]
        for gen in self._names("base"):
            old += [f"base/{gen}/{n}" for n in self._names(f"base/{gen}")
                    if n.startswith("bucket=") and (n.split("=")[1], gen.split("=")[1]) not in live]
        return old

    # --- reads ------------------------------------------------------------------------
    def _bucket(self, job_id: Column, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(job_id), F.lit(manifest["count"])).cast("int")

    def _pending(self, manifest: dict) -> list[str]:
        merged = set(manifest["merged"])
        return [n for n in self._names("log") if n not in merged and self._exists(f"log/{n}/_SUCCESS")]

    def _log(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*[f"{self.root}/log/{n}" for n in names])

    def _base(self, manifest: dict) -> DataFrame:
        paths = [f"{self.root}/base/gen={gen}/bucket={b}" for b, gen in manifest["buckets"].items()]
        if not paths:
            return self.spark.createDataFrame([], LEDGER_SCHEMA).withColumn("bucket", F.lit(0))
        schema = LEDGER_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
        return (self.spark.read.schema(f"{schema}, gen string, bucket int").option("basePath", f"{self.root}/base")
                .parquet(*paths).drop("gen"))

    def current(self) -> DataFrame:
        """The current record of every job."""
        manifest = self._manifest()
        base, pending = self._base(manifest).drop("bucket"), self._pending(manifest)
        if not pending:
            return base
        added = current_jobs(self._log(pending))
        ids = added.select(F.col("job_id").alias("changed"))
        same = F.col("job_id").eqNullSafe(F.col("changed"))
        return (base.join(ids, same, "left_anti")
                .unionByName(current_jobs(base.join(ids, same, "left_semi").unionByName(added))))

    def get(self, job_id: str) -> DataFrame:
        """One record or nothing."""
        manifest = self._manifest()
        found = (self._base(manifest).where(F.col("bucket") == self._bucket(F.lit(job_id), manifest))
                 .where(F.col("job_id") == job_id).drop("bucket"))
        pending = self._pending(manifest)
        if pending:
            found = current_jobs(found.unionByName(self._log(pending).where(F.col("job_id") == job_id)))
        return found.withColumn("columns", decode_columns(F.col("columns")))
