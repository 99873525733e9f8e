"""Spark session and shared-folder helpers.

Everything that writes intermediate data (retry rounds, sink round trips,
the job ledger in tests) goes to the shared folder the cluster names in
``spark.checkpoint.dir``.  A private folder is only created when that
setting is absent and everything runs on this machine; a cluster without the
setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
OUTPUT_CONF = "tabforge.output.dir"


def get_spark(master: str | None = None, app: str = "tabforge",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; set a private one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a client session without a local context
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured and sc is not None:
        configured = sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tabforge-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def parallelism(spark: SparkSession) -> int:
    """The cluster's default parallelism (from the context, else the setting)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - a client session without a local context
        return int(spark.conf.get("spark.default.parallelism", None) or 8)


def output_dir(spark: SparkSession) -> str:
    """Base folder for datasets and the ledger (shared storage)."""
    configured = spark.conf.get(OUTPUT_CONF, None)
    if configured:
        return configured
    return os.path.join(shared_dir(spark), "tabforge-output")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared output folder."""
    return os.path.join(output_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabforge`` importable on executors (``addPyFile`` of a zip), once per
    context.  Needed where Python runs on executors (the completion seam): a
    user function defined in a module is pickled by reference.  The zip is
    built in memory and written to the shared folder through the Hadoop
    FileSystem API, so no machine-local folder is involved."""
    import io
    import zipfile
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = f"{shared_dir(spark).rstrip('/')}/tabforge-{uuid.uuid4().hex[:8]}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(id(sc))


SHUFFLE_TARGET_BYTES = 128 * 1024 * 1024      # aim per shuffle partition (AQE advisory size)
SCAN_SPLIT_BYTES = 256 * 1024 * 1024          # parquet split per scan task
MAX_SHUFFLE_PARTITIONS = 100_000


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the input paths, from the file system's content summary."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return int(total)


def tune_for_scale(spark: SparkSession, total_input_bytes: int) -> dict[str, str]:
    """Partition sizing from the input size: shuffle partitions so each holds about
    128 MB (AQE coalesces small ones and splits skewed ones at run time), scans
    split at 256 MB.  At 100 TB this gives the 100k-partition ceiling; on a
    laptop it never drops below twice the cores."""
    cores = parallelism(spark)
    parts = max(2 * cores, min(MAX_SHUFFLE_PARTITIONS, -(-total_input_bytes // SHUFFLE_TARGET_BYTES)))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_TARGET_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * SHUFFLE_TARGET_BYTES),
        "spark.sql.files.maxPartitionBytes": str(SCAN_SPLIT_BYTES),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
