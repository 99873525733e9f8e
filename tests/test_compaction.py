"""The compacted ledger: equal to the plain one after any saves, compactions and crashes."""

import pytest
from pyspark.sql import functions as F

from tabforge.operators import ledger
from tabforge.operators.compaction import CompactedLedger
from tabforge.session import scratch_path

SCHEMA = "job_id string, rows long, columns string, file_path string, written_at timestamp"


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id string, rows long, day int").select(
        "job_id", F.lit("d").alias("dataset_name"), "rows", F.lit("csv").alias("format"), F.lit('["x"]').alias("columns"),
        F.concat(F.lit("datasets/"), F.col("rows").cast("string")).alias("file_path"),
        F.timestamp_seconds(F.col("day") * 86400).alias("written_at"))


def state(lg):
    return sorted((str(r.job_id), r.rows) for r in lg.current().collect())


SAVES = [[("a", 1, 10), ("b", 2, 10), (None, 3, 10)], [("a", 4, 12), ("b", 5, 9), ("a", 4, 12)],
         [("c", 6, 1), (None, 7, 11)], [("a", 8, 11), ("c", 9, 1)]]


@pytest.mark.parametrize("compact_after", [set(), {0}, {1, 2}, {0, 1, 2, 3}])
def test_equal_to_the_plain_ledger(spark, compact_after):
    lg, plain = CompactedLedger(spark, scratch_path(spark, "cl"), buckets=4), scratch_path(spark, "plain")
    assert state(lg) == [] and lg.compact() == 0 and lg.get("a").count() == 0
    for k, rows in enumerate(SAVES):
        lg.save(jobs(spark, rows))
        ledger.save_jobs(jobs(spark, rows), plain)
        if k in compact_after:
            assert lg.compact() > 0
        want = ledger.read_ledger(spark, plain)
        assert state(lg) == sorted((str(r.job_id), r.rows) for r in ledger.current_jobs(want).collect())
        assert lg.get("a").collect() == ledger.get_job(want, "a").collect()


def test_a_crash_between_write_and_manifest_loses_nothing(spark, monkeypatch):
    lg = CompactedLedger(spark, scratch_path(spark, "cl"), buckets=4)
    lg.save(jobs(spark, SAVES[0]))
    lg.compact()
    lg.save(jobs(spark, SAVES[1]))
    before = state(lg)
    with monkeypatch.context() as m:
        m.setattr(CompactedLedger, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            lg.compact()
    assert state(lg) == before
    path, fs = lg._path("manifest/000000000002.json")       # a torn manifest
    out = fs.create(path, False)
    out.write(bytearray(b'{"count": 4, "buck'))
    out.close()
    assert state(lg) == before and lg.compact() > 0 and state(lg) == before


def test_of_two_compactions_one_wins(spark, monkeypatch):
    lg = CompactedLedger(spark, scratch_path(spark, "cl"), buckets=4)
    lg.save(jobs(spark, SAVES[0]))
    before = state(lg)
    publish = CompactedLedger._publish

    def late(self, number, manifest):
        publish(self, number, manifest)                      # the other one was first
        publish(self, number, manifest)

    monkeypatch.setattr(CompactedLedger, "_publish", late)
    with pytest.raises(Exception, match="exists"):
        lg.compact()
    assert state(lg) == before


def test_a_lookup_reads_one_bucket_without_exchange_or_window(spark):
    lg = CompactedLedger(spark, scratch_path(spark, "cl"), buckets=8)
    lg.save(jobs(spark, [(f"j{i}", i, 1) for i in range(100)]))
    assert lg.compact() == 8
    lg.save(jobs(spark, [("j5", 500, 2)]))
    assert lg.compact() == 1 and lg.get("j5").first().rows == 500 and lg.current().count() == 100
    found = lg.get("j7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "PartitionFilters" in plan
    assert len({f.split("/part-")[0] for f in found.inputFiles()}) <= 8 and found.first().rows == 7
    scans = found._jdf.queryExecution().executedPlan()
    found.collect()
    assert "bucket" in scans.toString().split("PartitionFilters: [")[1].split("]")[0]
    assert any(x.startswith("log/") for x in lg.superseded()) and any(x.startswith("base/") for x in lg.superseded())
