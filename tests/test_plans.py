"""Physical-plan properties the scale design relies on (checked on the planned query,
not on timings): map-side limits before shuffles, partial aggregation, one scan
per profile, column pruning, pushed filters, shuffle-free generation."""

from pyspark.sql import functions as F

from tabforge.operators import assemble, generate, keys, ledger, profile
from tabforge.session import scratch_path
from tabforge.fixtures import customer_profile
from tabforge.spec import DatasetSpec


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_wins_dedup_limits_before_the_shuffle(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = plan_of(assemble.dedup_global(li, "l_orderkey", ["l_linenumber"]))
    assert p.count("WindowGroupLimit") == 2            # partial (map side) + final
    assert p.index("Exchange") < p.rindex("WindowGroupLimit")
    assert "WindowGroupLimit" in plan_of(assemble.trim_to_rows(li, "l_orderkey", ["l_linenumber"], 3))


def test_key_quality_is_partially_aggregated_and_pruned(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = plan_of(keys.key_quality(li, "l_orderkey"))
    assert "partial_count" in p and "hashpartitioning(l_orderkey" in p
    assert "ReadSchema: struct<l_orderkey:bigint>" in p


def test_profile_is_one_scan_without_a_keyed_shuffle(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = plan_of(profile.profile(li, "lineitem", key="l_orderkey"))
    assert p.count("FileScan parquet") == 1
    assert "Join" not in p and "hashpartitioning" not in p      # the flags need no keyed shuffle
    assert "SinglePartition" in p


def test_generation_has_no_shuffle(spark):
    df = generate.generate(spark, DatasetSpec("u", 1000, columns=customer_profile(), primary_key="customer_id"))
    p = plan_of(df)
    assert "Exchange" not in p and "Range" in p


def test_ledger_lookup_pushes_the_key_filter(spark):
    path = scratch_path(spark, "plan-ledger")
    jobs = spark.createDataFrame([("j1", "a", 1, "csv", "[]", "datasets/a", None, None, None)],
                                 "job_id string, dataset_name string, rows long, format string, columns string, "
                                 "file_path string, s3_key string, generated_at string, status string")
    ledger.save_jobs(jobs, path)
    p = plan_of(ledger.get_job(ledger.read_ledger(spark, path), "j1"))
    assert "PushedFilters: [IsNotNull(job_id), EqualTo(job_id,j1)]" in p


def test_sample_joins_are_broadcast(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    p = plan_of(generate.drop_sample_copies(part, part.orderBy("p_partkey").limit(10)))
    assert "BroadcastHashJoin" in p and "LeftAnti" in p


def test_scale_tuning_sizes_partitions_from_input(spark, sf_dir):
    from tabforge.session import input_bytes, tune_for_scale
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        n = input_bytes(spark, [f"{sf_dir}/lineitem.parquet"])
        assert n > 0
        conf = tune_for_scale(spark, 100 * 1024 ** 4)             # 100 TB
        assert conf["spark.sql.shuffle.partitions"] == "100000"
        conf = tune_for_scale(spark, n)
        assert int(conf["spark.sql.shuffle.partitions"]) == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
