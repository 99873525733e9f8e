"""Rows that are distinct by construction, and copies of samples that are drawn again."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabforge.operators import generate, validate
from tabforge.spec import DatasetSpec


def test_every_combination_occurs_once(spark):
    columns = [{"name": "n", "type": "integer", "pattern": "3-9"}, {"name": "b", "type": "boolean"},
               {"name": "d", "type": "date", "pattern": "2024-02-27 to 2024-03-02"},
               {"name": "f", "type": "float", "pattern": "0.001-0.004"}]
    total = 7 * 2 * 5 * 4
    df = generate.generate_unique(spark, DatasetSpec("u", total, columns=columns))
    rows = df.drop("row_idx", "batch_num").collect()
    assert len(rows) == len(set(rows)) == total
    assert {r.n for r in rows} == set(range(3, 10)) and {r.f for r in rows} == {0.001, 0.002, 0.003, 0.004}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    # another seed is another order; the same seed the same rows
    again = generate.generate_unique(spark, DatasetSpec("u", total, columns=columns)).drop("row_idx", "batch_num")
    other = generate.generate_unique(spark, DatasetSpec("u", total, columns=columns, seed=7)).drop("row_idx", "batch_num")
    assert again.collect() == rows and other.collect() != rows
    with pytest.raises(ValueError, match="combinations"):
        generate.generate_unique(spark, DatasetSpec("u", total + 1, columns=columns))


def test_a_single_column_and_columns_without_numbers(spark):
    one = generate.generate_unique(spark, DatasetSpec("u", 50, columns=[{"name": "n", "type": "integer", "pattern": "1-50"}]))
    values = [r.n for r in one.orderBy("row_idx").collect()]
    assert sorted(values) == list(range(1, 51)) and values != sorted(values)
    with pytest.raises(ValueError, match="combinations"):
        generate.generate_unique(spark, DatasetSpec("u", 2, columns=[{"name": "t", "type": "string"}]))


@settings(max_examples=8, derandomize=True, deadline=None)
@given(st.integers(1, 13), st.integers(1, 13), st.integers(0, 500))
def test_the_permutation_is_one(left, right, seed):
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    x, y = generate.permuted(F.col("id"), left, right, seed)
    got = {tuple(r) for r in spark.range(left * right).select(x, y).collect()}
    assert got == {(i, j) for i in range(left) for j in range(right)}


def test_copies_are_drawn_again_and_none_is_lost(spark):
    columns = [{"name": "b", "type": "boolean"}, {"name": "n", "type": "integer", "pattern": "1-4", "nullable": True}]
    spec = DatasetSpec("n", 400, columns=columns, null_rate=30)
    samples = spark.createDataFrame([(True, 1), (True, None), (False, 3)], "b boolean, n long")
    df = generate.generate_novel(spark, spec, samples)
    rows = df.collect()
    assert sorted(r.row_idx for r in rows) == list(range(1, 401))
    seen = Counter((r.b, r.n) for r in rows)
    assert not seen.keys() & {(True, 1), (True, None), (False, 3)} and len(seen) == 7
    first = {r.row_idx: (r.b, r.n) for r in generate.generate(spark, spec).collect()}
    for r in rows:                                        # rows that hit no sample keep their first draw
        if first[r.row_idx] in seen:
            assert first[r.row_idx] == (r.b, r.n)


def test_samples_that_hold_every_combination_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(generate, "MAX_REDRAWS", 3)
    spec = DatasetSpec("n", 20, columns=[{"name": "b", "type": "boolean"}])
    with pytest.raises(ValueError, match="sample"):
        generate.generate_novel(spark, spec, spark.createDataFrame([(True,), (False,)], "b boolean"))


def test_narrow_floats_stay_in_their_range(spark):
    columns = [{"name": "f", "type": "float", "pattern": "0.001-0.009"}]
    spec = DatasetSpec("f", 300, columns=columns)
    df = generate.generate(spark, spec)
    assert {round(r.f * 1000) for r in df.collect()} == set(range(1, 10))
    checks = validate.column_checks(df.drop("row_idx", "batch_num"), spec.columns, expected_rows=300)
    assert checks.agg(F.sum("violations")).first()[0] == 0


def test_nulls_are_drawn_at_the_sources_share(spark):
    source = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v"))
    skeleton = generate.row_skeleton(spark, 2000, 30).drop("batch_num")
    nulls = generate.mimic_numeric(skeleton, source, "v").where("v is null").count()
    assert abs(nulls - 1000) < 5 * math.sqrt(500)


def test_times_without_zone_keep_their_clock(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        source = spark.sql("select timestamp_ntz'2024-03-31 02:30:00' ts")          # no such time in Berlin
        skeleton = generate.row_skeleton(spark, 3, 30).drop("batch_num")
        got = {r.ts for r in generate.mimic_numeric(skeleton, source, "ts").selectExpr("cast(ts as string) ts").collect()}
        assert got == {"2024-03-31 02:30:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
