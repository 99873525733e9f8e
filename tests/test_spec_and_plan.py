"""Table-driven checks of the driver-side rules and the batch plan."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.plans import batches
from tabforge.spec import (ColumnContract, DatasetSpec, DateRange, NumericRange, RegexPattern, batch_size_for,
                           looks_like_contract, parse_pattern, resolve_contract, worker_cap)


@pytest.mark.parametrize("cols,size", [(0, 30), (10, 30), (11, 20), (20, 20), (21, 15), (35, 15),
                                       (36, 10), (50, 10), (51, 7), (75, 7), (76, 5), (100, 5)])
def test_batch_size_tiers(spark, cols, size):
    assert batch_size_for(cols) == size
    got = spark.range(1).select(batches.batch_size(F.lit(cols)).alias("s")).first()["s"]
    assert got == size


@pytest.mark.parametrize("rows", [1, 29, 30, 31, 1000, 1001, 10000, 10001])
def test_plan_matches_arithmetic(spark, rows):
    specs = spark.createDataFrame([("d", rows, 8)], "dataset_name string, rows long, num_columns int")
    plan = batches.plan_batches(specs).orderBy("batch_num").collect()
    n = math.ceil(rows / 30)
    assert len(plan) == n
    for b, r in enumerate(plan, start=1):
        target = min(30, rows - (b - 1) * 30)
        assert (r["target_rows"], r["start_idx"], r["end_idx"]) == (target, (b - 1) * 30 + 1, (b - 1) * 30 + target)
    assert sum(r["target_rows"] for r in plan) == rows
    single = batches.plan_single(spark, rows, 8, "d").orderBy("batch_num").collect()
    assert [tuple(r) for r in single] == [tuple(r) for r in plan]


@pytest.mark.parametrize("rows,batches_,cap", [(10, 1, 1), (1000, 34, 5), (1001, 34, 10), (10000, 334, 10),
                                               (10001, 334, 20), (10001, 3, 3)])
def test_worker_cap(rows, batches_, cap):
    assert worker_cap(rows, batches_) == cap


def test_seed_keys_are_upper_prefix_and_global_index(spark):
    specs = spark.createDataFrame([("d", 61, 3)], "dataset_name string, rows long, num_columns int")
    keys = batches.seed_keys(batches.plan_batches(specs), "dmc code").orderBy("row_idx").collect()
    assert [k["seed_key"] for k in keys[:2]] == ["DMCCODE-1", "DMCCODE-2"]
    assert keys[-1]["seed_key"] == "DMCCODE-61" and keys[-1]["batch_num"] == 3


def test_patterns():
    assert parse_pattern("18-65", "integer") == NumericRange(18, 65, 0)
    assert parse_pattern("-5.5-10", "float") == NumericRange(-5.5, 10, 1)
    d = parse_pattern("2020-01-01 to 2025-12-31", "date")
    assert isinstance(d, DateRange) and d.lo.year == 2020 and d.hi.year == 2025
    r = parse_pattern("[A-Z]{3}-[0-9]{4}", "string")
    assert isinstance(r, RegexPattern) and len(r.tokens) == 3 and r.tokens[0].max_rep == 3
    with pytest.raises(ValueError):
        parse_pattern("(a|b)", "string")


def test_open_repeats():
    (token,) = parse_pattern("[a-c]{2,}").tokens
    assert (token.min_rep, token.max_rep) == (2, 10)
    from tabforge.spec import parse_regex
    assert parse_regex("a+", open_repeat=30).tokens[0].max_rep == 30


def test_plan_of_a_trillion_rows(spark):
    specs = spark.createDataFrame([("big", 10**12, 8), ("none", 0, 8)], "dataset_name string, rows long, num_columns int")
    plan = batches.plan_batches(specs)
    assert "Exchange" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.limit(3).count() == 3
    small = batches.plan_batches(spark.createDataFrame([("s", 300_000_0, 8)], specs.schema))
    got = small.selectExpr("count(*)", "min(start_idx)", "max(end_idx)", "sum(target_rows)", "max(batch_num)").first()
    assert tuple(got) == (100_000, 1, 3_000_000, 3_000_000, 100_000)


def test_request_checks_and_key_confirmation():
    with pytest.raises(ValueError):
        DatasetSpec("", 10)
    with pytest.raises(ValueError):
        DatasetSpec("x", 0)
    assert DatasetSpec("x", 10**12).rows == 10**12           # no request is too large
    with pytest.raises(ValueError):
        DatasetSpec("x", 5, format="xlsx")
    s = DatasetSpec("x", 5, columns=[{"name": "id"}], primary_key="nope")
    assert s.primary_key is None
    assert DatasetSpec("x", 5, columns=[{"name": "id"}], primary_key="id").primary_key == "id"


def test_schema_precedence_and_contract_file(tmp_path):
    explicit = [{"name": "a", "type": "integer"}]
    assert resolve_contract(explicit, None, [{"b": 1}])[0].name == "a"
    from_rows = resolve_contract(None, None, [{"b": 1, "c": "x", "d": 1.5, "e": True}])
    assert [c.type for c in from_rows] == ["integer", "string", "float", "boolean"]
    f = tmp_path / "c.json"
    f.write_text('[{"name": "z", "type": "uuid"}]')
    assert resolve_contract(None, str(f), None) == [ColumnContract("z", "uuid")]
    assert looks_like_contract({"name": "a", "type": "b"})
    assert not looks_like_contract({"name": "a", "type": "b", "c": 1, "d": 1, "e": 1, "f": 1, "g": 1})


def test_default_text(spark):
    cat = spark.createDataFrame([("police_stops", i, f"c{i}", "string") for i in range(8)],
                                "table_name string, ordinal int, column_name string, physical_type string")
    row = batches.default_texts(cat).first()
    assert row["description"] == ("Realistic synthetic Police Stops dataset containing fields: "
                                  "c0, c1, c2, c3, c4, c5 and 2 more.")


@pytest.mark.parametrize("rows,calls,workers", [(5000, 167, 10), (10_000_000, 333_334, 20)])
def test_plan_sizes_match_the_baseline_arithmetic(spark, rows, calls, workers):
    plan = batches.plan_single(spark, rows, 8)
    agg = plan.agg(F.count(F.lit(1)).alias("n"), F.sum("target_rows").alias("rows"), F.max("end_idx").alias("end")).first()
    assert (agg["n"], agg["rows"], agg["end"]) == (calls, rows, rows)
    assert worker_cap(rows, calls) == workers


@pytest.mark.parametrize("name", ["police_stops", "2nd-run", "o'neil data", "ÉCOLE_été", "  users_v2  ", "ABC"])
def test_readable_name_matches_python_title(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(batches.readable_name(F.col("n")).alias("r")).first()["r"]
    assert got == name.replace("_", " ").replace("-", " ").strip().title()
