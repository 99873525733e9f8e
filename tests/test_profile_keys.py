"""Profiling and key rules (A5-A12, B1-B4) on fixture-shaped inputs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators import keys, profile
from tabforge.fixtures import customer_profile
from tabforge.spec import ColumnContract


@pytest.mark.parametrize("name,dtype,expected", [
    ("email_date", T.StringType(), "email"), ("mobile_no", T.LongType(), "phone"),
    ("updated_at", T.TimestampType(), "date"), ("sentiment", T.DoubleType(), "date"),
    ("id", T.LongType(), "uuid"), ("uuid", T.StringType(), "uuid"), ("order_id", T.LongType(), "uuid"),
    ("userid", T.LongType(), "integer"), ("link_id", T.StringType(), "uuid"),
    ("homepage_url", T.StringType(), "url"), ("ts", T.TimestampNTZType(), "datetime"),
    ("embedding", T.ArrayType(T.FloatType()), "string"), ("price", T.DoubleType(), "float"),
    ("flag", T.BooleanType(), "boolean"),
])
def test_name_rules(spark, name, dtype, expected):
    df = spark.createDataFrame([], T.StructType([T.StructField(name, dtype)]))
    assert profile.contract_from_schema(df.schema)[0].type == expected
    row = profile.profile(df, "t").first()
    assert row["semantic_type"] == expected and row["total_rows"] == 0


def test_profile_nullable_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), None)], "k long, v double, s string")
    got = {r["column_name"]: r["nullable"] for r in profile.profile(df, "t").collect()}
    assert got == {"k": False, "v": True, "s": True}


def test_key_detection_priorities():
    assert keys.detect_primary_key(customer_profile()) == "customer_id"
    sample = [ColumnContract("id", "uuid"), ColumnContract("full_name", "name")]
    assert keys.detect_primary_key(sample) == "id"
    police = [ColumnContract("stop_date", "date"), ColumnContract("driver_age", "integer")]
    assert keys.detect_primary_key(police) is None
    assert keys.detect_primary_key([ColumnContract("a", "string"), ColumnContract("x_id", "integer"),
                                    ColumnContract("id", "integer")]) == "id"


def test_key_quality_case(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,), (None,), ("3",), ("",)], "k string")
    r = keys.key_quality(df.limit(5), "k").first()
    assert (r["duplicates_found"], r["nulls_found"], r["is_valid"]) == (2, 2, False)
    r = keys.key_quality(df, "k").first()
    assert (r["duplicates_found"], r["nulls_found"]) == (2, 3)
    assert keys.key_quality(df, "missing") is None


def test_candidate_keys(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("m"))
    got = {r["column_name"]: r["is_unique"] for r in keys.verify_candidate_keys(df, ["id", "m"]).collect()}
    assert got == {"id": True, "m": False}


def test_samples_text_and_nulls(spark):
    df = spark.createDataFrame([(2, None), (1, 1.5)], "k long, v double")
    rows = profile.sample_rows(df, 5, ["k"]).collect()
    assert [tuple(r) for r in rows] == [("1", "1.5"), ("2", "")]


def test_json_first_object_contract(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text('[{"b": true, "i": 3, "f": 1.5, "s": "x", "n": null}, {"b": false, "i": 4}]')
    from tabforge.sources.readers import read_json_text
    contract, samples, total = profile.infer_contract_from_json(read_json_text(spark, str(p)))
    assert [(c.name, c.type, c.nullable) for c in contract] == [
        ("b", "boolean", False), ("i", "integer", False), ("f", "float", False), ("s", "string", False),
        ("n", "string", False)]
    assert total == 2 and samples.count() == 2
    c = tmp_path / "contract.json"
    c.write_text('[{"name": "a", "type": "uuid"}]')
    assert profile.infer_contract_from_json(read_json_text(spark, str(c)))[0] is None


def test_apply_contract_flags_bad_casts(spark):
    df = spark.createDataFrame([("1", "2020-01-02", "yes"), ("x", "bad", "no")], "a string, d string, b string")
    out = profile.apply_contract(df, [ColumnContract("a", "integer"), ColumnContract("d", "date"),
                                      ColumnContract("b", "boolean")]).collect()
    assert out[0]["a"] == 1 and str(out[0]["d"]) == "2020-01-02" and out[0]["b"] is True
    assert out[1]["a"] is None and sorted(out[1]["_cast_errors"]) == ["a", "d"]


def test_extract_profile_all_formats(spark, tmp_path, sf_dir):
    import json
    from tabforge.session import scratch_path
    p = profile.extract_profile(spark, f"{sf_dir}/customer.parquet")
    assert p["file_type"] == "parquet" and p["columns_count"] == 5 and p["total_rows"] == 150
    assert len(p["sample_rows"]) == 5 and p["columns"][0] == {"name": "c_custkey", "type": "integer",
                                                              "nullable": False}
    csv_path = scratch_path(spark, "prof") + ".csv"
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.option("header", True).option("sep", "|").csv(csv_path)
    c = profile.extract_profile(spark, csv_path)
    assert c["file_type"] == "csv" and c["total_rows"] == 150 and c["columns"][3]["type"] == "float"
    contract = tmp_path / "users_schema.json"
    contract.write_text(json.dumps([{"name": "user_id", "type": "uuid", "nullable": False}]))
    j = profile.extract_profile(spark, str(contract))
    assert j["total_rows"] == 0 and j["sample_rows"] == [] and j["columns"][0]["name"] == "user_id"
    data = tmp_path / "rows.json"
    data.write_text(json.dumps([{"a": i, "b": "x"} for i in range(12)]))
    d = profile.extract_profile(spark, str(data))
    assert d["total_rows"] == 12 and len(d["sample_rows"]) == 10 and d["columns"][0]["type"] == "integer"


def test_preview_prompt(spark):
    from tabforge.plans import batches, prompts
    from tabforge.spec import DatasetSpec
    spec = DatasetSpec("t", 70, columns=[{"name": "id"}])
    text = prompts.preview_prompt(batches.plan_single(spark, 70, 1), spec)
    assert "generating rows 1 through 30" in text


def test_json_contract_full_scan(spark, tmp_path):
    p = tmp_path / "rows.json"
    p.write_text('[{"a": 1, "b": "x"}, {"a": 2.5, "c": true}, {"a": 3, "b": null}]')
    from tabforge.sources.readers import read_json_text
    first, _, _ = profile.infer_contract_from_json(read_json_text(spark, str(p)))
    assert [(c.name, c.type, c.nullable) for c in first] == [("a", "integer", False), ("b", "string", False)]
    full, _, total = profile.infer_contract_from_json(read_json_text(spark, str(p)), full_scan=True)
    assert total == 3
    assert [(c.name, c.type, c.nullable) for c in full] == [("a", "float", False), ("b", "string", True),
                                                            ("c", "boolean", True)]


def test_candidate_check_is_exact(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") == 4999, F.lit(0)).otherwise(F.col("id")).alias("late"))
    got = {r["column_name"]: r["is_unique"] for r in keys.verify_candidate_keys(df, ["id", "late"]).collect()}
    assert got == {"id": True, "late": False}


def test_float_keys_fold_nan_into_null_like_pandas(spark):
    import pandas as pd
    from tabforge.operators import assemble
    vals = [1.0, float("nan"), None, 1.0, 2.0, float("nan")]
    s = pd.Series(vals, dtype="float64")
    df = spark.createDataFrame([(v,) for v in vals], "k double")
    r = keys.key_quality(df, "k").first()
    assert r["duplicates_found"] == int(s.duplicated().sum()) == 3
    assert r["nulls_found"] == int(s.isna().sum()) == 3
    assert assemble.drop_missing_keys(df, "k").count() == 3


def test_samples_follow_file_order(spark):
    from tabforge.session import scratch_path
    path = scratch_path(spark, "order")
    spark.range(1000).selectExpr("999 - id AS k").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert [r["k"] for r in profile.sample_rows(df, 3).collect()] == ["999", "998", "997"]
    plan = profile.sample_rows(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
