"""Generator properties (partition invariance, contracts obeyed) and validation checks."""

import re

from pyspark.sql import functions as F

from tabforge.operators import generate, validate
from tabforge.fixtures import customer_profile
from tabforge.spec import ColumnContract, DatasetSpec


def _users(spark, rows=500, parts=None, pk="customer_id"):
    spec = DatasetSpec("users", rows, columns=customer_profile(), primary_key=pk)
    return generate.generate(spark, spec, partitions=parts)


def test_same_rows_for_any_partitioning(spark):
    a = sorted(map(tuple, _users(spark, 300, 1).collect()))
    b = sorted(map(tuple, _users(spark, 300, 3).collect()))
    c = sorted(map(tuple, _users(spark, 300, 8).collect()))
    assert a == b == c


def test_exact_count_unique_keys_and_continuity(spark):
    df = _users(spark, 1001)
    assert df.count() == 1001
    assert df.select("customer_id").distinct().count() == 1001
    gaps = validate.key_gaps(df, validate.key_suffix(F.col("customer_id")))
    assert gaps.count() == 0
    assert df.where(F.col("customer_id") == "CUSTOMER_ID-1").count() == 1


def test_generated_rows_pass_the_contract(spark):
    contract = customer_profile()
    df = _users(spark, 2000, pk=None).drop("row_idx", "batch_num")
    rep = {(r["check_name"], r["column_name"]): r["violations"]
           for r in validate.column_checks(df, contract, expected_rows=2000).collect()}
    assert all(v == 0 for v in rep.values()), rep
    assert validate.column_set_check(df, contract) == ("column_set", 0)
    nulls = df.agg(F.count_if(F.col("c_mktsegment").isNull()).alias("c")).first()["c"]
    assert 40 < nulls < 180          # about 5 % of 2000
    assert df.agg(F.min("c_nationkey"), F.max("c_nationkey")).first() == (0, 24)


def test_regex_and_distributions(spark):
    cols = [ColumnContract("code", "string", pattern="[A-Z]{3}-[0-9]{4}"),
            ColumnContract("opt", "string", pattern="x[ab]?y{1,3}"),
            ColumnContract("u", "float", pattern="0-100", distribution="uniform"),
            ColumnContract("n", "float", pattern="0-100", distribution="normal"),
            ColumnContract("s", "float", pattern="0-100", distribution="skewed")]
    df = generate.generate(spark, DatasetSpec("p", 4000, columns=cols))
    rows = df.collect()
    assert all(re.fullmatch(r"[A-Z]{3}-[0-9]{4}", r["code"]) for r in rows)
    assert all(re.fullmatch(r"x[ab]?y{1,3}", r["opt"]) for r in rows)
    stats = df.agg(F.avg("u"), F.stddev("u"), F.avg("n"), F.stddev("n"), F.avg("s"), F.min("n"), F.max("s")).first()
    assert 45 < stats[0] < 55 and stats[1] > 25
    assert 45 < stats[2] < 55 and stats[3] < 12          # bell shape: much narrower than uniform
    assert stats[4] < 40                                 # mass near the low end
    assert stats[5] >= 0 and stats[6] <= 100


def test_mimic_categorical_follows_frequencies(spark):
    src = spark.createDataFrame([("a",)] * 70 + [("b",)] * 20 + [("c",)] * 10, "v string")
    skel = generate.row_skeleton(spark, 20000, 30).drop("batch_num")
    out = generate.mimic_categorical(skel, src, "v")
    assert out.count() == 20000
    freq = {r["v"]: r["count"] / 20000 for r in out.groupBy("v").count().collect()}
    assert abs(freq["a"] - 0.7) < 0.03 and abs(freq["c"] - 0.1) < 0.03


def test_running_total_matches_a_plain_sum(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("k"), (F.col("id") % 7).alias("amt"))
    got = {r["k"]: r["hi"] for r in generate.running_total(df, "k", "amt").collect()}
    total, want = 0, {}
    for k in range(1, 2001):
        total += k % 7
        want[k] = total
    assert got == want


def test_wide_ranges_reach_their_ends(spark):
    cols = [{"name": "big", "type": "integer", "pattern": "1-1000000000000"},
            {"name": "bell", "type": "integer", "pattern": "1-1000000000000", "distribution": "normal"},
            {"name": "low", "type": "integer", "pattern": "0-1000000000000", "distribution": "skewed"},
            {"name": "day", "type": "datetime", "pattern": "2000-01-01 to 2025-12-31", "distribution": "normal"},
            {"name": "price", "type": "float", "pattern": "0-5000000", "distribution": "normal"}]
    df = generate.generate(spark, DatasetSpec("w", 3000, columns=cols))
    r = df.selectExpr("max(big) a", "min(big) b", "avg(bell) c", "max(low) d", "min(day) e", "max(day) f",
                      "avg(price) g", "count(distinct bell) h").first()
    assert r.a > 9.9e11 and 1 <= r.b < 1e10 and 4.8e11 < r.c < 5.2e11 and r.d > 9e11
    assert r.e.year >= 2000 and r.f.year <= 2025 and 2.4e6 < r.g < 2.6e6 and r.h == 3000


def test_mimicry_keeps_nulls_and_dates(spark):
    src = spark.range(1, 1001).selectExpr(
        "if(id % 2 = 0, null, concat('v', id % 3)) v", "date_add(date '2020-01-01', cast(id as int)) d",
        "timestamp_ntz '2021-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) t")
    skel = generate.key_skeleton(spark.range(1, 4001), "id").drop("batch_num")
    share = generate.mimic_categorical(skel, src, "v").selectExpr("avg(int(v is null)) x").first().x
    assert abs(share - 0.5) < 0.03
    for c in ("d", "t"):
        out = generate.mimic_numeric(skel, src, c)
        assert out.schema[c].dataType == src.schema[c].dataType
        lo, hi = src.selectExpr(f"min({c})", f"max({c})").first()
        assert out.where((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).count() == 0
        assert out.select(c).distinct().count() > 500


def test_mimic_rows_and_copies(spark):
    samples = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "k long, s string, x double")
    skel = generate.row_skeleton(spark, 100, 30).drop("batch_num")
    out = generate.mimic_rows(skel, samples, "k", jitter={"x": 0.1})
    assert out.count() == 100 and out.where("x < 9 or x > 22").count() == 0
    gen = spark.createDataFrame([(1, "a", 10.0), (3, "c", 1.0)], "k long, s string, x double")
    assert generate.drop_sample_copies(gen, samples).collect()[0]["k"] == 3
    assert generate.sample_copies(gen, samples).count() == 1


def test_low_variety_placeholder_drift(spark):
    df = spark.createDataFrame([("x", "lorem ipsum dolor"), ("x", "a test."), ("y", "testing n/a")], "c string, t string")
    lv = validate.low_variety(df, ["c"]).first()
    assert (lv["top_value"], lv["top_count"], lv["total"]) == ("x", 2, 3)
    hits = {r["word"]: r["rows"] for r in validate.placeholder_hits(df, "t").collect()}
    assert hits["lorem"] == 1 and hits["ipsum"] == 1 and hits["test"] == 1 and hits["n/a"] == 1
    d = validate.drift(df.where("c = 'x'"), df.where("c = 'y'"), "c")
    assert validate.total_variation(d).first()["tvd"] == 1.0


def test_key_gaps_across_partitions(spark):
    df = spark.createDataFrame([(k,) for k in [1, 2, 3, 7, 8, 20, 21, 22, 40]], "k long")
    got = sorted(tuple(r) for r in validate.key_gaps(df, F.col("k")).collect())
    assert got == [(3, 7, 4), (8, 20, 12), (22, 40, 18)]


def test_mimic_categorical_many_values_matches_brute_force(spark):
    """Many tiny intervals and one hot value: the bucketed lookup equals a brute-force
    rank table (every rank exploded)."""
    src = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot"))
                                   .otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("v"))
    skel = generate.row_skeleton(spark, 5000, 30).drop("batch_num")
    got = {r["row_idx"]: r["v"] for r in generate.mimic_categorical(skel, src, "v").collect()}
    iv = generate.category_intervals(src, "v")
    ranks = iv.select("value", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("rank"))
    from tabforge.functions.random import offset
    want_df = skel.withColumn("rank", offset(3000, "uniform", 42, "v", F.col("row_idx"))).join(ranks, "rank")
    want = {r["row_idx"]: r["value"] for r in want_df.collect()}
    assert len(got) == 5000 and got == want


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(50, 10, 3000), np.full(2000, 42.0), [float("nan")] * 5])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = generate.exact_quantiles(df, "x", probs)
    want = np.quantile(vals[~np.isnan(vals)], probs)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_regex_pattern_only_shapes_text_columns(spark):
    cols = [ColumnContract("d", "date", pattern="[0-9]{4}"), ColumnContract("s", "string", pattern="[0-9]{4}")]
    r = generate.generate(spark, DatasetSpec("p", 20, columns=cols)).first()
    assert str(r["d"])[:2] == "20" and len(r["s"]) == 4 and r["s"].isdigit()


def test_formats_follow_the_stored_type_and_the_calendar(spark, sf_dir):
    from tabforge.operators import profile
    for table in ("orders", "events", "customer", "lineitem"):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        bad = validate.column_checks(df, profile.infer_contract(df)).where("violations > 0").collect()
        assert not bad, bad
    df = spark.createDataFrame([("2023-13-45", "A-12", "USER_ID-7", "5$"), ("2023-02-28", "B-3", "x", "7$")],
                               "day string, code string, user_id string, price string")
    contract = [ColumnContract("day", "date"), ColumnContract("code", "string", pattern="(A|B)-[0-9]+"),
                ColumnContract("user_id", "uuid"), ColumnContract("price", "string", pattern="^[0-9]+\\$")]
    got = {(r.check_name, r.column_name): r.violations
           for r in validate.column_checks(df, contract, key="user_id").collect()}
    assert got["type_format", "day"] == 1 and got["pattern", "code"] == 0
    assert got["type_format", "user_id"] == 1 and got["pattern", "price"] == 0


def test_key_gaps_with_an_outlier(spark):
    df = spark.range(1, 3000).select(F.col("id").alias("k")).union(spark.createDataFrame([(10**15,), (5000,)], "k long"))
    got = {(r.prev_key, r.key): r.gap for r in validate.key_gaps(df.where("k <> 70"), F.col("k")).collect()}
    assert got == {(69, 71): 2, (2999, 5000): 2001, (5000, 10**15): 10**15 - 5000}
    dealt = [len(p) for p in df.distinct().repartitionByRange(8, "k").rdd.glom().collect()]
    assert max(dealt) < 1000
