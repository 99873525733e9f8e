"""Sketches rule out, exact counts decide; sketches of parts merge."""

import pytest
from pyspark.sql import functions as F

from tabforge.operators import keys, validate


@pytest.fixture
def table(spark):
    n = F.col("id")
    return spark.range(20_000).select(
        n.alias("key"), F.when(n == 19_999, 0).otherwise(n).alias("once_twice"), (n % 19_000).alias("few_twice"),
        F.concat(F.repeat(F.lit("long "), 50), n).alias("text"), (n % 50).alias("low"),
        F.when(n != 7, n).alias("one_null"), F.when(n > 0, n.cast("double")).otherwise(float("nan")).alias("nan"))


def test_candidates_equal_exact_counts(table):
    got = {r["column_name"]: (r["total_rows"], r["is_unique"])
           for r in keys.verify_candidate_keys(table, table.columns).collect()}
    want = {}
    for c in table.columns:
        r = table.agg(F.count(F.lit(1)), F.count_distinct(c), F.count(c)).first()
        want[c] = (r[0], r[0] == r[1] == r[2])
    assert got == want
    assert [c for c, (_, u) in got.items() if u] == ["key", "text", "nan"]


def test_clear_columns_take_no_exact_pass(table, monkeypatch):
    judged = []
    plain = validate.duplicate_rows
    monkeypatch.setattr(validate, "duplicate_rows", lambda df, **kw: judged.append(df.first()["k"]) or plain(df, **kw))
    keys.verify_candidate_keys(table, ["low", "one_null", "text"]).collect()
    assert len(judged) == 1 and judged[0].startswith("long ")


def test_sketches_of_parts_merge(table):
    cols = ["key", "low"]
    parts = [keys.distinct_sketches(table.where(F.col("key") % 3 == i), cols) for i in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    r = keys.merged_sketches(both, cols).first()
    assert r["rows"] == 20_000 and abs(r["d0"] - 20_000) < 0.1 * 20_000 and r["d1"] == 50


def test_empty_and_repeated_candidates(table):
    assert [tuple(r) for r in keys.verify_candidate_keys(table.where("false"), ["key", "key"]).collect()] == [("key", 0, True)]
    assert keys.verify_candidate_keys(table, []).count() == 0
