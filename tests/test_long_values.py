"""Grouping by long values through hashes, heavy hitters, numeric drift, claims in any order."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import assemble, digests, generate, validate
from tabforge.streaming import replies_stream

ROWS = [("a", "x", 1), ("a", "x", 2), ("b", None, 3), ("b", None, 4), (None, "b", 5), ("", "", 6), ("", "", 7),
        (None, None, 8), ("long " * 50_000, "x", 9), ("long " * 50_000, "x", 10), ("once", "y", 11), ("x", "a", 12)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "a string, b string, id int").repartition(4)


def test_long_values_equal_the_plain_way(rows):
    ab = rows.select("a", "b")
    for fn in (validate.duplicate_rows, generate.unique_rows):
        plain = collections.Counter(map(tuple, fn(ab).collect()))
        assert collections.Counter(map(tuple, fn(ab, long_values=True).collect())) == plain
    for key in ("a", ["a", "b"]):
        got = assemble.dedup_global(rows, key, ["id"], long_values=True)
        want = assemble.dedup_global(rows, key, ["id"])
        assert got.columns == want.columns and sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
    assert assemble.dropped_duplicates(rows, "a", long_values=True).first() == assemble.dropped_duplicates(rows, "a").first()


def test_long_values_of_empty_tables(rows):
    none = rows.where("id < 0")
    assert generate.unique_rows(none, long_values=True).count() == 0
    assert validate.duplicate_rows(none, long_values=True).count() == 0
    assert assemble.dropped_duplicates(none, "a", long_values=True).first()["rows_in"] == 0
    assert validate.low_variety(none).count() == 0


def test_results_do_not_depend_on_hashes(rows, monkeypatch):
    """With one bitmap of few bits nearly all rows are let through, and results stay."""
    want = sorted(r["id"] for r in assemble.dedup_global(rows, "a", ["id"]).collect())
    monkeypatch.setattr(digests, "BUCKETS", 1)
    monkeypatch.setattr(digests, "_place", lambda h: (F.lit(0).cast("bigint").alias("__bucket"), F.pmod(h, F.lit(2))))
    assert sorted(r["id"] for r in assemble.dedup_global(rows, "a", ["id"], long_values=True).collect()) == want


def test_no_text_of_an_unrepeated_row_is_shuffled(spark, rows):
    """The plan exchanges hashes and bitmaps, and values only behind the flag."""
    settled, repeated = digests.settled_and_repeated(rows.select("a", "b"), ["a", "b"])
    plan = settled._jdf.queryExecution().optimizedPlan().toString()
    aggregates = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert aggregates and not any(re.search(r"\b[ab]#", keys) for keys in aggregates)
    assert "Join LeftOuter" in plan and "broadcast" in plan
    assert {r["a"] for r in settled.collect()} >= {"once", "x"}
    assert repeated.where("a = 'once'").count() == 0


def test_maps_take_the_plain_way(spark):
    df = spark.sql("SELECT map('k', 1) AS m, 1 AS i")
    assert not digests.hashable(df, ["m"]) and digests.hashable(df, ["i"])


def _top(values):
    counts = collections.Counter(v for v in values if v is not None)
    return min(counts.items(), key=lambda kv: (-kv[1], kv[0]))


def test_low_variety_against_counting(spark):
    rng = np.random.default_rng(5)
    data = {"ids": [f"id{i:05d}" for i in range(6000)],                       # all once
            "pairs": [f"p{i // 2:05d}" for i in range(6000)],                 # all twice
            "zipf": [f"z{int(x)}" for x in rng.zipf(1.3, 6000)],
            "flat": [f"f{int(x)}" for x in rng.integers(0, 2500, 6000)],
            "hot": ["hot" if i % 3 == 0 else f"h{i}" for i in range(6000)],
            "tied": [("u" if i % 2 else "t") if i % 10 else None for i in range(6000)],
            "none": [None] * 6000}
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{n} string" for n in names)).repartition(7)
    got = {r["column_name"]: r for r in validate.low_variety(df).collect()}
    assert set(got) == set(names) - {"none"}
    for n in got:
        value, count = _top(data[n])
        present = sum(v is not None for v in data[n])
        assert (got[n]["top_value"], got[n]["top_count"], got[n]["total"]) == (value, count, present), n
        assert got[n]["top_share"] == count / present


def _ks(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.unique(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(a, at, side="right") * len(b) - np.searchsorted(b, at, side="right") * len(a))
    return gap.max() / (len(a) * len(b)), at[gap.argmax()]


def test_drift_ks_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0, 1, 900), 1), np.round(rng.normal(0.3, 1.5, 1400), 1) + 0.0
    a = a + 0.0                                         # no negative zero
    fa = spark.createDataFrame([(float(x),) for x in a] + [(None,), (float("nan"),)], "v double")
    fb = spark.createDataFrame([(float(x),) for x in b], "v double")
    r = validate.drift_ks(fa, fb, "v").first()
    ks, at = _ks(a, b)
    assert (r["a_rows"], r["b_rows"]) == (900, 1400)
    assert r["ks"] == pytest.approx(ks, abs=1e-15) and r["at_value"] == at
    same = validate.drift_ks(fb, fb, "v").first()
    assert same["ks"] == 0.0 and same["at_value"] == b.min()
    assert validate.drift_ks(fa, fb.where("false"), "v").first()["ks"] is None


def test_drift_sums_pass_64_bits(spark):
    """Two frames of 4 * 10^9 rows each, as counts."""
    counts = spark.createDataFrame([("x", 4_000_000_000, 0), ("y", 0, 4_000_000_000)],
                                   "value string, a_count bigint, b_count bigint")
    assert validate.total_variation(counts).first()["tvd"] == 1.0


def test_claims_in_any_order_of_arrival(spark, tmp_path):
    """The same replies in both orders end in the rows F3 keeps, and a restart goes on."""
    schema = "batch_num bigint, attempt int, response string"
    first = [(1, 0, "k,v\n1,a\n2,b\n2,bb"), (2, 0, "1,c\n3,d")]
    second = [(1, 1, "1,z\n4,y\n,none"), (0, 1, "3,early")]
    want = {("1", "a"), ("2", "b"), ("3", "early"), ("4", "y")}
    for name, arrivals in (("plain", [first, second]), ("late", [second, first])):
        base = str(tmp_path / name)
        for data in arrivals:
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
            replies_stream.stream_claims(spark, f"{base}/in", ["k", "v"], "k", f"{base}/out", f"{base}/ckpt")
        claims = replies_stream.current_claims(spark, f"{base}/out", "k")
        assert {(r["k"], r["v"]) for r in claims.collect()} == want, name
    assert spark.conf.get(replies_stream.NO_DATA_BATCHES, "true") == "true"


def test_claims_of_one_row_are_not_sorted(monkeypatch):
    import pandas as pd
    from tabforge.streaming.replies_stream import _better_claims

    class State:
        hasTimedOut, exists, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            pass

    def refuse(*a, **k):
        raise AssertionError("sorted")

    monkeypatch.setattr(pd.DataFrame, "sort_values", refuse)
    piece = lambda *rows: pd.DataFrame(rows, columns=["batch_num", "attempt", "pos", "k"])
    state, better = State(), _better_claims(1000)
    got = list(better(("a",), iter([piece((2, 1, 0, "x")), piece((3, 0, 0, "w"), (1, 1, 5, "y"), (1, 1, 5, "z"))]), state))
    assert [r.values.tolist() for r in got] == [[[1, 1, 5, "y"]]] and state.get == (1, 1, 5)
    assert list(better(("a",), iter([piece((1, 1, 6, "v"))]), state)) == []
    assert [r.values.tolist() for r in better(("a",), iter([piece((1, 0, 9, "u"))]), state)] == [[[1, 0, 9, "u"]]]
