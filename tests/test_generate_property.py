"""Property: for random contracts, generated rows always pass the contract's checks
(G5-G7) and have the exact row count (G1)."""

from datetime import date, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.operators import generate, validate
from tabforge.spec import ColumnContract, DatasetSpec

DIST = st.sampled_from([None, "uniform", "normal", "skewed", "random"])


@st.composite
def column(draw, i):
    kind = draw(st.sampled_from(["integer", "float", "date", "datetime", "boolean", "email", "phone",
                                 "uuid", "name", "address", "url", "string", "regex"]))
    nullable = draw(st.booleans())
    name = f"c{i}"
    if kind == "integer":
        lo = draw(st.integers(-1000, 1000))
        return ColumnContract(name, "integer", nullable, f"{lo}-{lo + draw(st.integers(0, 5000))}", draw(DIST))
    if kind == "float":
        lo = draw(st.integers(-100, 100))
        return ColumnContract(name, "float", nullable, f"{lo}.5-{lo + draw(st.integers(1, 300))}.25", draw(DIST))
    if kind in ("date", "datetime"):
        d0 = date(2000, 1, 1) + timedelta(days=draw(st.integers(0, 8000)))
        d1 = d0 + timedelta(days=draw(st.integers(0, 900)))
        return ColumnContract(name, kind, nullable, f"{d0} to {d1}", draw(DIST))
    if kind == "regex":
        pat = draw(st.sampled_from(["[A-Z]{3}-[0-9]{4}", "x[ab]?y{1,3}", "[a-f0-9]{8}", "ID_[0-9]+"]))
        return ColumnContract(name, "string", nullable, pat)
    return ColumnContract(name, kind, nullable)


@settings(max_examples=12, deadline=None, derandomize=True)
@given(data=st.data(), rows=st.integers(1, 400), seed=st.integers(0, 10_000))
def test_generated_rows_always_pass_their_contract(spark, data, rows, seed):
    n_cols = data.draw(st.integers(1, 6))
    cols = [data.draw(column(i)) for i in range(n_cols)]
    spec = DatasetSpec("p", rows, columns=cols, seed=seed)
    df = generate.generate(spark, spec, keep_index=False)
    bad = [(r["check_name"], r["column_name"], r["violations"])
           for r in validate.column_checks(df, cols, expected_rows=rows).collect() if r["violations"]]
    assert bad == [], (cols, bad)
