"""Counter-based random draws.

A draw is a pure function of (seed, column, row index, salt): the first
32 bits of md5 over their '|'-joined text.  Unlike ``rand(seed)`` it does not
depend on how rows are partitioned, so re-runs, retries and lost executors
produce the same values, and any SQL engine with md5 can reproduce them.
One md5 yields four independent 32-bit draws (its four 8-hex-digit chunks), for
choices from short lists, or one 60-bit draw (its first 15 hex digits), for
positions in ranges of any width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296          # draws are in [0, 2^32)
TWO_60 = 1 << 60             # wide draws are in [0, 2^60)
IRWIN_HALL_TERMS = 12        # normal shape = mean of 12 uniforms
FINE_BITS = 24               # low bits of the normal shape, from a draw of their own


def hash_text(seed: int, column: str, idx: Column, salt: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(column), idx.cast("string"), F.lit(salt)))


def chunk(h: Column, i: int) -> Column:
    """i-th 32-bit chunk (0..3) of a 32-hex-digit hash, as bigint."""
    return F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")


def draw(seed: int, column: str, idx: Column, salt: str = "v", i: int = 0) -> Column:
    return chunk(hash_text(seed, column, idx, salt), i)


def wide_draw(seed: int, column: str, idx: Column, salt: str = "v") -> Column:
    """60-bit draw, as bigint."""
    return F.conv(F.substring(hash_text(seed, column, idx, salt), 1, 15), 16, 10).cast("bigint")


def irwin_hall_sum(seed: int, column: str, idx: Column) -> Column:
    """Sum of 12 draws (three md5 hashes x four chunks); bell-shaped in [0, 12*2^32)."""
    terms = []
    for g in range(IRWIN_HALL_TERMS // 4):
        h = hash_text(seed, column, idx, f"g{g}")
        terms += [chunk(h, i) for i in range(4)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def int_div(a: Column, b: int) -> Column:
    """Exact integral division (SQL ``div``) of a non-negative bigint by a constant."""
    return F.call_function("div", a, F.lit(b))


def offset(n: Column | int, dist: str | None, seed: int, column: str, idx: Column) -> Column:
    """An integer in [0, n) with the named distribution (D4):
    uniform / random: 60-bit draw mod n (two different streams);
    normal: Irwin-Hall S with FINE_BITS more bits below, (S * n) div (12 * 2^56) in
    decimals of 38 digits, so no width overflows;
    skewed: floor(x * x * n) with x = 60-bit draw / 2^60 (mass near 0)."""
    n_col = F.lit(n) if isinstance(n, int) else n
    d = (dist or "uniform").lower()
    if d == "normal":
        fine = draw(seed, column, idx, "g3") % F.lit(1 << FINE_BITS)
        s = irwin_hall_sum(seed, column, idx) * F.lit(1 << FINE_BITS) + fine
        return F.call_function("div", s.cast("decimal(19,0)") * n_col.cast("decimal(19,0)"),
                               F.lit(IRWIN_HALL_TERMS * TWO_32 << FINE_BITS).cast("decimal(38,0)"))
    if d == "skewed":
        x = wide_draw(seed, column, idx, "v") / F.lit(float(TWO_60))
        return F.floor(x * x * n_col).cast("bigint")
    salt = "r" if d == "random" else "v"
    return wide_draw(seed, column, idx, salt) % n_col
