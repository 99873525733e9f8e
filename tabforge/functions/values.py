"""Typed value expressions for the generator.

Every value is a built-in Column expression over a row index and the
counter-based draws, so generation runs inside whole-stage codegen on the
executors with no Python in the row path.
"""

from __future__ import annotations

import math
from datetime import datetime, time
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import DateRange, NumericRange, RegexPattern, parse_pattern
from .random import chunk, draw, hash_text, offset

# ---------------------------------------------------------------------------
# Word lists of this library's generator (its own choice).
# ---------------------------------------------------------------------------
FIRST_NAMES = ["James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda",
               "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica",
               "Thomas", "Sarah", "Carlos", "Karen", "Daniel", "Lisa", "Matthew", "Nancy",
               "Anthony", "Sandra", "Mark", "Ashley", "Wei", "Priya", "Ahmed", "Sofia"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis",
              "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson",
              "Thomas", "Taylor", "Moore", "Jackson", "Martin", "Lee", "Perez", "Thompson",
              "White", "Harris", "Sanchez", "Clark", "Ramirez", "Lewis", "Robinson", "Chen", "Patel"]
CITIES = ["New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia",
          "San Antonio", "San Diego", "Dallas", "Austin", "Seattle", "Denver", "Boston",
          "Portland", "Atlanta", "Miami", "Toronto", "London", "Berlin", "Madrid"]
STREETS = ["Main", "Oak", "Pine", "Maple", "Cedar", "Elm", "Washington", "Lake", "Hill",
           "Park", "Sunset", "River", "Church", "Mill", "Spring", "Highland"]
STREET_SUFFIXES = ["St", "Ave", "Rd", "Blvd", "Ln", "Dr", "Ct", "Way"]
DOMAINS = ["example.com", "mail.test", "inbox.example", "post.example.org"]
HOSTS = ["shop", "news", "blog", "data", "app", "docs", "portal", "media"]
TLDS = ["com", "org", "net", "io"]
WORDS = ["alpha", "bravo", "cedar", "delta", "ember", "falcon", "garnet", "harbor", "indigo",
         "juniper", "kestrel", "lumen", "meadow", "nectar", "onyx", "prairie", "quartz", "raven",
         "sierra", "tundra", "umber", "violet", "willow", "xenon", "yarrow", "zephyr"]
# Defaults when a contract gives no range.
DEFAULT_INT_RANGE = (0, 1000)
DEFAULT_FLOAT_RANGE = (0.0, 1000.0)
DEFAULT_DATE_RANGE = (datetime(2020, 1, 1), datetime(2025, 12, 31))
FLOAT_DECIMALS = 2
# ---------------------------------------------------------------------------
TEXT_TYPES = {"string", "name", "email", "phone", "uuid", "address", "url"}   # regex patterns apply


def pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % F.lit(len(words)) + 1).cast("int"))


def int_value(rng: NumericRange | None, dist, seed, col, idx) -> Column:
    lo, hi = (int(rng.lo), int(rng.hi)) if rng else DEFAULT_INT_RANGE
    return (F.lit(lo).cast("bigint") + offset(hi - lo + 1, dist, seed, col, idx)).cast("bigint")


def float_value(rng: NumericRange | None, dist, seed, col, idx) -> Column:
    scale, lo_c, hi_c = float_grid(rng)
    steps = F.lit(lo_c).cast("bigint") + offset(hi_c - lo_c + 1, dist, seed, col, idx)
    return (steps / F.lit(scale)).cast("double")


def float_grid(rng: NumericRange | None) -> tuple[int, int, int]:
    """(scale, first, last): the values first / scale ... last / scale of a range, at
    FLOAT_DECIMALS decimals or as many as the range is written with; none lies outside."""
    lo, hi = (rng.lo, rng.hi) if rng else DEFAULT_FLOAT_RANGE
    scale = 10 ** max(FLOAT_DECIMALS, rng.decimals if rng else 0)
    return scale, math.ceil(Decimal(str(lo)) * scale), math.floor(Decimal(str(hi)) * scale)


def date_value(rng: DateRange | None, dist, seed, col, idx) -> Column:
    lo, hi = (rng.lo, rng.hi) if rng else DEFAULT_DATE_RANGE
    days = (hi.date() - lo.date()).days
    return F.date_add(F.lit(lo.date()), offset(days + 1, dist, seed, col, idx).cast("int"))


def datetime_value(rng: DateRange | None, dist, seed, col, idx) -> Column:
    lo, hi = (rng.lo, rng.hi) if rng else DEFAULT_DATE_RANGE
    if hi.time() == time(0, 0):                  # a date-only end means the whole day
        hi = datetime.combine(hi.date(), time(23, 59, 59))
    secs = int((hi - lo).total_seconds())
    base = F.lit(lo.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return base + F.make_dt_interval(secs=offset(secs + 1, dist, seed, col, idx).cast("decimal(18,6)"))


def regex_value(pat: RegexPattern, seed, col, idx) -> Column:
    """Strings matching a simple regex: each token picks its repeat count and
    characters from the draws (one md5 gives four characters)."""
    parts = []
    for t_i, tok in enumerate(pat.tokens):
        span = tok.max_rep - tok.min_rep + 1
        reps = (F.lit(tok.min_rep) + draw(seed, col, idx, f"t{t_i}") % F.lit(span)) if span > 1 else None
        for j in range(tok.max_rep):
            if len(tok.alphabet) == 1:
                ch = F.lit(tok.alphabet)
            else:
                u = draw(seed, col, idx, f"t{t_i}c{j // 4}", j % 4)
                ch = F.substring(F.lit(tok.alphabet), (u % F.lit(len(tok.alphabet)) + 1).cast("int"), 1)
            if reps is not None and j >= tok.min_rep:
                ch = F.when(F.lit(j) < reps, ch).otherwise(F.lit(""))
            parts.append(ch)
    return F.concat(*parts) if parts else F.lit("")


def uuid_value(seed, col, idx) -> Column:
    """Version-4-shaped text from md5: 8-4-4-4-12 with version 4 and an RFC variant nibble."""
    h = hash_text(seed, col, idx, "u")
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"),
                    F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
                    F.substring(h, 21, 12))


def name_parts(seed, col, idx) -> tuple[Column, Column]:
    h = hash_text(seed, col, idx, "name")
    return pick(FIRST_NAMES, chunk(h, 0)), pick(LAST_NAMES, chunk(h, 1))


def email_value(seed, col, idx) -> Column:
    h = hash_text(seed, col, idx, "name")          # chunks 0-1 name, 2 domain, 3 null draw
    return F.lower(F.concat(pick(FIRST_NAMES, chunk(h, 0)), F.lit("."), pick(LAST_NAMES, chunk(h, 1)),
                            idx.cast("string"), F.lit("@"), pick(DOMAINS, chunk(h, 2))))


def phone_value(seed, col, idx) -> Column:
    h = hash_text(seed, col, idx, "ph")
    return F.concat(F.lit("+1-"), (F.lit(200) + chunk(h, 0) % 800).cast("string"), F.lit("-"),
                    F.lpad((chunk(h, 1) % 1000).cast("string"), 3, "0"), F.lit("-"),
                    F.lpad((chunk(h, 2) % 10000).cast("string"), 4, "0"))


def address_value(seed, col, idx) -> Column:
    h = hash_text(seed, col, idx, "addr")
    return F.concat((F.lit(1) + chunk(h, 0) % 9999).cast("string"), F.lit(" "), pick(STREETS, chunk(h, 1)),
                    F.lit(" "), pick(STREET_SUFFIXES, chunk(h, 2)), F.lit(", "), pick(CITIES, chunk(h, 3)))


def url_value(seed, col, idx) -> Column:
    h = hash_text(seed, col, idx, "url")
    return F.concat(F.lit("https://"), pick(HOSTS, chunk(h, 0)), F.lit("."), pick(WORDS, chunk(h, 1)),
                    F.lit("."), pick(TLDS, chunk(h, 2)), F.lit("/"), pick(WORDS, chunk(h, 3)), F.lit("/"),
                    idx.cast("string"))


def null_source(c) -> tuple[str, int]:
    """(salt, chunk) of the draw that decides a null: a spare chunk of the hash the
    value already uses when there is one (one md5 per value instead of two)."""
    t = (c.type or "string").lower()
    pat = parse_pattern(c.pattern, t)
    if isinstance(pat, RegexPattern) and t in TEXT_TYPES:
        return "null", 0
    if t in ("integer", "float", "date", "datetime", "string", "boolean") and \
            (c.distribution or "uniform").lower() in ("uniform", "skewed"):
        return "v", 3
    if t == "phone":
        return "ph", 3
    if t == "email":
        return "name", 3
    return "null", 0


def value_for(c, seed: int, idx: Column) -> Column:
    """One contract column -> its value expression (before null injection)."""
    t = (c.type or "string").lower()
    pat = parse_pattern(c.pattern, t)
    dist = c.distribution
    if isinstance(pat, RegexPattern) and t in TEXT_TYPES:
        return regex_value(pat, seed, c.name, idx)
    if t == "integer":
        return int_value(pat if isinstance(pat, NumericRange) else None, dist, seed, c.name, idx)
    if t == "float":
        return float_value(pat if isinstance(pat, NumericRange) else None, dist, seed, c.name, idx)
    if t == "boolean":
        return draw(seed, c.name, idx) % 2 == 0
    if t == "date":
        return date_value(pat if isinstance(pat, DateRange) else None, dist, seed, c.name, idx)
    if t == "datetime":
        return datetime_value(pat if isinstance(pat, DateRange) else None, dist, seed, c.name, idx)
    if t == "email":
        return email_value(seed, c.name, idx)
    if t == "phone":
        return phone_value(seed, c.name, idx)
    if t == "uuid":
        return uuid_value(seed, c.name, idx)
    if t == "name":
        first, last = name_parts(seed, c.name, idx)
        return F.concat(first, F.lit(" "), last)
    if t == "address":
        return address_value(seed, c.name, idx)
    if t == "url":
        return url_value(seed, c.name, idx)
    if isinstance(pat, NumericRange):
        return int_value(pat, dist, seed, c.name, idx).cast("string")
    return pick(WORDS, offset(len(WORDS), dist, seed, c.name, idx))


# Countable values (D10) -----------------------------------------------------------
def _span(c):
    """(kind, range) of a countable column."""
    pat = parse_pattern(c.pattern, c.type) if c.pattern and c.type not in TEXT_TYPES else None
    return (c.type or "string").lower(), pat


def countable(c) -> int:
    """How many values a column can take; 0 for texts, which have no numbered values."""
    t, pat = _span(c)
    if t == "boolean":
        return 2
    if t == "integer":
        lo, hi = (int(pat.lo), int(pat.hi)) if pat else DEFAULT_INT_RANGE
        return hi - lo + 1
    if t == "float":
        _, lo, hi = float_grid(pat)
        return hi - lo + 1
    if t in ("date", "datetime"):
        lo, hi = (pat.lo, pat.hi) if pat else DEFAULT_DATE_RANGE
        return (hi.date() - lo.date()).days + 1 if t == "date" else int((_last_second(hi) - lo).total_seconds()) + 1
    return 0


def _last_second(hi: datetime) -> datetime:
    return datetime.combine(hi.date(), time(23, 59, 59)) if hi.time() == time(0, 0) else hi


def value_at(c, number: Column) -> Column:
    """The ``number``-th value (from 0) of a countable column."""
    t, pat = _span(c)
    if t == "boolean":
        return number == 0
    if t == "integer":
        return F.lit(int(pat.lo) if pat else DEFAULT_INT_RANGE[0]).cast("bigint") + number
    if t == "float":
        scale, lo, _ = float_grid(pat)
        return ((F.lit(lo).cast("bigint") + number) / F.lit(scale)).cast("double")
    lo = (pat.lo if pat else DEFAULT_DATE_RANGE[0])
    if t == "date":
        return F.date_add(F.lit(lo.date()), number.cast("int"))
    return F.to_timestamp_ntz(F.lit(f"{lo:%Y-%m-%d %H:%M:%S}")) + F.make_dt_interval(secs=number.cast("decimal(18,6)"))
