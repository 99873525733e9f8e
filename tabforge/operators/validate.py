"""Contract validation: the prompt's rules as checks on data.

The per-column checks (not-null, type format, range / regex pattern, row
count) are one aggregate job over the data - conditional counts with a
partial aggregate on every partition - unpivoted into report rows
``(check, column_name, violations)``.  The grouping checks (duplicate rows,
low variety, drift) are partial-aggregated group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import ColumnContract, DateRange, NumericRange, parse_range
from . import digests

# ---------------------------------------------------------------------------
# Format rules of this library's validator (its own choice).
# ---------------------------------------------------------------------------
FORMAT_RULES = {
    "integer": "^-?[0-9]+$",
    "float": "^-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$",
    "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime": "^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?$",
    "email": "^[^@ ]+@[^@ ]+\\.[^@ ]+$",
    "phone": "^\\+?[0-9][0-9 ().-]{5,}[0-9]$",
    "uuid": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "url": "^https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?$",
}
SEEDED_KEY = "^[^a-z ]+-[0-9]+$"      # a pre-seeded key: the key's upper-case name and the row
BOOLEAN_WORDS = ["true", "false"]
PLACEHOLDER_WORDS = ["lorem", "ipsum", "test", "n/a", "xxx", "todo", "tbd", "placeholder", "dummy", "asdf"]
# ---------------------------------------------------------------------------

REPORT_SCHEMA = "check_name string, column_name string, violations bigint"


def _text(df: DataFrame, name: str) -> Column:
    """A column as text the way a CSV reply would carry it (timestamps ISO-like)."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def _missing(df: DataFrame, name: str) -> Column:
    t = _text(df, name)
    return t.isNull() | (t == "")


def format_ok(text: Column, vocab: str, physical: T.DataType = T.StringType(), key: bool = False) -> Column | None:
    """Whether present values have the contract type's form; None for types without one.

    Text must look like its type, and dates must exist in the calendar.  A column that
    is stored as something else has its type by construction: a semantic name (an
    ``_id`` that is a number, a ``date`` that is a timestamp) asks nothing of its text
    form.  A key column may hold pre-seeded keys."""
    v = vocab.lower()
    if v == "boolean":
        return F.lower(text).isin(*BOOLEAN_WORDS)
    rule = FORMAT_RULES.get(v)
    if rule is None:
        return None
    if not isinstance(physical, T.StringType) and v not in ("integer", "float"):
        return F.lit(True)
    ok = text.rlike(rule)
    if v in ("date", "datetime"):
        ok = ok & text.try_cast("date" if v == "date" else "timestamp_ntz").isNotNull()
    return ok | text.rlike(SEEDED_KEY) if key else ok


def whole_match(pattern: str) -> str:
    """A regex that must match the whole value; one outer ^ and $ are taken as meant so."""
    body = pattern[1:] if pattern.startswith("^") else pattern
    escapes = len(body[:-1]) - len(body[:-1].rstrip("\\"))
    if body.endswith("$") and escapes % 2 == 0:
        body = body[:-1]
    return f"^(?:{body})$"


def pattern_ok(df: DataFrame, c: ColumnContract) -> Column | None:
    if not c.pattern:
        return None
    pat = parse_range(c.pattern, c.type)
    t = _text(df, c.name)
    if isinstance(pat, NumericRange):
        num = t.try_cast("double")
        return num.isNotNull() & (num >= F.lit(pat.lo)) & (num <= F.lit(pat.hi))
    if isinstance(pat, DateRange):
        ts = t.try_cast("timestamp_ntz")
        hi = pat.hi if (pat.hi.hour, pat.hi.minute, pat.hi.second) != (0, 0, 0) else \
            pat.hi.replace(hour=23, minute=59, second=59, microsecond=999999)
        lo_l = F.lit(pat.lo.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
        hi_l = F.lit(hi.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")   # wall time: no zone
        return ts.isNotNull() & (ts >= lo_l) & (ts <= hi_l)
    return t.rlike(whole_match(c.pattern))


def column_checks(df: DataFrame, contract: list[ColumnContract], expected_rows: int | None = None,
                  key: str | None = None) -> DataFrame:
    """G1 + G5 + G6 + G7 in one aggregate job -> rows (check_name, column_name, violations).

    Present values only are format/pattern checked; missing values count
    under not_null when the column is NOT NULL."""
    checks: list[tuple[str, str, Column]] = []
    for c in contract:
        if c.name not in df.columns:
            continue
        miss = _missing(df, c.name)
        if not c.nullable:
            checks.append(("not_null", c.name, miss))
        fmt = format_ok(_text(df, c.name), c.type, df.schema[c.name].dataType, c.name == key)
        if fmt is not None:
            checks.append(("type_format", c.name, ~miss & ~F.coalesce(fmt, F.lit(False))))
        pat = pattern_ok(df, c)
        if pat is not None:
            checks.append(("pattern", c.name, ~miss & ~F.coalesce(pat, F.lit(False))))
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count_if(cond).alias(f"__v{i}") for i, (_, _, cond) in enumerate(checks)]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(chk).alias("check_name"), F.lit(col).alias("column_name"),
                      F.col(f"__v{i}").cast("bigint").alias("violations"))
             for i, (chk, col, _) in enumerate(checks)]
    if expected_rows is not None:
        items.append(F.struct(F.lit("row_count").alias("check_name"), F.lit(None).cast("string").alias("column_name"),
                              F.abs(F.col("__rows") - F.lit(expected_rows)).cast("bigint").alias("violations")))
    return one.select(F.explode(F.array(*items)).alias("r")).select("r.check_name", "r.column_name", "r.violations")


def column_set_check(df: DataFrame, contract: list[ColumnContract]) -> tuple[str, int]:
    """Column names and order equal the contract (a schema check, no data read)."""
    want = [c.name for c in contract]
    return ("column_set", 0 if df.columns == want else 1)


def duplicate_rows(df: DataFrame, columns: list[str] | None = None, long_values: bool = False) -> DataFrame:
    """Groups of identical rows (on ``columns``) with their copy count (> 1).

    With ``long_values`` hashes are counted first and only rows whose hash repeats are
    grouped, by value (see ``digests``): no text of a row without an equal is shuffled."""
    columns = columns or df.columns
    if long_values and digests.hashable(df, columns):
        df = digests.settled_and_repeated(df.select(*[F.col(f"`{c}`") for c in columns]), columns)[1]
    cols = [F.col(f"`{c}`") for c in columns]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def key_gaps(df: DataFrame, key: Column) -> DataFrame:
    """Breaks in a numeric key sequence: (prev_key, key, gap) where gap != 1.

    Distinct keys are dealt out by range, so a task's share follows the number of keys
    and not their values, and checkpointed (stable partition ids).  ``lag`` runs inside
    each partition; the first key of a partition takes the last one of the nearest
    lower partition from a summary of one row per partition."""
    from ..session import shared_dir
    spark = df.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key.cast("bigint").alias("k")).where(F.col("k").isNotNull()).distinct()
    dealt = keys.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()).checkpoint()
    inner = (dealt.withColumn("prev_key", F.lag("k").over(Window.partitionBy("part").orderBy("k")))
             .where(F.col("prev_key").isNotNull())
             .select("prev_key", F.col("k").alias("key")))
    ends = dealt.groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    across = (ends.withColumn("prev_key", F.lag("last").over(Window.orderBy("part")))
              .where(F.col("prev_key").isNotNull())
              .select("prev_key", F.col("first").alias("key")))
    both = inner.unionByName(across)
    return both.select("prev_key", "key", (F.col("key") - F.col("prev_key")).alias("gap")).where(F.col("gap") != 1)


def key_suffix(key: Column) -> Column:
    """Numeric suffix of a seeded key ('USER_ID-12' -> 12)."""
    return F.regexp_extract(key, "-([0-9]+)$", 1).try_cast("bigint")


CANDIDATES = 32               # values a column's sketch proposes
TRACKED = 1_000               # hashes a column's sketch keeps
SKETCH_GROUPS = 256           # groups of partitions whose sketches are merged first
SKETCH_ERROR = 4              # a sketch of TRACKED items is off by less than 4 n / TRACKED


def low_variety(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column the most frequent value, its count, the non-null total and its
    share (ties: smallest value).  Columns without a value give no row.

    One aggregate sketches the frequent hashes of every column (a task shuffles one row of at
    most TRACKED hashes a column, merged in SKETCH_GROUPS groups first) and one more counts the proposed values exactly.  A
    column is settled when the best exact count exceeds what any value left out can have:
    the smallest proposed estimate plus the sketch's error.  The other columns (no value is
    frequent, as with ids and texts) are counted by hash, and only values whose hash has the
    highest count are compared themselves."""
    cols = columns or df.columns
    if not cols:
        raise ValueError("no columns to look at")
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    numbered = range(len(cols))
    sketches = texts.withColumn("part", F.spark_partition_id() % SKETCH_GROUPS).groupBy("part").agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in numbered],
        *[F.expr(f"approx_top_k_accumulate(xxhash64(c{i}), {TRACKED}) FILTER (WHERE c{i} IS NOT NULL)").alias(f"s{i}")
          for i in numbered])
    seen = sketches.groupBy(F.lit(0).alias("all")).agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in numbered],
        *[F.expr(f"approx_top_k_estimate(approx_top_k_combine(s{i}, {TRACKED}), {CANDIDATES})").alias(f"k{i}")
          for i in numbered]).first()
    totals_of = {i: seen[f"n{i}"] for i in numbered if seen[f"n{i}"]} if seen else {}
    if not totals_of:
        return df.sparkSession.createDataFrame([], LOW_VARIETY_SCHEMA)
    proposed = {i: [(r["item"], r["count"]) for r in seen[f"k{i}"]] for i in totals_of}
    values = _long(texts, list(totals_of), lambda i: F.xxhash64(f"c{i}").isin([h for h, _ in proposed[i]]))
    best = {r["i"]: (r["t"]["value"], -r["t"]["neg"]) for r in _top(_counted(values)).collect()}
    tops, unsettled = {}, []
    for i, n in totals_of.items():
        missed = SKETCH_ERROR * n // TRACKED
        if len(proposed[i]) == CANDIDATES:
            missed += min(c for _, c in proposed[i])
        if i in best and best[i][1] > missed:
            tops[i] = best[i]
        else:
            unsettled.append(i)
    if unsettled:
        tops.update(_top_by_hash(texts, unsettled))
    rows = [(cols[i], tops[i][0], tops[i][1], n, tops[i][1] / n) for i, n in totals_of.items()]
    return df.sparkSession.createDataFrame(rows, LOW_VARIETY_SCHEMA)


LOW_VARIETY_SCHEMA = "column_name string, top_value string, top_count bigint, total bigint, top_share double"


def _long(texts: DataFrame, wanted: list[int], keep) -> DataFrame:
    """(i, value) of the wanted columns' values that ``keep`` accepts."""
    items = F.array(*[F.when(F.col(f"c{i}").isNotNull() & keep(i), F.struct(
        F.lit(i).alias("i"), F.col(f"c{i}").alias("value"))) for i in wanted])
    return texts.select(F.explode(F.filter(items, lambda x: x.isNotNull())).alias("x")).select("x.i", "x.value")


def _counted(values: DataFrame) -> DataFrame:
    return values.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))


def _top(counts: DataFrame) -> DataFrame:
    """Per column the highest count's smallest value: (i, t.neg, t.value)."""
    return counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("t"))


def _top_by_hash(texts: DataFrame, wanted: list[int]) -> dict[int, tuple[str, int]]:
    """The exact top of columns no sketch settles: hashes are counted, a column without a
    repeated hash has its smallest value on top, and in the others the values with a
    hash of the highest count are counted themselves."""
    from ..session import shared_dir
    shared_dir(texts.sparkSession)
    pair = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.col(f"c{i}").isNotNull().alias("present"), F.xxhash64(F.lit(i), f"c{i}").alias("h"),
        F.xxhash64(F.lit(-1 - i), f"c{i}").alias("h2")) for i in wanted])).alias("x")
    counts = (texts.select(pair).where("x.present").groupBy("x.i", "x.h", "x.h2")
              .agg(F.count(F.lit(1)).alias("n")).checkpoint())
    highest = {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.max("n").alias("n")).collect()}
    out = {}
    single = [i for i in wanted if highest[i] == 1]
    if single:
        least = texts.agg(*[F.min(f"c{i}").alias(f"c{i}") for i in single]).first()
        out = {i: (least[f"c{i}"], 1) for i in single}
    again = [i for i in wanted if highest[i] > 1]
    if again:
        at_top = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(highest[i]).cast("bigint").alias("n")) for i in again])
        tied = counts.where(F.array_contains(at_top, F.struct("i", "n")))
        bits = digests.bitmap(tied, "h")
        values = _long(texts, again, lambda i: F.lit(True)).withColumn("h", F.xxhash64("i", "value"))
        marked = digests.flag(values, F.col("h"), bits).where("__again")
        out.update({r["i"]: (r["t"]["value"], -r["t"]["neg"]) for r in _top(_counted(marked)).collect()})
    return out


def word_pattern(word: str) -> str:
    """Per-word rule (SQL-portable): the word with a non-[a-z0-9_] or edge on both sides."""
    import re
    return f"(^|[^a-z0-9_]){re.escape(word) if word.isalnum() else word}($|[^a-z0-9_])"


def placeholder_hits(df: DataFrame, text_col: str, words: list[str] | None = None) -> DataFrame:
    """Per placeholder word, rows whose (lower-cased) text holds it as a word.

    One regex pass per row: all words in one alternation with look-around
    boundaries (so adjacent hits do not hide each other), the distinct hits of a
    row exploded, then a partial-aggregated count per word."""
    import re
    words = words or PLACEHOLDER_WORDS
    alt = "|".join(re.escape(w) if w.isalnum() else w for w in words)
    hits = F.array_distinct(F.regexp_extract_all(
        F.lower(F.col(f"`{text_col}`")), F.lit(f"(?<![a-z0-9_])({alt})(?![a-z0-9_])"), 1))
    found = df.select(F.explode(hits).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    spark = df.sparkSession
    all_words = spark.createDataFrame([(w,) for w in words], "word string")
    return all_words.join(found, "word", "left").select("word", F.coalesce(F.col("rows"), F.lit(0)).alias("rows"))


def drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Frequencies of ``column`` in two frames:
    (value, a_count, b_count, a_share, b_share, share_diff).

    Both frames are counted in one aggregate; its rows (one per value) are checkpointed
    and give the totals, so each frame is read once."""
    from ..session import shared_dir
    shared_dir(a.sparkSession)
    value = F.col(f"`{column}`").alias("value")
    both = a.select(value, F.lit(True).alias("first")).union(b.select(value, F.lit(False)))
    counts = both.groupBy("value").agg(F.count_if("first").alias("a_count"),
                                       F.count_if(~F.col("first")).alias("b_count")).checkpoint()
    na, nb = totals(counts)
    return (counts.withColumn("a_share", F.col("a_count") / F.lit(max(na, 1)))
            .withColumn("b_share", F.col("b_count") / F.lit(max(nb, 1)))
            .withColumn("share_diff", F.abs(F.col("a_share") - F.col("b_share"))))


def totals(drift_rows: DataFrame) -> tuple[int, int]:
    """Rows of the two frames, from the counts of a drift table."""
    return tuple(x or 0 for x in drift_rows.agg(F.sum("a_count"), F.sum("b_count")).first())


def total_variation(drift_rows: DataFrame) -> DataFrame:
    """Total-variation distance from a drift table, exact in integers until the last
    division: sum |a*nb - b*na| / (2 * na * nb).  Products have 38 digits."""
    na, nb = totals(drift_rows)
    return drift_rows.agg((F.sum(_cross(F.col("a_count"), F.col("b_count"), na, nb)).cast("double")
                           / F.lit(2.0 * max(na, 1) * max(nb, 1))).alias("tvd"))


def _cross(a: Column, b: Column, na: int, nb: int) -> Column:
    """|a*nb - b*na| exactly."""
    wide = "decimal(19,0)"
    return F.abs(a.cast(wide) * F.lit(nb).cast(wide) - b.cast(wide) * F.lit(na).cast(wide))


def drift_ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """G12 for numbers, dates and times: the two-sample Kolmogorov-Smirnov distance, the
    largest difference of the two distributions, as one row (a_rows, b_rows, ks, at_value),
    ``at_value`` the smallest value with that difference.  Null and NaN are left out; a
    frame without a value gives null.

    Both frames are counted per value in one aggregate (a hot value collapses before the
    shuffle); running counts go over range partitions with one offset row each
    (``running_total``).  The difference is compared in integers, |A*nb - B*na|."""
    from .generate import running_total
    value = F.col(f"`{column}`").alias("value")
    both = a.select(value, F.lit(1).alias("first")).union(b.select(value, F.lit(0)))
    both = both.where(F.col("value").isNotNull())
    if isinstance(both.schema["value"].dataType, (T.DoubleType, T.FloatType)):
        both = both.where(~F.isnan("value"))
    counts = both.groupBy("value").agg(F.sum("first").alias("a_count"), F.sum(1 - F.col("first")).alias("b_count"))
    # one running sum carries both counts: a in the high part, b in the low one
    step = F.lit(1 << 62).cast("decimal(20,0)")
    packed = counts.withColumn("both", F.col("a_count").cast("decimal(18,0)") * step + F.col("b_count"))
    run = running_total(packed.select("value", F.col("both").cast("decimal(38,0)").alias("both")), "value", "both", "hi")
    run = run.select("value", F.call_function("div", F.col("hi"), step).alias("a"),
                     (F.col("hi") % step).cast("bigint").alias("b")).checkpoint()
    na, nb = (x or 0 for x in run.agg(F.max("a"), F.max("b")).first())
    if not na or not nb:
        kind = run.schema["value"].dataType
        return run.sparkSession.range(1).select(
            F.lit(na).cast("bigint").alias("a_rows"), F.lit(nb).cast("bigint").alias("b_rows"),
            F.lit(None).cast("double").alias("ks"), F.lit(None).cast(kind).alias("at_value"))
    gap = _cross(F.col("a"), F.col("b"), na, nb)
    most = run.agg(F.max(gap)).first()[0]
    return (run.where(gap == F.lit(most))
            .agg(F.min("value").alias("at_value"))
            .select(F.lit(na).cast("bigint").alias("a_rows"), F.lit(nb).cast("bigint").alias("b_rows"),
                    F.lit(float(most) / (float(na) * float(nb))).alias("ks"), "at_value"))


LOW_VARIETY_SHARE = 0.5       # a column whose most frequent value exceeds this share is flagged


def report(df: DataFrame, contract: list[ColumnContract], pk: str | None = None,
           expected_rows: int | None = None, samples: DataFrame | None = None,
           text_columns: list[str] | None = None, row_columns: list[str] | None = None) -> DataFrame:
    """All checks as one table of (check_name, column_name, violations):
    G1/G5-G7 (one aggregate), G2 key duplicates and missing keys (B3), G3 rows
    repeated on ``row_columns`` (rows beyond the first of each group), G4
    column set, G8 key gaps (numeric keys or seeded-key suffixes), G9 copies of
    sample rows, G10 rows holding a column's top value when its share exceeds
    LOW_VARIETY_SHARE, G11 rows with placeholder words per text column."""
    from .generate import sample_copies
    from .keys import key_quality
    spark = df.sparkSession
    parts = [column_checks(df, contract, expected_rows, pk)]
    name, bad = column_set_check(df, contract)
    parts.append(spark.createDataFrame([(name, None, bad)], REPORT_SCHEMA))
    if pk and pk in df.columns:
        kq = key_quality(df, pk)          # one aggregate, two report rows
        both = F.explode(F.array(
            F.struct(F.lit("key_duplicates").alias("check_name"), F.col("duplicates_found").alias("violations")),
            F.struct(F.lit("key_missing").alias("check_name"), F.col("nulls_found").alias("violations"))))
        parts.append(kq.select(both.alias("r")).select("r.check_name", F.lit(pk).alias("column_name"),
                                                        "r.violations"))
        numeric = dict(df.dtypes)[pk] in ("bigint", "int", "smallint", "tinyint")
        key = F.col(f"`{pk}`") if numeric else key_suffix(F.col(f"`{pk}`"))
        parts.append(key_gaps(df, key).agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("key_gaps").alias("check_name"), F.lit(pk).alias("column_name"), "violations"))
    dup = duplicate_rows(df, row_columns, long_values=bool(text_columns))
    parts.append(dup.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("violations"))
                 .select(F.lit("duplicate_rows").alias("check_name"), F.lit(None).cast("string").alias("column_name"),
                         "violations"))
    if samples is not None:
        parts.append(sample_copies(df, samples).agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("sample_copies").alias("check_name"), F.lit(None).cast("string").alias("column_name"), "violations"))
    lv = low_variety(df, [c.name for c in contract if c.name in df.columns])
    parts.append(lv.select(F.lit("low_variety").alias("check_name"), "column_name",
                           F.when(F.col("top_share") > LOW_VARIETY_SHARE, F.col("top_count"))
                           .otherwise(F.lit(0)).cast("bigint").alias("violations")))
    for col in text_columns or []:
        hits = placeholder_hits(df, col)
        parts.append(hits.agg(F.sum("rows").cast("bigint").alias("violations")).select(
            F.lit("placeholder").alias("check_name"), F.lit(col).alias("column_name"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
