"""Contract-driven row generation (D1, D6-D10) and sample mimicry.

``generate`` is a lazy DataFrame over ``spark.range``: exactly ``rows`` rows,
spread over partitions from the start, every value a built-in expression of
(seed, column, row index).  Nothing is collected; the same spec gives the
same rows whatever the partitioning or executor losses.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.random import draw, offset, wide_draw
from ..functions.values import countable, null_source, value_at, value_for
from ..plans.batches import key_prefix, seed_key
from ..spec import DatasetSpec, batch_size_for
from . import digests
from .ledger import ntz_epoch_seconds

ROWS_PER_PARTITION = 1_000_000      # most rows per task on a small cluster
MIN_ROWS_PER_PARTITION = 100_000    # fewest rows per task on a big one


def skeleton_partitions(spark: SparkSession, rows: int) -> int:
    """Use the cluster's parallelism, with tasks of 100k to 1M rows."""
    most = -(-rows // MIN_ROWS_PER_PARTITION)
    least = -(-rows // ROWS_PER_PARTITION)
    from ..session import parallelism
    return max(1, min(most, max(parallelism(spark), least)))


# D1
def row_skeleton(spark: SparkSession, rows: int, batch_size: int, partitions: int | None = None) -> DataFrame:
    parts = partitions or skeleton_partitions(spark, rows)
    base = spark.range(1, rows + 1, numPartitions=parts).select(F.col("id").alias("row_idx"))
    return base.withColumn("batch_num", F.call_function("div", F.col("row_idx") - 1, F.lit(batch_size)) + 1)


def key_skeleton(source: DataFrame, key: str, batch_size: int = 30) -> DataFrame:
    """A skeleton from the rows of a table: row_idx is the row's own integer key, so a
    row's values stay the same when other rows come or go."""
    idx = F.col(f"`{key}`").cast("bigint")
    return source.select(idx.alias("row_idx")).withColumn(
        "batch_num", F.call_function("div", F.col("row_idx") - 1, F.lit(batch_size)) + 1)


# D6
def with_nulls(v: Column, rate: int, seed: int, col: str, idx: Column, salt: str = "null", i: int = 0) -> Column:
    """Null at ``rate`` percent of rows (a chunk no other part of the value uses)."""
    return F.when(draw(seed, col, idx, salt, i) % 100 >= rate, v)


def generate(spark: SparkSession, spec: DatasetSpec, rows: int | None = None,
             partitions: int | None = None, typed_key: bool = False,
             keep_index: bool = True, skeleton: DataFrame | None = None) -> DataFrame:
    """Rows for a contract.  The key column (explicit ``primary_key``) gets the
    seeded key of its row (``PK-<row>``), or with ``typed_key`` a typed unique
    value (uuid text / the row index); nullable columns get nulls (never the key).
    ``skeleton`` (see ``key_skeleton``) gives the rows to fill instead of 1..rows."""
    if not spec.columns:
        raise ValueError("generation needs a column contract")
    n = rows if rows is not None else spec.rows
    skel = skeleton if skeleton is not None else row_skeleton(spark, n, batch_size_for(spec.num_columns), partitions)
    idx = F.col("row_idx")
    cols = []
    for c in spec.columns:
        if spec.primary_key and c.name == spec.primary_key:
            if typed_key and c.type == "integer":
                v = idx
            elif typed_key:
                v = value_for(c, spec.seed, idx)
            else:
                v = seed_key(key_prefix(spec.primary_key), idx)
        else:
            v = value_for(c, spec.seed, idx)
            if c.nullable:
                v = with_nulls(v, spec.null_rate, spec.seed, c.name, idx, *null_source(c))
        cols.append(v.alias(c.name))
    lead = ["row_idx", "batch_num"] if keep_index else []
    return skel.select(*lead, *cols)


# D9
def drop_sample_copies(generated: DataFrame, samples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Generated rows equal (null-safe, on all contract columns) to a sample row are
    dropped.  Null-safe equality on every column is an equi-join key; Spark
    broadcasts the sample side where its size in bytes allows."""
    columns = columns or samples.columns
    s = samples.select(*[F.col(f"`{c}`").alias(f"__s_{i}") for i, c in enumerate(columns)])
    cond = None
    for i, c in enumerate(columns):
        e = F.col(f"`{c}`").eqNullSafe(F.col(f"__s_{i}"))
        cond = e if cond is None else cond & e
    return generated.join(s, cond, "left_anti")


def sample_copies(generated: DataFrame, samples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Generated rows that copy a sample row."""
    columns = columns or samples.columns
    s = samples.select(*[F.col(f"`{c}`").alias(f"__s_{i}") for i, c in enumerate(columns)])
    cond = None
    for i, c in enumerate(columns):
        e = F.col(f"`{c}`").eqNullSafe(F.col(f"__s_{i}"))
        cond = e if cond is None else cond & e
    return generated.join(s, cond, "left_semi")


MAX_REDRAWS = 64
REDRAW_STEP = 1_000_003             # between the seeds of two draws of a row


def generate_novel(spark: SparkSession, spec: DatasetSpec, samples: DataFrame, rows: int | None = None,
                   skeleton: DataFrame | None = None) -> DataFrame:
    """D9 with the row count kept: rows equal (null-safe, on the samples' columns) to a
    sample are drawn again, with a seed salted by the round, until none is.  A round reads and
    writes only the rows that hit, so the rounds shrink by the share of combinations that
    the samples hold; a contract whose combinations they hold all (nearly) is an error."""
    todo = skeleton if skeleton is not None else row_skeleton(
        spark, rows if rows is not None else spec.rows, batch_size_for(spec.num_columns))
    kept = []
    for again in range(MAX_REDRAWS):
        drawn = _written(generate(spark, replace(spec, seed=spec.seed + again * REDRAW_STEP), skeleton=todo), "redraw")
        kept.append(drop_sample_copies(drawn, samples))
        todo = _written(sample_copies(drawn, samples).select("row_idx", "batch_num"), "redraw-hits")
        if todo.isEmpty():
            return reduce(DataFrame.union, kept)
    raise ValueError(f"after {MAX_REDRAWS} draws some rows still equal a sample: the contract leaves too few others")


def _written(df: DataFrame, name: str) -> DataFrame:
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# D10
def unique_rows(df: DataFrame, long_values: bool = False) -> DataFrame:
    """One of each group of identical rows.  With ``long_values`` rows whose hash is theirs
    alone stay where they are read, and only the rest is grouped (see ``digests``)."""
    if not long_values or not digests.hashable(df, df.columns):
        return df.dropDuplicates()
    settled, repeated = digests.settled_and_repeated(df, df.columns)
    return settled.unionByName(repeated.dropDuplicates())


FEISTEL_ROUNDS = 4
MOST_COMBINATIONS = 1 << 60         # on either side of the permutation


def permuted(i: Column, left: int, right: int, seed: int) -> tuple[Column, Column]:
    """A keyed permutation of 0 .. left * right - 1, as a pair of numbers below ``left`` and
    ``right``: rounds that add a hash of one half to the other, each of them reversible.
    The halves' sizes are the ranges themselves, so no value falls outside and has to be
    walked on.  With one half alone it is multiplied by a number coprime to its size."""
    div = lambda a, b: F.call_function("div", a, b)
    if min(left, right) == 1:
        size = max(left, right)
        factor = next(m for m in range(size * 618 // 1000 + seed % 97 + 1, 2 * size + 200) if math.gcd(m, size) == 1)
        wide = lambda x: x.cast("decimal(38,0)")
        one = ((wide(i) * wide(F.lit(factor)) + wide(F.lit(seed % size))) % wide(F.lit(size))).cast("bigint")
        return (one, F.lit(0).cast("bigint")) if left > 1 else (F.lit(0).cast("bigint"), one)
    x, y = div(i, F.lit(right)), i % F.lit(right)
    for k in range(FEISTEL_ROUNDS):
        if k % 2 == 0:
            x = (x + wide_draw(seed, "__unique", y, f"f{k}") % F.lit(left)) % F.lit(left)
        else:
            y = (y + wide_draw(seed, "__unique", x, f"f{k}") % F.lit(right)) % F.lit(right)
    return x, y


def halves(columns: list) -> tuple[list[tuple], list[tuple], int]:
    """The columns with countable values, (column, size) each, dealt to two halves of
    similar products, and the number of combinations; columns that would pass
    MOST_COMBINATIONS are left out (they are drawn freely)."""
    sides, products = ([], []), [1, 1]
    sized = [(c, countable(c)) for c in columns]
    for c, n in sorted((x for x in sized if x[1]), key=lambda x: -x[1]):
        k = int(products[1] < products[0])
        if products[k] * n <= MOST_COMBINATIONS:
            sides[k].append((c, n))
            products[k] *= n
    return sides[0], sides[1], products[0] * products[1]


def generate_unique(spark: SparkSession, spec: DatasetSpec, rows: int | None = None,
                    skeleton: DataFrame | None = None) -> DataFrame:
    """D10 without a shuffle: rows of a contract without key that are distinct by
    construction.  Row i gets the i-th combination, in a keyed permutation, of the values
    that the countable columns (integer, float, boolean, date, datetime) can take; other
    columns are drawn as usual.  Distributions and nulls do not apply to the countable
    columns.  ``skeleton`` must number rows from 1 without repeats; more rows than
    combinations are an error."""
    n = rows if rows is not None else spec.rows
    first, second, total = halves(spec.columns or [])
    if skeleton is not None:
        n = skeleton.agg(F.max("row_idx")).first()[0] or 0
    if n > total:
        raise ValueError(f"{n} distinct rows asked, the contract has {total} combinations")
    skel = skeleton if skeleton is not None else row_skeleton(spark, n, batch_size_for(spec.num_columns))
    sizes = [math.prod(size for _, size in side) for side in (first, second)]
    x, y = permuted(F.col("row_idx") - 1, *sizes, spec.seed)
    # the numbers are columns of their own, so that each is computed once
    placed = skel.withColumns({"__x": x, "__y": y})
    made = {}
    for side, name in ((first, "__x"), (second, "__y")):
        stride = 1
        for c, size in side:
            digit = F.call_function("div", F.col(name), F.lit(stride)) % F.lit(size)
            made[c.name] = value_at(c, digit)
            stride *= size
    cols = [made[c.name] if c.name in made else value_for(c, spec.seed, F.col("row_idx")) for c in spec.columns]
    return placed.select("row_idx", "batch_num", *(v.alias(c.name) for v, c in zip(cols, spec.columns)))


# D8 -------------------------------------------------------------------------
MIMIC_BUCKETS = 1024


def running_total(df: DataFrame, order_col: str, amount_col: str, out_col: str = "hi") -> DataFrame:
    """Inclusive running sum of ``amount_col`` in ``order_col`` order.

    Range-partitioned, checkpointed (stable partition ids, cut lineage), summed
    per partition, and each partition adds the offset of the partitions before
    it: no single task sees all rows."""
    from ..session import shared_dir
    shared_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order_col).withColumn("__pid", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("__pid").agg(F.sum(amount_col).alias("__s"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    w = Window.partitionBy("__pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranged.join(F.broadcast(offs), "__pid")
            .withColumn(out_col, F.col("__off") + F.sum(amount_col).over(w)).drop("__pid", "__off"))


def value_frequencies(source: DataFrame, column: str) -> DataFrame:
    """(value, freq) of all values, null among them: a partial-aggregated group-by."""
    return source.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def frequency_stats(freq: DataFrame) -> tuple[int, int]:
    """(distinct values, total rows) of a frequency table, one aggregate."""
    r = freq.agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("total")).first()
    return int(r["n"] or 0), int(r["total"] or 0)


def category_intervals(source: DataFrame, column: str, freq: DataFrame | None = None) -> DataFrame:
    """Frequencies of the source values as half-open rank intervals [lo, hi) in value
    order (running sum over the distinct values, see ``running_total``)."""
    freq = value_frequencies(source, column) if freq is None else freq
    return running_total(freq, "value", "freq").withColumn("lo", F.col("hi") - F.col("freq"))


def mimic_categorical(skeleton: DataFrame, source: DataFrame, column: str, seed: int = 42,
                      out_col: str | None = None, buckets: int = MIMIC_BUCKETS) -> DataFrame:
    """Draw values with the source's frequencies: rank r = draw mod N picks the
    interval holding r.  The range lookup is an equi-join on a rank bucket
    (intervals are exploded into the buckets they overlap) plus the range test.

    There are 4 buckets per distinct value (``buckets`` at least), each N / buckets
    ranks wide: every bucket receives an equal share of generated rows (no hot
    join key even when one value holds most of N), and the exploded interval
    table has at most 5 rows per distinct value (or ``buckets`` more), whatever N.
    AQE broadcasts it when it measures small."""
    out_col = out_col or column
    freq = value_frequencies(source, column)
    n_iv, total = frequency_stats(freq)
    iv = category_intervals(source, column, freq)
    if total == 0:
        return skeleton.withColumn(out_col, F.lit(None).cast(source.schema[column].dataType))
    width = max(1, -(-total // max(buckets, 4 * n_iv)))
    iv_b = iv.select("value", "lo", "hi", F.explode(F.sequence(
        F.call_function("div", F.col("lo"), F.lit(width)),
        F.call_function("div", F.col("hi") - 1, F.lit(width)))).alias("bucket"))
    r = offset(total, "uniform", seed, column, F.col("row_idx"))
    g = skeleton.withColumn("__r", r).withColumn("__b", F.call_function("div", F.col("__r"), F.lit(width)))
    joined = g.join(iv_b, (g["__b"] == iv_b["bucket"]) & (g["__r"] >= iv_b["lo"]) & (g["__r"] < iv_b["hi"]))
    return joined.select(*skeleton.columns, F.col("value").alias(out_col))


def exact_quantiles(source: DataFrame, column: str, probs: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation between order statistics (the
    pandas / SQL ``quantile_cont`` rule), NaN and null ignored.

    Distributed: values are counted per distinct value first (a hot value
    collapses map-side), the running sum gives each value its rank interval
    (``running_total``), and only the intervals holding the needed ranks -
    at most two per probability - reach the driver."""
    c = F.col(f"`{column}`").cast("double")
    vals = source.select(c.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    freq = value_frequencies(vals, "v").persist()     # released below: this function is eager
    try:
        _, n = frequency_stats(freq)
        if n == 0:
            return []
        iv = category_intervals(vals, "v", freq)
        return _interpolate(iv, n, probs)
    finally:
        freq.unpersist()


def _interpolate(iv: DataFrame, n: int, probs: list[float]) -> list[float]:
    import math
    wanted = {}
    for p in probs:
        pos = p * (n - 1)
        wanted[p] = (pos, math.floor(pos), min(math.ceil(pos), n - 1))
    ranks = sorted({r for _, lo, hi in wanted.values() for r in (lo, hi)})
    needed = F.array(*[F.lit(r).cast("bigint") for r in ranks])
    hit = F.exists(needed, lambda r: (F.col("lo") <= r) & (r < F.col("hi")))
    found = iv.where(hit).select("value", "lo", "hi").collect()

    def at(r):
        for row in found:
            if row["lo"] <= r < row["hi"]:
                return row["value"]
        raise AssertionError(r)
    out = []
    for p in probs:
        pos, lo, hi = wanted[p]
        v_lo, v_hi = at(lo), at(hi)
        out.append(v_lo + (v_hi - v_lo) * (pos - lo))
    return out


def mimic_numeric(skeleton: DataFrame, source: DataFrame, column: str, seed: int = 42,
                  out_col: str | None = None, points: int = 101, exact: bool = True,
                  accuracy: int = 10000) -> DataFrame:
    """Inverse of the source quantiles with linear interpolation.  The grid of
    ``points`` quantiles is exact by default (``exact_quantiles``) or from
    ``percentile_approx`` (fixed memory, one pass); either way it is a bounded
    array inlined as a literal.  Nulls are drawn at the source's share (NaN does not
    count as null and is left out of the grid).  Dates and timestamps go through days and
    microseconds since 1970 and come back in their own type."""
    out_col = out_col or column
    kind = source.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        plain, epoch = F.col(f"`{column}`"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        number = F.unix_date(plain) if isinstance(kind, T.DateType) else F.unix_micros(plain.cast("timestamp"))
        if isinstance(kind, T.TimestampNTZType):
            # no detour over the session's zone, whose clock changes would move values
            number = ntz_epoch_seconds(plain) * 1_000_000 + F.date_format(plain, "SSSSSS").cast("bigint")
        out = mimic_numeric(skeleton, source.select(number.cast("double").alias(column)), column, seed, out_col,
                            points, exact, accuracy)
        back = F.floor(F.col(out_col))
        if isinstance(kind, T.DateType):
            value = F.date_from_unix_date(back.cast("int"))
        elif isinstance(kind, T.TimestampNTZType):
            value = epoch + F.make_dt_interval(secs=(back.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))
        else:
            value = F.timestamp_micros(back.cast("bigint"))
        return out.withColumn(out_col, value)
    probs = [i / (points - 1) for i in range(points)]
    if exact:
        q = exact_quantiles(source, column, probs)
    else:
        q = source.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), probs, accuracy)
                       .alias("q")).first()["q"]
    if not q:
        return skeleton.withColumn(out_col, F.lit(None).cast("double"))
    share = source.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{column}`").isNull()).alias("nulls")).first()
    grid = F.array(*[F.lit(float(v)) for v in q])
    u = draw(seed, column, F.col("row_idx"), "q") / F.lit(4294967296.0) * F.lit(points - 1)
    i = F.floor(u).cast("int")
    frac = u - i
    lo_v = F.element_at(grid, i + 1)
    hi_v = F.element_at(grid, F.least(i + 2, F.lit(points)))
    value = lo_v + (hi_v - lo_v) * frac
    if share["nulls"]:
        value = F.when(wide_draw(seed, column, F.col("row_idx"), "n") % F.lit(share["n"]) >= share["nulls"], value)
    return skeleton.withColumn(out_col, value)


def mimic_rows(skeleton: DataFrame, samples: DataFrame, order_col: str, seed: int = 42,
               jitter: dict[str, float] | None = None) -> DataFrame:
    """Keep relations between columns: each generated row copies a sample row
    picked by draw mod n (equi-join on the sample's distributed rank in ``order_col``,
    which must not repeat), then numeric columns get a relative jitter.  Samples
    may be a whole table."""
    n = samples.count()
    if n == 0:
        return skeleton.join(samples, F.lit(False), "left_semi").select(
            "*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in samples.schema))
    ranked = (running_total(samples.withColumn("__one", F.lit(1)), order_col, "__one", "__k")
              .withColumn("__k", F.col("__k") - 1).drop("__one"))
    g = skeleton.withColumn("__k", wide_draw(seed, "__row", F.col("row_idx"), "k") % F.lit(n))
    out = g.join(ranked, "__k").drop("__k")
    for col, rel in (jitter or {}).items():
        d = draw(seed, col, F.col("row_idx"), "j") / F.lit(4294967296.0) * 2 - 1
        out = out.withColumn(col, F.col(col) * (1 + F.lit(rel) * d))
    return out
