"""Sources: delimited text, Parquet and JSON arrays.

Every reader returns a lazy DataFrame; the only eager steps are the
"is it empty" probe (a LIMIT 1 job) and, for text files without a known
delimiter, a sniff over a bounded head of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import splits

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Candidate delimiters for sniffing: comma, semicolon, tab, pipe.
DELIMITERS = [",", ";", "\t", "|"]
# Tokens a CSV reader with pandas' defaults turns into nulls.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]
# ---------------------------------------------------------------------------

SNIFF_LINES = 1000            # default head of lines a delimiter is sniffed from
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|Inf|Infinity)$"


def file_kind(path: str) -> str:
    """Format by extension, case-insensitive."""
    low = path.lower().rstrip("/")
    for ext in ("csv", "parquet", "json", "tsv"):
        if low.endswith("." + ext):
            return ext
    raise ValueError(f"{path}: the name must end in .csv, .tsv, .json or .parquet")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = file_kind(path)
    if kind == "csv":
        return read_delimited(spark, path)
    if kind == "tsv":
        return read_delimited(spark, path, sep="\t")
    if kind == "parquet":
        return read_parquet(spark, path)
    return read_json_rows(spark, path)


def _require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in the {what} source")
    return df


# A1b -------------------------------------------------------------------------
def delimiter_counts(lines: DataFrame, line_col: str = "value",
                     candidates: list[str] | None = None) -> DataFrame:
    """Per candidate delimiter: min/max occurrences per non-blank line.

    One aggregate pass (partial aggregation on every partition); the result
    has one row per candidate with ``consistent`` (same non-zero count on
    every line) and ``chosen`` (the consistent candidate with the highest
    count, else the one with the highest maximum).
    """
    candidates = candidates or DELIMITERS
    line = F.regexp_replace(F.col(line_col), '"[^"]*+"', "")      # delimiters inside quotes do not count
    body = lines.where(F.length(F.trim(F.col(line_col))) > 0)
    aggs = [F.count(F.lit(1)).alias("lines")]
    for i, d in enumerate(candidates):
        n = F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
        aggs += [F.min(n).alias(f"mn{i}"), F.max(n).alias(f"mx{i}")]
    row = body.agg(*aggs)
    per = F.explode(F.array(*[
        F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("ordinal"),
                 F.col(f"mn{i}").alias("min_count"), F.col(f"mx{i}").alias("max_count"))
        for i, d in enumerate(candidates)]))
    out = row.select("lines", per.alias("d")).select(
        "d.delimiter", "d.ordinal", "d.min_count", "d.max_count", F.col("lines").alias("total_lines"))
    out = out.withColumn("consistent", (F.col("min_count") == F.col("max_count")) & (F.col("min_count") > 0))
    # The pick is over a handful of candidate rows: a tiny window is fine.
    from pyspark.sql import Window
    rank = F.row_number().over(Window.orderBy(
        F.col("consistent").desc(), F.col("max_count").desc(), F.col("ordinal")))
    return out.withColumn("chosen", (rank == 1) & (F.col("max_count") > 0)).drop("ordinal")


def sniff_delimiter(spark: SparkSession, path: str, max_lines: int = SNIFF_LINES) -> str:
    """Pick the delimiter from a bounded head of the file (the sniffing sample)."""
    head = spark.read.text(path).limit(max_lines)
    rows = delimiter_counts(head).where("chosen").select("delimiter").collect()
    return rows[0][0] if rows else ","


# A1 --------------------------------------------------------------------------
def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   schema: T.StructType | None = None, infer: bool = True) -> DataFrame:
    """CSV with header; delimiter sniffed when not given; null tokens mapped; types inferred
    in one aggregate pass over the string columns."""
    sep = sep or sniff_delimiter(spark, path)
    df = _require_rows(splits.read_csv(spark, path, {"sep": sep}, schema), "CSV")
    if schema is not None:
        return df
    df = df.select([F.when(F.col(c).isin(NULL_TOKENS), F.lit(None)).otherwise(F.col(c)).alias(c)
                    for c in df.columns])
    return infer_types(df) if infer else df


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to bigint / double / boolean when every non-null value fits.

    One aggregate job with a partial aggregate per partition, then a lazy cast.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.col(c)
        # Spark's cast also takes Java's suffixes (1d, 2f), which are text here
        number = F.trim(v).rlike(NUMBER)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(v.try_cast("bigint")).alias(f"l{i}"),
                 F.count(F.when(number, v.try_cast("double"))).alias(f"d{i}"),
                 F.count(F.when(v.isin("True", "False", "true", "false", "TRUE", "FALSE"), 1)).alias(f"b{i}")]
    stats = df.agg(*aggs).first()
    cols = []
    for i, c in enumerate(df.columns):
        n = stats[f"n{i}"]
        if n and stats[f"l{i}"] == n:
            cols.append(F.col(c).try_cast("bigint").alias(c))
        elif n and stats[f"d{i}"] == n:
            cols.append(F.col(c).try_cast("double").alias(c))
        elif n and stats[f"b{i}"] == n:
            cols.append((F.lower(F.col(c)) == "true").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(cols)


# A2 --------------------------------------------------------------------------
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _require_rows(spark.read.parquet(path), "Parquet")


# A3 --------------------------------------------------------------------------
def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON file whose top level is a non-empty array of objects, or JSON Lines (what H3
    writes) -> one row per object.  One file is cut by many tasks (see ``splits``)."""
    reader = spark.read.option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader).json(splits.json_lines(spark, path))
    if not df.columns:
        raise ValueError("no rows in the JSON source")
    return _require_rows(df, "JSON")


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one row per file (for first-object contract inference)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))


# Replies from an offline inference run --------------------------------------------
REPLY_SCHEMA = T.StructType([T.StructField("batch_num", T.LongType()), T.StructField("attempt", T.IntegerType()),
                             T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])


def read_replies(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A replies table (batch_num, attempt, response, error) from
    - parquet / JSON Lines with those fields (``kind`` 'parquet' or 'json'), or
    - 'text': one file per reply under batch_num=<b>/attempt=<a>/ folders (the
      whole file is the reply; partition discovery gives batch and attempt)."""
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else
                    "json" if path.rstrip("/").endswith((".json", ".jsonl")) else "text")
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "json":
        df = spark.read.schema(REPLY_SCHEMA).json(path)
    else:
        df = (spark.read.option("basePath", path).text(path, wholetext=True)
              .withColumnRenamed("value", "response"))
    cols = set(df.columns)
    return df.select(F.col("batch_num").cast("long").alias("batch_num"),
                     (F.col("attempt") if "attempt" in cols else F.lit(0)).cast("int").alias("attempt"),
                     F.col("response").cast("string").alias("response"),
                     (F.col("error") if "error" in cols else F.lit(None)).cast("string").alias("error"))
