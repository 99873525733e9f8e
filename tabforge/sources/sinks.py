"""Sinks: csv, tsv, json, parquet and the dataset layout (H1-H5).

Writes are distributed (one part file per partition) into a directory named
like the reference's file.  Row order, when wanted, is restored with a range
repartition + per-partition sort on the carried order columns - never by
funnelling rows through one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import FORMATS
from . import splits

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
DATASET_DIR = "datasets"                 # published layout: datasets/{name}/{file}
FILE_STAMP = "%Y%m%d_%H%M%S"             # {name}_{stamp}.{fmt}
# ---------------------------------------------------------------------------
TS_NTZ_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def dataset_path(base: str, dataset_name: str, fmt: str, when: datetime | None = None) -> str:
    """H5: {base}/datasets/{name}/{name}_{yyyyMMdd_HHmmss}.{fmt}"""
    stamp = (when or datetime.now()).strftime(FILE_STAMP)
    return f"{base.rstrip('/')}/{DATASET_DIR}/{dataset_name}/{dataset_name}_{stamp}.{fmt}"


def published_key(path: str) -> str:
    """The 'datasets/{name}/{file}' key of a dataset path."""
    i = path.find(f"/{DATASET_DIR}/")
    return path[i + 1:] if i >= 0 else path


def _text_options(sep: str) -> dict[str, str]:
    # header, no index; null and '' both as an empty field; quotes doubled (not
    # backslash-escaped); surrounding spaces kept (Spark trims them on write by
    # default); timestamps with microseconds so a read-back is exact.
    return {"header": "true", "sep": sep, "emptyValue": "", "nullValue": "", "quote": '"',
            "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "timestampNTZFormat": TS_NTZ_FORMAT}


def _python_booleans(df: DataFrame) -> DataFrame:
    """Booleans as True / False in text output (the spelling pandas writes)."""
    from pyspark.sql import functions as F
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit("True")).when(~c, F.lit("False")).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def _pandas_datetimes(df: DataFrame) -> DataFrame:
    """Timestamps as text at the coarsest resolution the column needs, as pandas
    writes them: 'YYYY-MM-DD' when every time is midnight, then whole seconds,
    else microseconds.  One aggregate over the timestamp columns only."""
    from pyspark.sql import functions as F
    ts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    if not ts:
        return df
    aggs = []
    for i, c in enumerate(ts):
        col = F.col(f"`{c}`")
        aggs += [F.max(F.date_format(col, "HH:mm:ss.SSSSSS") != "00:00:00.000000").alias(f"t{i}"),
                 F.max(F.date_format(col, "SSSSSS") != "000000").alias(f"f{i}")]
    st = df.agg(*aggs).first()
    repl = {}
    for i, c in enumerate(ts):
        pattern = ("yyyy-MM-dd HH:mm:ss.SSSSSS" if st[f"f{i}"] else
                   "yyyy-MM-dd HH:mm:ss" if st[f"t{i}"] else "yyyy-MM-dd")
        repl[c] = F.date_format(F.col(f"`{c}`"), pattern).alias(c)
    return df.select(*[repl.get(c, F.col(f"`{c}`")) for c in df.columns])


def write_dataset(df: DataFrame, path: str, fmt: str, order_by: list[str] | None = None,
                  partitions: int | None = None, mode: str = "errorifexists",
                  keep: list[str] | None = None, pandas_datetimes: bool = True) -> str:
    """H1-H4.  ``order_by`` keeps file order equal to row order (range partitioning
    + sortWithinPartitions); ``keep`` then projects the output columns (a
    projection after the sort keeps the order, so order columns need not be
    written)."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt!r} is no output format; known ones: " + ", ".join(FORMATS))
    out = df
    if order_by:
        out = (out.repartitionByRange(partitions, *order_by) if partitions else out.repartitionByRange(*order_by)) \
            .sortWithinPartitions(*order_by)
    if keep:
        out = out.select(*[f"`{c}`" for c in keep])
    if fmt in ("csv", "tsv"):
        out = _python_booleans(out)
        if pandas_datetimes:
            out = _pandas_datetimes(out)
    w = out.write.mode(mode)
    if fmt in ("csv", "tsv"):
        w.options(**_text_options("," if fmt == "csv" else "\t")).csv(path)
    elif fmt == "json":
        w.option("ignoreNullFields", "false").option("timestampNTZFormat", TS_NTZ_FORMAT).json(path)
    else:
        w.parquet(path)
    return path


def read_dataset(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a written dataset back (with its schema when known: no inference pass)."""
    if fmt in ("csv", "tsv"):
        opts = _text_options("," if fmt == "csv" else "\t")
        opts.pop("timestampNTZFormat")          # the default parser reads every written shape
        if schema is None:
            opts["inferSchema"] = "true"
        return splits.read_csv(spark, path, opts, schema)
    if fmt == "json":
        r = spark.read.option("timestampNTZFormat", TS_NTZ_FORMAT)
        return (r.schema(schema) if schema is not None else r).json(path)
    return spark.read.parquet(path)
