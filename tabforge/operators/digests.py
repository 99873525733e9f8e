"""Grouping by long values without shuffling them.

Two steps: 128 bits of hash and the length of a row's values are counted first, which
shuffles 24 bytes a row and no text.  The hashes that occur twice or more are set in a
bitmap of at most 16 MB (4,096 rows of 4 KB, built by Spark's bitmap aggregates and
broadcast).  Rows whose bit is not set have no equal row and are settled where they are
read; only the others are grouped, and by their values, so results never depend on a hash.
A bitmap that fills up (far above 10^8 repeated values) lets more rows through to the
grouping and changes nothing else.

The input is read once for the hashes and once or twice for the values, so it must give the
same rows each time: a stored table, not a fresh random draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 32_768                # Fixed value: bits of one bitmap of Spark's aggregate (4 KB)
BUCKETS = 4_096                     # 2^27 bits in all, 16 MB

DIGEST = ["__d1", "__d2", "__dlen"]


def hashable(df: DataFrame, columns: list[str]) -> bool:
    """Whether Spark can hash the columns by value: no maps or variants inside, and no
    collation under which different bytes are equal."""
    def plain(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t)
        if isinstance(t, T.StringType):
            return getattr(t, "collation", "UTF8_BINARY") in (None, "UTF8_BINARY")
        return not isinstance(t, (T.MapType, T.VariantType))
    return all(plain(df.schema[c].dataType) for c in columns)


def digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two differently salted 64-bit hashes of the columns and the length of their strings.
    Equal rows (nulls equal) have equal digests."""
    cols = [F.col(f"`{c}`") for c in columns]
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(-1)).cast("bigint") for c in columns
             if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    length = sum(texts[1:], texts[0]) if texts else F.lit(0).cast("bigint")
    return [F.xxhash64(F.lit(1), *cols).alias(DIGEST[0]), F.xxhash64(F.lit(2), *cols).alias(DIGEST[1]),
            length.alias(DIGEST[2])]


def _place(h: Column) -> tuple[Column, Column]:
    """Bitmap bucket and bit of a hash."""
    at = F.pmod(h, F.lit(BUCKETS * BUCKET_BITS))
    return F.call_function("div", at, F.lit(BUCKET_BITS)).alias("__bucket"), at % BUCKET_BITS


def bitmap(hashes: DataFrame, name: str = DIGEST[0]) -> DataFrame:
    """(__bucket, __bits): the hashes of a column as at most BUCKETS bitmaps."""
    bucket, bit = _place(F.col(name))
    return hashes.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("__bits"))


def flag(df: DataFrame, h: Column, bits: DataFrame, name: str = "__again") -> DataFrame:
    """``df`` with a boolean: the bit of hash ``h`` is set.  No row of ``df`` is shuffled."""
    bucket, bit = _place(h)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    is_set = F.getbit(byte.cast("bigint"), (F.col("__bit") % 8).cast("int")) == 1
    return (df.withColumns({"__bucket": bucket, "__bit": bit})
            .join(F.broadcast(bits), "__bucket", "left")
            .withColumn(name, F.coalesce(is_set, F.lit(False)))
            .drop("__bucket", "__bit", "__bits"))


def flag_repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``__again``: false only for rows that no other row equals on ``columns``."""
    repeated = (df.select(*digest(df, columns)).groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1))
    return flag(df, digest(df, columns)[0], bitmap(repeated))


def settled_and_repeated(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows without an equal on ``columns``, and the rows that may have one."""
    flagged = flag_repeated(df, columns)
    return flagged.where(~F.col("__again")).drop("__again"), flagged.where(F.col("__again")).drop("__again")
