"""Parsing a table of raw text replies.

Input: (batch_num, attempt, response).  Each reply is small (one batch of
rows), so the whole parse is per-row column expressions plus explode - no
shuffle until something groups the result.  At scale the replies table is
read once; ``parse_csv_replies`` returns one frame that the rows, rejects and
status views all filter, so persist it when more than one is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_fields, split_records, strip_fences

REPLY_KEYS = ["batch_num", "attempt"]


@dataclass
class ParsedReplies:
    records: DataFrame      # one row per record (or per empty reply) with flags
    columns: list[str]
    carry: tuple[str, ...] = ()

    @property
    def rows(self) -> DataFrame:
        """Accepted rows, all text, with (batch_num, attempt, pos) kept for order
        (plus any carried reply columns, e.g. an arrival time)."""
        ok = self.records.where(F.col("_valid"))
        return ok.select(*REPLY_KEYS, "pos", *self.carry,
                         *[F.col("_fields")[i].alias(c) for i, c in enumerate(self.columns)])

    @property
    def rejects(self) -> DataFrame:
        """E5: malformed records with their field count and text."""
        bad = self.records.where(F.col("_record").isNotNull() & ~F.col("_header") & ~F.col("_valid"))
        return bad.select(*REPLY_KEYS, "pos", F.size("_fields").alias("n_fields"),
                          F.col("_record").alias("record"))

    @property
    def status(self) -> DataFrame:
        """One row per reply: rows kept, rejects, and ok/failed (no valid row)."""
        return reply_status_from(self.records)


def parse_csv_replies(replies: DataFrame, columns: list[str], response_col: str = "response",
                      carry: list[str] | None = None) -> ParsedReplies:
    """Strip fences, split records outside quotes, split fields, drop a header
    record (first field equals the first column name, tested before the width),
    accept exactly len(columns) fields.  ``carry`` names reply columns to keep."""
    n = len(columns)
    carry = tuple(carry or ())
    text = strip_fences(F.col(response_col))
    exploded = replies.select(*REPLY_KEYS, *carry,
                              F.posexplode_outer(split_records(text)).alias("pos", "_record"))
    fields = split_fields(F.col("_record"))
    first = F.lower(F.element_at(F.col("_fields"), 1))
    out = (exploded.withColumn("_fields", fields)
           .withColumn("_header", F.coalesce(first == F.lit(columns[0].lower()), F.lit(False)))
           .withColumn("_valid", F.col("_record").isNotNull() & ~F.col("_header")
                       & (F.size("_fields") == F.lit(n))))
    return ParsedReplies(out, columns, carry)


def reply_status_from(records: DataFrame) -> DataFrame:
    agg = records.groupBy(*REPLY_KEYS).agg(
        F.count_if(F.col("_valid")).alias("rows_parsed"),
        F.count_if(F.col("_record").isNotNull() & ~F.col("_header") & ~F.col("_valid")).alias("rejected"))
    return agg.withColumn("status", F.when(F.col("rows_parsed") > 0, "ok").otherwise("failed"))


# --- JSON replies (free mode) -------------------------------------------------
def _json_elements(replies: DataFrame, response_col: str) -> DataFrame:
    """Replies with ``_elems``, the texts of an array's elements, and ``_reason``, why a
    reply fails (null where it is an array of objects)."""
    text = strip_fences(F.col(response_col))
    out = replies.select(*REPLY_KEYS, text.alias("_text"), F.from_json(text, "array<string>").alias("_elems"))
    odd = F.exists("_elems", lambda x: F.coalesce(F.json_object_keys(x).isNull(), F.lit(True)))
    return out.withColumn("_reason", F.when(F.col("_elems").isNull(), "not a JSON array")
                          .when(odd, "an element is not an object"))


def json_union_schema(elements: DataFrame, elem_col: str = "_elem",
                      order_cols: list[str] | None = None) -> list[tuple[str, str]]:
    """Union of object keys in first-seen order, with one Spark type per key, from
    one aggregate grouped by key: each object is exploded into (key, value) pairs
    (``try_parse_json`` cast to a map of variants), the key's document position
    comes from ``json_object_keys``, and per key we keep the earliest
    (order_cols, position) and the merged value type (``schema_of_variant_agg``).
    The result is key-sized, not data-sized."""
    order_cols = order_cols or []
    e = F.col(elem_col)
    pairs = elements.select(*order_cols, F.json_object_keys(e).alias("__keys"),
                            F.explode(F.try_variant_get(F.try_parse_json(e), "$", "map<string,variant>"))
                            .alias("key", "__v"))
    pairs = pairs.withColumn("__kpos", F.array_position("__keys", F.col("key")))
    per_key = pairs.groupBy("key").agg(F.min(F.struct(*order_cols, "__kpos")).alias("o"),
                                       F.schema_of_variant_agg("__v").alias("t"))
    return [(r["key"], _to_spark_type(r["t"] or "STRING")) for r in per_key.orderBy("o").collect()]


def _to_spark_type(variant_type: str) -> str:
    t = variant_type.upper()
    if t in ("BIGINT", "INT", "SMALLINT", "TINYINT"):
        return "bigint"
    if t.startswith("DECIMAL") or t in ("DOUBLE", "FLOAT"):
        return "double"
    if t == "BOOLEAN":
        return "boolean"
    return "string"      # strings, nested values, mixed types: keep the JSON text


def parse_json_replies(replies: DataFrame, response_col: str = "response",
                       schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """A reply that is a JSON array of objects becomes rows (any other reply gives
    none, see ``json_reply_status``); the columns are
    the union of keys (first-seen order), missing keys are null.  The schema
    pass is one small aggregate; pass ``schema`` to skip it."""
    elems = _json_elements(replies, response_col).where("_reason is null")
    exploded = elems.select(*REPLY_KEYS, F.posexplode("_elems").alias("pos", "_elem"))
    if schema is None:
        schema = json_union_schema(exploded, "_elem", REPLY_KEYS + ["pos"])
    if not schema:                       # no object anywhere: no rows, no columns
        return exploded.select(*REPLY_KEYS, "pos").where(F.lit(False))
    struct = ", ".join(f"`{k}` {t}" for k, t in schema)
    parsed = exploded.select(*REPLY_KEYS, "pos", F.from_json("_elem", f"struct<{struct}>").alias("_o"))
    return parsed.select(*REPLY_KEYS, "pos", *[F.col("_o").getField(k).alias(k) for k, _ in schema])


def json_reply_status(replies: DataFrame, response_col: str = "response") -> DataFrame:
    """E7 for JSON mode: failed when the text is not a JSON array (bad or truncated) or
    when one of its elements is not an object."""
    elems = _json_elements(replies, response_col)
    ok = F.col("_reason").isNull()
    return elems.select(*REPLY_KEYS,
                        F.when(ok, F.size("_elems")).otherwise(F.lit(0)).alias("rows_parsed"),
                        F.when(ok, "ok").otherwise("failed").alias("status"))


def parse_json_column(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """E6 applied to a column of JSON objects (one object per row)."""
    el = df.select(*keep, F.col(col).alias("_elem"))
    schema = json_union_schema(el, "_elem", [])
    if not schema:
        return el.select(*keep)
    struct = ", ".join(f"`{k}` {t}" for k, t in schema)
    parsed = el.select(*keep, F.from_json("_elem", f"struct<{struct}>").alias("_o"))
    return parsed.select(*keep, *[F.col("_o").getField(k).alias(k) for k, _ in schema])


# --- rows -> reply text (round trip, offline hand-off) ------------------------
def rows_to_csv_replies(df: DataFrame, line: Column, batch: Column, order: Column | None = None,
                        header: str | None = None) -> DataFrame:
    """Render rows as one CSV reply per batch (bounded by the batch size): the
    lines are gathered per batch and joined by newlines, ordered by ``order``
    (or by the line text itself when no order is given)."""
    if order is None:
        g = df.select(batch.alias("batch_num"), line.alias("_line")) \
            .groupBy("batch_num").agg(F.array_sort(F.collect_list("_line")).alias("_ls"))
        body = F.array_join("_ls", "\n")
    else:
        g = df.select(batch.alias("batch_num"), order.alias("_o"), line.alias("_line")) \
            .groupBy("batch_num").agg(F.array_sort(F.collect_list(F.struct("_o", "_line"))).alias("_ls"))
        body = F.array_join(F.transform("_ls", lambda s: s["_line"]), "\n")
    if header:
        body = F.concat(F.lit(header + "\n"), body)
    return g.select("batch_num", F.lit(0).alias("attempt"), body.alias("response"))

