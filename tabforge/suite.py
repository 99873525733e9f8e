"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator
from the survey's inventory, all reading the driver tables (or data Spark
derives from them) in full."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import assemble, generate, keys, ledger, profile, replies, validate
from .operators.compaction import CompactedLedger
from .spec import ColumnContract, DatasetSpec
from .plans import batches, job, prompts
from .session import parallelism, scratch_path
from .sources import readers, sinks
from .streaming import replies_stream
from .fixtures import GEN_CONTRACTS, NOVEL_CONTRACT, TABLES, UNIQUE_CONTRACT, VALIDATE_CONTRACTS, customer_profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


_LOADED: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  The tables are read-only, so the DataFrame (with its file
    listing and footer schema) is reused within a session; the cache entry goes
    away with the session object."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    per_session = _LOADED.setdefault(spark, {})
    if path not in per_session:
        per_session[path] = spark.read.parquet(path)
    return per_session[path]


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: load(spark, sf_dir, t) for t in TABLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of lineitem with the key-quality report on l_orderkey (one scan)."""
    return profile.profile(load(spark, sf_dir, "lineitem"), "lineitem", key="l_orderkey")


QUERIES["profile_key_lineitem"] = flagship


# --- A: profiling ------------------------------------------------------------
def _profile_query(table: str):
    def run(spark, sf_dir):
        return profile.profile(load(spark, sf_dir, table), table, path=f"{sf_dir.rstrip('/')}/{table}.parquet")
    return run


for _t in ("customer", "orders", "documents", "events"):
    QUERIES[f"profile_{_t}"] = _profile_query(_t)


@query("contract_catalog")
def q_contract_catalog(spark, sf_dir):
    """A5-A7 for all 14 tables: contract type, nullable flag and row count per column
    (one aggregate scan per table)."""
    from .operators.assemble import assemble as union_all
    return union_all([profile.profile(df, t, path=f"{sf_dir.rstrip('/')}/{t}.parquet")
                      for t, df in all_tables(spark, sf_dir).items()])


@query("detect_keys_all")
def q_detect_keys_all(spark, sf_dir):
    """B1 on every table's contract, then B3 on the detected key over the table's
    data (a detected key may repeat: conversations.conv_id)."""
    from .operators.assemble import assemble as union_all
    tables = all_tables(spark, sf_dir)
    detected = keys.detect_keys(profile.contract_catalog(profile.catalog(spark, tables)))
    found = {r["table_name"]: r["primary_key"] for r in detected.collect()}      # one row per table
    parts = []
    for t, pk in found.items():
        if pk:
            parts.append(keys.key_quality(tables[t], pk).select(F.lit(t).alias("table_name"), "*"))
    report = union_all(parts)
    return detected.join(report.withColumnRenamed("primary_key_column", "primary_key"),
                         ["table_name", "primary_key"], "left")


@query("candidate_keys_conversations")
def q_candidate_keys(spark, sf_dir):
    df = load(spark, sf_dir, "conversations")
    return keys.verify_candidate_keys(df, df.columns)


@query("key_quality_lineitem")
def q_kq_lineitem(spark, sf_dir):
    return keys.key_quality(load(spark, sf_dir, "lineitem"), "l_orderkey")


@query("key_quality_orders")
def q_kq_orders(spark, sf_dir):
    return keys.key_quality(load(spark, sf_dir, "orders"), "o_orderkey")


@query("key_quality_nulls")
def q_kq_nulls(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    m = F.col("user_id") % 7
    blanked = ev.select(F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit(""))
                        .otherwise(F.col("user_id").cast("string")).alias("user_key"))
    return keys.key_quality(blanked, "user_key")


@query("samples_part")
def q_samples_part(spark, sf_dir):
    return profile.sample_rows(load(spark, sf_dir, "part"), 10, order_by=["p_partkey"])


# --- C: batch plans ------------------------------------------------------------
def table_specs(spark, sf_dir, names: list[str] | None = None) -> DataFrame:
    """One spec row per table: (dataset_name, rows = count(*), num_columns)."""
    from .operators.assemble import assemble
    parts = []
    for t in names or TABLES:
        df = load(spark, sf_dir, t)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(t).alias("dataset_name"), "rows", F.lit(len(df.columns)).alias("num_columns")))
    return assemble(parts)


@query("batch_plan_all")
def q_batch_plan_all(spark, sf_dir):
    return batches.plan_batches(table_specs(spark, sf_dir))


@query("seed_keys_orders")
def q_seed_keys_orders(spark, sf_dir):
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["orders"]))
    return batches.seed_keys(plan, "o_orderkey")


@query("default_text_all")
def q_default_text_all(spark, sf_dir):
    """C6 applied to a request per table: rows = count(*), width = column count,
    batch size (C1), and the default description / criteria."""
    texts = batches.default_texts(profile.catalog(spark, all_tables(spark, sf_dir)))
    specs = table_specs(spark, sf_dir).withColumn("batch_size", batches.batch_size(F.col("num_columns")))
    return specs.join(texts, "dataset_name")


# --- E: replies ----------------------------------------------------------------
CUST_REPLY_COLS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def customer_replies(spark, sf_dir, cut_every: int | None = None) -> DataFrame:
    """Customer rows rendered as CSV replies of 30 rows, with the shapes a model
    produces: quoted commas, escaped quotes, quoted newlines, padded values,
    blank lines, fenced replies and header rows."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = (F.when(k % 10 == 3, F.concat(F.lit('"'), F.col("c_name"), F.lit(', Inc"')))
            .when(k % 10 == 7, F.concat(F.lit('"'), F.col("c_name"), F.lit(' ""VIP"""')))
            .when(k % 10 == 9, F.concat(F.lit('"'), F.col("c_name"), F.lit('\nline2"')))
            .otherwise(F.col("c_name")))
    seg = F.when(k % 10 == 5, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).otherwise(F.col("c_mktsegment"))
    full = F.concat_ws(",", k.cast("string"), name, F.col("c_nationkey").cast("string"), seg)
    line = full
    if cut_every:
        short = F.concat_ws(",", k.cast("string"), name, F.col("c_nationkey").cast("string"))
        line = F.when(k % cut_every == 0, short).otherwise(full)
    line = F.when(k % 30 == 15, F.concat(line, F.lit("\n"))).otherwise(line)
    r = replies.rows_to_csv_replies(c, line, F.floor(k / 30), k)
    b = F.col("batch_num")
    body = F.when(b % 4 == 2, F.concat(F.lit(",".join(CUST_REPLY_COLS) + "\n"), F.col("response"))) \
        .otherwise(F.col("response"))
    body = F.when(b % 3 == 1, F.concat(F.lit("```csv\n"), body, F.lit("\n```"))).otherwise(body)
    return r.select("batch_num", "attempt", body.alias("response"))


@query("parse_csv_customer")
def q_parse_csv_customer(spark, sf_dir):
    parsed = replies.parse_csv_replies(customer_replies(spark, sf_dir), CUST_REPLY_COLS)
    return parsed.rows.drop("pos")


@query("rejects_customer")
def q_rejects_customer(spark, sf_dir):
    parsed = replies.parse_csv_replies(customer_replies(spark, sf_dir, cut_every=17), CUST_REPLY_COLS)
    return parsed.rejects.select("batch_num", "n_fields", "record")


def event_replies(spark, sf_dir, break_every: int | None = None) -> DataFrame:
    """Events as JSON-array replies of 20 objects; 'view' events omit ``value``
    (so the column set is a union); optionally every n-th reply is truncated."""
    ev = load(spark, sf_dir, "events")
    obj = F.to_json(F.struct("event_id", "user_id", "event_type",
                             F.when(F.col("event_type") != "view", F.col("value")).alias("value"), "props"))
    g = ev.select(F.floor(F.col("event_id") / 20).alias("batch_num"), F.col("event_id").alias("_o"),
                  obj.alias("_j")).groupBy("batch_num").agg(
        F.array_sort(F.collect_list(F.struct("_o", "_j"))).alias("_js"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_js", lambda s: s["_j"]), ","), F.lit("]"))
    out = g.select("batch_num", F.lit(0).alias("attempt"), text.alias("response"))
    if break_every:
        out = out.withColumn("response", F.when(
            F.col("batch_num") % break_every == 3,
            F.expr("substring(response, 1, length(response) - 1)")).otherwise(F.col("response")))
    return out


@query("parse_json_events")
def q_parse_json_events(spark, sf_dir):
    return replies.parse_json_replies(event_replies(spark, sf_dir)).drop("pos")


@query("props_union")
def q_props_union(spark, sf_dir):
    return replies.parse_json_column(load(spark, sf_dir, "events"), "props", ["event_id"])


@query("reply_status")
def q_reply_status(spark, sf_dir):
    return replies.json_reply_status(event_replies(spark, sf_dir, break_every=5))


# --- F: cleaning and assembly ---------------------------------------------------
LINEITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dedup_lineitem_key")
def q_dedup_lineitem(spark, sf_dir):
    li = assemble.drop_missing_keys(load(spark, sf_dir, "lineitem"), "l_orderkey")
    return assemble.dedup_global(li, "l_orderkey", LINEITEM_ORDER)


@query("dedup_documents_text")
def q_dedup_documents(spark, sf_dir):
    docs = assemble.drop_missing_keys(load(spark, sf_dir, "documents"), "text")
    return assemble.dedup_global(docs, "text", ["doc_id"], long_values=True).select("doc_id", "lang", "source", "n_chars")


@query("dropped_documents")
def q_dropped_documents(spark, sf_dir):
    return assemble.dropped_duplicates(load(spark, sf_dir, "documents"), "text", long_values=True)


@query("exclude_claimed_orders")
def q_exclude_claimed(spark, sf_dir):
    return assemble.exclude_claimed(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"),
                                    "o_orderkey", "l_orderkey")


def _orders_plan_and_kept(spark, sf_dir):
    from .spec import batch_size_for
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["orders"]))
    size = batch_size_for(len(load(spark, sf_dir, "orders").columns))
    kept = (load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("row_idx")).distinct()
            .withColumn("batch_num", F.floor((F.col("row_idx") - 1) / size) + 1))
    return plan, kept


@query("shortfall_lineitem")
def q_shortfall(spark, sf_dir):
    plan, kept = _orders_plan_and_kept(spark, sf_dir)
    return assemble.shortfall(plan, kept)


@query("retry_plan_lineitem")
def q_retry_plan(spark, sf_dir):
    plan, kept = _orders_plan_and_kept(spark, sf_dir)
    rp = assemble.retry_plan(plan, kept, attempt=0, prefix=batches.key_prefix("o_orderkey"))
    return rp.select("batch_num", "attempt", "target_rows", "start_idx", "end_idx", "temperature",
                     F.array_join("seed_keys", ",").alias("seeds"))


@query("assemble_union")
def q_assemble_union(spark, sf_dir):
    return assemble.assemble([load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")])


@query("trim_to_rows")
def q_trim_to_rows(spark, sf_dir):
    return assemble.trim_to_rows(load(spark, sf_dir, "lineitem"), "l_orderkey", LINEITEM_ORDER, 3)


# --- D: generation ----------------------------------------------------------------
TABLE_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"}


def _table_skeleton(spark, sf_dir, table: str):
    """One generated row per row of a driver table, addressed by that row's key."""
    return generate.key_skeleton(load(spark, sf_dir, table), TABLE_KEYS[table])


def _gen(spark, sf_dir, columns, pk=None):
    spec = DatasetSpec("gen", 1, columns=columns, primary_key=pk)
    return generate.generate(spark, spec, skeleton=_table_skeleton(spark, sf_dir, "customer")).drop("batch_num")


def _gen_query(name: str, columns: list[dict], pk: str | None = None):
    QUERIES[name] = lambda spark, sf_dir: _gen(spark, sf_dir, columns, pk)


for _name, _cols in GEN_CONTRACTS.items():
    _gen_query(_name, _cols)
QUERIES["gen_users"] = lambda spark, sf_dir: _gen(spark, sf_dir, [c.to_dict() for c in customer_profile()],
                                                  pk="customer_id")


@query("mimic_segment")
def q_mimic_segment(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    return generate.mimic_categorical(_table_skeleton(spark, sf_dir, "customer").drop("batch_num"), cust, "c_mktsegment")


@query("mimic_nullable")
def q_mimic_nullable(spark, sf_dir):
    """D8 over a column a third of which is null: nulls are drawn at their own share."""
    cust = load(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")))
    return generate.mimic_categorical(_table_skeleton(spark, sf_dir, "customer").drop("batch_num"), cust, "c_mktsegment")


@query("mimic_orderdate")
def q_mimic_orderdate(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return generate.mimic_numeric(_table_skeleton(spark, sf_dir, "orders").drop("batch_num"), orders, "o_orderdate")


@query("mimic_price")
def q_mimic_price(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return generate.mimic_numeric(_table_skeleton(spark, sf_dir, "orders").drop("batch_num"), orders, "o_totalprice")


@query("mimic_price_nullable")
def q_mimic_price_nullable(spark, sf_dir):
    """D8b over a column a third of which is null: nulls are drawn at their own share."""
    orders = load(spark, sf_dir, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")))
    return generate.mimic_numeric(_table_skeleton(spark, sf_dir, "orders").drop("batch_num"), orders, "o_totalprice")


@query("gen_unique_rows")
def q_gen_unique_rows(spark, sf_dir):
    """D10 by construction: one row per part, distinct without a key and without a shuffle."""
    spec = DatasetSpec("unique", 1, columns=UNIQUE_CONTRACT)
    part = load(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("p_partkey"))
    return generate.generate_unique(spark, spec, skeleton=generate.key_skeleton(part, "p_partkey")).drop("batch_num")


def _novel_samples(spark, sf_dir):
    """Combinations of the first ten parts, few enough for generated rows to meet them."""
    lead = load(spark, sf_dir, "part").orderBy("p_partkey").limit(10)
    return lead.select((F.col("p_partkey") % 2 == 0).alias("flag"), (1 + F.col("p_partkey") % 3).cast("bigint").alias("level"))


@query("novel_rows_redrawn")
def q_novel_rows_redrawn(spark, sf_dir):
    """One row per customer of ten possible combinations, none a sample's, none lost."""
    spec = DatasetSpec("novel", 1, columns=NOVEL_CONTRACT)
    return generate.generate_novel(spark, spec, _novel_samples(spark, sf_dir),
                                   skeleton=_table_skeleton(spark, sf_dir, "customer")).drop("batch_num")


def _part_samples(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part, part.orderBy("p_partkey").limit(10)


@query("novel_rows")
def q_novel_rows(spark, sf_dir):
    part, samples = _part_samples(spark, sf_dir)
    return generate.drop_sample_copies(part, samples)


@query("sample_copies_part")
def q_sample_copies(spark, sf_dir):
    part, samples = _part_samples(spark, sf_dir)
    return generate.sample_copies(part, samples)


def _orders_and_samples(spark, sf_dir):
    """Orders by customer and status; the ten first ones are the samples, which other orders repeat."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders, orders.orderBy("o_orderkey").limit(10).select("o_custkey", "o_orderstatus")


@query("sample_copies_orders")
def q_sample_copies_orders(spark, sf_dir):
    return generate.sample_copies(*_orders_and_samples(spark, sf_dir))


@query("novel_rows_orders")
def q_novel_rows_orders(spark, sf_dir):
    orders, samples = _orders_and_samples(spark, sf_dir)
    return generate.drop_sample_copies(orders, samples, samples.columns)


# --- G: validation ----------------------------------------------------------------
def _validate_query(table: str, name: str):
    def run(spark, sf_dir):
        contract = [ColumnContract.from_dict(d) for d in VALIDATE_CONTRACTS[table]]
        return validate.column_checks(load(spark, sf_dir, table), contract)
    QUERIES[name] = run


_validate_query("customer", "validate_customer")
_validate_query("pages", "validate_pages_url")
_validate_query("lineitem", "validate_ranges")


@query("row_uniqueness_documents")
def q_row_uniqueness(spark, sf_dir):
    dup = validate.duplicate_rows(load(spark, sf_dir, "documents"), ["lang", "source", "text"], long_values=True)
    return dup.select("lang", "source", F.md5("text").alias("text_md5"), "copies")


@query("key_continuity_lineitem")
def q_key_continuity_lineitem(spark, sf_dir):
    return validate.key_gaps(load(spark, sf_dir, "lineitem"), F.col("l_orderkey"))


@query("key_continuity_orders")
def q_key_continuity_orders(spark, sf_dir):
    return validate.key_gaps(load(spark, sf_dir, "orders"), F.col("o_orderkey"))


@query("key_continuity_seeded")
def q_key_continuity_seeded(spark, sf_dir):
    """Seeded text keys of the orders plan with the claimed rows (those with line
    items) kept: breaks show where the kept sequence skips."""
    plan, kept = _orders_plan_and_kept(spark, sf_dir)
    keys = batches.seed_keys(plan, "o_orderkey").join(kept.select("row_idx"), "row_idx", "left_semi")
    return validate.key_gaps(keys, validate.key_suffix(F.col("seed_key")))


@query("low_variety_part")
def q_low_variety(spark, sf_dir):
    return validate.low_variety(load(spark, sf_dir, "part"))


@query("low_variety_documents")
def q_low_variety_documents(spark, sf_dir):
    """Texts and ids, which no sketch settles, beside columns that one does."""
    top = validate.low_variety(load(spark, sf_dir, "documents"))
    return top.select("column_name", F.md5("top_value").alias("top_md5"), "top_count", "total", "top_share")


@query("placeholder_documents")
def q_placeholder(spark, sf_dir):
    return validate.placeholder_hits(load(spark, sf_dir, "documents"), "text")


def _event_halves(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    b = ev.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    mid = (b["lo"] + b["hi"]) // 2
    return ev.where(F.col("event_id") <= mid), ev.where(F.col("event_id") > mid)


@query("drift_events")
def q_drift(spark, sf_dir):
    a, b = _event_halves(spark, sf_dir)
    return validate.drift(a, b, "event_type")


@query("drift_tvd_events")
def q_drift_tvd(spark, sf_dir):
    a, b = _event_halves(spark, sf_dir)
    return validate.total_variation(validate.drift(a, b, "event_type"))


@query("drift_ks_events")
def q_drift_ks(spark, sf_dir):
    """Values of the first half of the events against those of the second."""
    a, b = _event_halves(spark, sf_dir)
    return validate.drift_ks(a, b, "value")


@query("drift_ks_event_times")
def q_drift_ks_times(spark, sf_dir):
    """As above on a time: the first type of event against the others."""
    ev = load(spark, sf_dir, "events")
    kind = ev.agg(F.min("event_type").alias("kind")).first()["kind"]
    return validate.drift_ks(ev.where(F.col("event_type") == kind), ev.where(F.col("event_type") != kind), "ts")


# --- H: sinks -----------------------------------------------------------------------
def _roundtrip(spark, sf_dir, table: str, fmt: str, order_by: list[str]):
    df = load(spark, sf_dir, table)
    path = sinks.dataset_path(scratch_path(spark, "sink"), table, fmt)
    sinks.write_dataset(df, path, fmt, order_by=order_by)
    return sinks.read_dataset(spark, path, fmt, schema=df.schema)


for _fmt in ("csv", "tsv", "json", "parquet"):
    QUERIES[f"sink_roundtrip_{_fmt}"] = (lambda f: lambda spark, sf_dir: _roundtrip(
        spark, sf_dir, "nation", f, ["n_nationkey"]))(_fmt)
QUERIES["sink_roundtrip_orders_csv"] = lambda spark, sf_dir: _roundtrip(spark, sf_dir, "orders", "csv", ["o_orderkey"])
QUERIES["sink_roundtrip_customer_tsv"] = lambda spark, sf_dir: _roundtrip(spark, sf_dir, "customer", "tsv",
                                                                          ["c_custkey"])


# --- I: job ledger ------------------------------------------------------------------
LEDGER_NOW = 883612800          # 1998-01-01T00:00:00Z, the "now" of the expiry query
LEDGER_GET_ID = "job-7"


def jobs_from_orders(orders: DataFrame) -> DataFrame:
    """Job records derived from orders: one job id per customer, so ids repeat and
    later writes replace earlier ones; some records lack generated_at, some have
    an empty s3_key, some point outside 'datasets/'."""
    k = F.col("o_orderkey")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("csv", "json", "parquet", "tsv")]), (k % 4 + 1).cast("int"))
    job = F.concat(F.lit("job-"), F.col("o_custkey").cast("string"))
    written = F.col("o_orderdate") + F.make_dt_interval(secs=k.cast("decimal(18,6)"))   # UTC wall time
    return orders.select(
        job.alias("job_id"), F.col("o_orderpriority").alias("dataset_name"),
        F.col("o_totalprice").cast("long").alias("rows"), fmt.alias("format"),
        F.when(k % 2 == 0, F.lit('["id", "name"]')).otherwise(F.lit('["id"]')).alias("columns"),
        F.when(k % 3 == 0, F.concat(F.lit("output/"), job, F.lit("."), fmt))
        .otherwise(F.concat(F.lit("datasets/"), F.col("o_orderpriority"), F.lit("/"), job, F.lit("."), fmt))
        .alias("file_path"),
        F.when(k % 5 == 0, F.concat(F.lit("datasets/s3/"), job)).when(k % 5 == 1, F.lit(""))
        .alias("s3_key"),
        F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("generated_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("success")).when(F.col("o_orderstatus") == "O", F.lit("partial"))
        .alias("status"),
        written.alias("written_at"))


def _ledger(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "ledger")
    ledger.save_jobs(jobs_from_orders(load(spark, sf_dir, "orders")), path)
    return ledger.read_ledger(spark, path)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("columns", F.array_join("columns", "|")) if "columns" in df.columns else df


@query("ledger_latest")
def q_ledger_latest(spark, sf_dir):
    return _flat(ledger.latest_jobs(_ledger(spark, sf_dir))).drop("written_at")


@query("ledger_get")
def q_ledger_get(spark, sf_dir):
    return _flat(ledger.get_job(_ledger(spark, sf_dir), LEDGER_GET_ID)).drop("written_at")


@query("ledger_resolve")
def q_ledger_resolve(spark, sf_dir):
    return ledger.resolve_artifacts(_ledger(spark, sf_dir))


@query("ledger_unexpired")
def q_ledger_unexpired(spark, sf_dir):
    return ledger.expire_jobs(_ledger(spark, sf_dir), LEDGER_NOW).select("job_id", "ttl", "status")


def _compacted_ledger(spark, sf_dir) -> CompactedLedger:
    """Records of the orders saved in three parts, the older two merged one by one, the third pending."""
    jobs = jobs_from_orders(load(spark, sf_dir, "orders"))
    part = F.pmod(F.xxhash64("job_id", "written_at"), F.lit(3))
    lg = CompactedLedger(spark, scratch_path(spark, "compacted-ledger"), buckets=16)
    for k in range(3):
        lg.save(jobs.where(part == k))
        if k < 2:
            lg.compact()
    return lg


@query("ledger_compacted")
def q_ledger_compacted(spark, sf_dir):
    return _compacted_ledger(spark, sf_dir).current().drop("written_at")


@query("ledger_get_compacted")
def q_ledger_get_compacted(spark, sf_dir):
    lg = _compacted_ledger(spark, sf_dir)
    lg.compact()
    return _flat(lg.get(LEDGER_GET_ID)).drop("written_at")


# --- J: streaming ---------------------------------------------------------------------
@query("stream_replies")
def q_stream_replies(spark, sf_dir):
    """Customer replies land as files (every 7th batch twice, as a second attempt);
    the stream claims each key once."""
    r = customer_replies(spark, sf_dir)
    again = r.where(F.col("batch_num") % 7 == 0).withColumn("attempt", F.lit(1))
    base = scratch_path(spark, "stream")
    r.unionByName(again).repartition(4).write.parquet(f"{base}/in")
    replies_stream.stream_replies(spark, f"{base}/in", CUST_REPLY_COLS, "c_custkey",
                                  f"{base}/out", f"{base}/ckpt", files_per_trigger=1)
    return spark.read.parquet(f"{base}/out").select(*CUST_REPLY_COLS)


@query("stream_claims_customer")
def q_stream_claims(spark, sf_dir):
    """The second attempts of every third batch arrive first and carry other values; every
    ninth batch has no first attempt.  The lowest (batch, attempt, pos) wins whatever came first."""
    r = customer_replies(spark, sf_dir)
    b = F.col("batch_num")
    second = replies.rows_to_csv_replies(
        load(spark, sf_dir, "customer"), F.concat_ws(",", "c_custkey", F.concat("c_name", F.lit(" again")), F.lit("99"),
                                                     F.lit("SECOND")), F.floor(F.col("c_custkey") / 30), F.col("c_custkey"))
    base = scratch_path(spark, "claims")
    early = second.where(b % 3 == 0).withColumn("attempt", F.lit(1))
    files = 2 * parallelism(spark)         # each arrival is written by all cores and read in about two batches
    early.repartition(files).write.parquet(f"{base}/in/arrival=1")
    r.where(b % 9 != 0).repartition(files).write.parquet(f"{base}/in/arrival=2")
    replies_stream.stream_claims(spark, f"{base}/in", CUST_REPLY_COLS, "c_custkey",
                                 f"{base}/out", f"{base}/ckpt", files_per_trigger=files // 2)
    return replies_stream.current_claims(spark, f"{base}/out", "c_custkey").drop("pos")


# --- C5 / C7: prompts and the completion hand-off ------------------------------------
def customer_spec(spark, sf_dir) -> tuple[DatasetSpec, list[dict]]:
    """A request mimicking the customer table: contract from its profile (A5+A6),
    five samples (A8), default texts (C6), explicit key c_custkey."""
    cust = load(spark, sf_dir, "customer")
    contract = profile.infer_contract(cust)
    texts = batches.default_texts(profile.catalog(spark, {"customer": cust})).first()
    samples = [r.asDict() for r in profile.sample_rows(cust, 5, order_by=["c_custkey"]).collect()]
    spec = DatasetSpec("customer", cust.count(), columns=contract, primary_key="c_custkey",
                       description=texts["description"], ai_criteria=texts["ai_criteria"])
    return spec, samples


@query("prompt_lengths")
def q_prompt_lengths(spark, sf_dir):
    spec, samples = customer_spec(spark, sf_dir)
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["customer"]))
    p = prompts.render_csv_prompts(plan, spec, samples)
    return p.select("batch_num", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


def echo_seeds_model(prompt: str, temperature: float, max_tokens: int) -> str:
    """A local deterministic stand-in for a model: answers with one CSV row per
    pre-seeded key (key, key length); fails for every 13th batch."""
    import json as _json
    import re as _re
    m = _re.search(r"\n(\[.*?\])\nDO NOT INVENT", prompt, _re.S)
    keys = _json.loads(m.group(1)) if m else []
    start = int(_re.search(r"generating rows (\d+) through", prompt).group(1))
    if (start - 1) // 30 % 13 == 12:
        raise RuntimeError("service unavailable")
    return "\n".join(f"{k},{len(k)}" for k in keys)


@query("complete_prompts_orders")
def q_complete_prompts(spark, sf_dir):
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["orders"]))
    spec = DatasetSpec("orders", load(spark, sf_dir, "orders").count(),
                       columns=[{"name": "order_key", "type": "string"}, {"name": "key_len", "type": "integer"}],
                       primary_key="order_key")
    replies_df = prompts.complete_prompts(prompts.render_csv_prompts(plan, spec), echo_seeds_model)
    parsed = replies.parse_csv_replies(replies_df.where(F.col("error").isNull()), ["order_key", "key_len"])
    return parsed.rows.select("batch_num", "order_key", "key_len")


@query("completion_errors_orders")
def q_completion_errors(spark, sf_dir):
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["orders"]))
    spec = DatasetSpec("orders", load(spark, sf_dir, "orders").count(),
                       columns=[{"name": "order_key", "type": "string"}, {"name": "key_len", "type": "integer"}],
                       primary_key="order_key")
    replies_df = prompts.complete_prompts(prompts.render_csv_prompts(plan, spec), echo_seeds_model)
    return replies_df.where(F.col("error").isNotNull()).select("batch_num", "attempt", "error")


# --- A: sources ------------------------------------------------------------------------
def _customer_semicolon_lines(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.concat_ws(";", *[F.col(x).cast("string") for x in c.columns]).alias("value"))


@query("delimiter_counts")
def q_delimiter_counts(spark, sf_dir):
    return readers.delimiter_counts(_customer_semicolon_lines(spark, sf_dir))


@query("delimiter_counts_long_quotes")
def q_delimiter_counts_long(spark, sf_dir):
    """A1b with a quoted field of several thousand characters on every line."""
    c = load(spark, sf_dir, "customer")
    long = F.concat(F.lit('"'), F.repeat(F.concat("c_name", F.lit(',""|""')), 300), F.lit('"'))
    return readers.delimiter_counts(c.select(F.concat_ws(";", "c_custkey", long, "c_mktsegment").alias("value")))


@query("read_multiline_customer")
def q_read_multiline(spark, sf_dir):
    """A1 over records that span lines: names with line ends, quotes and delimiters, some
    over many lines, cut inside splits."""
    c = load(spark, sf_dir, "customer")
    name = (F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\nsecond, "quoted"\n\nline')))
            .when(F.col("c_custkey") % 7 == 0, F.repeat(F.concat("c_name", F.lit("\n")), 40)).otherwise(F.col("c_name")))
    path = scratch_path(spark, "multiline") + ".csv"
    sinks.write_dataset(c.withColumn("c_name", name), path, "csv")
    return readers.read_any(spark, path)


@query("infer_json_contract_events")
def q_infer_json(spark, sf_dir):
    """A10: the contract of events as a JSON array, from its first object."""
    ev = load(spark, sf_dir, "events")
    objects = F.array_sort(F.collect_list(F.struct(
        "event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("_j"))))
    docs = (ev.groupBy(F.floor(F.col("event_id") / 1000).alias("doc")).agg(objects.alias("_js")).orderBy("doc")
            .select(F.concat(F.lit("["), F.array_join(F.transform("_js", lambda s: s["_j"]), ","), F.lit("]")).alias("doc")))
    contract, _, total = profile.infer_contract_from_json(docs)
    rows = [(i, c.name, c.type, c.nullable, total) for i, c in enumerate(contract)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, semantic_type string, nullable boolean, "
                                       "total_rows long")


@query("profile_json_roundtrip")
def q_profile_json_roundtrip(spark, sf_dir):
    """H3 written and read again through the reader of uploads (A3), then profiled."""
    path = sinks.dataset_path(scratch_path(spark, "json-roundtrip"), "events", "json")
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    sinks.write_dataset(ev, path, "json")
    back = readers.read_any(spark, path).select(ev.columns)
    return profile.profile(back, "events").select("column_name", "physical_type", "semantic_type", "nullable", "total_rows")


@query("read_delimited_customer")
def q_read_delimited(spark, sf_dir):
    """Customer written as ';'-separated text with 'NA' for some segments, read back
    with a sniffed delimiter, pandas-style null tokens and inferred types."""
    c = load(spark, sf_dir, "customer")
    seg = F.when(F.col("c_custkey") % 13 == 0, F.lit("NA")).otherwise(F.col("c_mktsegment"))
    path = scratch_path(spark, "delimited") + ".csv"
    c.withColumn("c_mktsegment", seg).write.option("header", True).option("sep", ";").csv(path)
    return readers.read_delimited(spark, path)


@query("read_json_events")
def q_read_json(spark, sf_dir):
    """Events written as JSON-array documents (one per batch of 1000 events), read
    back as rows."""
    ev = load(spark, sf_dir, "events")
    obj = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    docs = (ev.select(F.floor(F.col("event_id") / 1000).alias("doc"), F.col("event_id").alias("_o"), obj.alias("_j"))
            .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_o", "_j"))).alias("_js"))
            .select("doc", F.concat(F.lit("[\n"), F.array_join(F.transform("_js", lambda s: s["_j"]), ",\n"),
                                    F.lit("\n]")).alias("value")))
    path = scratch_path(spark, "jsondocs") + ".json"
    docs.write.partitionBy("doc").text(path)
    return readers.read_json_rows(spark, path).select("event_id", "user_id", "event_type", "value", "props")


@query("apply_contract_customer")
def q_apply_contract(spark, sf_dir):
    rows = replies.parse_csv_replies(customer_replies(spark, sf_dir), CUST_REPLY_COLS).rows
    contract = [ColumnContract("c_custkey", "integer"), ColumnContract("c_name", "string"),
                ColumnContract("c_nationkey", "integer"), ColumnContract("c_mktsegment", "string")]
    typed = profile.apply_contract(rows, contract)
    return typed.select(*CUST_REPLY_COLS, F.size("_cast_errors").alias("n_cast_errors"))


# --- whole jobs ---------------------------------------------------------------------------
def flaky_echo_model(prompt: str, temperature: float, max_tokens: int) -> str:
    """Local stand-in for a model that under-delivers on the first try: at
    temperature 0.3 it drops every 7th seeded key and fails every 17th batch;
    retries (higher temperature) answer in full."""
    import json as _json
    import re as _re
    m = _re.search(r"\n(\[.*?\])\nDO NOT INVENT", prompt, _re.S)
    keys_ = _json.loads(m.group(1)) if m else []
    first_try = abs(temperature - 0.3) < 1e-9
    start = int(_re.search(r"generating rows (\d+) through", prompt).group(1))
    if first_try and (start - 1) // 30 % 17 == 16:
        raise RuntimeError("rate limited")
    lines = [f"{k},{len(k)}" for k in keys_ if not (first_try and int(k.rsplit("-", 1)[1]) % 7 == 0)]
    if first_try and lines:
        lines.append(lines[0])          # a repeated key inside the reply
    return "```csv\n" + "\n".join(lines) + "\n```"


@query("synthesize_orders_offline")
def q_synthesize_offline(spark, sf_dir):
    spec = DatasetSpec("orders_keys", load(spark, sf_dir, "orders").count(), format="parquet",
                       columns=[{"name": "order_key", "type": "string"}, {"name": "key_len", "type": "integer"}],
                       primary_key="order_key")
    res = job.synthesize(spark, spec, flaky_echo_model, base=scratch_path(spark, "jobs"),
                         ledger_path=scratch_path(spark, "jobs-ledger"))
    return res.rows


@query("synthesize_users_rules")
def q_synthesize_rules(spark, sf_dir):
    spec = DatasetSpec("users", load(spark, sf_dir, "customer").count(), format="csv",
                       columns=customer_profile(), primary_key="customer_id")
    return job.synthesize(spark, spec, base=scratch_path(spark, "jobs")).rows


@query("dedup_within_batch_lineitem")
def q_dedup_within_batch(spark, sf_dir):
    """first row of each order key inside each batch (batch = line number)."""
    li = load(spark, sf_dir, "lineitem").withColumn("batch_num", F.col("l_linenumber")) \
        .withColumn("attempt", F.lit(0))
    return assemble.dedup_within_batch(li, "l_orderkey", ["attempt"] + LINEITEM_ORDER[1:]).drop("attempt", "batch_num")


@query("prompt_json_events")
def q_prompt_json(spark, sf_dir):
    """Free-mode prompts for an events-sized request, three events as samples."""
    ev = load(spark, sf_dir, "events")
    samples = [r.asDict() for r in profile.sample_rows(ev.drop("ts"), 3, order_by=["event_id"]).collect()]
    spec = DatasetSpec("events", ev.count(), sample_rows=samples)
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["events"]).withColumn("num_columns", F.lit(0)))
    p = prompts.render_json_prompts(plan, spec)
    return p.select("batch_num", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


@query("validate_generated_users")
def q_validate_generated(spark, sf_dir):
    """G1, G4-G7 on rule-generated users (one row per check; zero violations expected)."""
    contract = customer_profile()
    n = load(spark, sf_dir, "customer").count()
    df = generate.generate(spark, DatasetSpec("users", n, columns=contract), keep_index=False)
    name, bad = validate.column_set_check(df, contract)
    report = validate.column_checks(df, contract, expected_rows=n)
    extra = spark.createDataFrame([(name, None, bad)], validate.REPORT_SCHEMA)
    return report.unionByName(extra)


@query("roundtrip_lineitem_replies")
def q_roundtrip_lineitem(spark, sf_dir):
    """All of lineitem as CSV replies (one per order), parsed (E) and cast back to
    the table's types (A12): the result equals the table."""
    li = load(spark, sf_dir, "lineitem")
    cols = li.columns
    as_text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "l_shipdate" else F.col(c) for c in cols]
    r = replies.rows_to_csv_replies(li, text.csv_line(as_text), F.col("l_orderkey"))
    rows = replies.parse_csv_replies(r, cols).rows
    contract = profile.contract_from_schema(li.schema)
    for c in contract:                      # keep physical types, not name-rule semantics
        c.type = profile.physical_family(li.schema[c.name].dataType)
        c.type = "datetime" if c.name == "l_shipdate" else c.type
    typed = profile.apply_contract(rows, contract)
    return typed.select(*[F.col(c).cast(li.schema[c].dataType).alias(c) for c in cols],
                        F.size("_cast_errors").alias("n_cast_errors"))


@query("validation_report_documents")
def q_validation_report(spark, sf_dir):
    """G1-G11 as one report over documents (key doc_id, text checked for placeholders,
    rows compared on lang/source/text, samples = the first 5 documents)."""
    from .fixtures import REPORT_CONTRACT_DOCUMENTS
    docs = load(spark, sf_dir, "documents")
    contract = [ColumnContract.from_dict(d) for d in REPORT_CONTRACT_DOCUMENTS]
    return validate.report(docs, contract, pk="doc_id", expected_rows=docs.count(),
                           samples=docs.orderBy("doc_id").limit(5), text_columns=["text"],
                           row_columns=["lang", "source", "text"])


@query("stream_shortfall_customer")
def q_stream_shortfall(spark, sf_dir):
    """Customer replies (every 17th line malformed, every 7th batch answered twice)
    arrive as files; the stream keeps per-batch claimed counts as state and the
    current shortfall per planned batch is read back."""
    r = customer_replies(spark, sf_dir, cut_every=17).withColumn("batch_num", F.col("batch_num") + 1)
    again = r.where(F.col("batch_num") % 7 == 0).withColumn("attempt", F.lit(1))
    base = scratch_path(spark, "stream-sf")
    r.unionByName(again).repartition(4).write.parquet(f"{base}/in")
    plan = batches.plan_batches(table_specs(spark, sf_dir, ["customer"]).withColumn("num_columns", F.lit(4)))
    replies_stream.shortfall_stream(spark, f"{base}/in", CUST_REPLY_COLS, "c_custkey", plan,
                                    f"{base}/out", f"{base}/ckpt", files_per_trigger=1)
    return replies_stream.current_shortfall(spark, f"{base}/out", plan)


@query("mimic_rows_part")
def q_mimic_rows(spark, sf_dir):
    """Part-sized output where each row copies a part drawn from the whole table,
    keeping relations between columns, with the price jittered by up to 10 %."""
    part = load(spark, sf_dir, "part")
    return generate.mimic_rows(_table_skeleton(spark, sf_dir, "part").drop("batch_num"), part, "p_partkey",
                               jitter={"p_retailprice": 0.1})


@query("unique_rows_documents")
def q_unique_rows(spark, sf_dir):
    """D10 on the (lang, source, text) projection of documents: whole-row dedup."""
    return generate.unique_rows(load(spark, sf_dir, "documents").select("lang", "source", "text"), long_values=True) \
        .select("lang", "source", F.md5("text").alias("text_md5"))
