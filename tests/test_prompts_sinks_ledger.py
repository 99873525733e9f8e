"""Prompt text, completion hand-off, sinks, ledger and streaming."""

import os

from pyspark.sql import functions as F

from tabforge.operators import ledger
from tabforge.plans import batches, prompts
from tabforge.session import scratch_path
from tabforge.sources import sinks
from tabforge.spec import DatasetSpec

POLICE = [{"name": "stop_date", "type": "date"}, {"name": "driver_gender", "type": "string", "nullable": True},
          {"name": "driver_age", "type": "integer", "nullable": True},
          {"name": "violation", "type": "string", "nullable": True},
          {"name": "stop_outcome", "type": "string", "nullable": True}]


def test_csv_prompt_for_police_stops(spark):
    spec = DatasetSpec("police_stops", 100, columns=POLICE, primary_key="stop_date")
    plan = batches.plan_single(spark, 100, 5)
    p = prompts.render_csv_prompts(plan, spec).orderBy("batch_num").collect()
    assert len(p) == 4
    last = p[-1]["prompt"]
    assert last.startswith('Generate EXACTLY 10 unique rows of synthetic data for dataset "police_stops".\n'
                           "This is a PARTIAL BATCH: you are generating rows 91 through 100.\n")
    assert 'You MUST use the following exact 10 values for the \'stop_date\' column' in last
    assert '["STOP_DATE-91", "STOP_DATE-92",' in last and '"STOP_DATE-100"]\nDO NOT INVENT' in last
    assert "  stop_date (date, NOT NULL, PRIMARY KEY)\n  driver_gender (string, NULL)" in last
    assert "Do NOT output 9 or 11 rows." in last
    assert last.endswith("Output (raw CSV only, exactly 10 rows, no header):")


def test_prompt_with_samples_and_no_key(spark):
    spec = DatasetSpec("t", 5, columns=[{"name": "a"}, {"name": "b", "type": "integer", "pattern": "1-9",
                                                        "distribution": "normal"}],
                       sample_rows=[{"a": "x,y", "b": 1}], description="d", ai_criteria="c")
    p = prompts.render_csv_prompts(batches.plan_single(spark, 5, 2), spec).first()["prompt"]
    assert "\nDataset context: d\nUser Instructions / AI Criteria: c\n\nColumn definitions (2 columns total):" in p
    assert "  b (integer, NOT NULL, range/pattern: 1-9, distribution: normal)" in p
    assert 'do NOT copy them verbatim):\n"x,y",1\n' in p
    assert 'The "first" column is the PRIMARY KEY' in p and "PRE-SEEDED" not in p


def test_json_prompt(spark):
    spec = DatasetSpec("t", 5, sample_rows=[{"a": 1}])
    plan = batches.plan_single(spark, 5, 0)
    text = prompts.render_json_prompts(plan, spec).first()["prompt"]
    assert text == ("Generate 5 rows of realistic tabular data.\nDataset Name: t\n\nSample Rows:\n"
                    '[\n  {\n    "a": 1\n  }\n]\n' + prompts.JSON_PROMPT_RULES)
    full = DatasetSpec("t", 5, description="about {rows}", ai_criteria="be odd")
    text = prompts.render_json_prompts(plan, full, [{"b": 2}]).first()["prompt"]
    assert "\n\nDescription:\nabout {rows}\n\nSample Rows:\n" in text and "]\n\nAI Criteria:\nbe odd\n\nRules:" in text


def test_completion_errors_are_rows(spark):
    plan = batches.plan_single(spark, 90, 2)
    spec = DatasetSpec("t", 90, columns=[{"name": "k"}, {"name": "v"}], primary_key="k")

    def model(prompt, temperature, max_tokens):
        if "rows 31 through" in prompt:
            raise ValueError("boom")
        return f"ok,{temperature},{max_tokens}"
    out = {r["batch_num"]: (r["response"], r["error"])
           for r in prompts.complete_prompts(prompts.render_csv_prompts(plan, spec), model, 90, 3).collect()}
    assert out[1] == ("ok,0.3,8000", None) and out[2] == (None, "ValueError: boom")


def test_csv_sink_nulls_quotes_and_layout(spark):
    df = spark.createDataFrame([(1, None, 'say "hi"'), (2, "", "a,b")], "k long, e string, q string")
    base = scratch_path(spark, "t")
    path = sinks.dataset_path(base, "demo", "csv")
    assert "/datasets/demo/demo_" in path and path.endswith(".csv")
    sinks.write_dataset(df, path, "csv", order_by=["k"])
    local = path.removeprefix("file:")
    text = "".join(open(os.path.join(local, f)).read() for f in sorted(os.listdir(local)) if f.endswith(".csv"))
    assert text.splitlines()[0] == "k,e,q"
    assert '1,,"say ""hi"""' in text and '2,,"a,b"' in text
    back = sinks.read_dataset(spark, path, "csv", schema=df.schema).orderBy("k").collect()
    assert back[1]["q"] == "a,b"
    tsv = sinks.dataset_path(base, "demo", "tsv")
    sinks.write_dataset(df, tsv, "tsv")
    assert sinks.read_dataset(spark, tsv, "tsv", schema=df.schema).count() == 2
    assert sinks.published_key(path).startswith("datasets/demo/")


def test_ledger_rules(spark):
    rows = [("j1", "a", 1, "csv", '["x"]', "datasets/a/1.csv", "", "2024-01-01T00:00:00", None, "2024-01-01 00:00:00"),
            ("j1", "a", 2, "csv", '["x"]', "datasets/a/2.csv", "", "2024-01-02T00:00:00", "partial", "2024-01-02 00:00:00"),
            ("j2", "b", 3, "json", '["x","y"]', "output/b.json", "", None, None, "2024-01-03 00:00:00"),
            ("j3", "c", 4, "tsv", "[]", "output/c.tsv", "datasets/c/c.tsv", "2024-01-05T00:00:00", None,
             "2024-01-03 00:00:00")]
    rows += [(f"k{i}", "d", i, "csv", "[]", "x", None, f"2023-01-{i + 1:02d}T00:00:00", None, "2023-01-01 00:00:00")
             for i in range(12)]
    jobs = spark.createDataFrame(rows, "job_id string, dataset_name string, rows long, format string, columns string, "
                                       "file_path string, s3_key string, generated_at string, status string, "
                                       "written_at string").withColumn("written_at", F.to_timestamp("written_at"))
    path = scratch_path(spark, "ledger")
    ledger.save_jobs(jobs, path)
    lg = ledger.read_ledger(spark, path)
    j1 = ledger.get_job(lg, "j1").first()
    assert j1["rows"] == 2 and j1["status"] == "partial" and j1["columns"] == ["x"] and j1["s3_key"] is None
    assert ledger.get_job(lg, "nope").count() == 0
    latest = ledger.latest_jobs(lg).collect()
    assert len(latest) == 10 and [r["job_id"] for r in latest[:2]] == ["j3", "j1"]
    assert "ttl" not in latest[0].asDict()
    art = {r["job_id"]: r["artifact"] for r in ledger.resolve_artifacts(lg).collect()}
    assert art["j1"] == "datasets/a/2.csv" and art["j2"] is None and art["j3"] == "datasets/c/c.tsv"
    ttl_j1 = j1["ttl"]
    assert ledger.expire_jobs(lg, ttl_j1).where("job_id = 'j1'").count() == 0
    assert ledger.expire_jobs(lg, ttl_j1 - 1).where("job_id = 'j1'").count() == 1


def test_stream_equals_batch_key_set(spark, sf_dir):
    from tabforge.suite import QUERIES
    s = {r[0] for r in QUERIES["stream_replies"](spark, sf_dir).select("c_custkey").collect()}
    b = {r[0] for r in QUERIES["parse_csv_customer"](spark, sf_dir).select("c_custkey").collect()}
    assert s == b


def test_stream_with_arrival_time_uses_watermark_dedup(spark):
    from pyspark.sql import types as T
    from tabforge.streaming import replies_stream
    schema = T.StructType(replies_stream.REPLY_FILE_SCHEMA.fields + [T.StructField("arrived", T.TimestampType())])
    base = scratch_path(spark, "wm")
    rows = [(1, 0, "a1,x\na2,y", "2024-01-01 00:00:00"), (2, 0, "a2,z\na3,w", "2024-01-01 00:10:00")]
    spark.createDataFrame(rows, "batch_num long, attempt int, response string, t string") \
        .withColumn("arrived", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(f"{base}/in")
    replies_stream.stream_replies(spark, f"{base}/in", ["id", "name"], "id", f"{base}/out", f"{base}/ck",
                                  schema=schema, event_time="arrived")
    got = sorted(r["id"] for r in spark.read.parquet(f"{base}/out").collect())
    assert got == ["a1", "a2", "a3"]


def test_braces_in_user_text_stay_literal(spark):
    spec = DatasetSpec("t", 5, columns=[{"name": "a"}], description="use {rows} and {col_defs} literally",
                       primary_key="a")
    p = prompts.render_csv_prompts(batches.plan_single(spark, 5, 1), spec).first()["prompt"]
    assert "\nDataset context: use {rows} and {col_defs} literally\n" in p
    assert 'Generate EXACTLY 5 unique rows' in p and '["A-1", "A-2", "A-3", "A-4", "A-5"]' in p


def test_csv_and_tsv_keep_surrounding_spaces(spark):
    df = spark.createDataFrame([(1, "  padded  "), (2, "\ttab")], "k long, v string")
    for fmt in ("csv", "tsv"):
        path = sinks.dataset_path(scratch_path(spark, "ws"), "ws", fmt)
        sinks.write_dataset(df, path, fmt, order_by=["k"])
        back = {r["k"]: r["v"] for r in sinks.read_dataset(spark, path, fmt, schema=df.schema).collect()}
        assert back == {1: "  padded  ", 2: "\ttab"}, fmt


def test_text_sinks_spell_booleans_like_pandas(spark):
    import os
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k long, b boolean")
    path = sinks.dataset_path(scratch_path(spark, "bool"), "b", "csv")
    sinks.write_dataset(df, path, "csv", order_by=["k"])
    local = path.removeprefix("file:")
    text = "".join(open(os.path.join(local, f)).read() for f in sorted(os.listdir(local)) if f.endswith(".csv"))
    assert "1,True" in text and "2,False" in text and "3,\n" in text
    back = {r["k"]: r["b"] for r in sinks.read_dataset(spark, path, "csv", schema=df.schema).collect()}
    assert back == {1: True, 2: False, 3: None}


def test_text_sinks_write_timestamps_at_pandas_resolution(spark):
    import os
    from datetime import datetime
    rows = [(1, datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000))]
    df = spark.createDataFrame(rows, "k long, d timestamp_ntz, s timestamp_ntz, m timestamp_ntz")
    path = sinks.dataset_path(scratch_path(spark, "ts"), "ts", "csv")
    sinks.write_dataset(df, path, "csv")
    local = path.removeprefix("file:")
    text = "".join(open(os.path.join(local, f)).read() for f in sorted(os.listdir(local)) if f.endswith(".csv"))
    assert "1,2024-01-02,2024-01-02 03:04:05,2024-01-02 03:04:05.120000" in text
    assert [tuple(r) for r in sinks.read_dataset(spark, path, "csv", schema=df.schema).collect()] == rows
