"""Whole jobs: rule-based and offline (retries, statuses, ledger record)."""

from pyspark.sql import functions as F

from tabforge.operators import ledger
from tabforge.plans import job
from tabforge.session import scratch_path
from tabforge.spec import DatasetSpec

COLS = [{"name": "id", "type": "string"}, {"name": "v", "type": "integer"}]


from tabforge.plans.prompts import seeds_in_prompt as _seeds


def test_offline_job_retries_until_complete(spark):
    calls = []

    def model(prompt, temperature, max_tokens):
        keys = _seeds(prompt)
        calls.append(temperature)
        if temperature < 0.35:                       # first try: half the rows
            keys = keys[::2]
        return "\n".join(f"{k},{len(k)}" for k in keys)

    lp = scratch_path(spark, "ledger")
    spec = DatasetSpec("t", 95, format="json", columns=COLS, primary_key="id")
    res = job.synthesize(spark, spec, model, base=scratch_path(spark, "out"), ledger_path=lp)
    assert (res.rows_generated, res.status, res.attempts) == (95, "success", 2)
    assert res.quality == {"primary_key_column": "id", "duplicates_found": 0, "nulls_found": 0, "is_valid": True}
    got = sorted(r["id"] for r in res.rows.collect())
    assert got == sorted(f"ID-{i}" for i in range(1, 96))
    rec = ledger.get_job(ledger.read_ledger(spark, lp), res.job_id).first()
    assert rec["rows"] == 95 and rec["status"] == "success" and rec["columns"] == ["id", "v"]
    assert rec["s3_key"].startswith("datasets/t/t_")


def test_offline_job_partial_and_empty(spark):
    def stingy(prompt, temperature, max_tokens):
        return "\n".join(f"{k},1" for k in _seeds(prompt)[:1])

    res = job.synthesize(spark, DatasetSpec("t", 40, columns=COLS, primary_key="id"), stingy,
                         base=scratch_path(spark, "out"))
    assert res.attempts == 4 and res.status == "partial" and res.rows_generated == 8

    def broken(prompt, temperature, max_tokens):
        raise RuntimeError("down")
    res = job.synthesize(spark, DatasetSpec("t", 10, columns=COLS, primary_key="id"), broken,
                         base=scratch_path(spark, "out"))
    assert (res.status, res.rows_generated, res.attempts) == ("empty", 0, 4)


def test_rule_job_writes_ordered_csv(spark):
    spec = DatasetSpec("u", 120, columns=[{"name": "k", "type": "integer"}, {"name": "d", "type": "date"}])
    res = job.synthesize(spark, spec, base=scratch_path(spark, "out"))
    assert res.status == "success" and res.rows.count() == 120
    assert dict(res.rows.dtypes) == {"k": "bigint", "d": "date"}
    assert res.rows.where(F.col("d").isNull()).count() == 0


def test_free_mode_job_parses_json_and_retries_by_count(spark):
    def model(prompt, temperature, max_tokens):
        import json
        import re
        n = int(re.match(r"Generate (\d+) rows", prompt).group(1))
        if temperature < 0.35:
            n = max(0, n - 2)                    # first try comes up short
        return "```json\n" + json.dumps([{"name": f"n{i}", "score": i * 1.5} for i in range(n)]) + "\n```"

    spec = DatasetSpec("free", 45, format="parquet", description="anything")
    res = job.synthesize(spark, spec, model, base=scratch_path(spark, "out"))
    assert (res.rows_generated, res.status, res.attempts) == (45, "success", 2)
    assert set(res.rows.columns) == {"name", "score"}
    assert dict(res.rows.dtypes)["score"] == "double"


def test_rule_job_files_are_in_row_order(spark):
    import os
    spec = DatasetSpec("o", 2500, format="csv", columns=[{"name": "id", "type": "string"}], primary_key="id")
    res = job.synthesize(spark, spec, base=scratch_path(spark, "out"))
    local = res.path.removeprefix("file:")
    keys_in_files = []
    for f in sorted(os.listdir(local)):
        if f.startswith("part-"):
            keys_in_files += open(os.path.join(local, f)).read().splitlines()[1:]
    assert keys_in_files == [f"ID-{i}" for i in range(1, 2501)]


def test_command_line(spark, tmp_path, capsys, sf_dir):
    import json
    from tabforge.__main__ import main
    schema = tmp_path / "c.json"
    schema.write_text(json.dumps([{"name": "id", "type": "uuid"}, {"name": "n", "type": "integer", "pattern": "1-3"}]))
    led = scratch_path(spark, "cli-ledger")
    assert main(["generate", "cli", "25", "--schema", str(schema), "--key", "id", "--out",
                 scratch_path(spark, "cli"), "--ledger", led]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["rows_generated"] == 25 and out["quality_report"]["is_valid"] is True
    assert main(["job", "--ledger", led, out["job_id"]]) == 0
    rec = json.loads(capsys.readouterr().out)
    assert rec["artifact"].startswith("datasets/cli/cli_")
    assert main(["job", "--ledger", led, "missing"]) == 1
    capsys.readouterr()
    assert main(["profile", f"{sf_dir}/nation.parquet", "--samples", "3"]) == 0
    assert json.loads(capsys.readouterr().out)["total_rows"] == 25


def test_free_mode_job_with_a_dead_model_is_empty(spark):
    def broken(prompt, temperature, max_tokens):
        return "not json at all"
    res = job.synthesize(spark, DatasetSpec("free", 12), broken, base=scratch_path(spark, "out"))
    assert (res.status, res.rows_generated, res.attempts) == ("empty", 0, 4)


def test_offline_hand_off_through_files_and_resume(spark, tmp_path):
    """Prompts leave as JSON Lines, an outside service answers with one text file per
    batch, replies come back through read_replies; the job resumes from its folder."""
    import glob
    import json
    from tabforge.sources.readers import read_replies
    spec = DatasetSpec("handoff", 70, columns=COLS, primary_key="id")
    work = scratch_path(spark, "handoff-work")

    def service(prompt_dir, reply_dir, attempt, drop_every):
        for f in glob.glob(f"{prompt_dir.removeprefix('file:')}/*.json"):
            for line in open(f):
                req = json.loads(line)
                keys_ = _seeds(req["prompt"])
                body = "\n".join(f"{k},{len(k)}" for i, k in enumerate(keys_) if not (drop_every and i % drop_every == 0))
                d = tmp_path / reply_dir / f"batch_num={req['batch_num']}" / f"attempt={attempt}"
                d.mkdir(parents=True, exist_ok=True)
                (d / "reply.txt").write_text("```csv\n" + body + "\n```")

    job1 = job.OfflineJob(spark, spec, work)
    p0 = job1.export_prompts(0, scratch_path(spark, "prompts0"))
    service(p0, "r0", 0, drop_every=3)                   # every third row missing
    assert job1.ingest(0, read_replies(spark, str(tmp_path / "r0"))) == 46
    job2 = job.OfflineJob(spark, spec, work, job_id=job1.job_id)   # e.g. after a driver restart
    pend = job2.pending().collect()
    assert sum(r["target_rows"] for r in pend) == 24 and {r["attempt"] for r in pend} == {1}
    p1 = job2.export_prompts(1, scratch_path(spark, "prompts1"))
    service(p1, "r1", 1, drop_every=0)
    assert job2.ingest(1, read_replies(spark, str(tmp_path / "r1"))) == 24
    assert job2.pending().count() == 0
    res = job2.finish(base=scratch_path(spark, "out"))
    assert (res.rows_generated, res.status, res.attempts) == (70, "success", 2)
    assert sorted(r["id"] for r in res.rows.collect()) == sorted(f"ID-{i}" for i in range(1, 71))
