"""Reply shapes a model produces (E1-E7, F1-F4): table-driven cases."""

import pytest
from pyspark.sql import functions as F

from tabforge.operators import assemble, replies

COLS = ["id", "name"]


def _parse(spark, texts, cols=COLS):
    df = spark.createDataFrame([(i + 1, 0, t) for i, t in enumerate(texts)],
                               "batch_num long, attempt int, response string")
    return replies.parse_csv_replies(df, cols)


@pytest.mark.parametrize("text,rows,rejects", [
    ("a1,x\na2,y", [("a1", "x"), ("a2", "y")], 0),
    ("```csv\na1,x\n```", [("a1", "x")], 0),
    ("```a1,x", [("```a1", "x")], 0),
    ("id,name\na1,x", [("a1", "x")], 0),
    ("ID ,anything,extra\na1,x", [("a1", "x")], 0),
    ('a1,"x,y"', [("a1", "x,y")], 0),
    ('a1, "x,y"', [], 1),
    ('a1,"two\nlines"', [("a1", "two\nlines")], 0),
    ('a1,"say ""hi"""', [("a1", 'say "hi"')], 0),
    ("a1,b,c", [], 1),
    ("only", [], 1),
    ("a1,x\n    \na2,y", [("a1", "x"), ("a2", "y")], 1),
    ("a1,", [("a1", "")], 0),
    ("a1,x\n\n\na2,y", [("a1", "x"), ("a2", "y")], 0),
    ("  \n a1 , x \r\n", [("a1", "x")], 0),
])
def test_reply_cases(spark, text, rows, rejects):
    p = _parse(spark, [text])
    got = [(r["id"], r["name"]) for r in p.rows.orderBy("pos").collect()]
    assert got == rows
    assert p.rejects.count() == rejects


def test_wide_quoted_replies_stay_linear(spark):
    cols = [f"c{i}" for i in range(100)]
    line = ",".join(f'"v{i}, with comma"' for i in range(100))
    p = _parse(spark, ["\n".join([line] * 30)], cols)
    rows = p.rows.collect()
    assert len(rows) == 30 and rows[0]["c99"] == "v99, with comma"


def test_status_and_rejects(spark):
    p = _parse(spark, ["a1,x", "nothing,valid,here\nonly", "", "```\n```"])
    st = {r["batch_num"]: (r["status"], r["rows_parsed"], r["rejected"]) for r in p.status.collect()}
    assert st == {1: ("ok", 1, 0), 2: ("failed", 0, 2), 3: ("failed", 0, 0), 4: ("failed", 0, 0)}
    rej = p.rejects.orderBy("pos").collect()
    assert [(r["n_fields"], r["record"]) for r in rej] == [(3, "nothing,valid,here"), (1, "only")]


def test_missing_keys_and_first_wins(spark):
    p = _parse(spark, [",x\na1,x\na1,y", "a1,z\na2,w"])
    rows = assemble.drop_missing_keys(p.rows, "id")
    kept = assemble.dedup_global(rows, "id").orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in kept] == [("a1", "x"), ("a2", "w")]
    d = assemble.dropped_duplicates(p.rows, "id").first()
    assert (d["rows_in"], d["rows_kept"], d["dropped_duplicates"]) == (4, 2, 2)


def test_first_wins_does_not_depend_on_input_order(spark):
    p = _parse(spark, ["k1,a\nk2,b", "k1,c\nk3,d", "k2,e"])
    a = assemble.dedup_global(p.rows, "id").select("id", "name")
    b = assemble.dedup_global(p.rows.repartition(7).orderBy(F.rand(3)), "id").select("id", "name")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [("k1", "a"), ("k2", "b"), ("k3", "d")]


def test_json_replies_union_of_keys(spark):
    df = spark.createDataFrame([(1, 0, '[{"a":1},{"a":2,"b":"q"}]'), (2, 0, '[{"a":1.5}')],
                               "batch_num long, attempt int, response string")
    rows = replies.parse_json_replies(df).orderBy("batch_num", "pos").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, None), (2, "q")]
    st = {r["batch_num"]: r["status"] for r in replies.json_reply_status(df).collect()}
    assert st == {1: "ok", 2: "failed"}


def test_json_key_order_is_first_seen(spark):
    df = spark.createDataFrame([(1, 0, '```json\n[{"z":1,"a":"x"},{"m":true,"z":2}]\n```')],
                               "batch_num long, attempt int, response string")
    out = replies.parse_json_replies(df)
    assert out.columns[3:] == ["z", "a", "m"]
    assert dict(out.dtypes)["m"] == "boolean"


def test_retry_plan_seeds_only_missing_rows(spark):
    plan = spark.createDataFrame([("d", 1, 30, 5, 1, 5)],
                                 "dataset_name string, batch_num long, batch_size long, target_rows long, "
                                 "start_idx long, end_idx long")
    kept = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "batch_num long, row_idx long")
    rp = assemble.retry_plan(plan, kept, attempt=0, prefix="ID").first()
    assert (rp["attempt"], rp["target_rows"], rp["start_idx"], rp["temperature"]) == (1, 2, 4, 0.4)
    assert rp["seed_keys"] == ["ID-3", "ID-5"]
    assert assemble.retry_plan(plan, kept, attempt=3).count() == 0
    sf = assemble.shortfall(plan, kept).first()
    assert (sf["kept_rows"], sf["shortfall"]) == (3, 2)


def test_trim_and_assemble(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "batch_num long, pos long, v string")
    b = spark.createDataFrame([(2, 1, 9)], "batch_num long, pos long, w long")
    u = assemble.assemble([a, b])
    assert set(u.columns) == {"batch_num", "pos", "v", "w"} and u.count() == 4
    assert assemble.trim_to_rows(a, "batch_num", ["pos"], 2).count() == 2
    assert assemble.assemble([]) is None


def test_unicode_whitespace_is_stripped_like_python(spark):
    p = _parse(spark, ["　a1 ,\xa0x \n"])
    assert [(r["id"], r["name"]) for r in p.rows.collect()] == [("a1", "x")]


def test_stray_and_unclosed_quotes_follow_python_csv(spark):
    p = _parse(spark, ['a,b"c,d\na,"b"c"d,e\nx,"unclosed,\n\ntail'], ["c1", "c2", "c3"])
    got = [tuple(r[c] for c in ("c1", "c2", "c3")) for r in p.rows.orderBy("pos").collect()]
    assert got == [("a", 'b"c', "d"), ("a", 'bc"d', "e")]
    rej = [r["record"] for r in p.rejects.collect()]
    assert rej == ['x,"unclosed,\n\ntail']


def test_read_replies_from_text_files_and_jsonl(spark, tmp_path):
    from tabforge.sources.readers import read_replies
    for b, a, body in [(1, 0, "id,name\na1,x"), (2, 0, "```csv\na2,y\n```"), (2, 1, "a3,z")]:
        d = tmp_path / "txt" / f"batch_num={b}" / f"attempt={a}"
        d.mkdir(parents=True)
        (d / "reply.txt").write_text(body)
    r = read_replies(spark, str(tmp_path / "txt"))
    assert sorted((x["batch_num"], x["attempt"]) for x in r.collect()) == [(1, 0), (2, 0), (2, 1)]
    rows = replies.parse_csv_replies(r, COLS).rows
    assert sorted(x["id"] for x in rows.collect()) == ["a1", "a2", "a3"]
    j = tmp_path / "r.jsonl"
    j.write_text('{"batch_num": 1, "attempt": 0, "response": "a1,x"}\n{"batch_num": 2, "error": "timeout"}\n')
    got = sorted(tuple(x) for x in read_replies(spark, str(j)).collect())
    assert got == [(1, 0, "a1,x", None), (2, None, None, "timeout")]
