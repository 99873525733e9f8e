"""Records that span lines, cut by many splits, against whole-file readers."""

import csv
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.sources import readers, sinks, splits


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "499")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_records_over_split_borders(spark, tmp_path, small_splits):
    rng, rows = random.Random(4), []
    for i in range(80):
        text = "".join(rng.choice(['"', "\n", ",", "a", "é", " ", "\n\n"]) for _ in range(rng.choice([0, 3, 20, 300])))
        rows.append([str(i), text, rng.choice(["x", ""])])
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text", "flag"], *rows])
    lines = splits.split_rows(spark, path, "\n")
    assert lines.select("block").distinct().count() > 10
    df = splits.read_csv(spark, path, {"sep": ","})
    assert df.columns == ["id", "text", "flag"]
    got = {r.id: (r.text, r.flag) for r in df.collect()}
    whole = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert got == {r.id: (r.text, r.flag) for r in whole.collect()} and len(got) == 80
    # text fields as Python's own reader has them (an empty field is null)
    assert {k: v[0] or "" for k, v in got.items()} == {r[0]: r[1] for r in csv.reader(open(path, newline="")) if r[0] != "id"}


def test_csv_of_several_files_with_headers_and_line_ends_of_windows(spark, tmp_path, small_splits):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        body = "﻿" * (k == 0) + 'a;a;\r\n' + "".join(f'{k}{i};"x\ny{i}";z\r\n\r\n' for i in range(20))
        (folder / f"f{k}.csv").write_bytes(body.encode())
    df = readers.read_delimited(spark, str(folder), sep=";")
    assert df.columns == ["a0", "a1", "_c2"]
    assert sorted(tuple(r) for r in df.collect()) == sorted((int(f"{k}{i}"), f"x\ny{i}", "z") for k in range(3) for i in range(20))


def test_csv_without_line_ends_in_quotes_stays_with_sparks_reader(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    open(path, "w").write('a,b\n1,"x, ""y"""\n2,z\n')
    df = readers.read_delimited(spark, path)
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert [tuple(r) for r in df.collect()] == [(1, 'x, "y"'), (2, "z")]


OBJECTS = [{"id": i, "t": t, "n": {"k": [i, {"q": "}]"}]}} for i, t in enumerate(
    ["", "}", "{", '"', "\\", '\\"}', "a\nb", "[1,{]", "é}", "\\\\", "x" * 300, ",", '","'] * 4)]


@pytest.mark.parametrize("text", [json.dumps(OBJECTS), json.dumps(OBJECTS, indent=2, ensure_ascii=False),
                                  "﻿\n [" + " ,\n".join(map(json.dumps, OBJECTS)) + "]\n\n",
                                  "\n".join(map(json.dumps, OBJECTS)), "\n".join(map(json.dumps, OBJECTS)) + "\n"])
def test_json_objects_over_split_borders(spark, tmp_path, small_splits, text):
    path = str(tmp_path / "t.json")
    open(path, "w").write(text)
    assert splits.split_rows(spark, path, "}").select("block").distinct().count() > 3
    got = [json.loads(r.value) for r in spark.read.text(splits.json_lines(spark, path)).collect()]
    assert sorted(got, key=lambda o: o["id"]) == OBJECTS
    df = readers.read_any(spark, path)
    assert {r.id: r.t for r in df.collect()} == {o["id"]: o["t"] for o in OBJECTS}


@pytest.mark.parametrize("text", ["[]", " ", "[1, 2]", '[1, {"a": 1}]', '[{"a": 1}, 2]', '"x"', "7", '[[{"a": 1}]]'])
def test_json_that_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    path = str(tmp_path / "bad.json")
    open(path, "w").write(text)
    with pytest.raises(ValueError):
        readers.read_json_rows(spark, path)


@settings(max_examples=200, derandomize=True, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.text('{}[]"\\,a\n'), st.integers(0, 9)),
                    lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text('{}"\\'), x, max_size=3))),
       st.booleans())
def test_structure_of_pieces_adds_up(value, ascii_only):
    text = json.dumps([{"v": value}], ensure_ascii=ascii_only)
    inside, depth = False, 0
    pieces = text.split("}")
    for i, piece in enumerate(pieces):
        inside, change = splits.structure(piece, inside)
        depth += change
    assert not inside and depth == -1                     # the brace that the last piece does not have


def test_own_output_reads_back_in_every_format(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "x"\n', 0.5), (2, None, None), (3, "{}]", 2.0)], "k long, t string, v double")
    for fmt in ("csv", "tsv", "json", "parquet"):
        path = str(tmp_path / f"out.{fmt}")
        sinks.write_dataset(df, path, fmt)
        back = readers.read_any(spark, path).select("k", "t", "v").orderBy("k").collect()
        assert [tuple(r) for r in back] == [(1, 'a "x"\n', 0.5), (2, None, None), (3, "{}]", 2.0)], fmt


def test_no_reader_or_sink_takes_a_file_per_task():
    import inspect
    for module in (readers, sinks, splits):
        assert "multiLine" not in inspect.getsource(module)


def test_a_quoted_field_of_a_megabyte_is_sniffed(spark):
    lines = spark.createDataFrame([('1;"' + 'x,""' * 250_000 + '";2',)], "value string")
    assert readers.delimiter_counts(lines).where("chosen").first()["delimiter"] == ";"


def test_column_names():
    assert splits.column_names('a,,"b,c",A', ",") == ["a0", "_c1", "b,c", "A3"]
