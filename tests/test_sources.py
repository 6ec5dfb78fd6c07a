import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, writers
from corpusloom.sources.files import open_file, write_file
from corpusloom.streaming.counts import count_to_parquet, windowed_counts


def test_json_csv_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": "x", "n": 1}, {"k": "y"}]')
    assert readers.json_records(spark, str(tmp_path / "a.json"), "k string, n int").count() == 2
    df = spark.createDataFrame([("a,b\n\"c\"", ["x", "y"])], "t string, l array<string>")
    writers.write_table(df, str(tmp_path / "t.csv"))
    back = readers.csv_records(spark, str(tmp_path / "t.csv"), "t string, l string").first()
    assert (back.t, back.l) == ("a,b\n\"c\"", "x|y")
    (tmp_path / "s.txt").write_text("the\n\n and \n")
    assert [r.line for r in readers.lines(spark, str(tmp_path / "s.txt")).collect()] == ["the", "and"]
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "t.xyz"))


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://host/abs/1001.0061v2</id>'
        '<arxiv:primary_category term="a.B"/><category term="a.B"/><category term="c"/></entry></feed>'
    )
    assert tuple(readers.feed_categories(spark, str(tmp_path / "f.xml")).first()) == ("1001.0061", "a.B", ["a.B", "c"])


def test_metrics_and_fill(spark):
    df = spark.createDataFrame([("a", '{"reads": {"2001": 3, "x": 4}, "skip": {"2001": 1}}'), ("b", None)], "k string, m string")
    assert [tuple(r) for r in readers.metrics_long(df, "k", "m", ("skip",)).collect()] == [("a", "reads", 2001, 3)]
    left = spark.createDataFrame([("a", " "), ("b", "own"), ("c", None)], "k string, t string")
    right = spark.createDataFrame([("a", "new"), ("b", "new")], "k string, t string")
    assert {r.k: r.t for r in readers.fill_missing(left, right, "k", "t").collect()} == {"a": "new", "b": "own", "c": None}
    assert readers.year_query(readers.phrase_query(["dark matter"]), 1950, 2025) == '(abs:"dark matter") AND year:1950-2025'


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", 1.5, True, 0.0, 1.0), ("c", None, False, 2.0, 3.0)], "node string, w double, f boolean, x double, y double")
    es = spark.createDataFrame([("a & b", "c", 2)], "source string, target string, weight long")
    for name in ("g.graphml", "g.gexf"):
        writers.graph_file(nodes, es, str(tmp_path / name))
        tree = ET.parse(tmp_path / name)
        assert {e.get("id") for e in tree.iter() if e.tag.endswith("}node")} == {"a & b", "c"}
        assert len([e for e in tree.iter() if e.tag.endswith("}edge")]) == 1
    with pytest.raises(ValueError):
        writers.graph_file(nodes, es, str(tmp_path / "x.graphml"), most=1)


def test_latex_zip_manifest_cache(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1234, 0.5)], "name string, n long, s double")
    text = writers.latex_table(df, "c", "l")
    assert r"a\_b & 1,234 & 0.500 \\" in text
    (tmp_path / "x.txt").write_text("x")
    writers.zip_files([str(tmp_path / "x.txt")], str(tmp_path / "z.zip"))
    got = writers.manifest({"z": str(tmp_path / "z.zip")}, {"t": df}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == got and got["outputs"]["t"]["rows"] == 1
    path, calls = f"file://{tmp_path}/cached.parquet", []
    for _ in range(2):
        writers.reuse_or_build(spark, path, lambda: calls.append(1) or df)
    assert len(calls) == 1
    assert writers.range_checks(df, {"s": (0, 0.4)}).first().s is False


def test_files_are_whole(tmp_path):
    uri = f"file://{tmp_path}/d/f.bin"
    assert write_file(uri, [b"ab", b"c"]) == 3
    with open_file(uri) as f:
        assert f.read() == b"abc"
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["f.bin"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", k) for h in range(4) for k in "ab"] + [("2024-01-02 00:00:00", "a")]
    df = spark.createDataFrame(rows, "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type")
    df.write.parquet(f"{tmp_path}/in")
    count_to_parquet(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in windowed_counts(df).where("start < '2024-01-01 12:00:00'").collect()}
    assert got == want and len(want) == 8
