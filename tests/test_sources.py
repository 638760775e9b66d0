"""Readers, versions and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import providers
from lodestrata.sources import readers


def test_lists_and_json_lines(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# head\n\n a \r\nb\na\n", encoding="utf-8")
    assert {(r.line_no, r.entry) for r in readers.list_entries(spark, str(tmp_path / "urls.txt")).collect()} == {(2, "a"), (3, "b")}
    (tmp_path / "g.jsonl").write_text('{"id": "1", "tags": ["x"]}\n# no\n\n{"id": \n', encoding="utf-8")
    got = readers.json_lines(spark, str(tmp_path / "g.jsonl"), "id string, tags array<string>").collect()
    assert {(r.id, r.malformed) for r in got} == {("1", None), (None, '{"id":')}
    df = spark.createDataFrame([('{"a": "1"}',), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.json_map(F.col("t"))).collect()] == [{"a": "1"}, {}, {}]


def test_vtt(spark, tmp_path):
    (tmp_path / "v1.en.vtt").write_text("WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.500 align:start\n<c>Hi</c>  there\nyou\n\n01:00:00,000 --> 01:00:01,000\nEnd\n", encoding="utf-8")
    (tmp_path / "v1.en-orig.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nno\n", encoding="utf-8")
    (tmp_path / "v2.fr.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nnon\n", encoding="utf-8")
    files = readers.vtt_files(spark, str(tmp_path / "*.vtt"))
    assert [(r.video_id, r.lang) for r in files.collect()] == [("v1", "en")]
    assert {(r.start_seconds, r.end_seconds, r.text) for r in readers.vtt_cues(files).collect()} == {(1.0, 2.5, "Hi there\nyou"), (3600.0, 3601.0, "End")}


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>Menu</nav>Lead <b>bold</b> text<!-- gone --><h2>One <i>x</i></h2><p>a</p><script>no()</script><ul><li>b</li></ul><h3></h3></body>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>only")], "page_id int, html string")
    assert {(r.page_id, r.section_no, r.heading, r.body) for r in readers.html_sections(df).collect()} == {(1, 0, None, "Lead bold text"), (1, 1, "One x", "a\nb"), (3, 0, None, "only")}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    readers.write_version(spark.range(3), root, "v1")
    readers.write_version(readers.read_current(spark, root).where("id > 0"), root, "v2")
    assert {r.id for r in readers.read_current(spark, root).collect()} == {1, 2}


def test_bad_texts_are_isolated(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("400")
        return [[float(len(t))] * 2 for t in texts]

    assert providers.isolated(model, ["a", "bb", "bad", "cccc"]) == [[1.0, 1.0], [2.0, 2.0], None, [4.0, 4.0]]
    df = spark.createDataFrame([("a",), ("bad",), (None,), ("",)], "t string")
    got = df.select(providers.applied(model, F.col("t"), "array<double>").alias("v")).select(providers.unit(F.col("v"))).collect()
    assert [None if r[0] is None else round(r[0][0], 6) for r in got] == [0.707107, None, 0.707107, 0.707107]


def test_passing_errors_are_tried_again():
    calls = []

    def model(texts):
        calls.append(1)
        if len(calls) < 3:
            raise providers.Passing
        return texts

    assert providers.isolated(model, ["a"], wait=0) == ["a"] and len(calls) == 3


def test_files_by_extension_and_empty_lists(spark, tmp_path):
    import pytest

    for name, text in (("a.HTML", "<p>x</p>"), ("b.pdf", "%PDF"), ("c.txt", "plain"), ("list", "# only\n\n")):
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in readers.by_extension(spark, str(tmp_path)).collect()}
    assert got["a.HTML"] == ("html", "<p>x</p>") and got["b.pdf"] == ("pdf", None) and got["c.txt"] == ("text", "plain")
    with pytest.raises(ValueError):
        readers.required_entries(spark, str(tmp_path / "list"))
