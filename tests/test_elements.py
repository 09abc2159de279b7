"""Enrichment, chunking, staging, rows of documents, streams, the command line."""

from __future__ import annotations

import json
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import chunking, enrich, partition, relational, serialize, staging
from paperloom.operators.options import Options
from paperloom.operators.schema import element
from paperloom.sources.documents import read_documents, read_urls
from paperloom.streaming.pipeline import stream_elements, write_elements


def chunks(elements, strategy="basic", **o):
    return chunking.chunk(elements, chunking.chunk_options(strategy, **o))


def test_ids_and_hierarchy():
    a, b = element("Title", "Same", page_number=1), element("Title", "Same", page_number=2)
    enrich.set_ids([a, b])
    assert a["element_id"] != b["element_id"] and len(a["element_id"]) == 32
    c, d = element("Title", "Same", page_number=1), element("Title", "Same", page_number=1)
    enrich.set_ids([c, d])
    assert c["element_id"] == a["element_id"] != d["element_id"]
    es = [element("Header", "h"), element("Title", "t", category_depth=0), element("Title", "u", category_depth=1), element("NarrativeText", "x"),
          element("PageBreak"), element("NarrativeText", "y")]
    enrich.set_ids(es)
    enrich.set_hierarchy(es)
    ids = [e["element_id"] for e in es]
    assert [e["metadata"].get("parent_id") for e in es] == [None, ids[0], ids[1], ids[2], None, None]
    assert chunks([a])[0]["element_id"] == chunks([a])[0]["element_id"]


def test_native_hierarchy_and_ids_agree(spark):
    kinds = ["Header", "Title", "NarrativeText", "Title", "ListItem", "PageBreak", "Table", "Title", "UncategorizedText", "Image", "ListItem"]
    depths = [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    es = [element(k, f"t{i % 3}", category_depth=d) for i, (k, d) in enumerate(zip(kinds, depths))]
    enrich.set_ids(es)
    enrich.set_hierarchy(es)
    rows = [(1, i, e["type"], e["metadata"]["category_depth"], e["element_id"], e["text"]) for i, e in enumerate(es)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, type string, depth int, element_id string, text string")
    packed = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "depth", "element_id"))).alias("e"))
    got = packed.select(relational.parents(F.transform("e", lambda x: F.struct(x["type"], x["depth"], x["element_id"])))).first()[0]
    assert got == [e["metadata"].get("parent_id") for e in es]
    again = relational.assign_ids(df.drop("element_id")).orderBy("pos").collect()
    assert [r["element_id"] for r in again] == [e["element_id"] for e in es]


def test_chunking():
    t = lambda s: element("Title", s)
    n = lambda s, **m: element("NarrativeText", s, **m)
    assert [len(c["text"]) for c in chunks([n("a" * 60)] * 4, new_after_n_chars=100)] == [122, 122]
    two = [t("One"), n("x" * 100), t("Two"), n("y" * 100)]
    assert len(chunks(two, "by_title", combine_text_under_n_chars=0)) == 2 and len(chunks(two, "by_title")) == 1
    long = chunks([n(" ".join(["words"] * 200))], max_characters=100, overlap=20)
    assert all(len(c["text"]) <= 100 for c in long) and long[1]["metadata"]["is_continuation"] and "is_continuation" not in long[0]["metadata"]
    rows = "".join(f"<tr><td>r{i}</td><td>v{i}</td></tr>" for i in range(40))
    table = element("Table", " ".join(f"r{i} v{i}" for i in range(40)), text_as_html=f"<table>{rows}</table>")
    parts = chunks([n("before"), table, n("after")], max_characters=200)
    assert parts[0]["type"] == parts[-1]["type"] == "CompositeElement" and {p["type"] for p in parts[1:-1]} == {"TableChunk"}
    assert " ".join(p["text"] for p in parts[1:-1]) == table["text"] and [p["metadata"]["chunk_index"] for p in parts[1:-1]] == list(range(len(parts) - 2))
    assert [c["type"] for c in chunks([n("a"), element("Table", "x"), n("b")], isolate_table=False)] == ["CompositeElement"]
    paged = [n("a", page_number=1), n("b", page_number=2)]
    assert len(chunks(paged, "by_title")) == 1 and len(chunks(paged, "by_title", multipage_sections=False, combine_text_under_n_chars=0)) == 2
    m = chunks([n("a", page_number=4, languages=["eng"], link_urls=["a"], category_depth=1), n("b", page_number=5, languages=["deu", "eng"], link_urls=["b"])])[0]["metadata"]
    assert m == {"page_number": 4, "languages": ["eng", "deu"], "link_urls": ["a", "b"]}
    tail = chunks([t("One"), n("first words here"), t("Two"), n("more")], "by_title", combine_text_under_n_chars=0, overlap=5, overlap_all=True)
    assert tail[1]["text"].startswith("here\n\nTwo")
    assert chunks([element("CheckBox"), n("")]) == []


def test_chunk_options():
    for bad in ({"max_characters": 0}, {"max_characters": 5, "overlap": 5}, {"new_after_n_chars": -1}, {"skip_table_chunking": True, "isolate_table": False}):
        with pytest.raises(ValueError):
            chunking.chunk_options("basic", **bad)
    with pytest.raises(ValueError):
        chunking.chunk_options("by_title", max_characters=5, combine_text_under_n_chars=6)
    with pytest.raises(NotImplementedError):
        chunking.chunk_options("basic", max_tokens=5)
    with pytest.raises(ValueError):
        chunking.chunk_options("other")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_splitting_ends_and_fits(text, most, overlap):
    o = chunking.ChunkOptions(max_characters=most, overlap=min(overlap, most - 1))
    found = list(chunking.pieces(text, o))
    assert all(len(p) <= most for p in found) and len(found) <= len(text) + 1
    assert set("".join(text.split())) == set("".join("".join(found).split()))


def test_overlap_that_reaches_the_start():
    assert list(chunking.pieces("ab\n" + "x" * 300, chunking.ChunkOptions(max_characters=100, overlap=20)))[0] == "ab"


def test_partition_rows(spark, tmp_path):
    for name, data in (("a.md", b"# Head\n\nIt was good."), ("b.html", b"<p>It was bad."), ("c.doc", b"x"), ("d.bin", b"\0\1")):
        (tmp_path / name).write_bytes(data)
    docs = read_documents(spark, str(tmp_path))
    out = partition.partition(docs).orderBy("path").collect()
    assert [r["error"] is None for r in out] == [True, True, False, False]
    assert [e["text"] for e in out[0]["elements"]] == ["Head", "It was good."] and out[0]["elements"][0]["metadata"]["filename"] == "a.md"
    assert out[0]["elements"][0]["metadata"]["last_modified"] and out[2]["error"].startswith("UnsupportedFileFormatError")
    with pytest.raises(Exception, match="UnsupportedFileFormatError"):
        partition.partition(docs, mode="FAILFAST").collect()
    chunked = partition.partition(docs.where("path like '%a.md'"), chunking_strategy="basic").first()
    assert chunked["elements"][0]["type"] == "CompositeElement" and len(chunked["elements"][0]["orig_elements"]) == 2
    nulls = spark.createDataFrame([(None, 1)], "content binary, elements int")
    assert partition.partition(nulls).first().asDict() == {"content": None, "elements": None, "error": None}
    flat = partition.explode_elements(partition.partition(docs).select("path", "elements"))
    assert flat.columns[:3] == ["path", "pos", "type"] and staging.filter_element_types(flat, include=["Title"]).count() == 1
    assert staging.filter_element_types(flat, exclude=["Title"]).count() == 2
    with pytest.raises(ValueError):
        staging.filter_element_types(flat)
    plan = partition.partition(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_detection_column_agrees(spark):
    from paperloom.sources.decode import detect_filetype, filetype_column

    cases = [("a.md", b"x"), ("x/b.HTML", b""), ("c", b"%PDF-1"), ("d", b"<html><body>"), ("e", b'{"a"'), ("f", b"words"), ("g", b"\0"), ("h.doc", b"x"),
             ("i", b"From: a\nTo: b\nReceived: c\n")]
    df = spark.createDataFrame([(k, n, bytearray(d)) for k, (n, d) in enumerate(cases)], "k int, path string, content binary")
    got = [r[1] for r in df.select("k", filetype_column(F.col("path"), F.col("content"))).orderBy("k").collect()]
    for (name, data), kind in zip(cases, got):
        try:
            assert kind == detect_filetype(data, name)
        except ValueError:
            assert kind is None


def test_partition_text_agrees_with_rows(spark):
    texts = ["HARBOR POLICY\nShips are moored at night.\n• one\n- \n1. two\na@b.co", "", None, "Das ist nicht gut.\n\nUnd es ist ein Haus, das die Leute mit dem Auto sehen."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["elements"] for r in partition.partition_text(df).collect()}
    for i, t in enumerate(texts):
        expected = partition.parse_document((t or "").encode(), None, Options(content_type="text/plain"))
        assert [(e["type"], e["text"], e["element_id"], e["parent_id"], e["languages"]) for e in got[i]] == [
            (e["type"], e["text"], e["element_id"], e["metadata"].get("parent_id"), e["metadata"].get("languages")) for e in expected
        ]


def test_staging_columns(spark):
    df = spark.createDataFrame([(bytearray(b"# Head\n\nIt was good.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![p](u.png)"),)], "content binary")
    docs = partition.partition_md(df)
    plain = partition.parse_document(b"# Head\n\nIt was good.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![p](u.png)", None, Options(content_type="text/markdown"))
    r = docs.select(staging.markdown_of(F.col("elements")).alias("md"), staging.text_of(F.col("elements")).alias("txt")).first()
    assert r["md"] == serialize.to_md(plain) and r["txt"] == serialize.to_text(plain)
    packed = staging.with_packed_json(staging.with_json(docs))
    back = staging.from_packed_json(packed.select("packed")).first()["elements"]
    assert [e["text"] for e in back] == [e["text"] for e in plain]
    assert json.loads(packed.first()["json"])[0]["text"] == "Head"
    assert staging.csv_rows(partition.explode_elements(docs)).columns[6] == "sender"
    assert "metadata_filename" in staging.flatten_struct(partition.explode_elements(docs)).columns
    assert staging.read_types(spark.createDataFrame([("Text",), ("Nope",)], "type string")).collect()[0][0] == "NarrativeText"


def test_coordinates(spark):
    df = spark.createDataFrame([([(10.0, 20.0)],)], "p array<struct<x:double,y:double>>")
    got = df.select(relational.convert_coordinates(F.col("p"), ("PixelSpace", 100, 200), ("PointSpace", 100, 200))).first()[0][0]
    assert (got["x"], got["y"]) == (10.0, 180.0)


def test_urls_that_are_not_http(spark):
    r = read_urls(spark.createDataFrame([("file:///etc/passwd",), (None,)], "url string")).collect()
    assert all(x["content"] is None and x["fetch_error"].startswith("ValueError") for x in r)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"# Head\n\nIt was good.")
    q = write_elements(stream_elements(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_line(tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nIt was good.")
    run = lambda *a: subprocess.run([sys.executable, "-m", "paperloom", *a], capture_output=True, text=True, timeout=120)
    assert json.loads(run(str(tmp_path / "a.md")).stdout)[0]["type"] == "Title"
    assert run(str(tmp_path / "a.md"), "-f", "text").stdout == "Head\nIt was good.\n"
    bad = run(str(tmp_path / "none.md"))
    assert bad.returncode == 2 and bad.stderr.startswith("paperloom:")
    assert run("--version").stdout.startswith("paperloom ")
