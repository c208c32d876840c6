"""Jobs, streams, sources, sinks and model slots."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pagesmith.models import slots
from pagesmith.operators import jobs as J
from pagesmith.operators import translation as X
from pagesmith.operators.scan import numbered
from pagesmith.plans.registry import queries
from pagesmith.sources import files as I
from pagesmith.sources import sinks as O
from pagesmith.streaming import progress as S


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), "id").repartition(7)
    got = numbered(df, ["k", "id"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 1001)) and [r["k"] for r in got] == list(range(1000))


@pytest.mark.parametrize(
    "oks,want",
    [([False, False, True], ("completed", 3, 2)), ([False] * 5, ("failed", 3, 2)), ([True, False], ("completed", 1, 0)), ([False, True, True], ("completed", 2, 1))],
)
def test_run_outcome(spark, oks, want):
    a = spark.createDataFrame([("j", i, ok, 0) for i, ok in enumerate(oks)], "job string, ord int, ok boolean, pages int")
    r = J.run_outcome(a).first()
    assert (r["status"], r["n_attempts"], r["retry_count"]) == want


def test_transition_keeps_final_states():
    assert S.fold([("start", 0), ("error", 0), ("error", 0), ("error", 0), ("start", 0)]) == ("failed", 2, 0)
    assert S.fold([("start", 0), ("progress", 3), ("error", 0), ("error", 0), ("error", 0)]) == ("completed", 2, 3)
    assert S.fold([]) == ("queued", 0, 0)


def test_stream_equals_batch(spark, tmp_path):
    events = [("a", 1, "start", 0), ("a", 2, "error", 0), ("a", 3, "success", 9), ("b", 1, "start", 0), ("b", 2, "progress", 4)]
    spark.createDataFrame(events, "job_id string, ts int, event string, value int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, ts int, event string, value int").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = S.run_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(120):
        time.sleep(0.5)
        if spark.sql("SELECT count(*) FROM states").first()[0] >= 2:
            break
    q.stop()
    got = {r["job_id"]: (r["status"], r["retries"], r["pages"]) for r in spark.sql("SELECT * FROM states").collect()}
    for j in "ab":
        assert got[j] == S.fold([(e, v) for i, _, e, v in events if i == j])
    S.latest_progress(stream, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert {r["job_id"]: r["event"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "success", "b": "progress"}


def test_event_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS event_type UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'x'").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = S.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == 2


def test_sources(spark, tmp_path):
    for p, body in (("a/Data/x_ocr_data.json", "{}"), ("a/Data/a.json", "[]"), ("b/z.json", "{}"), ("b/doc.pdf", "%PDF")):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(body)
    found = {os.path.basename(r["path"]) for r in I.discover(spark, str(tmp_path)).collect()}
    assert found == {"x_ocr_data.json", "z.json"}
    assert I.uploads(spark, str(tmp_path)).count() == 1 and I.uploads(spark, str(tmp_path), largest=3).count() == 0
    (tmp_path / "dim.json").write_text('{"_c": "no", "k": "v"}')
    assert [tuple(r) for r in I.dimension(spark, str(tmp_path / "dim.json")).collect()] == [("k", "v")]


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("no json", 0), ("[]", 0), ('[{"type": "image", "text": ""}]', 1), ('{"pages": [{"page_number": 2, "regions": [{"type": "weird", "content": "c"}]}]}', 1), ('{"pdf_info": [{"page_idx": 0, "preproc_blocks": [{"type": "title", "spans": [{"content": "a"}, {"content": "b"}]}]}]}', 1)])
def test_layouts(spark, text, n):
    got = I.blocks_of_json(spark.createDataFrame([(1, text)], "k int, j string"), "k", "j").collect()
    assert len(got) == n
    if text and "weird" in text:
        assert (got[0]["page_idx"], got[0]["region_type"], got[0]["text"]) == (1, "text", "c")
    if text and "spans" in text:
        assert got[0]["text"] == "a b"


def test_page_count(spark):
    d = spark.createDataFrame([('{"pages": [{}, {}]}',), ('{"metadata": {"total_pages": 7}}',), ("x",)], "j string")
    assert [r[0] for r in d.select(I.page_count(F.col("j"))).collect()] == [2, 7, 1]


def test_export_skips_what_fails(spark, tmp_path):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    r = spark.createDataFrame([(1, "j", 1, 0, "title", None, "T & <b>x</b>", None, None, 2), (2, "j", 1, 1, "header", None, "H", None, None, None), (3, "j", 1, 2, "table", None, None, "<table><tr><th>a|b</th></tr><tr><td>1</td><td>2</td></tr></table>", None, None)], f"region_id bigint, job_id string, page_number int, block_idx int, region_type string, bbox {box}, content string, html string, latex string, heading_level int")
    got = O.export(r, str(tmp_path), ["markdown", "html", "csv"])
    assert [(x["format"], x["ok"]) for x in got] == [("json", True), ("markdown", True), ("html", True), ("csv", False)]
    text = lambda k: "\n".join(r["value"] for r in spark.read.text(got[k]["path"] + "/job_id=j").collect())
    assert text(1).strip() == "## T & **x**\n\n| a\\|b |  |\n| --- | --- |\n| 1 | 2 |"
    assert text(2).startswith("<!DOCTYPE html>") and text(2).endswith("</body></html>") and "<h2>T &amp; <b>x</b></h2>" in text(2) and "page-header" not in text(2)
    page = json.loads(text(0))
    assert page["page_number"] == 1 and len(page["regions"]) == 3


def test_long_documents_are_written_in_order(spark, tmp_path):
    pages = spark.createDataFrame([("j", i * 7 % 500, f"p{i * 7 % 500}") for i in range(500)], "job_id string, page_number int, body string").repartition(5)
    O.write_documents(pages, str(tmp_path / "o"), "head", "tail")
    files = sorted(os.listdir(tmp_path / "o" / "job_id=j"))
    lines = [x for f in files if f.endswith(".txt") for x in (tmp_path / "o" / "job_id=j" / f).read_text().splitlines()]
    assert lines == ["head", *(f"p{i}" for i in range(500)), "tail"]


def test_csv(spark):
    d = spark.createDataFrame([(1, '{"data": [{"b": 1, "a": "x\\"y"}, {"c": {"d": 2}}]}'), (2, "none")], "k int, j string")
    got = [r["line"] for r in O.csv_lines(O.records(d, "k", "j"), "k").orderBy("line_no").collect()]
    assert got == ['"b","a","c"', '"1","x""y",', ',,"{""d"":2}"']


def test_manifest(tmp_path):
    m = O.Manifest(str(tmp_path / "m.json"), "eng_Latn", ["tam_Taml", "hin_Deva", "tam_Taml"], 2)
    m.add("a", "hin_Deva", "a_hin")
    assert json.loads((tmp_path / "m.json").read_text())["status"] == "processing"
    m.add("a", "tam_Taml", "a_tam")
    s = json.loads((tmp_path / "m.json").read_text())
    assert (s["status"], s["completed"], s["tgt_langs"]) == ("completed", 2, ["hin_Deva", "tam_Taml"]) and os.listdir(tmp_path) == ["m.json"]


def test_upsert(spark):
    cur = spark.createDataFrame([("a", "queued", None), ("b", "queued", "t0"), ("c", "done", None)], "id string, status string, started_at string")
    ch = spark.createDataFrame([("a", "put", "processing", "t1", 1), ("a", "put", None, "t2", 2), ("b", "put", "retrying", "t9", 1), ("c", "delete", None, None, 1), ("d", "put", "queued", None, 1)], "id string, op string, status string, started_at string, ts int")
    got = {r["id"]: (r["status"], r["started_at"]) for r in O.upsert(spark, cur, ch, "id").collect()}
    assert got == {"a": ("processing", "t2"), "b": ("retrying", "t0"), "d": ("queued", None)}


def test_slots(spark):
    df = spark.createDataFrame([(bytearray(b"a long enough text"),), (bytearray(b"x"),), (None,)], "b binary")
    got = [r[0] for r in df.select(slots.apply("ocr", F.col("b"))).collect()]
    assert got[0][0]["text"] == "a long enough text" and got[1][0]["score"] == 0.0 and not got[2]
    assert [r[0] for r in df.select(slots.apply("font", F.col("b"))).collect()] == [None, None, None]
    t = spark.createDataFrame([("hi", "hin_Deva"), (" ", "hin_Deva"), (None, "tam_Taml")], "t string, l string")
    out = slots.translate(t, "t", "l").select("t", slots.untranslate(F.col("translated")).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in out)
    with pytest.raises(KeyError):
        slots.apply("ocr", F.col("b"), "cloud")


def test_tree_of_headings(spark):
    toc = '[{"title": "A", "level": 1, "children": [{"title": "B", "level": 2, "children": [{"title": "C", "level": 3}]}]}, {"title": "D", "level": 1}]'
    got = I.flatten_contents(spark.createDataFrame([(1, toc), (2, None), (3, "[]")], "k int, j string"), "k", "j").orderBy("path").collect()
    assert [(r["path"], r["title"]) for r in got] == [([0], "A"), ([0, 0], "B"), ([0, 0, 0], "C"), ([1], "D")]


def test_pair_texts(spark):
    b = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 1.0)], "page string, id bigint, y double")
    t = spark.createDataFrame([("p", 1, "a", 1.0), ("p", 2, "b", 0.5), ("p", 3, "c", 0.7)], "page string, ord int, text string, score double")
    assert sorted((r["box_id"], r["text"], round(r["score"], 3)) for r in J.pair_texts(b, t).collect()) == [(1, "b c", 0.6), (2, "a", 1.0)]


def folder(spark, path, **tables):
    """The driver's smallest tables, of which some are replaced by rows: dictionaries of the columns that matter."""
    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        if f[:-8] not in tables:
            os.symlink(f"{d}/{f}", path / f)
    for t, rows in tables.items():
        schema = spark.read.parquet(f"{d}/{t}.parquet").schema
        spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).write.parquet(str(path / f"{t}.parquet"))
    return str(path)


def region(i, kind="text", content=None, box=(0.0, 0.0, 100.0, 20.0), **more):
    return {"region_id": i, "job_id": "j", "page_number": 1, "block_idx": i, "region_type": kind, "content": content, "bbox": box, **more}


PAGE = {"job_id": "j", "page_number": 1, "width": 600.0, "height": 800.0, "scanned": False}


def test_first_words_takes_6000(spark, tmp_path):
    d = folder(spark, tmp_path, regions=[region(i, content=" ".join(["word"] * n)) for i, n in ((1, 5000), (2, 999), (3, 30), (4, 5))])
    assert {r["region_id"]: len(r["taken"].split()) for r in queries()["first_words"](spark, d).collect()} == {1: 5000, 2: 999, 3: 1}


def test_large_boxes_from_a_twentieth_percent(spark, tmp_path):
    d = folder(spark, tmp_path, ocr_pages=[PAGE], regions=[region(1, box=(0.0, 0.0, 24.0, 10.0)), region(2, box=(0.0, 0.0, 23.0, 10.0)), region(3, box=(0.0, 0.0, 600.0, 100.0))])
    assert sorted(r["region_id"] for r in queries()["large_boxes"](spark, d).collect()) == [1, 3]


def test_documents_keep_their_tables(spark, tmp_path):
    html = "<table><tr><td>a</td><td>b|c</td></tr><tr><td>1</td></tr></table>"
    d = folder(spark, tmp_path, regions=[region(1, content="one"), region(2, "table", "x", html=html), region(3, "table", "p  q\nr  s")])
    body = "one\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |\n\np  q\nr  s"
    assert [tuple(r) for r in queries()["markdown_pages"](spark, d).collect()] == [("j", 1, body)]
    got = {r["region_id"]: r["out"] for r in queries()["region_html"](spark, d).collect()}
    assert got == {1: "<p>one</p>", 2: html, 3: "<table><tr><td>p</td><td>q</td></tr><tr><td>r</td><td>s</td></tr></table>"}


def test_boxes_and_contents_are_whole(spark, tmp_path):
    long = "A sentence that is longer than thirty characters, number "
    wide, strip = (50.0, 100.0, 550.0, 130.0), (10.0, 100.0, 19.0, 400.0)
    d = folder(spark, tmp_path, ocr_pages=[PAGE], regions=[region(i, content=f"{long}{i}", box=strip if i == 7 else wide) for i in (1, 3, 7, 9, 10, 15)])
    pairs = [(r["box_id"], r["text"]) for r in queries()["box_text_pair"](spark, d).collect()]
    assert sorted(x for x, _ in pairs) == [1, 3, 7, 9, 10, 15] and sorted(t for _, t in pairs) == sorted(f"{long}{i}" for i in (1, 3, 7, 9, 10, 15))
    assert {r["id"]: r["given"] for r in queries()["page_unmerge"](spark, d).collect()} == {3: f"{long}1", 15: f"{long}9"}
    assert [r["region_id"] for r in queries()["decorative"](spark, d).where("decorative").collect()] == [7]


def test_csv_of_documents_with_nulls(spark, tmp_path):
    d = folder(spark, tmp_path, documents=[{"doc_id": 3}, {"doc_id": 4}, {"doc_id": 5}, {"doc_id": 6, "source": "s", "lang": "en"}])
    got = {}
    for r in queries()["json_to_csv"](spark, d).orderBy("doc_id", "line_no").collect():
        got.setdefault(r["doc_id"], []).append(r["line"])
    assert got == {3: ['"id","src","lang"', '"3",,', '"x",,'], 4: ['"lang","id"', ',"4"'], 5: ['"id","src"', '"5",'], 6: ['"id","src","lang"', '"6","s",', '"x",,"en"']}


def test_admitted_takes_the_first_of_each_class(spark):
    rows = [("a", "ocr", "queued", 9, 1), ("b", "ocr", "queued", 2, 2), ("c", "heading_correction", "queued", 2, 3), ("d", "ocr", "processing", 1, 0), ("e", "translate", "queued", None, 4), ("f", "ocr", "queued", 2, 1)]
    j = spark.createDataFrame(rows, "job_id string, job_type string, status string, total_pages int, created_at int")
    assert sorted((r["job_id"], r["turn"]) for r in J.admitted(j, {"ocr": 3, "llm": 1}).collect()) == [("b", 2), ("e", 1), ("f", 1)]
    assert J.admitted(j, {"ocr": 1, "llm": 0}).count() == 0


@pytest.mark.parametrize("reply,want", [('{"lines": ["a", {"text": "b"}]}', ("a\nb", 1.0)), ('{"text": "t"}', ("t", 1.0)), ("{no json", ("{no json", 0.9)), ("plain", ("plain", 0.9)), ("", ("[unreadable]", 0.0)), (None, ("[unreadable]", 0.0)), ("[1]", ("[1]", 0.9)), ("{}", ("", 1.0))])
def test_parsed_reply(spark, reply, want):
    assert tuple(spark.createDataFrame([(reply,)], "r string").select(J.parsed_reply(F.col("r")).alias("x")).first()["x"]) == want


def test_against_schema(spark):
    d = spark.createDataFrame([(1, '{"a": "x", "n": 3, "extra": 1}'), (2, '{"a": null, "n": "3"}'), (3, "no"), (4, None), (5, '{"n": 1.5}')], "k int, j string")
    got = sorted((r["k"], r["field"] or "", r["fault"]) for r in J.against_schema(d, "k", "j", {"a": "string", "n": "integer"}, ("a",)).collect())
    assert got == [(1, "extra", "unknown"), (2, "a", "null"), (2, "n", "kind"), (3, "", "json"), (4, "", "json"), (5, "a", "missing"), (5, "n", "kind")]


def test_translated_json_keeps_everything_else(spark):
    docs = [
        {"pages": [{"n": 1, "regions": [{"type": "text", "content": "one", "bbox": [1, 2], "odd": {"x": [1]}}, {"type": "table", "table_html": "<table><tr><td>a <b>b</b></td><td> </td></tr></table>"}, {"type": "figure", "content": "stays"}]}], "metadata": {"file_name": "f"}},
        {"content_list": [{"type": "title", "text": "t", "font_size": 9}, {"type": "text", "text": " "}]},
        [{"type": "text", "content": "bare"}],
        {"pdf_info": [{"preproc_blocks": [{"type": "list", "text": "l"}]}]},
    ]
    raw = [json.dumps(x) for x in docs] + ["no json", None]
    df = spark.createDataFrame([(i, x, "tam_Taml") for i, x in enumerate(raw)], "k int, j string, tgt string")
    got = {r["k"]: r["json"] for r in X.translate_json(df, "k", "j", "tgt").collect()}
    assert got[4] == "no json" and got[5] is None
    r = json.loads(got[0])["pages"][0]["regions"]
    assert [r[0]["content"], r[1]["table_html"], r[2]["content"]] == ["[tam_Taml] one", "<table><tr><td>[tam_Taml] a b</td><td> </td></tr></table>", "stays"]
    undone = {k: json.loads(v.replace("[tam_Taml] ", "")) for k, v in got.items() if k in (1, 2, 3)}
    assert [undone[1], undone[2], undone[3]] == docs[1:]
    assert json.loads(got[0].replace("[tam_Taml] ", "").replace("a b", "a <b>b</b>")) == docs[0]


def test_trees_of_any_depth(spark):
    toc = '{"title": "x", "level": 1}'
    for _ in range(11):
        toc = '{"title": "[x", "level": 1, "children": [' + toc + "]}"
    d = spark.createDataFrame([(1, f"[{toc}]"), (2, None), (3, "no")], "k int, j string")
    assert max(len(r["path"]) for r in I.flatten_contents(d, "k", "j").collect()) == 12
    from pagesmith.operators.selection import harvest

    assert harvest(d.withColumn("j", F.regexp_replace("j", r"^\[|\]$", "")), "k", "j", ["title"]).count() == 12


def test_finished_tasks_expire_by_a_timer(spark, tmp_path):
    spark.createDataFrame([("a", 1, "completed"), ("b", 1, "processing")], "job_id string, ts int, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, ts int, status string").parquet(str(tmp_path / "in"))
    q = S.expire(stream, "1 second").writeStream.outputMode("update").format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(0.5)
        if spark.sql("SELECT count(*) FROM gone").first()[0]:
            break
    q.stop()
    assert [r["job_id"] for r in spark.sql("SELECT * FROM gone").collect()] == ["a"]
