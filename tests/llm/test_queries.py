"""The queries of the text problems through Spark: fixtures with nulls, repeated rows and clashing names; empty tables; columns."""

import os

import pytest

from pagesmith.llm import queries as Q
from pagesmith.llm import leaks, scans, sentences, visual

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are missing")
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
COLUMNS = {"p1_found": ["region_id", "start_pos", "end_pos"], "p2_found": ["region_id"], "p3_found": ["region_id", "lang"], "p4_found": ["kind", "key_a", "key_b"], "p5_found": ["region_id", "flaw", "fixed"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@data
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = Q.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    if name != "p6_ids":
        rows = df.collect()
        assert len(rows) == len(set(rows))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(str(d / f))
    return str(d)


@data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


def test_sentence_spans_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "One. Two.", 7, "x"), (1, "One. Two.", 7, "x"), (2, None, 8, None), (3, " ", 9, "y")], "region_id bigint, content string, start_pos int, other string")
    got = sorted((r["region_id"], r["other"], r["start_pos"], r["end_pos"]) for r in sentences.sentence_spans(df).collect())
    assert got == [(1, "x", 0, 4), (1, "x", 0, 4), (1, "x", 5, 9), (1, "x", 5, 9)]


def test_look_alike_pairs(spark):
    df = spark.createDataFrame([(1, "The file"), (2, "The ﬁle"), (3, "Thе file"), (4, "The file"), (4, "The file"), (5, "the file"), (6, None), (7, ""), (8, "​")], "id bigint, t string")
    got = sorted(tuple(r) for r in visual.look_alike_pairs(df, "id", "t").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def test_a_hot_look_in_parts_and_its_classes(spark, monkeypatch):
    monkeypatch.setattr(visual, "HOT", 3)
    rows = [(i, ("The file", "The ﬁle", "Thе file")[i % 3]) for i in range(30)] + [(100 + i, "copies") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b < 30 and x != y)
    assert sorted(tuple(r) for r in visual.look_alike_pairs(df, "id", "t").collect()) == want
    got = visual.look_classes(df, "id", "t").collect()
    assert sorted((r["first_key"], r["members"]) for r in got) == [(0, 10), (1, 10), (2, 10)] and len({r["look"] for r in got}) == 1


def test_older_deliveries_do_not_come_back(spark, tmp_path):
    import shutil

    d = tmp_path / "d"
    shutil.copytree(DATA, d)
    schema = spark.read.parquet(f"{DATA}/regions.parquet").schema
    at = __import__("datetime").datetime
    row = lambda content, day: tuple({"region_id": 1, "job_id": "j", "page_number": 1, "block_idx": 0, "region_type": "text", "content": content, "ingested_at": at(2024, 1, day)}.get(c) for c in schema.names)
    os.remove(d / "regions.parquet")
    spark.createDataFrame([row("${name} is here. One.", 1), row("", 2)], schema).write.parquet(str(d / "regions.parquet"))
    os.remove(d / "ocr_pages.parquet")
    spark.createDataFrame([("j", 1, 1.0, 1.0, False)], "job_id string, page_number int, width double, height double, scanned boolean").write.parquet(str(d / "ocr_pages.parquet"))
    assert Q.queries()["p1_found"](spark, str(d)).count() == 0 and Q.queries()["p2_found"](spark, str(d)).count() == 0


def test_look_alike_runs(spark):
    regions = spark.createDataFrame([(1, "A <b>bold</b> word"), (2, None)], "region_id bigint, content string")
    runs = spark.createDataFrame([(10, 1, "bold"), (11, 1, "bоld"), (12, 1, "Bold"), (13, 1, None), (14, 1, ""), (15, 2, "x"), (16, 9, "x"), (11, 1, "bоld")], "run_id bigint, region_id bigint, text string")
    assert [tuple(r) for r in visual.look_alike_runs(runs, regions).collect()] == [(1, 11)]


def test_leaks_in_blocks(spark):
    item = " ".join(f"word{i}x" for i in range(50))
    other = " ".join(f"term{i}y" for i in range(50))
    docs = spark.createDataFrame([(1, "so " + item.upper()), (2, " ".join(item.split()[:20])), (3, None), (4, ""), (5, other + "\n" + item)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, other), (9, None)], "item_id bigint, text string")
    for chars in (leaks.BLOCK_CHARS, 300):
        assert sorted(tuple(r) for r in leaks.leaks(docs, bench, block_chars=chars).collect()) == [(1, 7), (5, 7), (5, 8)]


def test_flaws_of_scanned_pages(spark):
    rows, pages, rid = [], [], 0

    def add(job, page, idx, kind, y, text):
        nonlocal rid
        rid += 1
        rows.append((rid, job, page, idx, kind, (72.0, y, 520.0, y + 14.0) if y is not None else None, text))
        return rid

    for j in range(6):
        for p in range(1, 6):
            pages.append((f"d{j}", p, 595.0, 842.0, False))
            add(f"d{j}", p, 0, "text", 100.0, "The committee compared the attached letters with the well-known register of the office.")
            pages.append((f"s{j}", p, 595.0, 842.0, True))
            add(f"s{j}", p, 0, "header", 28.0, f"Rules of job {j}")
            add(f"s{j}", p, 1, "text", 100.0, "The letters of the office were read\nby the committee with the register.")
            add(f"s{j}", p, 2, "footer", 810.0, f"- {p} -")
    flawed = add("x", 1, 1, "text", 100.0, "The eommittee compared the attac-\nhed letters with the well-\nknown register.\n1\nThe office")
    add("x", 1, 0, "header", 28.0, "Rules of x")
    goes = add("x", 2, 0, "text", 100.0, "compared the letters.")
    pages += [("x", 1, 595.0, 842.0, True), ("x", 2, 595.0, 842.0, True), ("x", 2, 0.0, None, True)]
    add("x", 2, 1, "text", None, None)
    r = spark.createDataFrame([(*x, "extra") for x in rows], f"region_id bigint, job_id string, page_number int, block_idx int, region_type string, bbox {BOX}, content string, word string")
    pg = spark.createDataFrame(pages, "job_id string, page_number int, width double, height double, scanned boolean")
    got = {}
    for joined in (True, None):
        o = spark.createDataFrame([("x", joined), ("x", joined)], "job_id string, join_broken_pages boolean")
        got[joined] = sorted(tuple(x) for x in scans.flaws(spark, r, pg, o).where(f"region_id IN ({flawed}, {goes})").collect())
    base = [(flawed, "furniture", "1"), (flawed, "hyphen", "attached"), (flawed, "hyphen", "well-known"), (flawed, "misread", "committee")]
    assert got[True] == sorted([*base, (flawed, "split", str(goes))])
    assert got[None] == base


@pytest.mark.parametrize("sign", ["-", "\u2010", "\u2011", "\u00ac", "\u00ad"])
def test_words_broken_by_any_hyphen(spark, sign):
    rows, pages = [], []
    for p in range(1, 6):
        pages += [("d", p, 595.0, 842.0, False)]
        rows.append((p, "d", p, 0, "text", (72.0, 100.0, 520.0, 114.0), "The committee has the attached letters and the complaints."))
    pages += [("x", 1, 595.0, 842.0, True), ("x", 2, 595.0, 842.0, True)]
    rows.append((11, "x", 1, 0, "text", (72.0, 100.0, 520.0, 140.0), f"The committee has the attac{sign}\nhed letters and the compl{sign}"))
    rows.append((12, "x", 2, 0, "text", (72.0, 100.0, 520.0, 114.0), "aints."))
    r = spark.createDataFrame(rows, f"region_id bigint, job_id string, page_number int, block_idx int, region_type string, bbox {BOX}, content string")
    pg = spark.createDataFrame(pages, "job_id string, page_number int, width double, height double, scanned boolean")
    o = spark.createDataFrame([("x", True)], "job_id string, join_broken_pages boolean")
    got = sorted(tuple(x) for x in scans.flaws(spark, r, pg, o).where("region_id IN (11, 12)").collect())
    assert got == [(11, "hyphen", "attached"), (11, "hyphen", "complaints"), (11, "split", "12")]
    assert not {"attac", "hed", "compl"} & {x["word"] for x in scans.word_counts(scans.seen(scans.paged_regions(r, pg, o), scans.sent(spark, scans.Chain(4, scans.BITS)))).collect()}
