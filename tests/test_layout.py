"""Operators over boxes against plain loops, with ties, nulls and repeated rows."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pagesmith.operators import flow as U
from pagesmith.operators import layout as L
from pagesmith.operators import selection as P

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SCHEMA = f"region_id bigint, job_id string, page_number int, block_idx int, region_type string, bbox {BOX}, content string, extra string"


def regions(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_merge_folds_small_into_first_large(spark):
    got = L.merge_overlaps(regions(spark, [
        (1, "j", 1, 0, "text", (0.0, 0.0, 10.0, 10.0), "small"),
        (2, "j", 1, 1, "text", (0.0, 0.0, 100.0, 100.0), "large"),
        (3, "j", 1, 2, "table", (0.0, 0.0, 5.0, 5.0), "kept"),
        (4, "j", 1, 3, "text", None, None),
        (5, "j", 1, 4, "text", (0.0, 0.0, 100.0, 100.0), "equal"),
    ]))
    # The earlier of equal areas is folded into the later, with the text that it carries.
    assert {r["region_id"]: r["content"] for r in got.collect()} == {3: "kept", 4: "", 5: "small\nlarge\nequal"}


def test_merge_never_adds_blocks(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rng.random() * 50, rng.random() * 50
        rows.append((i, "j", i % 3, i, "text", (x, y, x + rng.random() * 60, y + rng.random() * 60), f"t{i}"))
    got = L.merge_overlaps(regions(spark, rows)).collect()
    assert len(got) <= len(rows)
    assert sorted(w for r in got for w in r["content"].split()) == sorted(f"t{i}" for i in range(60))


def test_overflow(spark):
    got = {r["region_id"]: (r["y1"], r["absorbed"]) for r in L.absorb_overflow(regions(spark, [
        (1, "j", 1, 0, "text", (0.0, 0.0, 10.0, 8.0), "a\nb\nc"),
        (2, "j", 1, 1, "text", (0.0, 13.0, 10.0, 20.0), ""),
        (3, "j", 1, 2, "text", (0.0, 25.1, 10.0, 30.0), None),
        (4, "j", 1, 3, "text", (0.0, 30.0, 10.0, 90.0), "own"),
    ])).collect()}
    assert got == {1: (20.0, False), 2: (20.0, True), 3: (30.0, False), 4: (90.0, False)}


def test_islands_and_intervals(spark):
    b = spark.createDataFrame([("j", 1, 1, 0.0, 10.0), ("j", 1, 2, 1.0, 11.0), ("j", 1, 3, 20.0, 30.0), ("j", 1, 4, 20.0, 20.0)], "job_id string, page_number int, id bigint, y0 double, y1 double")
    assert {r["id"]: r["island"] for r in L.line_islands(b).collect()} == {1: 1, 2: 1, 3: 2, 4: 3}
    i = b.select("job_id", "page_number", "id", F.col("y0").cast("bigint").alias("lo"), F.col("y1").cast("bigint").alias("hi"))
    assert sorted((r["start"], r["stop"]) for r in L.interval_union(i).collect()) == [(0, 11), (20, 30)]


def subtract(a, b, masks):
    merged = []
    for lo, hi in sorted(masks):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    out, at = [], a
    for lo, hi in merged:
        if hi < a or lo > b:
            continue
        if at <= lo - 1:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return [*out, (at, b)] if at <= b else out


def test_subtract_masks(spark):
    rng = random.Random(5)
    iv = [(k, s := rng.randint(0, 80), s + rng.randint(0, 40)) for k in range(40)]
    mk = [(k, s := rng.randint(0, 100), s + rng.randint(0, 9)) for k in range(9)]
    t = "job_id string, page_number int, id bigint, lo bigint, hi bigint"
    got = L.subtract_masks(spark.createDataFrame([("j", 1, *x) for x in iv], t), spark.createDataFrame([("j", 1, *x) for x in mk], t))
    want = sorted((k, *p) for k, a, b in iv for p in subtract(a, b, [m[1:] for m in mk]))
    assert sorted((r["id"], r["lo"], r["hi"]) for r in got.collect()) == want


def test_unmerge_drops_groups_without_a_later_slot(spark):
    b = spark.createDataFrame([("j", 1, 0, 1, False, "g1"), ("j", 2, 0, 2, True, None), ("k", 1, 0, 3, True, None), ("k", 1, 1, 4, False, "late"), ("l", 1, 0, 5, False, "none")], "job_id string, page_number int, block_idx int, id bigint, emptied boolean, group string")
    assert [(r["id"], r["given"]) for r in U.unmerge_pages(b).collect()] == [(2, "g1")]


@pytest.mark.parametrize("seed", range(3))
def test_unmerge_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    rows = [(f"j{i % 3}", i // 12 + 1, i % 12, i, rng.random() < 0.4, f"g{i}" if rng.random() < 0.4 else None) for i in range(90)]
    want = {}
    for job in ("j0", "j1", "j2"):
        waiting = []
        for _, _, _, i, emptied, group in sorted((r for r in rows if r[0] == job), key=lambda r: r[1:4]):
            if emptied and waiting:
                want[i] = waiting.pop(0)
            if group:
                waiting.append(group)
    b = spark.createDataFrame(rows, "job_id string, page_number int, block_idx int, id bigint, emptied boolean, group string")
    assert {r["id"]: r["given"] for r in U.unmerge_pages(b).collect()} == want


def test_bubble_order(spark):
    b = spark.createDataFrame([("j", 1, 1, 50.0, 0.0), ("j", 1, 2, 10.0, 5.0), ("j", 1, 3, 0.0, 40.0)], "job_id string, page_number int, id bigint, x0 double, y0 double")
    assert [r["id"] for r in L.bubble_order(b).orderBy("position").collect()] == [2, 1, 3]


def levels(heights, depths, tolerance=2.0):
    reps = []
    for h in sorted(set(heights), reverse=True):
        for i, r in enumerate(reps):
            if abs(h - r) <= tolerance:
                reps[i] = (r + h) / 2
                break
        else:
            reps.append(h)
    reps = sorted(reps, reverse=True)[:6]
    raw = []
    for h, d in zip(heights, depths):
        near = min(range(len(reps)), key=lambda i: abs(h - reps[i])) + 1
        raw.append(min(6, d if d is not None and abs(d - near) <= 1 else near))
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(raw)))}
    return [ranks[v] for v in raw]


@pytest.mark.parametrize("seed", range(4))
def test_heading_levels(spark, seed):
    rng = random.Random(seed)
    hs = [round(rng.uniform(8, 40), 1) for _ in range(25)]
    ds = [rng.choice([None, None, 1, 2, 3]) for _ in hs]
    t = spark.createDataFrame([("j", i, h, d) for i, (h, d) in enumerate(zip(hs, ds))], "job_id string, region_id bigint, height double, depth int")
    assert [r["level"] for r in L.heading_levels(t).orderBy("region_id").collect()] == levels(hs, ds)


def test_page_breaks(spark):
    b = spark.createDataFrame([("d", i, i, h) for i, h in enumerate([50.0, 60.0, 200.0, 10.0])], "doc string, ord int, id bigint, h double")
    got = [(r["id"], r["out_page"], r["y"]) for r in P.page_breaks(b, 120.0, 5.0).orderBy("id").collect()]
    assert got == [(0, 1, 0.0), (1, 1, 55.0), (2, 2, 0.0), (3, 3, 0.0)]


def set_on_pages(heights, page, gap):
    out, n, y = [], 1, 0.0
    for h in heights:
        if y > 0 and y + h > page:
            n, y = n + 1, 0.0
        out.append((n, y))
        y = y + h + gap
    return out


@pytest.mark.parametrize("parts", [False, True])
@pytest.mark.parametrize("page, gap", [(100.0, 8.0), (100.0, 0.0), (0.0, 0.0), (float("inf"), 1.0)])
def test_page_breaks_over_pieces(spark, monkeypatch, page, gap, parts):
    monkeypatch.setattr(P, "PIECE", 7)
    rng = random.Random(11)
    heights = {"short": [30.1], "mixed": [rng.choice([0.0, 0.1, 12.3, 40.7, 99.9, 100.0, 300.0]) for _ in range(150)], "equal": [23.0] * 100, "zero": [0.0] * 50, "low": [1.1] * 120, None: [rng.uniform(0, 60) for _ in range(90)]}
    rows = [(d, i, 1000 * k + i, h) for k, (d, hs) in enumerate(heights.items()) for i, h in enumerate(hs)]
    want = [(1000 * k + i, *at) for k, hs in enumerate(heights.values()) for i, at in enumerate(set_on_pages(hs, page, gap))]
    rng.shuffle(rows)
    b = spark.createDataFrame(rows, "doc string, ord int, id bigint, h double")
    # Parts of 16 blocks; those of a document need not begin at 0.
    got = P.page_breaks(b, page, gap, part=F.floor(F.col("ord") / 16) + F.when(F.col("doc") == "equal", 3).otherwise(0) if parts else None).collect()
    assert sorted((r["id"], r["out_page"], r["y"]) for r in got) == want


def test_page_breaks_of_one_long_document(spark):
    def took(documents):
        b = spark.range(40_000).select((F.col("id") % documents).cast("string").alias("doc"), F.col("id").alias("ord"), "id", (F.col("id") % 97).cast("double").alias("h"))
        began = time.time()
        P.page_breaks(b, 700.0).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(1000)
    assert took(1) < 4 * took(1000) + 4


def test_page_breaks_of_odd_rows_equals_sql(spark, tmp_path):
    from pagesmith.plans import small

    box = lambda h: None if h is None else (0.0, 50.0, 10.0, 50.0 + h)
    rows = [(1, "j", 1, 0, box(300.0)), (2, "j", 1, 1, box(-40.0)), (3, "j", None, 0, box(200.0)), (4, "j", 600, None, box(390.0)), (5, "j", 600, 2, box(120.0)), (6, "j", 2, 0, (0.0, 50.0, 10.0, None)), (7, "j", -3, 0, box(350.5)), (8, "j", 2, 1, None), (9, None, 1, 0, box(10.0)), (10, None, 300, 0, box(695.0))]
    spark.createDataFrame(rows, f"region_id bigint, job_id string, page_number int, block_idx int, bbox {BOX}").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "regions.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW regions AS SELECT * FROM '{tmp_path}/regions.parquet/*.parquet'")
    got = small.Q["page_breaks"](spark, str(tmp_path)).select("id", "out_page", "y").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(f"SELECT id, out_page, y FROM ({small.S['page_breaks']})").fetchall())


def test_harvest(spark):
    d = spark.createDataFrame([(1, '{"text": "a", "blocks": [{"text": "b", "n": {"html": "c"}}], "other": "d"}'), (2, "no json"), (3, None)], "k int, j string")
    assert sorted((r["name"], r["text"]) for r in P.harvest(d, "k", "j", ["text", "html"]).collect()) == [("html", "c"), ("text", "a"), ("text", "b")]


@pytest.mark.parametrize("how", ["sum", "min", "last"])
def test_earlier_pages_over_chunks(spark, how):
    rng = random.Random(7)
    rows = [(f"j{i % 2}", i // 2 * 37 % 4001, rng.randint(-9, 9) if rng.random() < 0.7 else None) for i in range(400)]
    got = {(r["job_id"], r["page_number"]): r["x"] for r in U.earlier(spark.createDataFrame(rows, "job_id string, page_number int, v int"), x=("v", how)).collect()}
    for j, p, _ in rows:
        before = [v for k, q, v in sorted(rows, key=lambda r: r[1]) if k == j and q < p and v is not None]
        assert got[j, p] == (sum(before) if how == "sum" else None if not before else min(before) if how == "min" else before[-1])


def test_numbered_in_jobs(spark):
    rows = [(f"j{i % 3}", i % 700, i % 5, i) for i in range(2000)]
    got = U.numbered_in_jobs(spark.createDataFrame(rows, "job_id string, page_number int, block_idx int, region_id bigint"), ["block_idx", "region_id"], "n")
    for j in ("j0", "j1", "j2"):
        mine = sorted((r for r in got.collect() if r["job_id"] == j), key=lambda r: (r["page_number"], r["block_idx"], r["region_id"]))
        assert [r["n"] for r in mine] == list(range(len(mine)))


def joins(spark, *rows):
    """(page, type, content) of one job whose pages are joined, in order; content None: nothing is shown. The numbers of the rows that join."""
    made = [("j", p, i, i, t, c, True, t == "text" or bool(c)) for i, (p, t, c) in enumerate(rows)]
    d = spark.createDataFrame(made, "job_id string, page_number int, block_idx int, region_id bigint, region_type string, content string, joined boolean, shown boolean")
    return sorted(r["region_id"] for r in U.page_joins(d).where("joins").collect())


def test_page_joins(spark):
    assert joins(spark, (1, "text", "open"), (2, "text", "goes on"), (2, "text", "not this")) == [1]
    assert joins(spark, (1, "text", "closed."), (2, "text", "new")) == []
    assert joins(spark, (1, "text", "open"), (2, "figure", None), (3, "text", "goes on")) == [2]
    assert joins(spark, (1, "text", "open"), (2, "title", "T"), (2, "text", "new")) == []
    assert joins(spark, (1, "text", "open"), (2, "text", ""), (2, "text", "goes on")) == [1, 2]
    assert joins(spark, (1, "text", "open"), (1, "figure", None), (2, "text", "new")) == []
    assert joins(spark, (1, "text", None), (2, "text", None)) == [1]
