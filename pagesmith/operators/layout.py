"""Operators over boxes of a page: measures, joins by place, merges of lines and intervals, headings.

Rows without a box take part only where said. Every order ends with the row's
own number, so that ties have one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesmith.functions import geometry as G
from pagesmith.functions import text as T

TEXT_TYPES = ("text", "title", "list", "index")


def line_boxes(regions: DataFrame) -> DataFrame:
    """(…, line_no, n_lines, line_box): a region's box cut into equal lines, one for each line of content."""
    x = regions.where("content IS NOT NULL AND bbox IS NOT NULL").withColumn("_l", F.split("content", "\n"))
    x = x.select("*", F.size("_l").alias("n_lines"), F.posexplode("_l").alias("line_no", "line")).drop("_l")
    h = G.height(F.col("bbox")) / F.col("n_lines")
    return x.withColumn("line_box", G.box(F.col("bbox.x0"), F.col("bbox.y0") + h * F.col("line_no"), F.col("bbox.x1"), F.col("bbox.y0") + h * (F.col("line_no") + 1)))


def line_height(regions: DataFrame) -> DataFrame:
    """(job_id, page_number, line_height): the upper median of the heights of text lines; null unless three blocks have one."""
    l = line_boxes(regions.where(F.col("region_type").isin(*TEXT_TYPES))).withColumn("h", G.height(F.col("line_box"))).where("h > 0")
    hs = F.sort_array(F.collect_list("h"))
    return l.groupBy("job_id", "page_number").agg(F.when(F.countDistinct("region_id") >= 3, F.element_at(hs, F.floor(F.size(hs) / 2).cast("int") + 1)).alias("line_height"))


def x_union(regions: DataFrame) -> DataFrame:
    """(job_id, page_number, x0, x1): the extent of text blocks of positive width."""
    ok = F.col("region_type").isin(*TEXT_TYPES) & (G.width(F.col("bbox")) > 0)
    return regions.where(ok).groupBy("job_id", "page_number").agg(F.min("bbox.x0").alias("x0"), F.max("bbox.x1").alias("x1"))


def decorative(regions: DataFrame, pages: DataFrame, all_regions: DataFrame | None = None) -> DataFrame:
    """(region_id, decorative): narrow strips; and, off the text's lines, small icons and watermarks. False without a box of positive area; without the page's measures only strips are. all_regions: those that a page is measured by, if others."""
    every = regions if all_regions is None else all_regions
    b = regions.join(pages, ["job_id", "page_number"]).join(line_height(every), ["job_id", "page_number"], "left").join(x_union(every), ["job_id", "page_number"], "left")
    w, h, n = G.width(F.col("bbox")), G.height(F.col("bbox")), F.length(T.strip(F.coalesce("content", F.lit(""))))
    strip = (h / w > 6) & (w < 60)
    overlap = F.greatest(F.lit(0.0), F.least(F.col("bbox.x1"), F.col("x1")) - F.greatest(F.col("bbox.x0"), F.col("x0")))
    inline = (h < 2 * F.col("line_height")) & (overlap > 0.5 * w)
    icon = (w < 0.15 * F.col("width")) & (h < 100) & (n > 0) & (n <= 10)
    mark = (n > 0) & (n <= 3) & (w < 0.25 * F.col("width")) & (w * h < 50 * F.col("width"))
    kind = F.when(F.col("bbox").isNull() | (w <= 0) | (h <= 0), False).when(strip, True).when(F.col("line_height").isNull() | F.col("x0").isNull(), False).when(inline, False).otherwise(icon | mark)
    return b.select("region_id", kind.alias("decorative"))


def renderable(regions: DataFrame) -> DataFrame:
    """(region_id): regions with something to draw and a positive area."""
    has = (T.strip(F.coalesce("content", F.lit(""))) != "") | (F.col("html").isNotNull() & (F.col("html") != "")) | F.col("latex").isNotNull()
    return regions.where(has & (G.area(F.col("bbox")) > 0)).select("region_id")


def best_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): of each left box the right box of its page that covers most of it; the first of equals; none without common area. Columns: job_id, page_number, id, ord, bbox."""
    a = left.select("job_id", "page_number", F.col("id").alias("left_id"), F.col("bbox").alias("a"))
    b = right.select("job_id", "page_number", F.col("id").alias("right_id"), F.col("ord").alias("o"), F.col("bbox").alias("b"))
    pairs = a.join(b, ["job_id", "page_number"]).withColumn("v", G.intersection(F.col("a"), F.col("b"))).where("v > 0 AND left_id <> right_id")
    return pairs.groupBy("left_id").agg(F.max_by("right_id", F.struct(F.col("v"), -F.col("o"), -F.col("right_id"))).alias("right_id"))


def dominant_by_centre(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, name): of each block the name with most characters among the spans whose centre lies in it; the first seen of equals. spans: job_id, page_number, ord, name, n_chars, bbox; blocks: job_id, page_number, id, bbox."""
    cx, cy = (F.col("s.x0") + F.col("s.x1")) / 2, (F.col("s.y0") + F.col("s.y1")) / 2
    s = spans.select("job_id", "page_number", "ord", "name", "n_chars", F.col("bbox").alias("s"))
    b = blocks.select("job_id", "page_number", F.col("id").alias("block_id"), F.col("bbox").alias("b"))
    inside = s.join(b, ["job_id", "page_number"]).where(cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.y0"), F.col("b.y1")))
    total = inside.groupBy("block_id", "name").agg(F.sum("n_chars").alias("n"), F.min("ord").alias("o"))
    return total.groupBy("block_id").agg(F.max_by("name", F.struct(F.col("n"), -F.col("o"))).alias("name"))


def line_islands(boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """(id, island): boxes of a page, from above, that overlap the one before by more than share of the lower height lie on one line. Columns: job_id, page_number, id, y0, y1."""
    w = W.partitionBy("job_id", "page_number").orderBy("y0", "id")
    p0, p1 = F.lag("y0").over(w), F.lag("y1").over(w)
    common = F.least(F.col("y1"), p1) - F.greatest(F.col("y0"), p0)
    least = F.least(F.col("y1") - F.col("y0"), p1 - p0)
    new = F.when(p0.isNull() | ~((least > 0) & (common / least > share)), 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).select("id", "island")


def interval_union(boxes: DataFrame) -> DataFrame:
    """(job_id, page_number, start, stop): the intervals of a page merged where they touch. Columns: job_id, page_number, id, lo, hi."""
    w = W.partitionBy("job_id", "page_number").orderBy("lo", "hi", "id")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    x = boxes.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("job_id", "page_number", "_g").agg(F.min("lo").alias("start"), F.max("hi").alias("stop")).drop("_g")


def subtract_masks(intervals: DataFrame, masks: DataFrame) -> DataFrame:
    """(id, lo, hi): what masks of the same page leave of whole-number intervals. Masks that touch count as one; ends are the neighbours of a mask's ends.

    intervals: job_id, page_number, id, lo, hi; masks: job_id, page_number, id, lo, hi.
    """
    merged = interval_union(masks)
    i = intervals.select("job_id", "page_number", "id", F.col("lo").alias("a"), F.col("hi").alias("b"))
    hit = i.join(merged, ["job_id", "page_number"]).where("start <= b AND stop >= a").groupBy("id", "a", "b").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("m"))
    whole = i.join(hit.select("id"), "id", "left_anti").select("id", F.col("a").alias("lo"), F.col("b").alias("hi"))
    step = lambda acc, m: F.struct(F.concat(acc["out"], F.when(acc["at"] <= m["start"] - 1, F.array(F.struct(acc["at"].alias("lo"), (m["start"] - 1).alias("hi")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))).alias("out"), F.greatest(acc["at"], m["stop"] + 1).alias("at"))
    done = F.aggregate("m", F.struct(F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("out"), F.col("a").alias("at")), step)
    cut = hit.select("id", "b", done.alias("d")).select("id", F.explode(F.concat(F.col("d.out"), F.when(F.col("d.at") <= F.col("b"), F.array(F.struct(F.col("d.at").alias("lo"), F.col("b").alias("hi")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>")))).alias("p"))
    return cut.select("id", "p.lo", "p.hi").unionByName(whole)


def reading_order(regions: DataFrame) -> DataFrame:
    """(region_id, position): order of a page by height, the given order among equals."""
    w = W.partitionBy("job_id", "page_number").orderBy(F.coalesce(F.col("bbox.y0"), F.lit(0.0)), "block_idx", "region_id")
    return regions.select("region_id", F.row_number().over(w).alias("position"))


def largest_blocks(regions: DataFrame, n: int = 10) -> DataFrame:
    """(region_id, rank): a job's n blocks of largest area; reading order among equals."""
    w = W.partitionBy("job_id").orderBy(G.area(F.col("bbox")).desc(), "page_number", "block_idx", "region_id")
    return regions.where("bbox IS NOT NULL").select("region_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def merge_overlaps(regions: DataFrame, share: float = 0.6) -> DataFrame:
    """(region_id, content): text blocks of which share lies in a block at least as large go into the first such one, their text before its.

    Each merge changes what the next one sees, so a page's text blocks are
    folded in order, and only on pages where any two may merge. Blocks without
    area, and of other types, stay and are not grouped.
    """
    may = F.coalesce(F.col("region_type").isin("text", "title", "list") & (G.area(F.col("bbox")) > 0), F.lit(False))
    text = F.coalesce("content", F.lit(""))
    rest = regions.where(~may).select("region_id", text.alias("content"))
    block = F.struct("block_idx", "region_id", "bbox", G.area(F.col("bbox")).alias("area"), text.alias("text"), F.lit(False).alias("gone"))
    page = regions.where(may).groupBy("job_id", "page_number").agg(F.sort_array(F.collect_list(block)).alias("b"))
    takes = lambda big, small: ~big["gone"] & (big["region_id"] != small["region_id"]) & (big["area"] >= small["area"]) & (G.intersection(small["bbox"], big["bbox"]) / small["area"] >= share)

    def fold(s: Column, i: Column) -> Column:
        small = F.element_at(s, i)
        at = F.array_position(F.transform(s, lambda x: takes(x, small)), F.lit(True))
        put = lambda x, k: F.when(k + 1 == at, x.withField("text", T.strip(F.concat(T.strip(small["text"]), F.lit("\n"), x["text"])))).when(k + 1 == i, x.withField("gone", F.lit(True))).otherwise(x)
        return F.when(small["gone"] | (at == 0), s).otherwise(F.transform(s, put))

    any_pair = F.exists("b", lambda x: F.exists("b", lambda y: takes(y, x)))
    page = page.withColumn("b", F.when(any_pair, F.aggregate(F.sequence(F.lit(1), F.size("b")), F.col("b"), fold)).otherwise(F.col("b")))
    return page.select(F.explode(F.filter("b", lambda x: ~x["gone"])).alias("x")).select("x.region_id", F.col("x.text").alias("content")).unionByName(rest)


def absorb_overflow(regions: DataFrame, per_line: float = 10.0, gap: float = 5.0) -> DataFrame:
    """(region_id, y1, absorbed): a text block lower than its lines need takes in the empty blocks that follow close below, up to a block with text, a table, figure, title or image. One block takes at a time, so a page is one fold in reading order."""
    text = T.strip(F.coalesce("content", F.lit("")))
    lines = F.size(F.split(F.coalesce("content", F.lit("")), "\n"))
    starts = (text != "") & ~F.coalesce(F.col("region_type").isin("table", "figure", "image", "image_body"), F.lit(False)) & (F.col("bbox.y1") - F.col("bbox.y0") < per_line * lines)
    free = (text == "") & ~F.coalesce(F.col("region_type").isin("table", "figure", "title", "image"), F.lit(False))
    block = F.struct("block_idx", "region_id", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), starts.alias("starts"), free.alias("free"))
    page = regions.where("bbox IS NOT NULL").groupBy("job_id", "page_number").agg(F.sort_array(F.collect_list(block)).alias("b"))
    entry = "array<struct<region_id:bigint,y1:double,by:bigint>>"
    start = F.struct(F.lit(None).cast("bigint").alias("by"), F.lit(0.0).alias("reach"), F.array().cast(entry).alias("out"))

    def fold(s: Column, x: Column) -> Column:
        taken = s["by"].isNotNull() & x["free"] & (x["y0"] - s["reach"] <= gap)
        one = F.struct(x["region_id"].alias("region_id"), x["y1"].alias("y1"), F.when(taken, s["by"]).alias("by"))
        return F.struct(F.when(taken, s["by"]).when(x["starts"], x["region_id"]).alias("by"), F.when(taken, F.greatest(s["reach"], x["y1"])).otherwise(x["y1"]).alias("reach"), F.concat(s["out"], F.array(one)).alias("out"))

    o = page.select(F.when(F.exists("b", lambda x: x["free"]) & F.exists("b", lambda x: x["starts"]), F.aggregate("b", start, fold)["out"]).otherwise(F.transform("b", lambda x: F.struct(x["region_id"].alias("region_id"), x["y1"].alias("y1"), F.lit(None).cast("bigint").alias("by")))).alias("o"))
    reach = lambda x: F.when(x["by"].isNull(), F.array_max(F.transform(F.filter("o", lambda y: (y["by"] == x["region_id"]) | (y["region_id"] == x["region_id"])), lambda y: y["y1"]))).otherwise(x["y1"])
    return o.select(F.explode(F.transform("o", lambda x: F.struct(x["region_id"].alias("region_id"), reach(x).alias("y1"), x["by"].isNotNull().alias("absorbed")))).alias("x")).select("x.*")


def bubble_order(boxes: DataFrame, near: float = 10.0) -> DataFrame:
    """(id, position): by y then x; then each box moves forward past those before it that lie within near of its height and have a larger x, as far as that goes. A fold over a page: a box is put in after the last one that it does not pass. Columns: job_id, page_number, id, x0, y0."""
    page = boxes.groupBy("job_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "id"))).alias("b"))

    def fold(s: Column, x: Column) -> Column:
        stops = F.transform(s, lambda y: ~((F.abs(x["y0"] - y["y0"]) < near) & (x["x0"] < y["x0"])))
        p = F.coalesce(F.array_max(F.transform(stops, lambda v, k: F.when(v, k + 1).otherwise(0))), F.lit(0))
        return F.concat(F.slice(s, F.lit(1), p), F.array(x), F.slice(s, p + 1, F.size(s)))

    done = F.aggregate("b", F.array().cast("array<struct<y0:double,x0:double,id:bigint>>"), fold)
    return page.select(F.posexplode(done).alias("k", "x")).select("x.id", (F.col("k") + 1).alias("position"))


def title_heights(regions: DataFrame) -> DataFrame:
    """(job_id, region_id, content, height): the mean height of a title's lines, to the millionth of a point; titles without content or box are left out."""
    l = line_boxes(regions.where("region_type = 'title'"))
    return l.groupBy("region_id").agg(F.any_value("job_id").alias("job_id"), F.any_value("content").alias("content"), F.round(F.avg(G.height(F.col("line_box"))), 6).alias("height"))


def heading_levels(titles: DataFrame, tolerance: float = 2.0, most: int = 6) -> DataFrame:
    """(region_id, level): levels of titles by the heights of their lines.

    titles: job_id, region_id, height, depth (of a numbering, or null). Heights
    from large to small join the first cluster within the tolerance of its
    middle, which moves halfway; the nearest of the six largest clusters gives
    the level, a numbering depth next to it goes before it; the levels that a
    job uses are then closed up. What is grouped by job is only its distinct
    heights and levels, each made unique before the shuffle.
    """
    hs = titles.groupBy("job_id").agg(F.sort_array(F.collect_set("height"), asc=False).alias("hs"))

    def put(reps, h):
        at = F.array_position(F.transform(reps, lambda r: F.abs(h - r) <= tolerance), F.lit(True)).cast("int")
        moved = F.transform(reps, lambda r, i: F.when(i == at - 1, (r + h) / 2).otherwise(r))
        return F.when(at > 0, moved).otherwise(F.concat(reps, F.array(h)))

    reps = hs.select("job_id", F.slice(F.sort_array(F.aggregate("hs", F.array().cast("array<double>"), put), asc=False), 1, most).alias("reps"))
    t = titles.join(reps, "job_id")
    nearest = F.array_min(F.transform("reps", lambda r, i: F.struct(F.abs(F.col("height") - r).alias("d"), (i + 1).alias("level"))))["level"]
    level = F.when(F.abs(F.col("depth") - nearest) <= 1, F.col("depth")).otherwise(nearest)
    t = t.select("job_id", "region_id", F.least(level, F.lit(most)).alias("raw"))
    used = t.groupBy("job_id").agg(F.sort_array(F.collect_set("raw")).alias("used"))
    return t.join(used, "job_id").select("region_id", F.least(F.array_position("used", F.col("raw")).cast("int"), F.lit(most)).alias("level"))


def apply_corrections(titles: DataFrame, corrections: DataFrame) -> DataFrame:
    """(region_id, level): the level of the last correction of the title's trimmed text, else its own. corrections: ord, text, level."""
    last = corrections.groupBy(F.trim("text").alias("k")).agg(F.max_by("level", "ord").alias("new_level"))
    return titles.withColumn("k", F.trim("content")).join(last, "k", "left").select("region_id", F.coalesce("new_level", "heading_level").alias("level"))
