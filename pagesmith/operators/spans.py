"""Operators over spans of a page: fonts and texts of nested documents, texts looked up by page, lines of detected boxes, places of equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesmith.functions import geometry as G
from pagesmith.functions import text as T
from pagesmith.operators.layout import line_islands, subtract_masks

#: A page as a text extraction gives it.
PAGE = "struct<blocks:array<struct<lines:array<struct<spans:array<struct<text:string,font:string,bbox:array<double>>>>>>>>"
#: A line is merged if it is so many times as wide as high.
WIDE = 4.0


def font_spans(pages: DataFrame, key: str, json: str) -> DataFrame:
    """(key, block_idx, line_idx, span_idx, name, n_chars, bbox): every span of pages in JSON, as they are nested in blocks and lines. Blank texts and fonts without a name are left out, and so is what is no JSON."""
    b = pages.select(key, F.posexplode(F.from_json(json, PAGE)["blocks"]).alias("block_idx", "b"))
    l = b.select(key, "block_idx", F.posexplode("b.lines").alias("line_idx", "l"))
    s = l.select(key, "block_idx", "line_idx", F.posexplode("l.spans").alias("span_idx", "s")).where((T.strip(F.coalesce("s.text", F.lit(""))) != "") & (F.coalesce("s.font", F.lit("")) != ""))
    return s.select(key, "block_idx", "line_idx", "span_idx", F.col("s.font").alias("name"), F.length("s.text").alias("n_chars"), G.box_of_array(F.col("s.bbox")).alias("bbox"))


def with_page_texts(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """blocks with per_page: the text that a page has for a block, null where it has none or the same; and text, which it goes before. blocks: job_id, page_number, block_idx, content; texts: job_id, page_number, block_idx, text, one row a block."""
    j = blocks.join(texts.withColumnRenamed("text", "_t"), ["job_id", "page_number", "block_idx"], "left")
    return j.withColumn("per_page", F.nullif("_t", "content")).withColumn("text", F.coalesce("per_page", "content")).drop("_t")


def merged_lines(boxes: DataFrame, wide: float = WIDE) -> DataFrame:
    """(job_id, page_number, x0, y0, x1, y1, n): detected boxes as lines: boxes on one line that is much wider than high are merged where they touch or overlap in x, boxes of other lines stay; rotated ones are set aside and stay.

    boxes: job_id, page_number, id, x0, y0, x1, y1, rotated.
    """
    flat = boxes.where(~F.col("rotated"))
    line = line_islands(flat.select("job_id", "page_number", "id", "y0", "y1"))
    b = flat.join(line, "id")
    extent = b.groupBy("job_id", "page_number", "island").agg(F.min("x0").alias("lx0"), F.max("x1").alias("lx1"), F.min("y0").alias("ly0"), F.max("y1").alias("ly1"))
    b = b.join(extent, ["job_id", "page_number", "island"]).withColumn("_merge", F.col("lx1") - F.col("lx0") > (F.col("ly1") - F.col("ly0")) * wide)
    w = W.partitionBy("job_id", "page_number", "island").orderBy("x0", "id")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("_new", F.when(F.col("_merge") & (F.col("x0") <= reach), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = b.groupBy("job_id", "page_number", "island", "_g").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))
    keep = ["job_id", "page_number", "x0", "y0", "x1", "y1", "n"]
    return out.select(*keep).unionByName(boxes.where("rotated").withColumn("n", F.lit(1).cast("bigint")).select(*keep))


def masked_texts(texts: DataFrame, formulas: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, lo, hi): what formulas on the same line leave of text boxes, in x: those that overlap a text in y by more than share of the lower height are taken out. Columns of both: job_id, page_number, id, bbox; ends in whole points."""
    t = texts.select("job_id", "page_number", "id", F.col("bbox").alias("t"))
    f = formulas.select("job_id", "page_number", F.col("id").alias("fid"), F.col("bbox").alias("f"))
    hit = t.join(f, ["job_id", "page_number"]).where(G.y_overlap(F.col("t"), F.col("f")) > share)
    # Every text is its own line of masks: its number goes into the key.
    key = F.concat_ws("/", "job_id", F.col("id").cast("string"))
    masks = hit.select(key.alias("job_id"), "page_number", F.col("fid").alias("id"), F.floor("f.x0").alias("lo"), F.floor("f.x1").alias("hi"))
    lines = t.select(key.alias("job_id"), "page_number", "id", F.floor("t.x0").alias("lo"), F.floor("t.x1").alias("hi"))
    return subtract_masks(lines, masks)


def recognised_spans(spans: DataFrame, figures: DataFrame) -> DataFrame:
    """Spans that are to be read: of category 15, with a language, and not inside a figure of their page. spans: job_id, page_number, id, category, lang, bbox; figures: job_id, page_number, bbox."""
    s = spans.where("category = 15 AND lang IS NOT NULL")
    cx, cy = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    f = figures.select("job_id", "page_number", F.col("bbox").alias("f"))
    inside = s.select("job_id", "page_number", "id", F.col("bbox").alias("b")).join(f, ["job_id", "page_number"]).where(cx.between(F.col("f.x0"), F.col("f.x1")) & cy.between(F.col("f.y0"), F.col("f.y1")))
    return s.join(inside.select("id").distinct(), "id", "left_anti")


def equation_places(content: Column, equations: Column) -> Column:
    """Of each equation with boxes of positive height (struct<bbox, line_bbox>) where its placeholder stands in the text (0 if nowhere), and its width and its line's height in relation to its own, to the hundredth."""
    h, w, l = (lambda e: G.height(e["bbox"])), (lambda e: G.width(e["bbox"])), (lambda e: G.height(e["line_bbox"]))
    kept = F.filter(equations, lambda e: e["bbox"].isNotNull() & e["line_bbox"].isNotNull() & (h(e) > 0) & (l(e) > 0))
    at = lambda i: F.greatest(F.instr(content, F.concat(F.lit("{{EQ:"), i.cast("string"), F.lit("}}"))) - 1, F.lit(0))
    return F.transform(kept, lambda e, i: F.struct(at(i).alias("at"), F.round(w(e) / h(e), 2).alias("aspect"), F.round(h(e) / l(e), 2).alias("height")))
