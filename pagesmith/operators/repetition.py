"""Operators over lines: repetition over pages, lists, numbers at margins, samples of text. Null lines and contents give no row unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesmith.functions import text as T
from pagesmith.operators.flow import rising_numbers
from pagesmith.operators.layout import decorative


def pages_of_lines(lines: DataFrame) -> DataFrame:
    """(job_id, line_key, n_pages): on how many pages of its job each line stands; lines without ink are left out."""
    k = lines.select("job_id", "page_number", T.repetition_key(F.col("line")).alias("line_key")).where("line_key <> ''")
    return k.groupBy("job_id", "line_key").agg(F.countDistinct("page_number").alias("n_pages"))


def classify_discarded(regions: DataFrame, pages: DataFrame, options: DataFrame, min_pages: int = 3) -> DataFrame:
    """(region_id, class): what becomes of each header or footer region: header, footer, image, text or skip.

    It recurs if its text stands on min_pages pages (or on all, if the job has
    fewer); a number of one to four digits counts as recurring. What is
    decorative becomes an image, or is left out where a job takes no figures;
    where it takes them as text, one that recurs is a head or foot, any other is
    text. What recurs is a head in the upper half of the page, else a foot; the
    rest is text, the empty and null text too. options: job_id, include_figures,
    figure_display; missing ones are true and image.
    """
    o = options.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max("include_figures").alias("include_figures"), F.max("figure_display").alias("figure_display"))
    text = F.coalesce("content", F.lit(""))
    off = regions.where("region_type IN ('header', 'footer')")
    b = off.withColumn("k", F.when(text != "", T.repetition_key(text))).join(pages, ["job_id", "page_number"])
    n = b.where("k <> ''").groupBy("job_id", "k").agg(F.countDistinct("page_number").alias("n_pages"))
    total = regions.groupBy("job_id").agg(F.countDistinct("page_number").alias("total"))
    half = F.when(F.coalesce(F.col("bbox.y0"), F.lit(0.0)) < F.col("height") / 2, "header").otherwise("footer")
    repeats = F.coalesce((F.col("n_pages") >= F.least(F.lit(min_pages), F.col("total"))) | F.col("k").rlike("^[0-9]{1,4}$"), F.lit(False))
    takes, image = F.coalesce("include_figures", F.lit(True)), F.coalesce("figure_display", F.lit("image")) == "image"
    kind = F.when(F.col("decorative") & ~takes, "skip").when(F.col("decorative") & image, "image").when(repeats, half).otherwise("text")
    return b.join(n, ["job_id", "k"], "left").join(total, "job_id").join(decorative(off, pages, regions), "region_id").join(o, "job_id", "left").select("region_id", kind.alias("class"))


def list_blocks(lines: DataFrame, share: float = 0.6) -> DataFrame:
    """(region_id, block_type): a text block of two or more lines with ink, of which share are items, is a list."""
    ink = T.strip(F.col("line")) != ""
    g = lines.groupBy("region_id", "region_type").agg(F.count_if(ink).alias("n"), F.avg(F.when(ink, T.is_list_item(F.col("line")).cast("int"))).alias("part"))
    is_list = F.col("region_type").isin("text", "list") & (F.col("n") >= 2) & (F.col("part") >= share)
    return g.select("region_id", F.when(is_list, "list").otherwise(F.col("region_type")).alias("block_type"))


def list_indents(lines: DataFrame) -> DataFrame:
    """(region_id, line_no, indent_em): a line without marker keeps the level before it; levels count from the least of the block."""
    w = W.partitionBy("region_id").orderBy("line_no")
    every = W.partitionBy("region_id")
    x = lines.where(T.strip(F.col("line")) != "").select("region_id", "line_no", T.list_level(F.col("line")).alias("lv"))
    x = x.withColumn("lowest", F.coalesce(F.min(F.when(F.col("lv") >= 0, F.col("lv"))).over(every), F.lit(0)))
    now = F.coalesce(F.last(F.when(F.col("lv") >= 0, F.col("lv")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("lowest"))
    return x.select("region_id", "line_no", (F.greatest(F.lit(0), now - F.col("lowest")) * F.lit(1.5)).cast("double").alias("indent_em"))


def margin_numbers_block(lines: DataFrame) -> DataFrame:
    """Lines without the numbers at their margin, in blocks with three or more that count up by 1 to 10 at least twice and in two fifths of the steps."""
    c = lines.select("region_id", "line_no", "line", T.margin_number(F.col("line")).alias("n"))
    s = c.where("n IS NOT NULL").withColumn("step", F.col("n") - F.lag("n").over(W.partitionBy("region_id").orderBy("line_no")))
    f = s.groupBy("region_id").agg(((F.count("*") >= 3) & (F.count_if(F.col("step").between(1, 10)) >= F.greatest(F.lit(2.0), 0.4 * F.count("*")))).alias("numbered"))
    return c.join(f, "region_id", "left").select("region_id", "line_no", F.when(F.coalesce("numbered", F.lit(False)) & F.col("n").isNotNull(), F.regexp_replace("line", r"^\s*\d{1,4}\s+", "")).otherwise(F.col("line")).alias("line"))


def margin_numbers_doc(lines: DataFrame) -> DataFrame:
    """(job_id, numbered, n_candidates): whether the numbers before the first lines of a job's blocks rise."""
    return rising_numbers(lines.where("line_no = 0").select("job_id", "region_id", "page_number", "block_idx", T.margin_number(F.col("line")).alias("n")).where("n IS NOT NULL"))


def pangram_report(regions: DataFrame) -> DataFrame:
    """(job_id, n_components, n_flagged, n_dropped): regions, those with a pangram, those of which nothing else is left."""
    c = F.col("content")
    return regions.groupBy("job_id").agg(F.count("*").alias("n_components"), F.count_if(T.has_pangram(c)).alias("n_flagged"), F.count_if(T.has_pangram(c) & (T.strip(T.strip_pangrams(c)) == "")).alias("n_dropped"))


def text_sample(regions: DataFrame, n_pages: int) -> DataFrame:
    """(job_id, sample): the contents of a job's first n pages in reading order, a line break between. The pages are chosen by an aggregate that holds no more than n of them."""
    page = regions.select("job_id", "page_number").distinct()
    first = page.withColumn("_k", F.row_number().over(W.partitionBy("job_id").orderBy("page_number"))).where(F.col("_k") <= n_pages).select("job_id", "page_number")
    each = F.sort_array(F.collect_list(F.struct("page_number", "block_idx", "region_id", "content")))
    return regions.join(first, ["job_id", "page_number"], "left_semi").groupBy("job_id").agg(F.array_join(F.transform(each, lambda x: x["content"]), "\n").alias("sample"))
