"""Operators over html and marked text: cells of tables, runs, chapters, renderings. Null html gives no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesmith.functions import text as T
from pagesmith.operators.flow import page_joins

ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)(<t[hd][^>]*>.*?)</t[hd]>"
# Tags and properties that a table may keep.
TABLE_TAGS = "table|thead|tbody|tfoot|tr|th|td|caption|colgroup|col|b|i|u|s|em|strong|sub|sup|br|p|span"


def table_cells(df: DataFrame, key: str = "region_id", html: str = "html") -> DataFrame:
    """(key, row_idx, cell_idx, is_header, colspan, rowspan, align, text): the cells of tables, in order; spans below 1 or missing are 1."""
    rows = df.where(F.col(html).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(html, F.lit(ROW), F.lit(1))).alias("row_idx", "row"))
    cells = rows.select(key, "row_idx", F.posexplode(F.regexp_extract_all("row", F.lit(CELL), F.lit(1))).alias("cell_idx", "cell"))
    head = F.regexp_extract("cell", r"(?is)^(<t[hd][^>]*>)", 1)
    body = F.regexp_extract("cell", r"(?is)^<t[hd][^>]*>(.*)$", 1)
    span = lambda n: F.greatest(F.lit(1), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(cell, '(?is)^<t[hd][^>]*{n}=\"?([0-9]+)', 1), '') AS int)"), F.lit(1)))
    return cells.select(key, "row_idx", "cell_idx", F.lower(head).startswith("<th").alias("is_header"), span("colspan").alias("colspan"), span("rowspan").alias("rowspan"), F.nullif(F.lower(F.regexp_extract(head, r"(?i)align=\"?(left|center|right)", 1)), F.lit("")).alias("align"), T.squeeze(T.decode_entities(T.strip_tags(body))).alias("text"))


def max_columns(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, n_cols): the widest row of each table, spans counted; at least 1."""
    r = cells.groupBy(key, "row_idx").agg(F.sum("colspan").alias("n"))
    return r.groupBy(key).agg(F.greatest(F.lit(1), F.max("n")).alias("n_cols"))


def column_widths(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, col, width_pct): columns in proportion to their longest text, a cell's length spread over its columns; equal columns if all are empty."""
    w = W.partitionBy(key, "row_idx").orderBy("cell_idx")
    c = cells.withColumn("first", F.sum("colspan").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("colspan"))
    each = c.select(key, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("colspan") - 1)).alias("col"), (F.length("text") / F.col("colspan")).alias("n"))
    longest = each.groupBy(key, "col").agg(F.max("n").alias("n"))
    t = W.partitionBy(key)
    total, count = F.sum("n").over(t), F.count("*").over(t)
    return longest.select(key, "col", F.when(total > 0, F.col("n") / total * 100).otherwise(100.0 / count).alias("width_pct"))


def table_fill(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, n_cells, fill, largest_share, poor): poor: more than four cells of which under three tenths are filled, or one with over four fifths of the text."""
    g = cells.groupBy(key).agg(F.count("*").alias("n_cells"), F.avg((F.col("text") != "").cast("int")).alias("fill"), F.max(F.length("text")).alias("m"), F.sum(F.length("text")).alias("s"))
    share = F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0)
    return g.select(key, "n_cells", "fill", share.alias("largest_share"), (((F.col("n_cells") > 4) & (F.col("fill") < 0.3)) | (share > 0.8)).alias("poor"))


def gfm(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, markdown): tables as pipe tables: the first row is the header, rows are padded to the widest, pipes escaped."""
    r = cells.groupBy(key, "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell_idx", F.replace("text", F.lit("|"), F.lit("\\|")).alias("t")))), lambda x: x["t"]).alias("row"))
    t = r.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row_idx", "row"))).alias("rows")).withColumn("n", F.array_max(F.transform("rows", lambda x: F.size(x["row"]))))
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    padded = F.transform("rows", lambda x: F.concat(x["row"], F.array_repeat(F.lit(""), F.col("n") - F.size(x["row"]))))
    out = F.transform(padded, line)
    rule = line(F.array_repeat(F.lit("---"), F.col("n")))
    return t.select(key, F.array_join(F.concat(F.slice(out, 1, 1), F.array(rule), F.slice(out, F.lit(2), F.greatest(F.size(out) - 1, F.lit(0)))), "\n").alias("markdown"))


def sanitize_table(c: Column) -> Column:
    """Table html without scripts, event handlers, classes and ids, without styles that load or compute, and without tags that a table does not need, whose text stays."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>", "")
    t = F.regexp_replace(t, r"(?i)\s(?:on[a-z]+|class|id)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    t = F.regexp_replace(t, r"(?i)\sstyle\s*=\s*\"[^\"]*(?:url\(|expression|!important)[^\"]*\"", "")
    t = F.regexp_replace(t, r"(?i)(style=\"[^\"]*?)\bwidth:\s*[0-9]+px;?\s*", "$1")
    return F.regexp_replace(t, rf"(?i)</?(?!(?:{TABLE_TAGS})\b)[a-z][^>]*>", "")


def plain_table(c: Column) -> Column:
    """A table from plain text: a row a line, cells apart by a tab or two or more spaces; lines without ink are left out."""
    rows = F.filter(F.split(c, "\n"), lambda x: T.strip(x) != "")
    cell = lambda x: F.concat(F.lit("<td>"), T.escape_html(T.strip(x)), F.lit("</td>"))
    html = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(T.strip(r), r"\t|\s{2,}"), cell), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(html, ""), F.lit("</table>"))


def styled_runs(df: DataFrame, key: str = "region_id", text: str = "content") -> DataFrame:
    """(key, run_idx, text, bold, italic): text cut at tags; a run is bold or italic while more such tags have been opened than closed; runs without characters are left out."""
    parts = F.regexp_extract_all(text, F.lit(r"(<[^>]*>|[^<]+|<)"), F.lit(1))
    p = df.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("at", "part"))
    w = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    change = lambda tags: F.when(F.lower("part").rlike(rf"^<(?:{tags})>$"), 1).when(F.lower("part").rlike(rf"^</(?:{tags})>$"), -1).otherwise(0)
    p = p.withColumn("bold", F.sum(change("b|strong")).over(w) > 0).withColumn("italic", F.sum(change("i|em")).over(w) > 0).where(~F.col("part").rlike(r"^<[^>]*>$"))
    return p.select(key, (F.row_number().over(W.partitionBy(key).orderBy("at")) - 1).alias("run_idx"), T.decode_entities(F.col("part")).alias("text"), "bold", "italic")


def chapters(df: DataFrame, key: str, html: str, default: str = "Document") -> DataFrame:
    """(key, chapter, title, n_chars): html cut before each h1; a part without one is named by its number; html without any is one chapter of the default title."""
    marked = F.regexp_replace(html, r"(?i)(<h1[^>]*>)", "\u0001$1")
    x = df.where(F.col(html).isNotNull()).select(key, F.filter(F.split(marked, "\u0001"), lambda p: T.strip(p) != "").alias("parts"), F.col(html).rlike(r"(?i)<h1[^>]*>").alias("has"))
    p = x.select(key, "has", F.posexplode("parts").alias("i", "part"))
    title = T.strip(T.strip_tags(F.regexp_extract("part", r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    name = F.when(~F.col("has"), F.lit(default)).when(F.col("part").rlike(r"(?is)<h1[^>]*>(.*?)</h1>"), title).otherwise(F.concat(F.lit("Chapter "), (F.col("i") + 1).cast("string")))
    return p.select(key, (F.col("i") + 1).alias("chapter"), name.alias("title"), F.length("part").alias("n_chars"))


def fill_equations(content: Column, latex: Column) -> Column:
    """{{EQ:n}} becomes $latex[n]$; a number without an equation stays."""
    n = F.coalesce(F.size(latex), F.lit(0))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), content, lambda a, i: F.replace(a, F.concat(F.lit("{{EQ:"), i.cast("string"), F.lit("}}")), F.concat(F.lit("$"), F.coalesce(F.try_element_at(latex, i + 1), F.lit("")), F.lit("$"))))).otherwise(content)


#: Options of a rendering and what a missing one stands for.
DEFAULTS = {"remove_headers_footers": False, "join_broken_pages": False, "formula_display": "image", "table_display": "rendered", "include_figures": True, "figure_display": "image"}


def visible(regions: DataFrame, options: DataFrame) -> DataFrame:
    """The regions that a job's options leave, with these options; without a row of options a job has the defaults. options: one row a job: job_id, page_start, page_end (null: no end), and any of the others."""
    o = options.where("job_id IS NOT NULL").groupBy("job_id").agg(*(F.max(c).alias(f"_{c}") for c in [*DEFAULTS, "page_start", "page_end"]))
    x = regions.join(o, "job_id", "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit(v)) for c, v in DEFAULTS.items()})
    inside = (F.col("page_number") >= F.coalesce("_page_start", "page_number")) & (F.col("page_number") <= F.coalesce("_page_end", "page_number"))
    return x.where(inside & ~(F.col("remove_headers_footers") & F.col("region_type").isin("header", "footer"))).drop(*(f"_{c}" for c in [*DEFAULTS, "page_start", "page_end"]))


def region_html(regions: DataFrame) -> Column:
    """A region's html by its type and the job's options (columns as in DEFAULTS; image and mime where the table has them); the empty text where nothing is shown."""
    c = F.coalesce("content", F.lit(""))
    safe = T.sanitize(c)
    has = "image" in regions.columns
    image = F.concat(F.lit('<img src="data:'), F.col("mime"), F.lit(";base64,"), F.col("image")) if has else F.lit(None).cast("string")
    picture = lambda alt: F.concat(image, F.lit('" alt="'), alt, F.lit('" style="max-width:100%">'))
    level = F.when(F.col("heading_level").between(1, 6), F.col("heading_level")).otherwise(1).cast("string")
    wrap = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    some = lambda x: F.nullif(x, F.lit(""))
    formula = F.coalesce(some(F.col("latex")), some(c))
    block = lambda kind, x: F.concat(F.lit(f'<div class="{kind}">'), x, F.lit("</div>"))
    items = F.array_join(F.transform(F.filter(F.split(c, "\n"), lambda x: T.strip(x) != ""), lambda x: wrap("p", T.sanitize(T.strip(x)))), "")
    shown = F.concat(F.lit("<figure>"), picture(T.escape_html(c)), F.when(c != "", wrap("figcaption", safe)).otherwise(""), F.lit("</figure>"))
    kind = F.col("region_type")
    return (
        F.when(kind == "title", F.concat(F.lit("<h"), level, F.lit(">"), safe, F.lit("</h"), level, F.lit(">")))
        .when(kind == "text", wrap("p", safe))
        .when(kind == "table", F.coalesce(F.when(F.col("table_display") == "image", block("table-image", picture(F.lit("Table")))), sanitize_table(some(F.col("html"))), F.when(T.strip(c) != "", plain_table(c)), F.lit("")))
        .when(kind == "formula", F.coalesce(F.when(F.col("formula_display") == "image", block("math-block", picture(F.lit("Formula")))), block("math-block", wrap("code", T.escape_html(formula))), F.lit("")))
        .when(kind == "caption", wrap("figcaption", safe))
        .when(kind == "list", block("list-block", items))
        .when(kind.isin("header", "footer"), F.concat(F.lit('<div class="page-'), kind, F.lit('">'), safe, F.lit("</div>")))
        .when(kind == "figure", F.when(~F.col("include_figures"), "").when(F.col("figure_display") == "text", wrap("p", F.when(c != "", safe).otherwise("[Image]"))).otherwise(F.coalesce(shown, F.lit(""))))
        .otherwise(wrap("p", T.escape_html(c)))
    )


def render(regions: DataFrame, options: DataFrame) -> DataFrame:
    """(region_id, job_id, page_number, block_idx, joins, out): the regions that a job's options leave, as html; a text that goes on with the page before stands without its paragraph."""
    v = visible(regions, options)
    v = v.withColumn("out", region_html(v)).withColumn("shown", F.col("out") != "").withColumn("joined", F.col("join_broken_pages"))
    j = page_joins(v.select("job_id", "page_number", "block_idx", "region_id", "region_type", "content", "joined", "shown"))
    bare = F.when(F.col("joins"), T.sanitize(F.coalesce("content", F.lit("")))).otherwise(F.col("out"))
    return v.join(j, "region_id", "left").select("region_id", "job_id", "page_number", "block_idx", F.coalesce("joins", F.lit(False)).alias("joins"), bare.alias("out"))


def region_markdown(regions: DataFrame) -> DataFrame:
    """(region_id, job_id, page_number, block_idx, out): a region's markdown by its type; heads and feet of pages are left out, emphasis is kept, tables come from their cells."""
    c = F.coalesce("content", F.lit(""))
    em = F.regexp_replace(F.regexp_replace(c, "</?(?:b|strong)>", "**"), "</?(?:i|em)>", "*")
    level = F.when(F.col("heading_level").between(1, 6), F.col("heading_level")).otherwise(1)
    tables = gfm(table_cells(regions.where("region_type = 'table'")))
    x = regions.where(~F.col("region_type").isin("header", "footer")).join(tables, "region_id", "left")
    out = F.when(F.col("region_type") == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), em)).when(F.col("region_type") == "table", F.coalesce("markdown", c)).when(F.col("region_type") == "formula", F.coalesce(F.concat(F.lit("$$"), F.col("latex"), F.lit("$$")), c)).otherwise(em)
    return x.select("region_id", "job_id", "page_number", "block_idx", out.alias("out"))


def pages_of(rendered: DataFrame, between: str = "\n") -> DataFrame:
    """(job_id, page_number, body): rendered regions of a page in reading order, empty ones left out. Documents are put together of pages where they are written. rendered: job_id, page_number, block_idx, region_id, out."""
    each = F.sort_array(F.collect_list(F.struct("block_idx", "region_id", "out")))
    return rendered.where("out <> ''").groupBy("job_id", "page_number").agg(F.array_join(F.transform(each, lambda r: r["out"]), between).alias("body"))
