"""Selections and small measures around recognition and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesmith.functions import geometry as G
from pagesmith.functions import text as T

#: Blocks of a piece that page_breaks folds at once.
PIECE = 256

# What a request may ask for; the first is the default.
OPTIONS = {"processing_mode": ["local", "cloud"], "table_mode": ["local", "cloud"], "formula_display": ["rendered", "image"], "table_display": ["rendered", "image"], "figure_display": ["image", "text"]}


def large_enough(boxes: DataFrame, part: float = 0.0005, least: float = 20.0) -> DataFrame:
    """Boxes whose area is at least a part of their page's, and least. Columns: bbox, width, height."""
    return boxes.where(G.area(F.col("bbox")) >= F.greatest(F.lit(part) * F.col("width") * F.col("height"), F.lit(least)))


def class_of_crop(w: Column, h: Column, name: Column, sure: Column, least: float = 0.4) -> Column:
    """The class that a model gave a crop: null if the crop is too small for one, or the model less sure than least."""
    return F.when((crop_gate(w, h) == "ok") & (sure >= least), name)


def crop_gate(w: Column, h: Column) -> Column:
    """What a model may do with a crop: under ten pixels it is unreadable, under 32 it has no class."""
    least = F.least(w, h)
    return F.when(least < 10, "unreadable").when(least < 32, "no class").otherwise("ok")


def equation_crops(regions: DataFrame) -> DataFrame:
    """Formulas without LaTeX and with a box of positive area: those to be cut out as images."""
    return regions.where((F.col("region_type") == "formula") & F.col("latex").isNull() & (G.area(F.col("bbox")) > 0))


def figure_crops(regions: DataFrame, mode: Column) -> DataFrame:
    """Figures of positive area, where the mode is to show images."""
    return regions.where((F.col("region_type") == "figure") & (mode == "image") & (G.area(F.col("bbox")) > 0))


def public_keys(m: Column) -> Column:
    """A map without the keys that start with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def checked_option(name: str, c: Column) -> Column:
    """A request's value in lower case, the default where it is missing or blank, null where it is none of the allowed ones."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v == "", OPTIONS[name][0]).when(v.isin(*OPTIONS[name]), v)


def as_flag(c: Column, default: bool) -> Column:
    """true, 1, yes and on, or not; the default for null and blank."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v == "", default).otherwise(v.isin("true", "1", "yes", "on"))


def sparse(new: Column, old: Column) -> Column:
    """What is only kept where it differs."""
    return F.nullif(new, old)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present, key, "left_anti")


def is_table_html(c: Column) -> Column:
    """Whether a table model's answer is whole."""
    return F.coalesce(T.strip(c).rlike(r"(?i)</(?:html|table)>$"), F.lit(False))


def cell_offsets(cells: DataFrame, widths: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, row_idx, cell_idx, x_pct): where each cell starts, from the widths of the columns before it. widths: key, col, width_pct."""
    w = W.partitionBy(key, "row_idx").orderBy("cell_idx").rowsBetween(W.unboundedPreceding, 0)
    c = cells.withColumn("first", F.sum("colspan").over(w) - F.col("colspan"))
    before = widths.withColumn("x_pct", F.coalesce(F.sum("width_pct").over(W.partitionBy(key).orderBy("col").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return c.join(before.select(key, F.col("col").alias("first"), "x_pct"), [key, "first"]).select(key, "row_idx", "cell_idx", "x_pct")


def table_font(row_height: Column, most: float = 12.0, least: float = 6.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), row_height * 0.6))


def page_breaks(blocks: DataFrame, page: float, gap: float = 8.0, part: Column | None = None) -> DataFrame:
    """(id, out_page, y): blocks of a document set one below the other, on a new page where one does not fit.

    blocks: doc, ord, id, h (0 or more). part: a number from 0 that never falls
    along ord, as each part of a document is gathered apart; without it a document
    is one part. Parts are cut in pieces of PIECE blocks, as a fold that returns
    its blocks costs the square of their number. A piece takes over only how far
    the page is filled. However far, its first break is at one of its blocks up to
    the first that breaks an empty page, and after a break all is as if the piece
    began there. So a piece is summed up by what follows from a break at each of
    these blocks, and only these sums are folded over a whole document. A document
    begins behind a full page 0 (NaN, above any number), so its first piece breaks
    at its first block.
    """
    n, y, no, full = F.lit(0), F.lit(0.0), F.lit(False), F.lit(float("nan"))
    over = lambda s, h: (s["y"] > 0) & (s["y"] + h > page)
    at = lambda n, y, **more: F.struct(n.alias("n"), y.alias("y"), *(v.alias(k) for k, v in more.items()))
    nothing = lambda kind: F.array().cast(f"array<{kind}>")

    def put(s: Column, b: Column) -> tuple[Column, Column]:
        return F.when(over(s, b["h"]), s["n"] + 1).otherwise(s["n"]), F.when(over(s, b["h"]), 0.0).otherwise(s["y"])

    def set_down(s: Column, b: Column) -> Column:
        p, top = put(s, b)
        return at(p, top + b["h"] + gap)

    def placed(s: Column, b: Column) -> Column:
        p, top = put(s, b)
        return at(p, top + b["h"] + gap, out=F.concat(s["out"], F.array(F.struct(b["id"].alias("id"), p.alias("out_page"), top.alias("y")))))

    def sums(piece: Column, k: Column) -> Column:
        """The blocks at which the piece may break first; with each: pages begun after a break there, and how far the last is filled."""
        first = F.aggregate(piece, at(n, y, broke=no), lambda s, b: F.when(s["broke"], s).otherwise(at(s["n"] + 1, s["y"] + b["h"] + gap, broke=over(s, b["h"]))), lambda s: s["n"])
        return F.transform(F.slice(piece, F.lit(1), F.when((F.col("key.part") == 0) & (k == 0), 1).otherwise(first)), lambda b, i: F.struct(b["h"].alias("h"), F.aggregate(F.slice(piece, i + 1, F.lit(PIECE)), at(n, y), set_down).alias("then")))

    def to_break(s: Column, b: Column) -> Column:
        return F.when(s["broke"], s).when(over(s, b["h"]), at(s["n"] + 1 + b["then"]["n"], b["then"]["y"], broke=F.lit(True))).otherwise(at(s["n"], s["y"] + b["h"] + gap, broke=no))

    def over_piece(s: Column, piece: Column) -> Column:
        return F.aggregate(piece, at(s["n"], s["y"], broke=no), to_break, lambda e: at(e["n"], e["y"], starts=F.concat(s["starts"], F.array(at(s["n"], s["y"])))))

    def over_part(s: Column, p: Column) -> Column:
        return F.aggregate(p["pieces"], at(s["n"], s["y"], starts=nothing("struct<n:int,y:double>")), over_piece, lambda e: at(e["n"], e["y"], parts=F.concat(s["parts"], F.array(F.struct(p["key"].alias("key"), e["starts"].alias("starts"))))))

    rows = blocks.groupBy(F.struct("doc", (F.lit(0) if part is None else part).alias("part")).alias("key")).agg(F.sort_array(F.collect_list(F.struct("ord", "id", F.col("h").cast("double").alias("h")))).alias("b"))
    pieces = rows.select("key", F.transform(F.sequence(F.lit(1), F.size("b"), F.lit(PIECE)), lambda i: F.slice("b", i, F.lit(PIECE))).alias("pieces"))
    docs = pieces.select("key", F.transform("pieces", sums).alias("pieces")).groupBy("key.doc").agg(F.sort_array(F.collect_list(F.struct("key", "pieces"))).alias("parts"))
    kind = pieces.schema["key"].dataType.simpleString()
    begun = docs.select(F.explode(F.aggregate("parts", at(n, full, parts=nothing(f"struct<key:{kind},starts:array<struct<n:int,y:double>>>")), over_part, lambda s: s["parts"])).alias("o")).select("o.*")
    each = F.zip_with("pieces", "starts", lambda piece, s: F.aggregate(piece, at(s["n"], s["y"], out=nothing("struct<id:bigint,out_page:int,y:double>")), placed, lambda e: e["out"]))
    return pieces.join(begun, "key").select(F.explode(F.flatten(each)).alias("o")).select("o.*")


def layer_size(n_lines: Column, h: Column) -> Column:
    """The size of an invisible text layer: from 11 down to 3 by halves, until its lines fit the box."""
    step = lambda s, _: F.when((s > 3) & (s * 1.2 * n_lines > h), s - 0.5).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(11.0), step)


def line_scale(natural: Column, w: Column, last: Column) -> Column:
    """Percent by which a line is stretched to its box; the last line of a block by no more than half."""
    s = F.when(natural > 0, w / natural * 100).otherwise(100.0)
    return F.when(last, F.least(s, F.lit(150.0))).otherwise(s)


def harvest(df: DataFrame, key: str, json: str, names: list[str]) -> DataFrame:
    """(key, name, text): every string under one of the names, at any level of a JSON value. What is no JSON gives no row."""
    from pagesmith.sources.files import deepest

    depth = max(1, deepest(df, json))
    now = df.select(key, F.try_parse_json(F.col(json)).alias("v")).where("v IS NOT NULL")
    out = None
    for _ in range(depth):
        now = now.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(key, F.col("key").alias("name"), F.col("value").alias("v"))
        hit = now.where(F.col("name").isin(*names) & (F.schema_of_variant("v") == "STRING")).select(key, "name", F.try_variant_get("v", "$", "string").alias("text"))
        out = hit if out is None else out.unionByName(hit)
    return out
