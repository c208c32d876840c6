"""Column functions over boxes (struct<x0,y0,x1,y1>), pages and sizes. A null box counts as one of zeros where a number is needed, and has no area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(F.coalesce(F.lit(v) if not isinstance(v, (Column, str)) else F.col(v) if isinstance(v, str) else v, F.lit(0.0)).cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def box_of_array(a: Column) -> Column:
    """The first four numbers; of a shorter or null array zeros."""
    ok = F.size(F.coalesce(a, F.array().cast("array<double>"))) >= 4
    return F.struct(*(F.when(ok, F.try_element_at(a, F.lit(i + 1))).otherwise(F.lit(0.0)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def y_overlap(a: Column, b: Column) -> Column:
    """Common height over the smaller height; 0 where a height is not positive."""
    common = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    least = F.least(height(a), height(b))
    return F.when(least > 0, common / least).otherwise(0.0)


def polygon(b: Column) -> Column:
    """The four corners from the upper left on, clockwise."""
    p = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))


def box_of_polygon(p: Column) -> Column:
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_rotated(p: Column, tolerance: float = 0.2) -> Column:
    """Whether the left side's height is not within a fifth of the right side's."""
    left, right = F.abs(p[3]["y"] - p[0]["y"]), F.abs(p[2]["y"] - p[1]["y"])
    return (left > right * (1 + tolerance)) | (left < right * (1 - tolerance))


def y_centre(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, q: a + q["y"]) / F.size(p)


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "landscape").otherwise("portrait")


def to_twips(v: Column) -> Column:
    """Points to twentieths, to the nearest, halves up."""
    return F.floor(v * 20 + 0.5).cast("bigint")


def to_inches(v: Column) -> Column:
    return v / 72.0


def reading_size(w: Column, h: Column, most: int) -> Column:
    """Size of an image of w by h whose longer side is at most so long, in whole pixels."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return F.struct(F.floor(w * scale).cast("int").alias("w"), F.floor(h * scale).cast("int").alias("h"))


#: Width of a character as a part of the font's size, by kind of text.
CHARACTER = 0.48


# How far the search for a size goes, as (halvings at most, closeness): by a mean width of characters, by a font's own widths, in a browser.
SEARCH = {"mean": (20, 0.5), "metric": (25, 0.25), "browser": (40, 0.05)}


def fitted_size(lengths: Column, w: Column, h: Column, ratio: float = CHARACTER, search: str = "mean") -> Column:
    """The largest font size at which lines of these lengths, wrapped, fit a box: binary search on [1, h] as far as SEARCH says; 1 without text or area. lengths: characters, or with ratio 1 widths at size 1."""
    steps, close = SEARCH[search]
    def needed(size: Column) -> Column:
        per_line = F.greatest(F.lit(1.0), F.floor(w / (size * ratio)).cast("double"))
        rows = F.aggregate(lengths, F.lit(0.0), lambda a, n: a + F.greatest(F.lit(1.0), F.ceil(n / per_line).cast("double")))
        return rows * 1.2 * size

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fits = needed(mid) <= h
        open_ = s["hi"] - s["lo"] >= close
        return F.struct(F.when(open_ & fits, mid).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~fits, mid).otherwise(s["hi"]).alias("hi"), F.when(open_ & fits, mid).otherwise(s["best"]).alias("best"))

    start = F.struct(F.lit(1.0).alias("lo"), F.greatest(F.lit(1.0), h).alias("hi"), F.lit(1.0).alias("best"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["best"])
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    return F.when((w > 0) & (h > 0) & (total > 0), found).otherwise(1.0)


def wrap(text: Column, most: Column) -> Column:
    """Words put to lines of at most so many characters; a longer word has a line of its own. The empty text: no lines."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")

    def put(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        joined = F.concat(last, F.lit(" "), word)
        fits = last.isNotNull() & (F.length(joined) <= most)
        return F.when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), put)
