"""Scripts of texts and fonts for them: column functions and the dimensions they use."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.functions import text as T

# Ranges of the scripts of India, in the order in which a tie is settled.
INDIC = {"devanagari": "\\x{0900}-\\x{097f}\\x{a8e0}-\\x{a8ff}\\x{11b00}-\\x{11b5f}", "bengali": "\\x{0980}-\\x{09ff}", "gurmukhi": "\\x{0a00}-\\x{0a7f}", "gujarati": "\\x{0a80}-\\x{0aff}", "oriya": "\\x{0b00}-\\x{0b7f}", "tamil": "\\x{0b80}-\\x{0bff}", "telugu": "\\x{0c00}-\\x{0c7f}", "kannada": "\\x{0c80}-\\x{0cff}", "malayalam": "\\x{0d00}-\\x{0d7f}"}
# Scripts by which a document's recogniser is chosen.
DOCUMENT = {"latin": "A-Za-z\\x{00aa}\\x{00ba}\\x{00c0}-\\x{00d6}\\x{00d8}-\\x{00f6}\\x{00f8}-\\x{024f}\\x{1e00}-\\x{1eff}\\x{ff21}-\\x{ff3a}\\x{ff41}-\\x{ff5a}", "devanagari": "\\x{0900}-\\x{097f}", "arabic": "\\x{0600}-\\x{06ff}\\x{0750}-\\x{077f}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{fefc}", "ch": "\\x{2e80}-\\x{2fdf}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}", "korean": "\\x{1100}-\\x{11ff}\\x{ac00}-\\x{d7a3}", "japan": "\\x{3041}-\\x{309f}\\x{30a0}-\\x{30ff}", "cyrillic": "\\x{0400}-\\x{052f}", "thai": "\\x{0e01}-\\x{0e5b}", "ta": "\\x{0b80}-\\x{0bff}", "te": "\\x{0c00}-\\x{0c7f}", "greek": "\\x{0370}-\\x{03ff}\\x{1f00}-\\x{1fff}", "ka": "\\x{10a0}-\\x{10ff}"}
# The family that a document of each script is set in.
DEFAULT_FAMILY = {"en": "Inter", "latin": "Inter", "ch": "Noto Sans SC", "chinese_cht": "Noto Sans TC", "japan": "Noto Sans JP", "korean": "Noto Sans KR", "devanagari": "Noto Sans Devanagari", "arabic": "Noto Sans Arabic", "cyrillic": "Inter", "greek": "Inter", "thai": "Noto Sans Thai", "ta": "Noto Sans Tamil", "te": "Noto Sans Telugu", "ka": "Inter", "eslav": "Inter"}
FONTS = Path(__file__).resolve().parent.parent / "data" / "fonts.json"


def font_rows() -> list[tuple[int, str, str, str]]:
    """(ordinal, key, family, file) of the font table, without keys that start with an underscore."""
    table = json.loads(FONTS.read_text(encoding="utf-8"))
    return [(i, k, v["family"], v["file"]) for i, (k, v) in enumerate((k, v) for k, v in table.items() if not k.startswith("_"))]


def fonts(spark: SparkSession) -> DataFrame:
    """The font dimension: a fixed 143 rows, read on the driver."""
    return spark.createDataFrame(font_rows(), "ord int, key string, family string, file string")


def map_fonts(names: DataFrame, dim: DataFrame) -> DataFrame:
    """(name, family, file): each distinct name by its own key, else by the longest key that it contains; null if none is. The dimension has a fixed size and is broadcast."""
    n = names.select("name").where("name IS NOT NULL").distinct().withColumn("k", T.font_name(F.col("name")))
    hit = n.join(F.broadcast(dim), F.col("k").contains(F.col("key"))).groupBy("name").agg(F.max_by(F.struct("family", "file"), F.struct((F.col("k") == F.col("key")).alias("e"), F.length("key").alias("n"), (-F.col("ord")).alias("o"))).alias("f"))
    return n.join(hit, "name", "left").select("name", F.col("f.family").alias("family"), F.col("f.file").alias("file"))


def _count(c: Column, chars: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[{chars}]")), F.lit(0))


def _first_largest(c: Column, ranges: dict[str, str]) -> tuple[Column, Column]:
    """The name with the highest count, the first of equals, and that count."""
    order = F.array(*(F.struct(_count(c, r).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, r) in enumerate(ranges.items())))
    best = F.array_max(order)
    return best["name"], best["n"]


def text_script(c: Column) -> Column:
    """The script of India with most characters, the first of the list among equals; latin if there is none, also for null."""
    name, n = _first_largest(c, INDIC)
    return F.when(n > 0, name).otherwise("latin")


def document_script(c: Column) -> Column:
    """The script other than Latin with most letters, if it has more than a tenth of them; else en, also below twenty characters."""
    others = {k: v for k, v in DOCUMENT.items() if k != "latin"}
    name, n = _first_largest(c, others)
    total = sum((_count(c, r) for r in DOCUMENT.values()), F.lit(0))
    return F.when((F.length(T.strip(c)) >= 20) & (n > 0) & (n / total > 0.1), name).otherwise("en")


def default_family(script: Column) -> Column:
    """The family for a script, Inter for those that are unknown."""
    table = F.create_map(*(F.lit(x) for kv in DEFAULT_FAMILY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, script), F.lit("Inter"))


def font_stack(c: Column, family: Column) -> Column:
    """The families for a text: the document's, its script's, then those for all."""
    s = text_script(c)
    noto = F.when(s != "latin", F.concat(F.lit("'Noto Sans "), F.initcap(s), F.lit("'")))
    return F.concat_ws(", ", F.when(family.isNotNull(), F.concat(F.lit("'"), family, F.lit("'"))), noto, F.lit("'Noto Sans'"), F.lit("'Inter'"), F.lit("sans-serif"))


def recogniser_language(codes: Column) -> Column:
    """Of a comma list of codes the first that is not en, else the first; auto for null and blank lists."""
    each = F.filter(F.transform(F.split(codes, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce(F.try_element_at(F.filter(each, lambda x: x != "en"), F.lit(1)), F.try_element_at(each, F.lit(1)), F.lit("auto"))
