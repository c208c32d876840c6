"""Problem 4: one form for text that looks the same in print.

``canonical`` leaves stable text as it is: a quick check finds the characters
that may change (their own form differs, or they may combine with the one
before), each such segment is taken with the starter before it, decomposed,
mapped, composed and spliced back. The form keeps what a reader can tell
apart: case, accents, superscripts, enclosed and square characters, line
breaks, the number of spaces, and joiners that change letters' shapes.

Null gives null, the empty text gives the empty text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import HYPHENS, INVISIBLE, LOOK_ALIKE, SPACES, kept, map_arrow

ZWNJ, ZWJ = "‌", "‍"
#: Joiners after a virama, or between letters of a joining script, show in print.
_JOINER_SHOWS = re.compile(r"(?<=[्্੍્୍்్್്්္])[‌‍]|(?<=[ؠ-ۿ])[‌‍](?=[ؠ-ۿ])")
_TAGS = re.compile(r"</?[bi]>")


@cache
def _maps() -> tuple[dict[int, str], re.Pattern]:
    """The mapping of single decomposed characters, and the pattern of segments that may change."""
    table: dict[int, str] = {ord(c): "" for c in INVISIBLE if c not in (ZWNJ, ZWJ)}
    table |= {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS} | {ord(a): b for a, b in LOOK_ALIKE.items()}
    for o in range(0x10000):
        d = unicodedata.decomposition(chr(o))
        if d.startswith(("<wide>", "<narrow>")) or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17:
            table[o] = "".join(table.get(ord(c), c) for c in unicodedata.normalize("NFKC", chr(o)))
    unstable = []
    # Beyond these planes no character has a canonical form of its own.
    for o in range(0x80, 0x30000):
        c = chr(o)
        if 0xD800 <= o < 0xE000:
            continue
        d = unicodedata.normalize("NFD", c)
        if o in table or unicodedata.combining(c) or ord(d[0]) in table or unicodedata.normalize("NFC", c) != c or 0x1160 <= o < 0x1200 or c in (ZWNJ, ZWJ):
            unstable.append(o)
    parts, i = [], 0
    while i < len(unstable):
        j = i
        while j + 1 < len(unstable) and unstable[j + 1] == unstable[j] + 1:
            j += 1
        parts.append(f"\\U{unstable[i]:08x}" + (f"-\\U{unstable[j]:08x}" if j > i else ""))
        i = j + 1
    return table, re.compile(f"[^\\x00-\\x1f]?[{''.join(parts)}]+")


def canonical(text: str | None) -> str | None:
    """The form that all texts have in common that look like this one."""
    if not text or text.isascii():
        return text.replace("\r\n", "\n") if text and "\r" in text else text
    table, segment = _maps()

    def normal(m: re.Match) -> str:
        s = m.group()
        if ZWNJ in s or ZWJ in s:
            lo, hi = max(0, m.start() - 2), m.end() + 1
            shown = {x.start() for x in _JOINER_SHOWS.finditer(text, lo, min(len(text), hi))}
            s = "".join(c for i, c in enumerate(s, m.start()) if c not in (ZWNJ, ZWJ) or i in shown)
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(table))

    return segment.sub(normal, text).replace("\r\n", "\n")


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def look_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, form): 128-bit digests of the canonical form and of the text as it stands; null, empty and blank texts give no row."""
    kind = dict(df.dtypes)[key]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        look, form, rows = [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            if t and not t.isspace():
                rows.append(i)
                look.append(_digest(canonical(t)))
                form.append(_digest(t))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(look, pa.binary()), pa.array(form, pa.binary())], names=[key, "look", "form"])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, look binary, form binary")


#: Rows of one look from which it is parted into several keys of the join.
HOT = 2000


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(look, form, first_key, members): the spellings of each look that has more than one, with the least key that is so spelled and how many are. The bounded statement of ``look_alike_pairs``: two rows are a pair if their looks are equal and their forms differ."""
    d = look_digests(df, key, text).dropDuplicates([key, "look", "form"]).groupBy("look", "form").agg(F.min(key).alias("first_key"), F.count("*").alias("members"))
    mixed = d.groupBy("look").agg(F.count("*").alias("_n")).where("_n > 1").select("look")
    return d.join(mixed, "look", "left_semi").select(F.hex("look").alias("look"), F.hex("form").alias("form"), "first_key", "members")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts look the same but differ in code points.

    The texts are read once: their digests are written to the shared folder.
    Only digests are shuffled. Groups of one form only, however large, are
    dropped by an aggregate before the join, so that exact copies never meet
    each other; what is left is joined on the look, a large look in parts, and
    rows of one form again do not pair.
    """
    d = kept(look_digests(df, key, text).dropDuplicates([key, "look", "form"]))
    mixed = d.groupBy("look").agg(F.min("form").alias("_lo"), F.max("form").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi").select("look", F.ceil(F.col("_n") / HOT).cast("int").alias("_parts"))
    d = d.join(mixed, "look")
    a = d.select("look", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"), F.col("form").alias("form_a"), F.col(key).alias("key_a"))
    b = d.select("look", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("form").alias("form_b"), F.col(key).alias("key_b"))
    return a.join(b, ["look", "_part"]).where("key_a < key_b AND form_a <> form_b").select("key_a", "key_b").distinct()


def look_alike_runs(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """(key_a, key_b): region and run whose text is not in the region's content, tags aside, but looks like a part of it.

    runs: run_id, region_id, text; regions: region_id, content, one row each.
    Null and empty texts, and runs without ink of any kind, give no row.
    """
    both = runs.where("text IS NOT NULL AND text <> ''").select("run_id", "region_id", "text").join(regions.where("content IS NOT NULL"), "region_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for a, r, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            c = _TAGS.sub("", c)
            if t not in c and (look := canonical(t)) and look in canonical(c):
                found.append((a, r))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["key_a", "key_b"])

    return map_arrow(both.select("region_id", "run_id", "text", "content"), run, "key_a bigint, key_b bigint", spread=False).distinct()
