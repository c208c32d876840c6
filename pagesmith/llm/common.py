"""Shared by the text operators: tables, character folding, sentence-level batches.

Folding maps every code point to exactly one code point, so that positions in
the folded text are positions in the text itself.
"""

from __future__ import annotations

import atexit
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.session import shared_dir, ship, width

# Characters of other scripts that are drawn like a Latin letter, and that letter.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian and others
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Տ": "S", "Օ": "O", "ɡ": "g", "ɑ": "a", "ı": "i",
}
# Characters without width or ink.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Kinds of a single space, and of a hyphen.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"

_INVISIBLE_RE = re.compile(f"[{INVISIBLE}]")


def _fold_table() -> dict[int, str]:
    table = {ord(a): b for a, b in LOOK_ALIKE.items()}
    table |= {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
    for o in [*range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:  # full and half width forms, mathematical letters
        n = unicodedata.normalize("NFKC", chr(o))
        if len(n) == 1 and n != chr(o):
            table[o] = n
    return table


#: One code point to one code point: look-alikes, widths, kinds of space and hyphen. CJK punctuation keeps its width.
FOLD = {k: v for k, v in _fold_table().items() if chr(k) not in "！，．：；？（）［］｛｝"}


def fold(text: str) -> str:
    """The text with look-alikes, widths and spaces unified, each code point in its place. A text without Latin letters keeps its own script's letters, which are no look-alikes there."""
    if text.isascii():
        return text
    return text.translate(FOLD if _LATIN.search(text) else FOLD_SPACES)


_LATIN = re.compile("[A-Za-z]")
FOLD_SPACES = {k: v for k, v in FOLD.items() if v in " -"}


def fold_words(text: str) -> str:
    """As fold, but look-alikes count only in words that hold a Latin letter or stand among Latin words; words wholly of another script keep their letters."""
    if text.isascii():
        return text
    if not _ODD_SPACES.isdisjoint(text):
        text = text.translate(FOLD_SPACES)
    return text if _LOOKS.isdisjoint(text) else _MIXED.sub(lambda m: m.group().translate(FOLD), text)


_ODD_SPACES = frozenset(map(chr, FOLD_SPACES))
_LOOKS = frozenset([*LOOK_ALIKE, *map(chr, range(0xFF01, 0xFFEF))])
_FOREIGN = "".join(re.escape(c) for c in LOOK_ALIKE) + "！-￮"
#: A word with a foreign look-alike and a Latin letter, a digit or nothing but look-alikes that could be Latin.
_MIXED = re.compile(rf"(?<![^\W_])(?=[A-Za-z0-9À-ɏ{_FOREIGN}'{INVISIBLE}̀-ͯ-]*[{_FOREIGN}])[A-Za-z0-9À-ɏ{_FOREIGN}'{INVISIBLE}̀-ͯ-]+(?![^\W_])")


def strip_invisible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE_RE.sub("", text)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def latest_regions(regions: DataFrame, *columns: str) -> DataFrame:
    """One row a region_id: of rows delivered twice, the one ingested last. Rows without region_id are no regions and are left out."""
    wanted = [c for c in columns if c != "region_id"]
    keep = F.struct("ingested_at", *wanted)
    return (
        regions.where(F.col("region_id").isNotNull())
        .groupBy("region_id")
        .agg(F.max_by(F.struct(*wanted), F.struct(F.col("ingested_at"), F.coalesce(*(F.col(c).cast("string") for c in wanted if c in ("content", "html", "job_id")), F.lit("")))).alias("_r"))
        .select("region_id", "_r.*")
    )


def scanned_pages(pages: DataFrame) -> DataFrame:
    """One row a page: (job_id, page_number, scanned)."""
    return pages.where("scanned IS NOT NULL").groupBy("job_id", "page_number").agg(F.max("scanned").alias("scanned"))


def splits(df: DataFrame) -> int:
    """Splits of a plain scan, counted without running it; 0 for a plan with shuffles, whose parts are put together at run time."""
    q = df._jdf.queryExecution()
    return 0 if "Exchange" in q.executedPlan().toString() else q.toRdd().getNumPartitions()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, spread: bool = True) -> DataFrame:
    """fn over Arrow batches; spread: df is put over the session's shuffle width first, unless it is a scan with a split for each core or more."""
    spark = df.sparkSession
    ship(spark)
    if spread and splits(df) < spark.sparkContext.defaultParallelism:
        df = df.repartition(width(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and each row's length."""
    at = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, the same at every run: those whose key has the smallest digest, with the digest as column h.

    The table is counted first and rows far above the expected bound are dropped
    where they are read, so that what reaches the driver does not grow with it.
    """
    h = F.xxhash64(key)
    n = df.count()
    part = min(1.0, 2.0 * most / n + 64.0 / n) if n else 1.0
    if part < 1.0:
        df = df.where(F.pmod(h, F.lit(1 << 62)) < F.lit(int(part * (1 << 62))))
    return df.withColumn("h", F.pmod(h, F.lit(1 << 62))).orderBy("h", key).limit(most)


_WRITTEN: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, from which it is read again: what several branches read is made once, and a lost executor makes nothing anew. The tables go when the program ends (``sweep``)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagesmith-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(sweep)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Deletes the tables that ``kept`` wrote; results that were not yet read from them are lost."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session is gone, and with it the way to its files
            return


_MADE: dict[str, object] = {}


class Shared:
    """A broadcast value and what a worker makes of it, made once a worker process and kept until another is used.

    The key is new for each instance: values of another run are never taken for this one's.
    """

    def __init__(self, spark: SparkSession, value, make: Callable):
        self.key, self.make = uuid.uuid4().hex, make
        self.broadcast = spark.sparkContext.broadcast(value)

    def get(self):
        if self.key not in _MADE:
            _MADE.clear()
            _MADE[self.key] = self.make(self.broadcast.value)
        return _MADE[self.key]
