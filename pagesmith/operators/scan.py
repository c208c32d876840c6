"""Scans of the document model: regions, lines, cells, pages, jobs, each delivered row once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extent of a page whose size is missing or zero.
WIDTH, HEIGHT = 612.0, 792.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once(df: DataFrame, keys: list[str], order: list[Column], columns: tuple[str, ...] = ()) -> DataFrame:
    """One row of each key: the last in the given order, with the given columns, or all. One aggregate with map-side combine, of no more than these columns, so that no other is read; rows with a null key form a group too."""
    rest = [c for c in df.columns if c not in keys and (not columns or c in columns)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def regions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row a region, as delivered last, with the columns named, or all."""
    return once(read(spark, d, "regions"), ["region_id"], [F.col("ingested_at")], columns)


def lines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row a line of a region's content, numbered from 0, with further columns of its region; null contents have none, the empty content has one empty line."""
    return regions(spark, d, *columns, "content").where("content IS NOT NULL").select("region_id", *columns, F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One row a page; null, zero and negative sizes take the default extent."""
    size = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, F.col(c)).otherwise(F.lit(n))
    return read(spark, d, "ocr_pages").groupBy("job_id", "page_number").agg(F.max("scanned").alias("scanned"), F.max("width").alias("width"), F.max("height").alias("height")).select("job_id", "page_number", "scanned", size("width", WIDTH).alias("width"), size("height", HEIGHT).alias("height"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """One row a job; rows delivered twice are equal."""
    return read(spark, d, "jobs").dropDuplicates(["job_id"])


def first_pages(df: DataFrame, n: int) -> DataFrame:
    """Rows of a job's first n pages, by the pages that it has."""
    from pyspark.sql import Window as W

    return df.withColumn("_k", F.dense_rank().over(W.partitionBy("job_id").orderBy("page_number"))).where(F.col("_k") <= n).drop("_k")


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with the number of each row in a total order, from 1. Ranges of the order are sorted apart and numbered from the sizes of those before, so that no task takes all rows; the sorted rows go to the shared folder, as they are read twice."""
    from pyspark.sql import Window as W

    from pagesmith.session import shared_dir

    shared_dir(df.sparkSession)
    x = df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()).checkpoint()
    x = x.withColumn("_p", F.shiftright("_i", 33)).withColumn("_k", F.col("_i").bitwiseAND((1 << 33) - 1))
    sizes = x.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return x.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn(name, (F.col("_before") + F.col("_k") + 1).cast("int")).drop("_i", "_p", "_k", "_before")


#: The same relations in SQL.
SQL_REGIONS = "(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) AS rn_ FROM regions) WHERE rn_ = 1)"
SQL_LINES = f"(SELECT region_id, job_id, page_number, block_idx, region_type, i - 1 AS line_no, parts[i] AS line FROM (SELECT region_id, job_id, page_number, block_idx, region_type, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT *, string_split(content, chr(10)) AS parts FROM {SQL_REGIONS} WHERE content IS NOT NULL)))"
SQL_PAGES = f"(SELECT job_id, page_number, bool_or(scanned) AS scanned, CASE WHEN coalesce(max(width), 0) > 0 THEN max(width) ELSE {WIDTH} END AS width, CASE WHEN coalesce(max(height), 0) > 0 THEN max(height) ELSE {HEIGHT} END AS height FROM ocr_pages GROUP BY ALL)"
SQL_JOBS = "(SELECT DISTINCT ON (job_id) * FROM jobs)"
