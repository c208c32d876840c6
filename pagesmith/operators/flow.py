"""What a page takes over from the pages before it, in documents of any length.

A document's pages are put in chunks. A chunk's total is one aggregate, totals
before a chunk are summed over chunks, values before a page within its chunk:
no task takes all rows of one document, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pages of a chunk.
CHUNK = 256


def earlier(pages: DataFrame, **values: tuple[str, str]) -> DataFrame:
    """(job_id, page_number, a column a value): of each page what the earlier pages of its job come to.

    pages: one row a page. values: name=(column, how): sum (0 if there is none),
    min, or last, which takes the last one that is not null.
    """
    x = pages.select("job_id", "page_number", F.floor(F.col("page_number") / CHUNK).alias("_c"), *(F.col(c).alias(f"_{n}") for n, (c, _) in values.items()))
    over_chunk: dict[str, Column] = {}
    for n, (_, how) in values.items():
        v = F.col(f"_{n}")
        over_chunk[n] = {"sum": F.sum(v), "min": F.min(v), "last": F.max_by(v, F.when(v.isNotNull(), F.col("page_number")))}[how]
    total = x.groupBy("job_id", "_c").agg(*(v.alias(f"_t_{n}") for n, v in over_chunk.items()))
    chunks = W.partitionBy("job_id").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy("job_id", "_c").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    run = {"sum": F.sum, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    total = total.select("job_id", "_c", *(run[how](f"_t_{n}").over(chunks).alias(f"_b_{n}") for n, (_, how) in values.items()))
    x = x.select("*", *(run[how](f"_{n}").over(inner).alias(f"_i_{n}") for n, (_, how) in values.items())).join(total, ["job_id", "_c"])
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "last": lambda a, b: F.coalesce(b, a)}
    return x.select("job_id", "page_number", *(both[how](F.col(f"_b_{n}"), F.col(f"_i_{n}")).alias(n) for n, (_, how) in values.items()))


def numbered_in_jobs(df: DataFrame, within: list[str], name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """df with the number of each row in its job (and extra columns), from 0, by page and then by the order within."""
    page = W.partitionBy("job_id", "page_number", *extra).orderBy(*within)
    key = F.concat_ws("\u0001", F.col("job_id"), *(F.col(c).cast("string") for c in extra)) if extra else F.col("job_id")
    counts = df.groupBy("job_id", "page_number", *extra).agg(F.count("*").alias("_n")).withColumn("_key", key)
    before = earlier(counts.select(F.col("_key").alias("job_id"), "page_number", "_n"), _before=("_n", "sum")).withColumnRenamed("job_id", "_key")
    counts = counts.join(before, ["_key", "page_number"]).select("job_id", "page_number", *extra, "_before")
    return df.withColumn("_k", F.row_number().over(page) - 1).join(counts, ["job_id", "page_number", *extra]).withColumn(name, F.col("_before") + F.col("_k")).drop("_before", "_k")


def page_joins(rendered: DataFrame) -> DataFrame:
    """(region_id, joins): whether a text region goes on with the paragraph before.

    rendered: job_id, page_number, block_idx, region_id, region_type, content,
    joined (whether the job's pages are joined), shown (whether the region
    renders to anything): the regions that are left after the job's options. A
    page whose last region is text without a final mark hands on a flag; any
    other page that shows something ends it, one that shows nothing passes it on.
    On the next pages the first region that is shown takes it; a text without a
    character is shown only where it has no flag.
    """
    order = F.struct("block_idx", "region_id")
    ends = ~F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "").rlike(r"[.!?:]$")
    takes = F.col("shown") & ((F.col("region_type") != "text") | (F.coalesce("content", F.lit("")) != ""))
    x = rendered.withColumn("_takes", takes)
    page = x.groupBy("job_id", "page_number").agg(F.max_by(F.when(F.col("region_type") == "text", ends), order).alias("open"), F.max("_takes").alias("takes"), F.max("joined").alias("joined"))
    page = page.withColumn("out", F.when(F.col("open").isNotNull() & F.col("joined"), F.col("open")).when(F.col("takes"), F.lit(False)))
    w = W.partitionBy("job_id", "page_number").orderBy("block_idx", "region_id").rowsBetween(W.unboundedPreceding, -1)
    r = x.withColumn("_taken", F.coalesce(F.max("_takes").over(w), F.lit(False))).join(earlier(page, flag=("out", "last")), ["job_id", "page_number"])
    return r.where("region_type = 'text'").select("region_id", (F.coalesce("flag", F.lit(False)) & ~F.col("_taken")).alias("joins"))


def first_words(regions: DataFrame, most: int) -> DataFrame:
    """(region_id, taken): a job's first words in reading order; the region that reaches the limit gives what is left of it, words apart by one space, others keep their spacing."""
    words = F.filter(F.split("content", r"\s+"), lambda x: x != "")
    r = regions.withColumn("n", F.size(words))
    before = earlier(r.groupBy("job_id", "page_number").agg(F.sum("n").alias("n")), words=("n", "sum")).where(F.col("words") < most)
    w = W.partitionBy("job_id", "page_number").orderBy("block_idx", "region_id").rowsBetween(W.unboundedPreceding, 0)
    r = r.join(before, ["job_id", "page_number"]).withColumn("before", F.col("words") + F.sum("n").over(w) - F.col("n")).where((F.col("before") < most) & (F.col("n") > 0))
    rest = F.array_join(F.slice(words, F.lit(1), (F.lit(most) - F.col("before")).cast("int")), " ")
    return r.select("region_id", F.when(F.col("before") + F.col("n") <= most, F.col("content")).otherwise(rest).alias("taken"))


def rising_numbers(candidates: DataFrame) -> DataFrame:
    """(job_id, numbered, n_candidates): whether numbers at margins rise over a job: five or more, three fifths of the steps upward. candidates: job_id, page_number, block_idx, region_id, n."""
    page = candidates.groupBy("job_id", "page_number").agg(F.max_by("n", F.struct("block_idx", "region_id")).alias("n"))
    w = W.partitionBy("job_id", "page_number").orderBy("block_idx", "region_id")
    c = candidates.withColumn("_lag", F.lag("n").over(w)).join(earlier(page, _page=("n", "last")), ["job_id", "page_number"]).withColumn("before", F.coalesce("_lag", "_page"))
    return c.groupBy("job_id").agg(((F.count("*") >= 5) & (F.count_if(F.col("n") > F.col("before")) >= 0.6 * (F.count("*") - 1))).alias("numbered"), F.count("*").alias("n_candidates"))


def unmerge_pages(blocks: DataFrame) -> DataFrame:
    """(id, given): lines that belong to a later page go, first come first served, to the blocks that were emptied for them.

    blocks: job_id, page_number, block_idx, id, emptied, group (the lines that
    cross the page, null if none). In reading order a block first takes the
    oldest waiting group, if it was emptied and one waits, then adds its own.
    How many wait is a running sum less its running minimum, so the queue needs
    no loop; the k-th block that is served gets the k-th group. Groups that no
    later block takes are dropped.
    """
    order = ["block_idx", "id", "push"]
    slots = blocks.where("emptied").select("job_id", "page_number", "block_idx", "id", F.lit(None).cast("string").alias("group"), F.lit(0).alias("push"))
    pushes = blocks.where("group IS NOT NULL").select("job_id", "page_number", "block_idx", "id", "group", F.lit(1).alias("push"))
    page = W.partitionBy("job_id", "page_number").orderBy(*order)
    so_far = page.rowsBetween(W.unboundedPreceding, 0)
    e = slots.unionByName(pushes).withColumn("_x", F.sum(F.when(F.col("push") == 1, 1).otherwise(-1)).over(so_far))
    sums = e.groupBy("job_id", "page_number").agg(F.max_by("_x", F.struct("block_idx", "id", "push")).alias("sum"), F.min("_x").alias("low"))
    sums = sums.join(earlier(sums, x0=("sum", "sum")), ["job_id", "page_number"])
    lows = earlier(sums.withColumn("low", F.col("x0") + F.col("low")), m0=("low", "min"))
    at = sums.select("job_id", "page_number", "x0").join(lows, ["job_id", "page_number"]).withColumn("m0", F.least(F.lit(0), "m0"))
    e = e.join(at, ["job_id", "page_number"]).withColumn("_x", F.col("x0") + F.col("_x"))
    e = e.withColumn("_m", F.least("m0", F.min("_x").over(so_far)))
    e = e.withColumn("_wait", F.coalesce(F.lag(F.col("_x") - F.col("_m")).over(page), F.col("x0") - F.col("m0")))
    served = numbered_in_jobs(e.where("push = 0 AND _wait > 0").select("job_id", "page_number", "block_idx", "id"), ["block_idx", "id"], "n").select("job_id", "n", "id")
    given = numbered_in_jobs(pushes.select("job_id", "page_number", "block_idx", "id", "group"), ["block_idx", "id"], "n").select("job_id", "n", F.col("group").alias("given"))
    return served.join(given, ["job_id", "n"]).select("id", "given")
