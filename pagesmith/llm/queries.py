"""The queries of the text problems, by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.llm.common import latest_regions, read, scanned_pages

Query = Callable[[SparkSession, str], DataFrame]


def texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(region_id, content, further columns) of regions that are text with content as they were delivered last."""
    return latest_regions(read(spark, d, "regions"), "region_type", "content", *columns).where("region_type = 'text' AND content IS NOT NULL AND content <> ''").drop("region_type")


def digital_text(spark: SparkSession, d: str) -> DataFrame:
    """(region_id, content) of text regions with content on pages with a digital text layer, each region once."""
    r = texts(spark, d, "job_id", "page_number")
    p = scanned_pages(read(spark, d, "ocr_pages")).where("NOT scanned")
    return r.join(p.select("job_id", "page_number"), ["job_id", "page_number"], "left_semi").select("region_id", "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row a sentence of each text region on pages that are not scanned."""
    from pagesmith.llm.sentences import sentence_spans

    return sentence_spans(digital_text(spark, d)).select("region_id", "start_pos", "end_pos")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Regions of which content or html is or holds residue."""
    from pagesmith.llm.residue import fitted, residue_scores

    r = read(spark, d, "regions")
    latest = latest_regions(r, "content", "html")
    return residue_scores(latest, fitted(r)).where("score >= 0.5").select("region_id").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """How the classifier does on jobs, and on families of phrases and placeholders, that it was not fitted on."""
    from pagesmith.llm.residue import report

    return report(read(spark, d, "regions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Text regions with a language in which a whole sentence is written while the job's ocr_lang does not name it."""
    from pagesmith.llm.language import fitted, named_languages, written_languages

    r = texts(spark, d, "job_id")
    written = written_languages(r.select("region_id", "content"), "region_id", "content", fitted(read(spark, d, "documents")))
    named = named_languages(read(spark, d, "submit_options"), read(spark, d, "lang_codes"))
    return written.join(r.select("region_id", "job_id"), "region_id").join(named, ["job_id", "lang"], "left_anti").select("region_id", "lang")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every text region with its language and confidence; lang null where it has none."""
    from pagesmith.llm.language import fitted, sentence_languages

    r = texts(spark, d)
    s = sentence_languages(r, "region_id", "content", fitted(read(spark, d, "documents")))
    z = s.select("region_id", F.explode(F.arrays_zip("starts", "ends", "langs", "confidences")).alias("s"))
    return z.select("region_id", F.col("s.starts").alias("start_pos"), F.col("s.ends").alias("end_pos"), F.col("s.langs").alias("lang"), F.round("s.confidences", 4).alias("confidence"))


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the language of most of its words, its confidence, and whether its label names another one."""
    from pagesmith.llm.language import LANGUAGES, fitted, sentence_languages

    docs = read(spark, d, "documents")
    s = sentence_languages(docs, "doc_id", "text", fitted(docs))
    z = s.select("doc_id", F.explode_outer(F.arrays_zip("langs", "confidences", "words")).alias("s"))
    by = z.groupBy("doc_id", F.col("s.langs").alias("found")).agg(F.sum(F.col("s.words")).alias("n"), F.sum(F.col("s.words") * F.col("s.confidences")).alias("w"))
    best = by.groupBy("doc_id").agg(F.max_by(F.struct("found", "n", "w"), F.struct(F.when(F.col("found").isNotNull(), F.col("n")).otherwise(-1), F.col("found"))).alias("b"))
    label = F.lower(F.regexp_extract(F.trim("lang"), "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    out = best.join(docs.select("doc_id", label.alias("label")), "doc_id")
    return out.select("doc_id", F.col("b.found").alias("lang"), F.round(F.coalesce(F.col("b.w") / F.col("b.n"), F.lit(0.0)), 4).alias("confidence"), (F.col("label").isin(*LANGUAGES) & (F.col("label") != F.col("b.found"))).alias("contradicts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions, and of regions and runs, that look the same in print but differ in code points."""
    from pagesmith.llm.visual import look_alike_pairs, look_alike_runs

    regions = look_alike_pairs(digital_text(spark, d), "region_id", "content").select(F.lit("region").alias("kind"), "key_a", "key_b")
    runs = look_alike_runs(read(spark, d, "styled_runs"), latest_regions(read(spark, d, "regions"), "content"))
    return regions.unionByName(runs.select(F.lit("run").alias("kind"), "key_a", "key_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Regions that look the same, by look and spelling: a row a spelling, with how many regions have it."""
    from pagesmith.llm.visual import look_classes

    return look_classes(digital_text(spark, d), "region_id", "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Flaws of scanned pages: broken and misread words, furniture among the text, paragraphs split by a page's end."""
    from pagesmith.llm.scans import flaws

    r = latest_regions(read(spark, d, "regions"), "job_id", "page_number", "block_idx", "region_type", "bbox", "content")
    return flaws(spark, r, read(spark, d, "ocr_pages"), read(spark, d, "html_options"), read(spark, d, "regions"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    from pagesmith.llm.tokens import token_ids

    return token_ids(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of test items, with the items."""
    from pagesmith.llm.leaks import leaks

    return leaks(read(spark, d, "documents"), read(spark, d, "benchmark")).select("doc_id", "item_id")


def _toxicity(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    from pagesmith.llm.abuse import fitted, toxicity

    docs = read(spark, d, "documents")
    return toxicity(docs, fitted(docs, read(spark, d, "labels")), extra=extra)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a sentence of abuse, hatred or explicit sex."""
    from pagesmith.llm.abuse import THRESHOLD

    return _toxicity(spark, d).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score, and where its toxic spans start and end."""
    return _toxicity(spark, d).select("doc_id", F.round("score", 6).alias("score"), "starts", "ends")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of every source its documents, those that are cases, and their share; source null is a group of its own."""
    from pagesmith.llm.abuse import THRESHOLD

    return _toxicity(spark, d, "source").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= THRESHOLD).alias("n_toxic")).withColumn("rate", F.round(F.col("n_toxic") / F.col("n_docs"), 6))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_segments": p3_segments, "p3_documents": p3_documents, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_scores": p8_scores, "p8_sources": p8_sources}


def oracle_sql() -> dict[str, str]:
    return {}
