"""Sinks: documents in several formats, tables of extracted records, manifests."""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.functions import text as T
from pagesmith.operators import markup as M

log = logging.getLogger(__name__)
# Formats and the folder of their kind.
FOLDERS = {"json": "Data", "csv": "Data", "html": "Reflowed", "markdown": "Reflowed", "epub": "Reflowed", "reflowed_docx": "Reflowed", "reflowed_pdf": "Reflowed", "true_copy_html": "True Copy", "true_copy_docx": "True Copy", "true_copy_pdf": "True Copy", "true_copy_pptx": "True Copy", "searchable_pdf": "True Copy"}


def folder(fmt: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FOLDERS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, fmt), F.lit("Data"))


def page_json(regions: DataFrame) -> DataFrame:
    """(job_id, page_number, json): a page and its regions as JSON, in reading order. A document is its pages one below the other."""
    r = F.struct("block_idx", "region_id", F.struct(F.col("region_type").alias("type"), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("bbox"), "content", "html", "latex", F.col("heading_level").alias("level")).alias("r"))
    pages = regions.groupBy("job_id", "page_number").agg(F.transform(F.sort_array(F.collect_list(r)), lambda x: x["r"]).alias("regions"))
    return pages.select("job_id", "page_number", F.to_json(F.struct("page_number", "regions")).alias("json"))


def write_documents(pages: DataFrame, path: str, head: str = "", tail: str = "", between: str = "") -> None:
    """Text files of documents, a folder a job: pages in order, so that no task holds more than its range of a long one; its files go on in the order of their names. pages: job_id, page_number, body."""
    jobs = pages.select("job_id").distinct()
    edge = lambda text, at: jobs.select("job_id", F.lit(at).alias("page_number"), F.lit(text).alias("body")) if text else None
    body = pages.select("job_id", F.col("page_number").cast("bigint"), F.concat(F.lit(between), "body") if between else F.col("body"))
    body = body.toDF("job_id", "page_number", "body")
    for part in (edge(head, -(1 << 62)), edge(tail, 1 << 62)):
        body = body.unionByName(part) if part is not None else body
    body.repartitionByRange("job_id", "page_number").sortWithinPartitions("job_id", "page_number").select("job_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)


def write_json(regions: DataFrame, path: str) -> None:
    """JSON lines, a page a line, a folder a job."""
    write_documents(page_json(regions).withColumnRenamed("json", "body"), path)


def write_html(regions: DataFrame, path: str) -> None:
    """Html text, a folder a job: its regions in reading order, heads and feet left out."""
    options = regions.select("job_id").distinct().select("job_id", F.lit(True).alias("remove_headers_footers"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), *(F.lit(v).alias(k) for k, v in M.DEFAULTS.items() if k != "remove_headers_footers"))
    write_documents(M.pages_of(M.render(regions, options)), path, "<!DOCTYPE html><html><body>", "</body></html>")


def write_markdown(regions: DataFrame, path: str) -> None:
    """Markdown text, a folder a job."""
    write_documents(M.pages_of(M.region_markdown(regions), "\n\n"), path, between="\n")


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {"json": write_json, "html": write_html, "markdown": write_markdown}


def export(regions: DataFrame, path: str, formats: list[str]) -> list[dict]:
    """Writes documents in several formats; JSON always and first. A format that fails or is unknown is logged and skipped; each has a row in what is returned."""
    out = []
    for f in ["json", *(x for x in dict.fromkeys(formats) if x != "json")]:
        to = os.path.join(path, FOLDERS.get(f, "Data"), f)
        try:
            WRITERS[f](regions, to)
            out.append({"format": f, "path": to, "ok": True})
        except Exception as e:  # noqa: BLE001
            log.warning("format %s is skipped: %s", f, e)
            out.append({"format": f, "path": None, "ok": False})
    return out


def records(df: DataFrame, key: str, result: str) -> DataFrame:
    """(key, row, record): an extraction's records as JSON: the array itself, that under data, that under results, else the object as one record. What is no JSON gives no row."""
    v = F.coalesce(F.get_json_object(result, "$.data"), F.get_json_object(result, "$.results"), F.col(result))
    listed = F.when(F.ltrim(v).startswith("["), v).otherwise(F.concat(F.lit("["), v, F.lit("]")))
    return df.select(key, F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias("row", "record")).where("record IS NOT NULL")


def csv_lines(rec: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line): records as CSV: the header is the union of the keys in the order in which they are first seen; every value is quoted, missing ones are empty."""
    k = rec.select(key, F.col("row").alias("_row"), F.posexplode(F.map_keys("record")).alias("_i", "_name")).groupBy(key, "_name").agg(F.min(F.struct("_row", "_i")).alias("_o"))
    head = k.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_name"))), lambda x: x["_name"]).alias("header"))
    r = rec.join(head, key)
    body = r.select(key, (F.col("row") + 1).alias("line_no"), F.array_join(F.transform("header", lambda h: T.csv_field(F.try_element_at(F.col("record"), h))), ",").alias("line"))
    return head.select(key, F.lit(0).alias("line_no"), F.array_join(F.transform("header", T.csv_field), ",").alias("line")).unionByName(body)


def write_translations(df: DataFrame, path: str) -> None:
    """Translated blocks, a folder for each language."""
    df.write.mode("overwrite").partitionBy("tgt_lang").json(path)


class Manifest:
    """A list of what has been written, replaced as a whole by a rename after each file, so that a reader never sees half of it."""

    def __init__(self, path: str, src: str, targets: list[str], total: int):
        self.path = path
        self.state = {"status": "processing", "src_lang": src, "tgt_langs": sorted(set(targets)), "completed": 0, "total": total, "files": []}
        self._write()

    def add(self, source: str, target: str, output: str) -> None:
        self.state["files"].append({"source": source, "target_lang": target, "output": output})
        self.state["completed"] += 1
        if self.state["completed"] >= self.state["total"]:
            self.state["status"] = "completed"
        self._write()

    def _write(self) -> None:
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(self.state, f, ensure_ascii=False)
        os.replace(part, self.path)


def upsert(spark: SparkSession, current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with changes applied: only given (not null) fields change; started_at is set once; the end is set by a final status; deleted keys go. changes: key, op (put, delete), the fields, ts."""
    fields = [c for c in current.columns if c != key]
    last = changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"n_{c}") for c in fields if c in changes.columns), F.max_by("op", "ts").alias("op"))
    j = current.join(last, key, "full").where("op IS NULL OR op <> 'delete'")
    pick = lambda c: (F.coalesce(c, f"n_{c}") if c == "started_at" else F.coalesce(f"n_{c}", c)) if c in changes.columns else F.col(c)
    return j.select(key, *(pick(c).alias(c) for c in fields))
