"""Translation of documents that keeps all but their texts: of regions in a table, and of documents in JSON."""

from __future__ import annotations

import json as json_lib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmith.functions import text as T
from pagesmith.models import slots
from pagesmith.session import ship

TEXTS = ("text", "title", "list", "caption")
_CELL = re.compile(r"(<t[hd]\b[^>]*>)(.*?)(</t[hd]\s*>)", re.I | re.S)


def translate_regions(regions: DataFrame, targets: list[str], mode: str = "local") -> DataFrame:
    """(region_id, tgt, content, html): regions in every language: contents of texts, titles, lists and captions, and the cells of tables; everything else stays as it is. Every text keeps its key on its way through the model, nothing is put back by its place in a batch."""
    langs = F.array(*map(F.lit, sorted(set(targets)))) if targets else F.array().cast("array<string>")
    each = regions.select("region_id", "region_type", "content", "html", F.explode(langs).alias("tgt"))
    says = F.col("region_type").isin(*TEXTS) & (T.strip(F.coalesce("content", F.lit(""))) != "")
    cut = F.regexp_extract_all("html", F.lit(r"(?is)(<t[hd]\b[^>]*>.*?</t[hd]\s*>|.(?:(?!<t[hd]\b).)*)"), F.lit(1))
    table = (F.col("region_type") == "table") & (F.coalesce("html", F.lit("")) != "")
    pieces = each.where(table).select("region_id", "tgt", F.posexplode(cut).alias("k", "piece"))
    head, tail = F.regexp_extract("piece", r"(?is)^(<t[hd]\b[^>]*>)", 1), F.regexp_extract("piece", r"(?is)(</t[hd]\s*>)$", 1)
    inner = T.strip(T.strip_tags(F.regexp_extract("piece", r"(?is)^<t[hd]\b[^>]*>(.*)</t[hd]\s*>$", 1)))
    is_cell = (head != "") & (tail != "")
    todo = each.select("region_id", "tgt", F.lit(-1).alias("k"), F.when(says, F.col("content")).alias("text")).unionByName(pieces.select("region_id", "tgt", "k", F.when(is_cell, F.nullif(inner, F.lit(""))).alias("text"))).where("text IS NOT NULL")
    done = todo.select("region_id", "tgt", "k", slots.translation(F.col("text"), F.col("tgt"), mode).alias("out"))
    html = pieces.join(done, ["region_id", "tgt", "k"], "left").withColumn("piece", F.when(F.col("out").isNotNull(), F.concat(head, "out", tail)).otherwise(F.col("piece")))
    html = html.groupBy("region_id", "tgt").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("_html"))
    text = done.where("k = -1").select("region_id", "tgt", F.col("out").alias("_content"))
    return each.join(text, ["region_id", "tgt"], "left").join(html, ["region_id", "tgt"], "left").select("region_id", "tgt", F.coalesce("_content", "content").alias("content"), F.coalesce("_html", "html").alias("html"))


def _put(doc: object, todo: list[tuple[dict, str, str | None]]) -> None:
    """Notes every text of a document: (block, field, cell's place or none), blocks of the first layout that it has."""
    if isinstance(doc, list):
        blocks, first = doc, "text"
    elif isinstance(doc, dict) and doc.get("content_list"):
        blocks, first = doc["content_list"], "text"
    elif isinstance(doc, dict) and "pages" in doc:
        blocks, first = [r for p in doc["pages"] for r in p.get("regions") or []], "content"
    elif isinstance(doc, dict) and "pdf_info" in doc:
        blocks, first = [b for p in doc["pdf_info"] for b in p.get("preproc_blocks") or p.get("para_blocks") or []], "text"
    else:
        return
    second = "content" if first == "text" else "text"
    for b in blocks:
        if not isinstance(b, dict):
            continue
        if b.get("type") in TEXTS:
            name = first if b.get(first) else second
            if isinstance(b.get(name), str) and b[name].strip():
                todo.append((b, first if first in b else name, b[name]))
        elif b.get("type") == "table":
            name = next((n for n in ("table_html", "html", "text") if isinstance(b.get(n), str) and "<" in b[n]), None)
            if name:
                todo.append((b, name, None))


def translate_json(df: DataFrame, key: str, json: str, tgt: str, mode: str = "local") -> DataFrame:
    """(key, tgt, json): documents in JSON of any layout with their texts in another language; every other field, known or not, stays. What is no JSON stays as it is. All texts of a batch of documents go to the model at once."""
    kinds = dict(df.dtypes)
    ship(df.sparkSession)
    step = slots.maker("translate", mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translate = step()
        for b in batches:
            docs: list[object] = []
            texts: list[str] = []
            langs: list[str] = []
            puts: list[tuple[dict, str, list[tuple[int, int]] | int]] = []
            for raw, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    doc = json_lib.loads(raw) if raw else None
                except ValueError:
                    doc = None
                docs.append(doc)
                todo: list[tuple[dict, str, str | None]] = []
                _put(doc, todo)
                for block, name, text in todo:
                    if text is not None:
                        puts.append((block, name, len(texts)))
                        texts.append(text)
                    else:
                        cells = [(i, " ".join(re.sub(r"<[^>]*>", " ", m.group(2)).split())) for i, m in enumerate(_CELL.finditer(block[name]))]
                        at = [(i, len(texts) + k) for k, (i, _) in enumerate([c for c in cells if c[1]])]
                        texts += [c for _, c in cells if c]
                        puts.append((block, name, at))
                langs += [lang] * (len(texts) - len(langs))
            out = translate(pd.DataFrame({"text": texts, "tgt": langs})).tolist() if texts else []
            for block, name, at in puts:
                if isinstance(at, int):
                    block[name] = out[at]
                else:
                    places, n = dict(at), iter(range(1 << 30))
                    block[name] = _CELL.sub(lambda m, places=places, n=n: m.group(1) + (out[places[k]] if (k := next(n)) in places else m.group(2)) + m.group(3), block[name])
            made = [raw if doc is None else json_lib.dumps(doc, ensure_ascii=False) for doc, raw in zip(docs, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.string())], names=[key, "tgt", "json"])

    return df.select(key, json, tgt).mapInArrow(run, f"`{key}` {kinds[key]}, tgt string, json string")
