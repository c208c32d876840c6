"""Sources: documents as files and as JSON of several layouts, made-up documents, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.operators.scan import numbered

#: Largest upload that is taken, in bytes.
LARGEST = 500 * 1024 * 1024

_REGION = "struct<type:string,bbox:array<double>,content:string,text:string,html:string,latex:string,level:int,spans:array<struct<content:string>>>"
#: All layouts at once: what a document lacks is null.
DOCUMENT = f"content_list array<struct<type:string,text:string,content:string,bbox:array<double>,page_idx:int>>, pages array<struct<page_number:int,width:double,height:double,regions:array<{_REGION}>>>, pdf_info array<struct<page_idx:int,page_size:string,preproc_blocks:array<{_REGION}>,para_blocks:array<{_REGION}>>>, metadata struct<total_pages:int,file_name:string>"
# Raw kinds of blocks and the types that they become; any other is text.
TYPES = {"title": "title", "text": "text", "list": "list", "index": "list", "table": "table", "table_body": "table", "image": "figure", "image_body": "figure", "figure": "figure", "interline_equation": "formula", "equation": "formula", "formula": "formula", "image_caption": "caption", "table_caption": "caption", "caption": "caption", "header": "header", "footer": "footer"}


def uploads(spark: SparkSession, path: str, glob: str = "*.pdf", largest: int = LARGEST) -> DataFrame:
    """(path, length, modificationTime, content): files below the size limit; the filter on the length is applied before contents are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).where(F.col("length") <= largest)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(folder, path): the JSON of each folder: the raw output if there is one, else the first by name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path).select("path")
    f = f.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    best = F.min_by("path", F.struct((~F.col("path").endswith("_ocr_data.json")).alias("other"), F.col("path")))
    return f.groupBy("folder").agg(best.alias("path"))


def region_type(raw: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(raw)), F.lit("text"))


def blocks_of_json(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, page_idx, block_idx, region_type, text): blocks of documents in any of three layouts; the first that a document has counts: a flat list, pages with regions, raw pages with blocks.

    A bare array is a flat list. What is no JSON, or has no layout, gives no row. Empty text falls back to content, then to the joined spans.
    """
    d = df.select(key, F.from_json(F.when(F.ltrim(F.col(json)).startswith("["), F.concat(F.lit('{"content_list":'), F.col(json), F.lit("}"))).otherwise(F.col(json)), DOCUMENT).alias("d"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    text = lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), F.nullif(b["content"], F.lit("")), F.array_join(F.transform(b["spans"], lambda s: s["content"]), " "), F.lit(""))
    out = "array<struct<page_idx:int,type:string,text:string>>"
    flat = F.transform("d.content_list", lambda b: F.struct(F.coalesce(b["page_idx"], F.lit(0)).alias("page_idx"), b["type"].alias("type"), F.coalesce(F.nullif(b["text"], F.lit("")), b["content"], F.lit("")).alias("text"))).cast(out)
    paged = F.flatten(F.transform("d.pages", lambda p: F.transform(p["regions"], lambda b: F.struct((p["page_number"] - 1).alias("page_idx"), b["type"].alias("type"), text(b).alias("text"))))).cast(out)
    raw = F.flatten(F.transform("d.pdf_info", lambda p: F.transform(F.when(some(p["para_blocks"]), p["para_blocks"]).otherwise(p["preproc_blocks"]), lambda b: F.struct(p["page_idx"].alias("page_idx"), b["type"].alias("type"), text(b).alias("text"))))).cast(out)
    blocks = F.when(some(F.col("d.content_list")), flat).when(some(F.col("d.pages")), paged).when(some(F.col("d.pdf_info")), raw)
    return d.select(key, F.posexplode(blocks).alias("block_idx", "b")).select(key, F.col("b.page_idx").alias("page_idx"), "block_idx", region_type(F.col("b.type")).alias("region_type"), F.col("b.text").alias("text"))


def page_count(json: Column) -> Column:
    """Pages of a document's JSON: its pages, else raw pages, else what its metadata say, else 1."""
    d = F.from_json(json, DOCUMENT)
    n = lambda c: F.nullif(F.when(F.size(c) > 0, F.size(c)), F.lit(0))
    return F.coalesce(n(d["pages"]), n(d["pdf_info"]), d["metadata"]["total_pages"], F.lit(1))


def made_up_documents(spark: SparkSession, n: int) -> DataFrame:
    """(doc_id, page_idx, block_idx, region_type, text): documents of 5 to 24 pages: a title on the first, a section on every third page; tables, equations and lists in turn; a header and a footer on each."""
    d = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") * 7 % 20 + 5).alias("total"))
    p = d.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("total") - 1).cast("int"))).alias("page_idx"))
    kind = lambda i: F.when(i == 0, "header").when(i == 7, "footer").when((i == 1) & (F.col("page_idx") == 0), "title").when((i == 1) & (F.col("page_idx") % 3 == 0), "title").when(i % 4 == 2, "table").when(i % 5 == 3, "formula").when(i % 3 == 1, "list").otherwise("text")
    b = p.select("doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block_idx"))
    return b.select("doc_id", "page_idx", "block_idx", kind(F.col("block_idx")).alias("region_type"), F.concat_ws(" ", kind(F.col("block_idx")), F.col("doc_id"), F.col("page_idx"), F.col("block_idx")).alias("text"))


def dimension(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): a JSON object as rows, without keys that start with an underscore."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return one.select(F.explode("m").alias("key", "value")).where(~F.col("key").startswith("_"))


def depth_of(json: Column) -> Column:
    """How deep the brackets of a JSON text are nested; 0 for null."""
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    top = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))
    return F.coalesce(top["most"], F.lit(0))


def deepest(df: DataFrame, json: str) -> int:
    """The deepest nesting of all rows: one number, found in one pass, by which trees are then taken apart without leaving a level out."""
    return int(df.agg(F.max(depth_of(F.col(json)))).first()[0] or 0)


def flatten_contents(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, level, title): trees of headings of any depth, in pre-order; path: the places of a node and its forebears. What is no list of nodes gives no row."""
    depth = max(1, deepest(df, json) // 2)
    node = "title:string,level:int"
    for _ in range(depth - 1):
        node = f"title:string,level:int,children:array<struct<{node}>>"
    now = df.select(key, F.posexplode(F.from_json(json, f"array<struct<{node}>>")).alias("i", "n")).select(key, F.array("i").alias("path"), "n")
    out = now.select(key, "path", "n.level", "n.title")
    for _ in range(depth - 1):
        now = now.select(key, "path", F.posexplode("n.children").alias("i", "n")).select(key, F.concat("path", F.array("i")).alias("path"), "n")
        out = out.unionByName(now.select(key, "path", "n.level", "n.title"))
    return out


def latest_templates(df: DataFrame) -> DataFrame:
    """Templates with a number by the time of their last change, newest first; no task sorts them all."""
    return numbered(df.withColumn("_t", -F.unix_micros(F.col("updated_at").cast("timestamp"))), ["_t", "id"]).drop("_t")
