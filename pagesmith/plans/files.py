"""Queries over sources and sinks: layouts of JSON, trees of headings, made-up documents, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesmith.operators.scan import SQL_REGIONS, read, regions
from pagesmith.sources import files as I
from pagesmith.sources import sinks as O

Q: dict = {}
S: dict[str, str] = {}
R = SQL_REGIONS


def _documents(spark, d):
    """A document for each page of text, in one of four layouts."""
    r = regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content").where("content IS NOT NULL AND content <> ''")
    b = F.sort_array(F.collect_list(F.struct("block_idx", "region_id", "region_type", "content")))
    p = r.groupBy("job_id", "page_number").agg(b.alias("b")).withColumn("key", F.concat_ws("/", "job_id", F.col("page_number").cast("string")))
    flat = F.to_json(F.transform("b", lambda x: F.struct(x["region_type"].alias("type"), x["content"].alias("text"), F.lit(0).alias("page_idx"))))
    region = F.transform("b", lambda x: F.struct(x["region_type"].alias("type"), x["content"].alias("content")))
    paged = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("page_number"), region.alias("regions"))).alias("pages")))
    raw = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.transform("b", lambda x: F.struct(x["region_type"].alias("type"), F.array(F.struct(x["content"].alias("content"))).alias("spans"))).alias("para_blocks"))).alias("pdf_info")))
    k = F.col("page_number") % 4
    return p.select("key", F.when(k == 0, flat).when(k == 1, F.concat(F.lit('{"content_list":'), flat, F.lit("}"))).when(k == 2, paged).otherwise(raw).alias("json"))


Q["json_layouts"] = lambda spark, d: I.blocks_of_json(_documents(spark, d), "key", "json")
S["json_layouts"] = f"SELECT job_id || '/' || page_number AS key, 0 AS page_idx, (row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx, region_id) - 1)::INT AS block_idx, CASE WHEN region_type IN ('title', 'text', 'list', 'table', 'figure', 'formula', 'caption', 'header', 'footer') THEN region_type ELSE 'text' END AS region_type, content AS text FROM {R} WHERE content IS NOT NULL AND content <> ''"
Q["json_page_counts"] = lambda spark, d: O.page_json(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "bbox", "content", "html", "latex", "heading_level")).select("job_id", I.page_count(F.concat(F.lit('{"pages":['), "json", F.lit("]}"))).alias("n")).groupBy("job_id").agg(F.sum("n").alias("n_pages"))
S["json_page_counts"] = f"SELECT job_id, count(DISTINCT page_number)::BIGINT AS n_pages FROM {R} GROUP BY job_id"
# A page as it is written, and read back.
_PAGE = "struct<page_number:int,regions:array<struct<type:string,bbox:array<double>,content:string,html:string,latex:string,level:int>>>"
Q["json_pages"] = lambda spark, d: O.page_json(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "bbox", "content", "html", "latex", "heading_level")).select("job_id", F.from_json("json", _PAGE).alias("p")).select("job_id", F.col("p.page_number").alias("page_number"), F.posexplode("p.regions").alias("k", "r")).select("job_id", "page_number", "k", F.col("r.type").alias("type"), F.round(F.get("r.bbox", F.lit(3)), 3).alias("y1"), F.col("r.content").alias("content"), F.col("r.html").alias("html"), F.col("r.latex").alias("latex"), F.col("r.level").alias("level"))
S["json_pages"] = f"SELECT job_id, page_number, (row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx, region_id) - 1)::INT AS k, region_type AS type, round(bbox.y1, 3) AS y1, content, html, latex, heading_level AS level FROM {R}"
Q["format_folders"] = lambda spark, d: read(spark, d, "documents").groupBy("export_format", O.folder(F.col("export_format")).alias("folder")).agg(F.count("*").alias("n"))
S["format_folders"] = "SELECT export_format, CASE " + " ".join(f"WHEN export_format = '{k}' THEN '{v}'" for k, v in O.FOLDERS.items()) + " ELSE 'Data' END AS folder, count(*) AS n FROM documents GROUP BY ALL"
Q["synthetic_docs"] = lambda spark, d: I.made_up_documents(spark, 50).groupBy("doc_id", "region_type").agg(F.count("*").alias("n"), F.countDistinct("page_idx").alias("n_pages"))
S["synthetic_docs"] = """SELECT doc_id, region_type, count(*) AS n, count(DISTINCT page_idx) AS n_pages FROM (SELECT doc_id, page_idx, CASE WHEN i = 0 THEN 'header' WHEN i = 7 THEN 'footer' WHEN i = 1 AND page_idx % 3 = 0 THEN 'title' WHEN i % 4 = 2 THEN 'table' WHEN i % 5 = 3 THEN 'formula' WHEN i % 3 = 1 THEN 'list' ELSE 'text' END AS region_type
 FROM (SELECT doc_id, page_idx, unnest(generate_series(0, 7)) AS i FROM (SELECT id AS doc_id, unnest(generate_series(0, id * 7 % 20 + 4)) AS page_idx FROM range(50) t(id)))) GROUP BY ALL"""


def _trees(spark, d):
    """A tree of each page's titles, each under the one before it."""
    t = regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content").where("region_type = 'title' AND content IS NOT NULL")
    g = t.groupBy("job_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("block_idx", "region_id", "content"))).alias("b"))
    node = lambda x, i: F.concat(F.lit('{"title":'), F.element_at(F.array(F.to_json(F.array(x["content"]))), 1), F.lit(',"level":'), (i + 1).cast("string"), F.lit(',"children":['))
    opened = F.transform("b", lambda x, i: F.regexp_replace(node(x, i), r'^\{"title":\[(.*)\],"level"', '{"title":$1,"level"'))
    return g.select(F.concat_ws("/", "job_id", F.col("page_number").cast("string")).alias("page"), F.concat(F.lit("["), F.array_join(opened, ""), F.repeat(F.lit("]}"), F.size("b")), F.lit("]")).alias("toc"))


Q["toc_flatten"] = lambda spark, d: I.flatten_contents(_trees(spark, d), "page", "toc").select("page", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "level", "title")
S["toc_flatten"] = f"SELECT job_id || '/' || page_number AS page, array_to_string(list_transform(range(k), lambda x: '0'), '.') AS path, k::INT AS level, content AS title FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx, region_id) AS k FROM {R} WHERE region_type = 'title' AND content IS NOT NULL)"

# A null value is an empty field; its column stays in the header.
_RESULT = "CASE doc_id % 3 WHEN 0 THEN to_json(array(map('id', cast(doc_id as string), 'src', source), map('id', 'x', 'lang', lang)), map('ignoreNullFields', 'false')) WHEN 1 THEN to_json(named_struct('data', array(map('lang', lang, 'id', cast(doc_id as string)))), map('ignoreNullFields', 'false')) ELSE to_json(named_struct('id', cast(doc_id as string), 'src', source), map('ignoreNullFields', 'false')) END"
Q["json_to_csv"] = lambda spark, d: O.csv_lines(O.records(read(spark, d, "documents").select("doc_id", F.expr(_RESULT).alias("result")), "doc_id", "result"), "doc_id")
_QT = lambda x: f"""'"' || replace({x}, '"', '""') || '"'"""
S["json_to_csv"] = f"""WITH s AS (SELECT doc_id, source, lang FROM documents)
 SELECT doc_id, 0 AS line_no, CASE doc_id % 3 WHEN 0 THEN '"id","src","lang"' WHEN 1 THEN '"lang","id"' ELSE '"id","src"' END AS line FROM s UNION ALL
 SELECT doc_id, 1, CASE doc_id % 3 WHEN 0 THEN {_QT('doc_id::VARCHAR')} || ',' || coalesce({_QT('source')}, '') || ',' WHEN 1 THEN coalesce({_QT('lang')}, '') || ',' || {_QT('doc_id::VARCHAR')} ELSE {_QT('doc_id::VARCHAR')} || ',' || coalesce({_QT('source')}, '') END FROM s UNION ALL
 SELECT doc_id, 2, '"x",,' || coalesce({_QT('lang')}, '') FROM s WHERE doc_id % 3 = 0"""
