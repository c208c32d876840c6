"""Queries over spans, page texts, translated documents, admission, replies and results of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesmith.operators import jobs as J
from pagesmith.operators import spans as P
from pagesmith.operators import translation as X
from pagesmith.operators.scan import SQL_JOBS, SQL_REGIONS, jobs, read, regions
from pagesmith.plans.files import _documents
from pagesmith.plans.layout import _BX, _boxes
from pagesmith.plans.text import STRIP
from pagesmith.sources import files as I

Q: dict = {}
S: dict[str, str] = {}
R = SQL_REGIONS


def _pages_of_spans(spark, d):
    """Pages as a text extraction gives them: a block a region, a line a line, a span a line."""
    line = lambda x: F.struct(F.array(F.struct(x.alias("text"), F.col("font_family").alias("font"), F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("bbox"))).alias("spans"))
    b = regions(spark, d, "job_id", "page_number", "block_idx", "content", "font_family", "bbox").where("content IS NOT NULL").withColumn("lines", F.transform(F.split("content", "\n"), line))
    b = b.groupBy("job_id", "page_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "region_id", "lines"))), lambda x: F.struct(x["lines"].alias("lines"))).alias("blocks"))
    return b.select(F.concat_ws("/", "job_id", F.col("page_number").cast("string")).alias("page"), F.to_json(F.struct("blocks")).alias("json"))


Q["font_spans"] = lambda spark, d: P.font_spans(_pages_of_spans(spark, d), "page", "json").select("page", "block_idx", "line_idx", "span_idx", "name", "n_chars", F.round("bbox.x1", 3).alias("x1"))
S["font_spans"] = f"""WITH b AS (SELECT job_id || '/' || page_number AS page, (row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx, region_id) - 1)::INT AS block_idx, string_split(content, chr(10)) AS ls, font_family, bbox FROM {R} WHERE content IS NOT NULL), l AS (SELECT *, unnest(range(len(ls))) AS i FROM b)
 SELECT page, block_idx, i::INT AS line_idx, 0 AS span_idx, font_family AS name, length(ls[i + 1])::INT AS n_chars, round(bbox.x1, 3) AS x1 FROM l WHERE {STRIP('ls[i + 1]')} <> '' AND coalesce(font_family, '') <> ''"""


def _runs(spark, d):
    """Texts of regions as their runs give them, each run once."""
    r = read(spark, d, "styled_runs").where("run_id IS NOT NULL").groupBy("run_id").agg(F.max("region_id").alias("region_id"), F.max("run_idx").alias("run_idx"), F.max("text").alias("text"))
    return r.groupBy("region_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_idx", "run_id", "text"))), lambda x: x["text"]), "").alias("text"))


_RUNS = "(SELECT region_id, string_agg(text, '' ORDER BY run_idx, run_id) FILTER (WHERE text IS NOT NULL) AS text FROM (SELECT run_id, max(region_id) AS region_id, max(run_idx) AS run_idx, max(text) AS text FROM styled_runs WHERE run_id IS NOT NULL GROUP BY run_id) GROUP BY region_id)"


def _page_texts(spark, d):
    b = regions(spark, d, "job_id", "page_number", "block_idx", "content")
    t = b.join(_runs(spark, d), "region_id").groupBy("job_id", "page_number", "block_idx").agg(F.min_by("text", "region_id").alias("text"))
    return P.with_page_texts(b, t).select("region_id", "per_page", "text")


Q["page_texts"] = _page_texts
S["page_texts"] = f"""WITH t AS (SELECT job_id, page_number, block_idx, arg_min(u.text, r.region_id) AS t FROM {R} r JOIN {_RUNS} u USING (region_id) GROUP BY ALL)
 SELECT region_id, nullif(t, content) AS per_page, coalesce(nullif(t, content), content) AS text FROM {R} r LEFT JOIN t USING (job_id, page_number, block_idx)"""

_MB = lambda spark, d: _boxes(spark, d).select("job_id", "page_number", "id", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"), (F.col("id") % 11 == 0).alias("rotated"))
Q["merged_lines"] = lambda spark, d: P.merged_lines(_MB(spark, d)).select("job_id", "page_number", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")), "n")
S["merged_lines"] = f"""WITH b AS (SELECT * FROM {_BX} WHERE id % 11 <> 0), l AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1 FROM b WINDOW w AS (PARTITION BY job_id, page_number ORDER BY y0, id)),
 g AS (SELECT *, sum(CASE WHEN p0 IS NOT NULL AND least(y1 - y0, p1 - p0) > 0 AND (least(y1, p1) - greatest(y0, p0)) / least(y1 - y0, p1 - p0) > 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, page_number ORDER BY y0, id ROWS UNBOUNDED PRECEDING) AS line FROM l),
 e AS (SELECT *, max(x1) OVER q - min(x0) OVER q > (max(y1) OVER q - min(y0) OVER q) * 4.0 AS wide FROM g WINDOW q AS (PARTITION BY job_id, page_number, line)),
 m AS (SELECT *, sum(CASE WHEN wide AND x0 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, page_number, line ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, max(x1) OVER (PARTITION BY job_id, page_number, line ORDER BY x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e))
 SELECT job_id, page_number, round(min(x0), 3) AS x0, round(min(y0), 3) AS y0, round(max(x1), 3) AS x1, round(max(y1), 3) AS y1, count(*) AS n FROM m GROUP BY job_id, page_number, line, grp UNION ALL SELECT job_id, page_number, round(x0, 3), round(y0, 3), round(x1, 3), round(y1, 3), 1 FROM {_BX} WHERE id % 11 = 0"""

Q["masked_texts"] = lambda spark, d: P.masked_texts(_boxes(spark, d).where("region_type = 'text'"), _boxes(spark, d).where("region_type IN ('formula', 'table', 'figure')"))
# Point by point: what of a text's points no mask of its line holds.
S["masked_texts"] = f"""WITH h AS (SELECT t.id, floor(f.x0)::BIGINT AS lo, floor(f.x1)::BIGINT AS hi FROM {_BX} t JOIN {_BX} f USING (job_id, page_number) WHERE t.region_type = 'text' AND f.region_type IN ('formula', 'table', 'figure') AND least(t.y1 - t.y0, f.y1 - f.y0) > 0 AND greatest(0, least(t.y1, f.y1) - greatest(t.y0, f.y0)) / least(t.y1 - t.y0, f.y1 - f.y0) > 0.8),
 p AS (SELECT id, unnest(generate_series(floor(x0)::BIGINT, floor(x1)::BIGINT)) AS x FROM {_BX} WHERE region_type = 'text'), k AS (SELECT p.id, p.x, p.x - row_number() OVER (PARTITION BY p.id ORDER BY p.x) AS run FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = p.id AND p.x BETWEEN h.lo AND h.hi))
 SELECT id, min(x) AS lo, max(x) AS hi FROM k GROUP BY id, run"""

Q["recognised_spans"] = lambda spark, d: P.recognised_spans(_boxes(spark, d).where("region_type IN ('text', 'title', 'caption')").withColumn("category", F.when(F.col("region_type") == "title", 0).otherwise(15)).withColumn("lang", F.when(F.col("ord") % 5 > 0, "en")), _boxes(spark, d).where("region_type IN ('figure', 'table')")).select("id")
S["recognised_spans"] = f"SELECT id FROM {_BX} s WHERE region_type IN ('text', 'caption') AND ord % 5 > 0 AND NOT EXISTS (SELECT 1 FROM {_BX} f WHERE f.region_type IN ('figure', 'table') AND f.job_id = s.job_id AND f.page_number = s.page_number AND (s.x0 + s.x1) / 2 BETWEEN f.x0 AND f.x1 AND (s.y0 + s.y1) / 2 BETWEEN f.y0 AND f.y1)"

_BOXED = "transform(inline_latex, (e, i) -> named_struct('bbox', named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', length(e) * 4.0D, 'y1', CASE WHEN region_id % 9 = 0 THEN 0.0D ELSE i + 8.0D END), 'line_bbox', named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 300.0D, 'y1', 14.0D)))"
Q["equation_places"] = lambda spark, d: regions(spark, d, "content", "inline_latex").where("size(inline_latex) > 0").select("region_id", F.posexplode(P.equation_places(F.col("content"), F.expr(_BOXED))).alias("i", "e")).select("region_id", "i", "e.*")
S["equation_places"] = f"SELECT region_id, i::INT AS i, greatest(instr(content, '{{{{EQ:' || i || '}}}}') - 1, 0)::INT AS \"at\", round(length(inline_latex[i + 1]) * 4.0 / (i + 8), 2)::DOUBLE AS aspect, round((i + 8) / 14.0, 2)::DOUBLE AS height FROM (SELECT *, unnest(range(len(inline_latex))) AS i FROM {R} WHERE len(inline_latex) > 0 AND region_id % 9 <> 0)"

_WAITING = lambda spark, d: jobs(spark, d).withColumn("status", F.when(F.col("status") == "completed", "queued").otherwise(F.col("status")))
Q["admitted_jobs"] = lambda spark, d: J.admitted(_WAITING(spark, d), {"ocr": 2, "llm": 30})
S["admitted_jobs"] = f"""WITH j AS (SELECT job_id, CASE WHEN job_type IN ('ocr', 'heading_correction') THEN 'ocr' ELSE 'llm' END AS class, CASE status WHEN 'completed' THEN 'queued' ELSE status END AS status, coalesce(total_pages, 0) AS n, created_at FROM {SQL_JOBS}), q AS (SELECT job_id, class, row_number() OVER (PARTITION BY class ORDER BY n, created_at, job_id)::INT AS turn FROM j WHERE status = 'queued')
 SELECT job_id, class, turn FROM q WHERE turn <= CASE class WHEN 'ocr' THEN 2 ELSE 30 END - (SELECT count(*) FROM j WHERE j.class = q.class AND status IN ('processing', 'retrying'))"""
Q["rate_limits"] = lambda spark, d: J.rate_limited(read(spark, d, "events").select(F.col("user_id").alias("doc"), F.struct("ts", "event_id").alias("ord"), (F.col("event_type") == "error").alias("limited")))
S["rate_limits"] = "WITH e AS (SELECT user_id AS doc, event_type = 'error' AS limited, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM events) SELECT doc, count(*) AS n_calls, count(*) FILTER (WHERE limited) AS n_limited, count(*) FILTER (WHERE NOT limited AND after) AS n_after FROM e GROUP BY doc"
Q["last_results"] = lambda spark, d: J.last_results(read(spark, d, "events").select(F.col("user_id").alias("grp"), F.struct("ts", "event_id").alias("ord"), "event_id", "value"), 3).select("grp", "event_id", "value")
S["last_results"] = "SELECT user_id AS grp, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"
_INTAKE = "ff000000-5c4c-4000-8000-3bf86c1de65a"
Q["job_lookup"] = lambda spark, d: J.by_key(jobs(spark, d), "job_id", _INTAKE).select("job_id", "status", "total_pages", F.get_json_object("tool_config", "$.ocr_lang").alias("ocr_lang"))
S["job_lookup"] = f"SELECT job_id, status, total_pages, json_extract_string(tool_config, '$.ocr_lang') AS ocr_lang FROM {SQL_JOBS} WHERE job_id = '{_INTAKE}'"
Q["unique_uploads"] = lambda spark, d: J.accepted_uploads(read(spark, d, "jobs").select(F.col("job_id").alias("id"), F.regexp_extract("file_path", "([^/]*)$", 1).alias("name"), (F.col("total_pages") * 3_000_000).cast("bigint").alias("size"), F.col("created_at").alias("at")))
S["unique_uploads"] = "SELECT name, size, arg_min(id, (\"at\", id)) AS first_id, count(*) AS n FROM (SELECT job_id AS id, regexp_extract(file_path, '([^/]*)$', 1) AS name, total_pages::BIGINT * 3000000 AS size, created_at AS \"at\" FROM jobs) WHERE ends_with(lower(name), '.pdf') AND size <= 104857600 GROUP BY name, size"

_REPLY = "CASE region_id % 6 WHEN 0 THEN to_json(named_struct('lines', array(content, 'two'))) WHEN 1 THEN to_json(named_struct('text', content)) WHEN 2 THEN concat('raw ', content) WHEN 3 THEN to_json(named_struct('lines', array(named_struct('text', content), named_struct('text', 'x')))) WHEN 4 THEN concat('{', content) ELSE '' END"
Q["reply_parse"] = lambda spark, d: regions(spark, d, "region_type", "content").where("region_type = 'text' AND content IS NOT NULL").select("region_id", J.parsed_reply(F.expr(_REPLY)).alias("r")).select("region_id", "r.*")
_REPLY_SQL = "(CASE region_id % 6 WHEN 0 THEN to_json({'lines': [content, 'two']})::VARCHAR WHEN 1 THEN to_json({'text': content})::VARCHAR WHEN 2 THEN 'raw ' || content WHEN 3 THEN to_json({'lines': [{'text': content}, {'text': 'x'}]})::VARCHAR WHEN 4 THEN '{' || content ELSE '' END)"
S["reply_parse"] = f"""WITH r AS (SELECT region_id, {_REPLY_SQL} AS reply FROM {R} WHERE region_type = 'text' AND content IS NOT NULL), o AS (SELECT *, CASE WHEN json_valid(reply) THEN json_type(reply) = 'OBJECT' ELSE false END AS ok FROM r)
 SELECT region_id, CASE WHEN {STRIP('reply')} = '' THEN '[unreadable]' WHEN NOT ok THEN reply WHEN json_type(reply, '$.lines') = 'ARRAY' THEN array_to_string(list_transform(json_extract(reply, '$.lines[*]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.text') ELSE json_extract_string(x, '$') END), chr(10)) ELSE coalesce(json_extract_string(reply, '$.text'), '') END AS text, (CASE WHEN {STRIP('reply')} = '' THEN 0.0 WHEN NOT ok THEN 0.9 ELSE 1.0 END)::DOUBLE AS score FROM o"""

Q["config_faults"] = lambda spark, d: J.against_schema(jobs(spark, d).where("tool_config IS NOT NULL"), "job_id", "tool_config", {"ocr_lang": "string", "join_broken_pages": "boolean", "pages": "integer"}, ("ocr_lang", "join_broken_pages"))
S["config_faults"] = f"""WITH j AS (SELECT job_id, tool_config AS c FROM {SQL_JOBS} WHERE tool_config IS NOT NULL), f AS (SELECT job_id, field, json_type(c, '$.' || field) AS t, req, kinds FROM j, (VALUES ('ocr_lang', true, ['VARCHAR']), ('join_broken_pages', true, ['BOOLEAN']), ('pages', false, ['BIGINT', 'UBIGINT'])) AS s(field, req, kinds) WHERE json_valid(c)),
 g AS (SELECT job_id, field, CASE WHEN t IS NULL THEN CASE WHEN req THEN 'missing' END WHEN t = 'NULL' THEN CASE WHEN req THEN 'null' END WHEN NOT list_contains(kinds, t) THEN 'kind' END AS fault FROM f)
 SELECT job_id, field, fault FROM g WHERE fault IS NOT NULL UNION ALL SELECT job_id, field, 'unknown' FROM (SELECT job_id, unnest(json_keys(c)) AS field FROM j WHERE json_valid(c)) WHERE field NOT IN ('ocr_lang', 'join_broken_pages', 'pages') UNION ALL SELECT job_id, NULL, 'json' FROM j WHERE NOT json_valid(c)"""
Q["heading_prompts"] = lambda spark, d: J.heading_prompt(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content", "heading_level").where("region_type = 'title' AND content IS NOT NULL"))
S["heading_prompts"] = f"SELECT job_id, page_number, 'Give every heading its level from 1 to 6 as a JSON list of text and level.' || chr(10) || string_agg('- [' || coalesce(heading_level::VARCHAR, '?') || '] ' || content, chr(10) ORDER BY block_idx, region_id) AS prompt FROM {R} WHERE region_type = 'title' AND content IS NOT NULL GROUP BY ALL"


def _preview(spark, d):
    """Lines of a region beside those of its runs, by their place."""
    a = regions(spark, d, "content").where("content IS NOT NULL").select("region_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    b = _runs(spark, d).select("region_id", F.posexplode(F.split("text", "\n")).alias("i", "other"))
    j = a.join(b, ["region_id", "i"], "left")
    return j.groupBy("region_id").agg(F.count("*").alias("n"), F.count_if(F.col("other").isNull()).alias("n_without"), F.count_if(F.col("other") != F.col("line")).alias("n_changed"))


Q["preview_diff"] = _preview
S["preview_diff"] = f"""WITH a AS (SELECT region_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT region_id, string_split(content, chr(10)) AS p FROM {R} WHERE content IS NOT NULL)), b AS (SELECT region_id, unnest(range(len(p))) AS i, unnest(p) AS other FROM (SELECT region_id, string_split(text, chr(10)) AS p FROM {_RUNS}))
 SELECT region_id, count(*) AS n, count(*) FILTER (WHERE other IS NULL) AS n_without, count(*) FILTER (WHERE other <> line) AS n_changed FROM a LEFT JOIN b USING (region_id, i) GROUP BY region_id"""

_LANGS = ["hin_Deva", "tam_Taml"]
Q["translate_regions"] = lambda spark, d: X.translate_regions(regions(spark, d, "region_type", "content", "html"), _LANGS)
S["translate_regions"] = f"""SELECT region_id, tgt, CASE WHEN region_type IN ('text', 'title', 'list', 'caption') AND {STRIP("coalesce(content, '')")} <> '' THEN '[' || tgt || '] ' || content ELSE content END AS content, CASE WHEN region_type = 'table' THEN regexp_replace(html, '(<t[hd][^>]*>)\\s*([^<]*[^<\\s])\\s*(</t[hd]>)', '\\1[' || tgt || '] \\2\\3', 'g') ELSE html END AS html FROM {R}, (VALUES ('hin_Deva'), ('tam_Taml')) AS l(tgt)"""
# Blocks whose text is only in their spans are no texts to the translator: those of every fourth page.
Q["translate_documents"] = lambda spark, d: I.blocks_of_json(X.translate_json(_documents(spark, d).withColumn("tgt", F.lit("hin_Deva")), "key", "json", "tgt"), "key", "json")
S["translate_documents"] = f"SELECT job_id || '/' || page_number AS key, 0 AS page_idx, (row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx, region_id) - 1)::INT AS block_idx, region_type, CASE WHEN region_type IN ('text', 'title', 'list', 'caption') AND page_number % 4 <> 3 AND {STRIP('content')} <> '' THEN '[hin_Deva] ' || content ELSE content END AS text FROM {R} WHERE content IS NOT NULL AND content <> ''"
