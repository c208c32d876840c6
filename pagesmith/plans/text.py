"""Queries over text: repetition of lines, joining, lists, numbers at margins, names, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.functions import text as T
from pagesmith.operators import flow as U
from pagesmith.operators import repetition as R
from pagesmith.operators.scan import SQL_LINES, SQL_REGIONS, lines, read, regions

Q: dict = {}
S: dict[str, str] = {}

# Pieces of SQL that the statements below share.
SQ = lambda x: rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
TAGS = lambda x: f"regexp_replace({x}, '<[^>]*>', '', 'g')"
KEY = lambda x: f"lower({SQ(TAGS(x))})"
ROMAN = lambda x: f"(length({x}) > 0 AND regexp_matches(lower({x}), '^{T.ROMAN}$'))"
CAP = lambda x, p: f"coalesce({ROMAN(f"regexp_extract({x}, '{p}', 1)")}, false)"


def item_sql(x: str) -> str:
    return f"""(regexp_matches({x}, '^[{T.BULLETS}]\\s') OR regexp_matches({x}, '^([0-9०-९]+\\.)+\\s|^[0-9०-९]+\\)\\s|^\\([0-9०-९]+\\)\\s|^\\[[0-9०-९]+\\]\\s')
 OR regexp_matches({x}, '^\\([a-zA-Zअ-ह]\\)\\s|^\\[[a-zA-Zअ-ह]\\]\\s|^[a-zA-Zअ-ह][.)]\\s') OR regexp_matches({x}, '^\\((?:{T.LETTER_NAMES})\\)\\s|^(?:{T.LETTER_NAMES})[.)]\\s')
 OR regexp_matches({x}, '(?i)^(?:{T.SECTION_WORDS})\\b') OR regexp_matches({x}, '^(?:{T.SECTION_WORDS_HI})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')
 OR {CAP(x, '(?i)^[(]([ivxlcdm]+)[)]\\s')} OR {CAP(x, '(?i)^([ivxlcdm]{2,})[.)]\\s')})"""


def level_sql(x: str) -> str:
    t = STRIP(x)
    return f"""CASE WHEN regexp_matches({t}, '^(\\d+\\.)+\\s|^\\d+\\)\\s|^\\(\\d+\\)\\s|^\\[\\d+\\]\\s') THEN 0
 WHEN {CAP(t, '(?i)^[(]([ivxlcdm]+)[)]\\s')} OR {CAP(t, '(?i)^([ivxlcdm]{2,})[.)]\\s')} THEN 1
 WHEN regexp_matches({t}, '^\\([a-zA-Z]\\)\\s|^[a-zA-Z][.)]\\s|^\\[[a-zA-Z]\\]\\s') THEN 2 WHEN regexp_matches({t}, '^[{T.BULLETS}]\\s') THEN 0
 WHEN regexp_matches({t}, '(?i)^(?:{T.SECTION_WORDS})\\b') THEN 0 WHEN {x} IS NOT NULL THEN -1 END"""


def replace_sql(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        x = f"replace({x}, '{a}', '{b}')"
    return x


def recurring_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur on three or more pages of a job."""
    return R.pages_of_lines(lines(spark, d, "job_id", "page_number")).where("n_pages >= 3")


Q["recurring_lines"] = recurring_lines
S["recurring_lines"] = f"SELECT job_id, {KEY('line')} AS line_key, count(DISTINCT page_number) AS n_pages FROM {SQL_LINES} GROUP BY ALL HAVING line_key <> '' AND n_pages >= 3"

Q["line_join"] = lambda spark, d: regions(spark, d, "region_type", "content").where("region_type IN ('text', 'title', 'list') AND content IS NOT NULL").select("region_id", T.join_lines(F.split("content", "\n")).alias("joined"))
S["line_join"] = f"""SELECT region_id, CASE WHEN len(kept) = 0 THEN '' ELSE list_reduce(kept, lambda acc, x: CASE WHEN {item_sql(STRIP('x'))} THEN acc || chr(10) || {STRIP('x')}
 WHEN ends_with(acc, '-') AND lower(substring({STRIP('x')}, 1, 1)) = substring({STRIP('x')}, 1, 1) AND upper(substring({STRIP('x')}, 1, 1)) <> substring({STRIP('x')}, 1, 1) THEN regexp_replace(acc, '-$', '') || {STRIP('x')} ELSE acc || ' ' || {STRIP('x')} END) END AS joined
 FROM (SELECT region_id, list_filter(string_split(content, chr(10)), lambda x: {STRIP('x')} <> '') AS kept FROM {SQL_REGIONS} WHERE region_type IN ('text', 'title', 'list') AND content IS NOT NULL)"""

Q["dehyphenate"] = lambda spark, d: regions(spark, d, "content").where("content IS NOT NULL").select("region_id", F.regexp_count("content", F.lit(r"\p{L}-\n\p{Ll}")).cast("bigint").alias("n_broken"))
S["dehyphenate"] = rf"SELECT region_id, len(regexp_extract_all(content, '\p{{L}}-\n\p{{Ll}}'))::BIGINT AS n_broken FROM {SQL_REGIONS} WHERE content IS NOT NULL"

Q["list_items"] = lambda spark, d: lines(spark, d).select("region_id", "line_no", T.is_list_item(F.col("line")).alias("is_item"), T.list_level(F.col("line")).alias("level"), T.list_prefix_strip(F.col("line")).alias("rest"))
S["list_items"] = f"""SELECT region_id, line_no::INTEGER AS line_no, {item_sql('line')} AS is_item, {level_sql('line')} AS level, regexp_replace({STRIP('line')}, '^([{T.BULLETS}]|\\(?[0-9०-९]+[.)]|\\(?[a-zA-Z][.)])\\s+', '') AS rest FROM {SQL_LINES}"""

Q["list_blocks"] = lambda spark, d: R.list_blocks(lines(spark, d, "region_type"))
S["list_blocks"] = f"SELECT region_id, CASE WHEN region_type IN ('text', 'list') AND count(*) FILTER (WHERE {STRIP('line')} <> '') >= 2 AND avg(({item_sql('line')})::INT) FILTER (WHERE {STRIP('line')} <> '') >= 0.6 THEN 'list' ELSE region_type END AS block_type FROM {SQL_LINES} GROUP BY region_id, region_type"

Q["list_indent"] = lambda spark, d: R.list_indents(lines(spark, d, "region_type").where("region_type = 'list'"))
S["list_indent"] = f"""WITH l AS (SELECT region_id, line_no, {level_sql('line')} AS lv FROM {SQL_LINES} WHERE region_type = 'list' AND {STRIP('line')} <> ''), m AS (SELECT *, coalesce(min(lv) FILTER (WHERE lv >= 0) OVER (PARTITION BY region_id), 0) AS least_lv FROM l)
 SELECT region_id, line_no::INTEGER AS line_no, greatest(0, coalesce(last_value(CASE WHEN lv >= 0 THEN lv END IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), least_lv) - least_lv) * 1.5::DOUBLE AS indent_em FROM m"""

Q["margin_numbers_block"] = lambda spark, d: R.margin_numbers_block(lines(spark, d).withColumn("line", F.concat(F.col("line_no") * 5 + 5, F.lit(" "), "line")))
_M = lambda x: rf"CASE WHEN regexp_extract({x}, '^\s*(\d{{1,4}})\s+([A-Za-z(].*)$', 1) <> '' AND length(regexp_extract({x}, '^\s*(\d{{1,4}})\s+([A-Za-z(].*)$', 2)) >= 10 AND NOT {item_sql(rf"regexp_extract({x}, '^\s*(\d{{1,4}})\s+([A-Za-z(].*)$', 2)")} THEN regexp_extract({x}, '^\s*(\d{{1,4}})\s+([A-Za-z(].*)$', 1)::INT END"
_NUMBERED = f"(SELECT region_id, job_id, page_number, block_idx, line_no, (line_no * 5 + 5) || ' ' || line AS line FROM {SQL_LINES})"
S["margin_numbers_block"] = f"""WITH c AS (SELECT region_id, line_no, line, {_M('line')} AS n FROM {_NUMBERED}), s AS (SELECT region_id, n, n - lag(n) OVER (PARTITION BY region_id ORDER BY line_no) AS step FROM c WHERE n IS NOT NULL),
 f AS (SELECT region_id, count(*) >= 3 AND count(*) FILTER (WHERE step BETWEEN 1 AND 10) >= greatest(2, 0.4 * count(*)) AS numbered FROM s GROUP BY region_id)
 SELECT c.region_id, c.line_no::INTEGER AS line_no, CASE WHEN coalesce(f.numbered, false) AND c.n IS NOT NULL THEN regexp_replace(c.line, '^\\s*\\d{{1,4}}\\s+', '') ELSE c.line END AS line FROM c LEFT JOIN f USING (region_id)"""

Q["margin_numbers_doc"] = lambda spark, d: R.margin_numbers_doc(lines(spark, d, "job_id", "page_number", "block_idx").withColumn("line", F.when(F.col("line_no") == 0, F.concat(F.col("page_number") * 20 + F.col("block_idx") + 1, F.lit(" "), "line")).otherwise(F.col("line"))))
S["margin_numbers_doc"] = f"""WITH l AS (SELECT region_id, job_id, page_number, block_idx, line_no, CASE WHEN line_no = 0 THEN (page_number * 20 + block_idx + 1) || ' ' || line ELSE line END AS line FROM {SQL_LINES}), c AS (SELECT job_id, region_id, page_number, block_idx, {_M('line')} AS n FROM l WHERE line_no = 0),
 s AS (SELECT job_id, n, lag(n) OVER (PARTITION BY job_id ORDER BY page_number, block_idx, region_id) AS before FROM c WHERE n IS NOT NULL)
 SELECT job_id, count(*) >= 5 AND count(*) FILTER (WHERE n > before) >= 0.6 * (count(*) - 1) AS numbered, count(*) AS n_candidates FROM s GROUP BY job_id"""

Q["numbering_depth"] = lambda spark, d: regions(spark, d, "content").where("content IS NOT NULL").select("region_id", T.numbering_depth(F.col("content")).cast("int").alias("depth"))
S["numbering_depth"] = rf"""SELECT region_id, (CASE WHEN regexp_extract({STRIP('content')}, '^(\d+(?:\.\d+)*)\.?\s', 1) <> '' THEN length(regexp_extract({STRIP('content')}, '^(\d+(?:\.\d+)*)\.?\s', 1)) - length(replace(regexp_extract({STRIP('content')}, '^(\d+(?:\.\d+)*)\.?\s', 1), '.', '')) + 1
 WHEN regexp_matches({STRIP('content')}, '(?i)^(chapter|part)\b') THEN 1 WHEN regexp_matches({STRIP('content')}, '(?i)^(section|article)\b') THEN 2 END)::INT AS depth FROM {SQL_REGIONS} WHERE content IS NOT NULL"""

Q["sanitize_text"] = lambda spark, d: regions(spark, d, "content").where("content IS NOT NULL").select("region_id", T.sanitize(F.col("content")).alias("safe"), T.escape_html(F.col("content")).alias("escaped"), T.decode_entities(T.escape_html(F.col("content"))).alias("decoded"), T.plain_text(F.col("content")).alias("plain"))
S["sanitize_text"] = rf"""SELECT region_id, regexp_replace({replace_sql('content', T.ESCAPES[:3])}, '&lt;(/?(?:{'|'.join(T.ALLOWED_TAGS)}))&gt;', '<\1>', 'g') AS safe, {replace_sql('content', T.ESCAPES)} AS escaped, {replace_sql(replace_sql('content', T.ESCAPES), T.ENTITIES)} AS decoded,
 {SQ(rf"regexp_replace({TAGS('content')}, '\{{\{{EQ:\d+\}}\}}', '', 'g')")} AS plain FROM {SQL_REGIONS} WHERE content IS NOT NULL"""

Q["emphasis_counts"] = lambda spark, d: regions(spark, d, "job_id", "content").groupBy("job_id").agg(F.sum(F.coalesce(F.regexp_count("content", F.lit("<b>")), F.lit(0))).alias("n_bold"), F.sum(F.coalesce(F.regexp_count("content", F.lit("<i>")), F.lit(0))).alias("n_italic"), F.count("*").alias("n_blocks"))
S["emphasis_counts"] = f"SELECT job_id, sum(coalesce(len(regexp_extract_all(content, '<b>')), 0))::BIGINT AS n_bold, sum(coalesce(len(regexp_extract_all(content, '<i>')), 0))::BIGINT AS n_italic, count(*) AS n_blocks FROM {SQL_REGIONS} GROUP BY ALL"

Q["markdown_unescape"] = lambda spark, d: read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length(T.unescape_markdown(F.concat(F.lit("\\*"), F.col("text"), F.lit("\\$\\~")))).alias("n"))
S["markdown_unescape"] = r"SELECT doc_id, length(replace(replace(replace('\*' || text || '\$\~', '\*', '*'), '\`', '`'), '\~', '~'))::INT AS n FROM documents WHERE text IS NOT NULL"

Q["reference_split"] = lambda spark, d: regions(spark, d, "content").where("content IS NOT NULL").select("region_id", T.split_references(F.concat(F.lit("[1] a [2] b (3) c "), F.col("content"))).alias("out"))
S["reference_split"] = rf"SELECT region_id, CASE WHEN len(regexp_extract_all(x, '\[\d+\]|\(\d+\)')) >= 3 AND NOT contains(x, chr(10)) THEN regexp_replace(x, ' +(\[\d+\] |\(\d+\) )', chr(10) || '\1', 'g') ELSE x END AS out FROM (SELECT region_id, '[1] a [2] b (3) c ' || content AS x FROM {SQL_REGIONS} WHERE content IS NOT NULL)"

Q["file_names"] = lambda spark, d: read(spark, d, "jobs").select("job_id", "file_path").distinct().select("job_id", T.base_name(F.col("file_path")).alias("base"), T.mime_type(F.col("file_path")).alias("mime"), F.concat_ws("_", T.base_name(F.col("file_path")), F.substring("job_id", 1, 8)).alias("out_name"), T.csv_field(F.col("file_path")).alias("csv"), T.mask_secret(F.concat(F.lit("sk-or-"), F.col("job_id"))).alias("masked"))
_BASE = r"regexp_replace(regexp_replace(regexp_replace(file_path, '^.*[/\\]', ''), '\.[A-Za-z0-9]+$', ''), '_ocr_data$', '')"
S["file_names"] = rf"""SELECT DISTINCT job_id, {_BASE} AS base, CASE lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'pdf' THEN 'application/pdf' WHEN 'json' THEN 'application/json' ELSE CASE WHEN file_path IS NOT NULL THEN 'application/octet-stream' END END AS mime,
 concat_ws('_', {_BASE}, substring(job_id, 1, 8)) AS out_name, CASE WHEN file_path IS NULL THEN '' ELSE '"' || replace(file_path, '"', '""') || '"' END AS csv, regexp_extract('sk-or-' || job_id, '^(sk-[a-z]*-?|[A-Za-z]{{2,4}}-)', 1) || repeat('•', 12) || right(job_id, 4) AS masked FROM jobs"""

Q["hex_colours"] = lambda spark, d: read(spark, d, "documents").select("doc_id", T.hex_colour(F.expr("concat('#', substring(md5(cast(doc_id as string)), 1, CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 1 THEN 6 ELSE 4 END))")).alias("colour"))
_HEX = "upper(substring(md5(doc_id::VARCHAR), 1, CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 3 = 1 THEN 6 ELSE 4 END))"
S["hex_colours"] = f"SELECT doc_id, CASE WHEN length(h) = 6 THEN h WHEN length(h) = 3 THEN repeat(h[1], 2) || repeat(h[2], 2) || repeat(h[3], 2) ELSE '999999' END AS colour FROM (SELECT doc_id, {_HEX} AS h FROM documents)"

Q["reply_clean"] = lambda spark, d: regions(spark, d, "html").where("html IS NOT NULL").select("region_id", T.clean_reply(F.concat(F.lit("```html\n<html><body>Here: "), F.regexp_replace("html", "</table>.*$", ""), F.lit("\n```"))).alias("table"))
_RC = r"'```html' || chr(10) || '<html><body>Here: ' || regexp_replace(html, '</table>.*$', '') || chr(10) || '```'"
_RC1 = STRIP(rf"regexp_replace({STRIP(rf"regexp_replace({_RC}, '^\s*```[a-zA-Z]*\s*|\s*```\s*$', '', 'g')")}, '(?i)</?(?:html|body)[^>]*>', '', 'g')")
S["reply_clean"] = f"SELECT region_id, CASE WHEN instr(t, '<table') > 0 THEN substring(t, instr(t, '<table')) || '</table>' ELSE t END AS \"table\" FROM (SELECT region_id, {_RC1} AS t FROM {SQL_REGIONS} WHERE html IS NOT NULL)"

Q["pangram_report"] = lambda spark, d: R.pangram_report(regions(spark, d, "job_id", "content").where("content IS NOT NULL").withColumn("content", F.when(F.col("region_id") % 7 == 0, F.concat(F.col("content"), F.lit(" <b>The quick</b> brown fox jumps over the lazy dog."))).otherwise(F.col("content"))))
S["pangram_report"] = f"SELECT job_id, count(*) AS n_components, count(*) FILTER (WHERE region_id % 7 = 0) AS n_flagged, count(*) FILTER (WHERE region_id % 7 = 0 AND {STRIP('content')} = '') AS n_dropped FROM {SQL_REGIONS} WHERE content IS NOT NULL GROUP BY ALL"

Q["text_sample"] = lambda spark, d: R.text_sample(regions(spark, d, "job_id", "page_number", "block_idx", "content").where("content IS NOT NULL AND content <> ''"), 3)
S["text_sample"] = f"WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY job_id ORDER BY page_number) AS k FROM {SQL_REGIONS} WHERE content IS NOT NULL AND content <> '') SELECT job_id, string_agg(content, chr(10) ORDER BY page_number, block_idx, region_id) AS sample FROM r WHERE k <= 3 GROUP BY job_id"

Q["first_words"] = lambda spark, d: U.first_words(regions(spark, d, "job_id", "page_number", "block_idx", "content").where("content IS NOT NULL"), 6000)
S["first_words"] = rf"""WITH r AS (SELECT job_id, region_id, page_number, block_idx, content, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n FROM {SQL_REGIONS} WHERE content IS NOT NULL), c AS (SELECT *, sum(n) OVER (PARTITION BY job_id ORDER BY page_number, block_idx, region_id ROWS UNBOUNDED PRECEDING) - n AS before FROM r)
 SELECT region_id, CASE WHEN before + n <= 6000 THEN content ELSE array_to_string(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')[1:(6000 - before)::INT], ' ') END AS taken FROM c WHERE before < 6000 AND n > 0"""
