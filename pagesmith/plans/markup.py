"""Queries over html, tables, runs, scripts and fonts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesmith.functions import scripts as C
from pagesmith.functions import text as T
from pagesmith.operators import markup as M
from pagesmith.operators.scan import SQL_REGIONS, read, regions
from pagesmith.plans.text import SQ, STRIP, TAGS, replace_sql

Q: dict = {}
S: dict[str, str] = {}
R = SQL_REGIONS


def _cells(spark, d):
    """Cells of tables; first cells of header rows span two columns in every third table."""
    html = F.when(F.col("region_id") % 3 == 0, F.regexp_replace("html", "<tr><th>", '<tr><th colspan="2" align="center">')).otherwise(F.col("html"))
    return M.table_cells(regions(spark, d, "html").withColumn("html", html).select("region_id", "html"))


_H = """(SELECT region_id, CASE WHEN region_id % 3 = 0 THEN replace(html, '<tr><th>', '<tr><th colspan="2" align="center">') ELSE html END AS html FROM """ + R + ")"
_C = f"""(SELECT region_id, row_idx, cell_idx, starts_with(lower(cell), '<th') AS is_header, greatest(1, coalesce(try_cast(nullif(regexp_extract(cell, '(?is)^<t[hd][^>]*colspan="?([0-9]+)', 1), '') AS INT), 1)) AS colspan, greatest(1, coalesce(try_cast(nullif(regexp_extract(cell, '(?is)^<t[hd][^>]*rowspan="?([0-9]+)', 1), '') AS INT), 1)) AS rowspan,
 nullif(lower(regexp_extract(cell, '(?i)^<t[hd][^>]*align="?(left|center|right)', 1)), '') AS align, {SQ(replace_sql(TAGS("regexp_extract(cell, '(?is)^<t[hd][^>]*>(.*)$', 1)"), T.ENTITIES))} AS text
 FROM (SELECT region_id, row_idx, (j - 1)::INT AS cell_idx, cells[j] AS cell FROM (SELECT region_id, row_idx, cells, unnest(generate_series(1, len(cells))) AS j FROM (SELECT region_id, (i - 1)::INT AS row_idx, regexp_extract_all(rows[i], '(?is)(<t[hd][^>]*>.*?)</t[hd]>', 1) AS cells FROM (SELECT region_id, rows, unnest(generate_series(1, len(rows))) AS i FROM (SELECT region_id, regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rows FROM {_H} WHERE html IS NOT NULL))))))"""

Q["table_cells"] = _cells
S["table_cells"] = f"SELECT * FROM {_C}"
Q["table_columns"] = lambda spark, d: M.max_columns(_cells(spark, d))
S["table_columns"] = f"SELECT region_id, greatest(1, max(n))::BIGINT AS n_cols FROM (SELECT region_id, row_idx, sum(colspan) AS n FROM {_C} GROUP BY ALL) GROUP BY region_id"
Q["column_widths"] = lambda spark, d: M.column_widths(_cells(spark, d)).select("region_id", "col", F.round("width_pct", 4).alias("width_pct"))
S["column_widths"] = f"""WITH f AS (SELECT *, sum(colspan) OVER (PARTITION BY region_id, row_idx ORDER BY cell_idx ROWS UNBOUNDED PRECEDING) - colspan AS first FROM {_C}), e AS (SELECT region_id, unnest(generate_series(first::BIGINT, (first + colspan - 1)::BIGINT)) AS col, length(text) / colspan AS n FROM f), l AS (SELECT region_id, col, max(n) AS n FROM e GROUP BY ALL)
 SELECT region_id, col, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w * 100 ELSE 100.0 / count(*) OVER w END, 4) AS width_pct FROM l WINDOW w AS (PARTITION BY region_id)"""
Q["table_fill"] = lambda spark, d: M.table_fill(_cells(spark, d)).withColumn("fill", F.round("fill", 6)).withColumn("largest_share", F.round("largest_share", 6))
S["table_fill"] = f"SELECT region_id, n_cells, round(fill, 6) AS fill, round(share, 6) AS largest_share, (n_cells > 4 AND fill < 0.3) OR share > 0.8 AS poor FROM (SELECT region_id, count(*) AS n_cells, avg((text <> '')::INT) AS fill, CASE WHEN sum(length(text)) > 0 THEN max(length(text)) / sum(length(text)) ELSE 0 END AS share FROM {_C} GROUP BY region_id)"
Q["gfm_tables"] = lambda spark, d: M.gfm(_cells(spark, d))
S["gfm_tables"] = f"""WITH r AS (SELECT region_id, row_idx, list(replace(text, '|', '\\|') ORDER BY cell_idx) AS c FROM {_C} GROUP BY ALL), n AS (SELECT *, max(len(c)) OVER (PARTITION BY region_id) AS n FROM r), l AS (SELECT region_id, row_idx, n, '| ' || array_to_string(list_concat(c, list_transform(range(n - len(c)), lambda x: '')), ' | ') || ' |' AS line FROM n)
 SELECT region_id, string_agg(CASE WHEN row_idx = 0 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda x: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY row_idx) AS markdown FROM l GROUP BY region_id"""

_DIRTY = lambda: F.concat(F.lit('<script>x()</script><div class="a" onclick="y()">'), F.replace("html", F.lit("<table>"), F.lit('<table id="t" style="width: 40px; color: red">')), F.lit('<style>b{}</style><a href="u" style="background: url(x)">z</a></div>'))
_DIRTY_SQL = """('<script>x()</script><div class="a" onclick="y()">' || replace(html, '<table>', '<table id="t" style="width: 40px; color: red">') || '<style>b{}</style><a href="u" style="background: url(x)">z</a></div>')"""


def sanitize_sql(x: str) -> str:
    """The allowed tags marked, all others taken out, the marks taken back."""
    for a, b in ((r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>", ""), (r"""(?i)\s(?:on[a-z]+|class|id)\s*=\s*(?:"[^"]*"|\x27[^\x27]*\x27|[^\s>]+)""", ""), (r'''(?i)\sstyle\s*=\s*"[^"]*(?:url\(|expression|!important)[^"]*"''', ""), (r'''(?i)(style="[^"]*?)\bwidth:\s*[0-9]+px;?\s*''', r"\1"), (rf"(?i)<(/?(?:{M.TABLE_TAGS})\b[^>]*)>", "\x01\\1\x02"), (r"(?i)</?[a-z][^>]*>", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"translate({x}, chr(1) || chr(2), '<>')"


Q["table_sanitize"] = lambda spark, d: regions(spark, d, "html").where("html IS NOT NULL").select("region_id", M.sanitize_table(_DIRTY()).alias("safe"))
S["table_sanitize"] = f"SELECT region_id, {sanitize_sql(_DIRTY_SQL)} AS safe FROM {R} WHERE html IS NOT NULL"
Q["plain_tables"] = lambda spark, d: regions(spark, d, "region_type", "content").where("region_type = 'list' AND content IS NOT NULL").select("region_id", M.plain_table(F.replace("content", F.lit(". "), F.lit(".  "))).alias("html"))
_PT = lambda x: replace_sql(STRIP(x), T.ESCAPES)
S["plain_tables"] = rf"""SELECT region_id, '<table>' || array_to_string(list_transform(list_filter(string_split(replace(content, '. ', '.  '), chr(10)), lambda r: {STRIP('r')} <> ''), lambda r: '<tr>' || array_to_string(list_transform(regexp_split_to_array({STRIP('r')}, '\t|\s{{2,}}'), lambda c: '<td>' || {_PT('c')} || '</td>'), '') || '</tr>'), '') || '</table>' AS html FROM {R} WHERE region_type = 'list' AND content IS NOT NULL"""

Q["styled_runs"] = lambda spark, d: M.styled_runs(regions(spark, d, "region_type", "content").where("region_type = 'text'").select("region_id", "content"))
S["styled_runs"] = f"""WITH p AS (SELECT region_id, i AS pos, parts[i] AS part FROM (SELECT region_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT region_id, regexp_extract_all(content, '(<[^>]*>|[^<]+|<)', 1) AS parts FROM {R} WHERE region_type = 'text' AND content IS NOT NULL))),
 s AS (SELECT *, sum(CASE WHEN regexp_matches(lower(part), '^<(?:b|strong)>$') THEN 1 WHEN regexp_matches(lower(part), '^</(?:b|strong)>$') THEN -1 ELSE 0 END) OVER w > 0 AS bold, sum(CASE WHEN regexp_matches(lower(part), '^<(?:i|em)>$') THEN 1 WHEN regexp_matches(lower(part), '^</(?:i|em)>$') THEN -1 ELSE 0 END) OVER w > 0 AS italic FROM p WINDOW w AS (PARTITION BY region_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
 SELECT region_id, (row_number() OVER (PARTITION BY region_id ORDER BY pos) - 1)::INT AS run_idx, {replace_sql('part', T.ENTITIES)} AS text, bold, italic FROM s WHERE NOT regexp_matches(part, '^<[^>]*>$')"""

Q["html_chapters"] = lambda spark, d: M.chapters(read(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^# ([^\r\n]*)", "<h1>$1</h1>").alias("html")), "doc_id", "html")
S["html_chapters"] = rf"""WITH h AS (SELECT doc_id, regexp_replace(text, '(?m)^# ([^\r\n]*)', '<h1>\1</h1>', 'g') AS html FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, regexp_matches(html, '(?i)<h1[^>]*>') AS has, list_filter(string_split(regexp_replace(html, '(?i)(<h1[^>]*>)', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIP('x')} <> '') AS parts FROM h), e AS (SELECT doc_id, has, i, parts[i] AS part FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p))
 SELECT doc_id, i::INT AS chapter, CASE WHEN NOT has THEN 'Document' WHEN regexp_matches(part, '(?is)<h1[^>]*>(.*?)</h1>') THEN {STRIP(TAGS("regexp_extract(part, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))} ELSE 'Chapter ' || i END AS title, length(part)::INT AS n_chars FROM e"""

Q["equation_slots"] = lambda spark, d: regions(spark, d, "content", "inline_latex").where("content LIKE '%{{EQ:%'").select("region_id", M.fill_equations(F.col("content"), F.col("inline_latex")).alias("filled"))
S["equation_slots"] = f"SELECT region_id, CASE WHEN coalesce(len(inline_latex), 0) > 0 THEN list_reduce(range(len(inline_latex)), lambda a, i: replace(a, '{{{{EQ:' || i || '}}}}', '$' || coalesce(inline_latex[i + 1], '') || '$'), content) ELSE content END AS filled FROM {R} WHERE content LIKE '%{{{{EQ:%'"

_SAFE = rf"regexp_replace({replace_sql("coalesce(content, '')", T.ESCAPES[:3])}, '&lt;(/?(?:{'|'.join(T.ALLOWED_TAGS)}))&gt;', '<\1>', 'g')"
_SAFE_X = rf"regexp_replace({replace_sql(STRIP('x'), T.ESCAPES[:3])}, '&lt;(/?(?:{'|'.join(T.ALLOWED_TAGS)}))&gt;', '<\1>', 'g')"
_LV = "CASE WHEN heading_level BETWEEN 1 AND 6 THEN heading_level ELSE 1 END"
_PLAIN_TABLE = rf"CASE WHEN {STRIP("coalesce(content, '')")} = '' THEN '' ELSE '<table>' || array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda r: {STRIP('r')} <> ''), lambda r: '<tr>' || array_to_string(list_transform(regexp_split_to_array({STRIP('r')}, '\t|\s{{2,}}'), lambda c: '<td>' || {_PT('c')} || '</td>'), '') || '</tr>'), '') || '</table>' END"
_OUT = f"""CASE region_type WHEN 'title' THEN '<h' || {_LV} || '>' || {_SAFE} || '</h' || {_LV} || '>' WHEN 'text' THEN '<p>' || {_SAFE} || '</p>' WHEN 'formula' THEN CASE WHEN coalesce(nullif(latex, ''), nullif(content, '')) IS NOT NULL THEN '<div class="math-block"><code>' || {replace_sql("coalesce(nullif(latex, ''), content)", T.ESCAPES)} || '</code></div>' ELSE '' END
 WHEN 'table' THEN coalesce({sanitize_sql("nullif(html, '')")}, {_PLAIN_TABLE}) WHEN 'caption' THEN '<figcaption>' || {_SAFE} || '</figcaption>' WHEN 'list' THEN '<div class="list-block">' || array_to_string(list_transform(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: {STRIP('x')} <> ''), lambda x: '<p>' || {_SAFE_X} || '</p>'), '') || '</div>' WHEN 'header' THEN '<div class="page-header">' || {_SAFE} || '</div>' WHEN 'footer' THEN '<div class="page-footer">' || {_SAFE} || '</div>'
 WHEN 'figure' THEN CASE WHEN coalesce(include_figures, true) AND coalesce(figure_display, 'image') = 'text' THEN '<p>' || CASE WHEN coalesce(content, '') <> '' THEN {_SAFE} ELSE '[Image]' END || '</p>' ELSE '' END ELSE '<p>' || {replace_sql("coalesce(content, '')", T.ESCAPES)} || '</p>' END"""
# The reader's way through a job, region by region: what stands open is what the last text of an earlier page left open, if nothing was shown since.
_RENDER = f"""WITH o AS (SELECT job_id, max(remove_headers_footers) AS remove_headers_footers, max(join_broken_pages) AS join_broken_pages, max(page_start) AS page_start, max(page_end) AS page_end, max(include_figures) AS include_figures, max(figure_display) AS figure_display FROM html_options WHERE job_id IS NOT NULL GROUP BY job_id),
 v AS (SELECT r.*, coalesce(join_broken_pages, false) AS joined, {_OUT} AS plain, {_SAFE} AS bare FROM {R} r LEFT JOIN o USING (job_id) WHERE page_number >= coalesce(page_start, page_number) AND page_number <= coalesce(page_end, page_number) AND NOT (coalesce(remove_headers_footers, false) AND region_type IN ('header', 'footer'))),
 e AS (SELECT *, plain <> '' AND NOT (region_type = 'text' AND bare = '') AS takes, row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx DESC, region_id DESC) = 1 AND joined AND region_type = 'text' AS speaks, row_number() OVER (PARTITION BY job_id ORDER BY page_number, block_idx, region_id) AS k FROM v),
 s AS (SELECT job_id, 2 * k AS pos, 'take' AS ev FROM e WHERE takes UNION ALL SELECT job_id, 2 * k + 1, CASE WHEN regexp_matches({STRIP("coalesce(content, '')")}, '[.!?:]$') THEN 'closed' ELSE 'open' END FROM e WHERE speaks),
 j AS (SELECT e.*, coalesce((SELECT arg_max(ev, pos) FROM s WHERE s.job_id = e.job_id AND s.pos < 2 * e.k) = 'open', false) AND region_type = 'text' AS joins FROM e)"""
Q["region_html"] = lambda spark, d: M.render(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content", "html", "latex", "heading_level"), read(spark, d, "html_options")).select("region_id", "joins", "out")
S["region_html"] = f"{_RENDER} SELECT region_id, joins, CASE WHEN joins THEN bare ELSE plain END AS out FROM j"
Q["page_joins"] = lambda spark, d: Q["region_html"](spark, d).where("joins").select("region_id")
S["page_joins"] = f"{_RENDER} SELECT region_id FROM j WHERE joins"

Q["markdown_pages"] = lambda spark, d: M.pages_of(M.region_markdown(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content", "html", "latex", "heading_level")), "\n\n")
_EM = "regexp_replace(regexp_replace(coalesce(content, ''), '</?(?:b|strong)>', '**', 'g'), '</?(?:i|em)>', '*', 'g')"
_GFM0 = S["gfm_tables"].replace(_H, f"(SELECT region_id, html FROM {R} WHERE region_type = 'table')")
S["markdown_pages"] = f"""WITH g AS ({_GFM0}), o AS (SELECT r.*, CASE region_type WHEN 'title' THEN repeat('#', {_LV}) || ' ' || {_EM} WHEN 'table' THEN coalesce(g.markdown, content, '') WHEN 'formula' THEN coalesce('$$' || latex || '$$', content, '') ELSE {_EM} END AS out FROM {R} r LEFT JOIN g USING (region_id) WHERE region_type NOT IN ('header', 'footer')) SELECT job_id, page_number, string_agg(out, chr(10) || chr(10) ORDER BY block_idx, region_id) AS body FROM o WHERE out <> '' GROUP BY job_id, page_number"""

Q["script_detect"] = lambda spark, d: read(spark, d, "documents").select("doc_id", C.text_script(F.col("text")).alias("script"))
_N = lambda x, r: f"coalesce(len(regexp_extract_all({x}, '[{r}]')), 0)"
S["script_detect"] = "SELECT doc_id, CASE WHEN b.n > 0 THEN b.name ELSE 'latin' END AS script FROM (SELECT doc_id, list_max([" + ", ".join(f"{{'n': {_N('text', r)}, 'o': {-i}, 'name': '{k}'}}" for i, (k, r) in enumerate(C.INDIC.items())) + "]) AS b FROM documents)"
Q["document_script"] = lambda spark, d: read(spark, d, "documents").select("doc_id", C.document_script(F.col("text")).alias("script"), C.default_family(C.document_script(F.col("text"))).alias("family"))
_DS = "(SELECT doc_id, CASE WHEN length(" + STRIP("text") + ") >= 20 AND b.n > 0 AND b.n / total > 0.1 THEN b.name ELSE 'en' END AS script FROM (SELECT doc_id, text, list_max([" + ", ".join(f"{{'n': {_N('text', r)}, 'o': {-i}, 'name': '{k}'}}" for i, (k, r) in enumerate((k, r) for k, r in C.DOCUMENT.items() if k != "latin")) + "]) AS b, " + " + ".join(_N("text", r) for r in C.DOCUMENT.values()) + " AS total FROM documents))"
S["document_script"] = "SELECT doc_id, script, CASE script " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DEFAULT_FAMILY.items()) + f" ELSE 'Inter' END AS family FROM {_DS}"

_NAME = "concat('ABCDEF+', element_at(array('Arial-BoldMT', 'TimesNewRomanPSMT', 'Lato-Light', 'Unknown Face', 'Helvetica', 'Roboto-Medium', 'CMR10'), cast(doc_id % 7 as int) + 1))"
Q["font_map"] = lambda spark, d: C.map_fonts(read(spark, d, "documents").select(F.expr(_NAME).alias("name")), C.fonts(spark))
_DIM = "(VALUES " + ", ".join(f"({o}, '{k}', '{f}', '{x}')" for o, k, f, x in C.font_rows()) + ") AS dim(ord, key, family, file)"
S["font_map"] = f"""WITH n AS (SELECT DISTINCT 'ABCDEF+' || ['Arial-BoldMT', 'TimesNewRomanPSMT', 'Lato-Light', 'Unknown Face', 'Helvetica', 'Roboto-Medium', 'CMR10'][(doc_id % 7)::INT + 1] AS name FROM documents), k AS (SELECT name, lower(trim(regexp_replace(trim(name), '^[A-Z]{{6}}\\+', ''))) AS k FROM n)
 SELECT name, family, file FROM k LEFT JOIN {_DIM} ON contains(k, key) QUALIFY row_number() OVER (PARTITION BY name ORDER BY k = key DESC, length(key) DESC, ord) = 1"""
Q["used_fonts"] = lambda spark, d: regions(spark, d, "job_id", "page_number", "block_idx", "font_family").where("font_family IS NOT NULL").groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("font_family")), ",").alias("fonts"), F.min_by("font_family", F.struct("page_number", "block_idx", "region_id")).alias("first_font"))
S["used_fonts"] = f"SELECT job_id, array_to_string(list_sort(list(DISTINCT font_family)), ',') AS fonts, arg_min(font_family, (page_number, block_idx, region_id)) AS first_font FROM {R} WHERE font_family IS NOT NULL GROUP BY job_id"
Q["font_stacks"] = lambda spark, d: regions(spark, d, "content", "font_family").select("region_id", C.font_stack(F.col("content"), F.col("font_family")).alias("stack"))
S["font_stacks"] = "SELECT region_id, concat_ws(', ', CASE WHEN font_family IS NOT NULL THEN '''' || font_family || '''' END, CASE WHEN b.n > 0 THEN '''Noto Sans ' || upper(b.name[1]) || b.name[2:] || '''' END, '''Noto Sans''', '''Inter''', 'sans-serif') AS stack FROM (SELECT region_id, font_family, list_max([" + ", ".join(f"{{'n': {_N('content', r)}, 'o': {-i}, 'name': '{k}'}}" for i, (k, r) in enumerate(C.INDIC.items())) + f"]) AS b FROM {R})"
Q["ocr_language"] = lambda spark, d: read(spark, d, "submit_options").select("job_id", C.recogniser_language(F.col("ocr_lang")).alias("lang")).distinct()
S["ocr_language"] = "SELECT DISTINCT job_id, coalesce(list_filter(l, lambda x: x <> 'en')[1], l[1], 'auto') AS lang FROM (SELECT job_id, list_filter(list_transform(string_split(ocr_lang, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS l FROM submit_options)"
