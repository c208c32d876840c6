"""Queries of selections and measures around recognition and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesmith.functions import geometry as G
from pagesmith.operators import markup as M
from pagesmith.operators import selection as P
from pagesmith.operators.flow import CHUNK
from pagesmith.operators.scan import SQL_JOBS, SQL_PAGES, SQL_REGIONS, first_pages, jobs, pages, read, regions
from pagesmith.plans.markup import _C

Q: dict = {}
S: dict[str, str] = {}
R = SQL_REGIONS



def _shown(spark, d):
    """Regions with the display of figures that their job asks for."""
    o = read(spark, d, "html_options").where("job_id IS NOT NULL").groupBy("job_id").agg(F.max("figure_display").alias("figure_display"))
    return regions(spark, d, "job_id", "region_type", "bbox").join(o, "job_id", "left")


Q["large_boxes"] = lambda spark, d: P.large_enough(regions(spark, d, "job_id", "page_number", "bbox").join(pages(spark, d), ["job_id", "page_number"])).select("region_id")
S["large_boxes"] = f"SELECT region_id FROM {R} JOIN {SQL_PAGES} USING (job_id, page_number) WHERE greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0) >= greatest(0.0005 * width * height, 20)"
Q["crop_gates"] = lambda spark, d: regions(spark, d, "bbox").where("bbox IS NOT NULL").select("region_id", P.crop_gate(G.width(F.col("bbox")), G.height(F.col("bbox"))).alias("gate"))
S["crop_gates"] = f"SELECT region_id, CASE WHEN least(bbox.x1 - bbox.x0, bbox.y1 - bbox.y0) < 10 THEN 'unreadable' WHEN least(bbox.x1 - bbox.x0, bbox.y1 - bbox.y0) < 32 THEN 'no class' ELSE 'ok' END AS gate FROM {R} WHERE bbox IS NOT NULL"
Q["crop_candidates"] = lambda spark, d: P.equation_crops(regions(spark, d, "region_type", "bbox", "latex")).select("region_id", F.lit("equation").alias("kind")).unionByName(P.figure_crops(_shown(spark, d), F.coalesce("figure_display", F.lit("image"))).select("region_id", F.lit("figure").alias("kind")))
S["crop_candidates"] = f"SELECT region_id, CASE region_type WHEN 'formula' THEN 'equation' ELSE 'figure' END AS kind FROM {R} r LEFT JOIN (SELECT job_id, max(figure_display) AS fd FROM html_options GROUP BY job_id) o USING (job_id) WHERE greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0) > 0 AND ((region_type = 'formula' AND latex IS NULL) OR (region_type = 'figure' AND coalesce(fd, 'image') = 'image'))"
Q["request_options"] = lambda spark, d: read(spark, d, "submit_options").select("job_id", P.checked_option("formula_display", F.col("formula_display")).alias("formula_display"), P.checked_option("figure_display", F.col("figure_display")).alias("figure_display"), P.as_flag(F.col("formula_enable").cast("string"), True).alias("formulas")).distinct()
_OPT = lambda n: f"CASE WHEN lower(trim(coalesce({n}, ''))) = '' THEN '{P.OPTIONS[n][0]}' WHEN lower(trim({n})) IN ({', '.join(repr(x) for x in P.OPTIONS[n])}) THEN lower(trim({n})) END"
S["request_options"] = f"SELECT DISTINCT job_id, {_OPT('formula_display')} AS formula_display, {_OPT('figure_display')} AS figure_display, coalesce(formula_enable, true) AS formulas FROM submit_options"
Q["public_keys"] = lambda spark, d: jobs(spark, d).select("job_id", F.array_join(F.sort_array(F.map_keys(P.public_keys(F.create_map(F.lit("_tmp"), "status", F.lit("status"), "status", F.lit("type"), "job_type")))), ",").alias("ks"))
S["public_keys"] = f"SELECT job_id, 'status,type' AS ks FROM {SQL_JOBS}"
Q["sparse_text"] = lambda spark, d: regions(spark, d, "content").where("content IS NOT NULL").select("region_id", P.sparse(F.trim("content"), F.col("content")).alias("changed"))
S["sparse_text"] = f"SELECT region_id, nullif(trim(content, ' '), content) AS changed FROM {R} WHERE content IS NOT NULL"
# Pages without a title: what is required and not there.
Q["missing_pages"] = lambda spark, d: P.missing(pages(spark, d).select("job_id", "page_number"), regions(spark, d, "job_id", "page_number", "region_type").where("region_type = 'title'").select("job_id", "page_number").distinct(), ["job_id", "page_number"])
S["missing_pages"] = f"SELECT job_id, page_number FROM {SQL_PAGES} p WHERE NOT EXISTS (SELECT 1 FROM {R} r WHERE r.job_id = p.job_id AND r.page_number = p.page_number AND r.region_type = 'title')"
Q["whole_tables"] = lambda spark, d: regions(spark, d, "html").where("html IS NOT NULL").select("region_id", P.is_table_html(F.col("html")).alias("whole"))
S["whole_tables"] = rf"SELECT region_id, regexp_matches(regexp_replace(html, '^\s+|\s+$', '', 'g'), '(?i)</(?:html|table)>$') AS whole FROM {R} WHERE html IS NOT NULL"


def _offsets(spark, d):
    c = M.table_cells(regions(spark, d, "html"))
    return P.cell_offsets(c, M.column_widths(c)).withColumn("x_pct", F.round("x_pct", 4))


Q["cell_offsets"] = _offsets
_C0 = _C.replace("""replace(html, '<tr><th>', '<tr><th colspan="2" align="center">')""", "html")
S["cell_offsets"] = f"""WITH f AS (SELECT *, sum(colspan) OVER (PARTITION BY region_id, row_idx ORDER BY cell_idx ROWS UNBOUNDED PRECEDING) - colspan AS first FROM {_C0}), e AS (SELECT region_id, unnest(generate_series(first::BIGINT, (first + colspan - 1)::BIGINT)) AS col, length(text) / colspan AS n FROM f), l AS (SELECT region_id, col, max(n) AS n FROM e GROUP BY ALL),
 w AS (SELECT region_id, col, CASE WHEN sum(n) OVER q > 0 THEN n / sum(n) OVER q * 100 ELSE 100.0 / count(*) OVER q END AS width_pct FROM l WINDOW q AS (PARTITION BY region_id)), x AS (SELECT region_id, col, coalesce(sum(width_pct) OVER (PARTITION BY region_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x_pct FROM w)
 SELECT f.region_id, f.row_idx, f.cell_idx, round(x.x_pct, 4) AS x_pct FROM f JOIN x ON f.region_id = x.region_id AND f.first = x.col"""
Q["layer_sizes"] = lambda spark, d: regions(spark, d, "bbox", "content").where("content IS NOT NULL AND bbox IS NOT NULL").select("region_id", P.layer_size(F.size(F.split("content", "\n")), G.height(F.col("bbox"))).alias("size"), F.round(P.line_scale(F.length("content") * 5.0, G.width(F.col("bbox")), F.lit(True)), 3).alias("scale"), F.round(P.table_font(G.height(F.col("bbox")) / 4), 3).alias("font"))
S["layer_sizes"] = f"""SELECT region_id, list_reduce(range(16), lambda s, i: CASE WHEN s > 3 AND s * 1.2 * n > h THEN s - 0.5 ELSE s END, 11.0::DOUBLE) AS size, round(least(CASE WHEN len > 0 THEN w / (len * 5.0) * 100 ELSE 100.0 END, 150.0), 3) AS scale, round(least(12.0, greatest(6.0, h / 4 * 0.6)), 3) AS font FROM (SELECT region_id, len(string_split(content, chr(10))) AS n, bbox.y1 - bbox.y0 AS h, bbox.x1 - bbox.x0 AS w, length(content) AS len FROM {R} WHERE content IS NOT NULL AND bbox IS NOT NULL)"""
# Regions without a page or block number come last, as in SQL.
_AT = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(2**63 - 1)).alias(c)
Q["page_breaks"] = lambda spark, d: P.page_breaks(regions(spark, d, "job_id", "page_number", "block_idx", "bbox").where("bbox IS NOT NULL").select(F.col("job_id").alias("doc"), F.struct(_AT("page_number"), _AT("block_idx"), "region_id").alias("ord"), F.col("region_id").alias("id"), F.greatest(F.lit(0.0), G.height(F.col("bbox"))).alias("h")), 700.0, part=F.greatest(F.lit(0), F.floor(F.col("ord.page_number") / CHUNK))).withColumn("y", F.round("y", 4))
S["page_breaks"] = f"""WITH b AS (SELECT job_id, list({{'id': region_id, 'h': greatest(0, bbox.y1 - bbox.y0)::DOUBLE, 'p': 0, 'y': 0.0::DOUBLE, 'z': 0.0::DOUBLE}} ORDER BY page_number, block_idx, region_id) AS b FROM {R} WHERE bbox IS NOT NULL GROUP BY job_id),
 o AS (SELECT list_reduce(list_transform(b, lambda x: [x]), lambda s, x: s || [CASE WHEN s[len(s)].z > 0 AND s[len(s)].z + x[1].h > 700.0 THEN struct_update(x[1], p := s[len(s)].p + 1, y := 0.0::DOUBLE, z := x[1].h + 8.0) ELSE struct_update(x[1], p := s[len(s)].p, y := s[len(s)].z, z := s[len(s)].z + x[1].h + 8.0) END], [{{'id': 0::BIGINT, 'h': 0.0::DOUBLE, 'p': 1, 'y': 0.0::DOUBLE, 'z': 0.0::DOUBLE}}]) AS s FROM b)
 SELECT x.id AS id, x.p AS out_page, round(x.y, 4) AS y FROM (SELECT unnest(s[2:]) AS x FROM o)"""
Q["json_harvest"] = lambda spark, d: P.harvest(jobs(spark, d).where("tool_config IS NOT NULL"), "job_id", "tool_config", ["ocr_lang"])
S["json_harvest"] = f"SELECT job_id, 'ocr_lang' AS name, json_extract_string(tool_config, '$.ocr_lang') AS text FROM {SQL_JOBS} WHERE json_type(tool_config, '$.ocr_lang') = 'VARCHAR'"
Q["first_pages"] = lambda spark, d: first_pages(regions(spark, d, "job_id", "page_number"), 10).groupBy("job_id").agg(F.count("*").alias("n"))
S["first_pages"] = f"SELECT job_id, count(*) AS n FROM (SELECT job_id, dense_rank() OVER (PARTITION BY job_id ORDER BY page_number) AS k FROM {R}) WHERE k <= 10 GROUP BY job_id"
Q["run_compare"] = lambda spark, d: regions(spark, d, "job_id", "page_number", "region_type", "content").join(pages(spark, d), ["job_id", "page_number"]).groupBy("region_type").agg(F.count_if("scanned").alias("n_scanned"), F.count_if(~F.col("scanned")).alias("n_digital"), F.sum(F.when(F.col("scanned"), F.regexp_count("content", F.lit("<[bi]>")))).alias("emphasis_scanned"), F.sum(F.when(~F.col("scanned"), F.regexp_count("content", F.lit("<[bi]>")))).alias("emphasis_digital"))
S["run_compare"] = f"SELECT region_type, count(*) FILTER (WHERE scanned) AS n_scanned, count(*) FILTER (WHERE NOT scanned) AS n_digital, sum(len(regexp_extract_all(content, '<[bi]>'))) FILTER (WHERE scanned AND content IS NOT NULL)::BIGINT AS emphasis_scanned, sum(len(regexp_extract_all(content, '<[bi]>'))) FILTER (WHERE NOT scanned AND content IS NOT NULL)::BIGINT AS emphasis_digital FROM {R} JOIN {SQL_PAGES} USING (job_id, page_number) GROUP BY ALL"
