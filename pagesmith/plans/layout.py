"""Queries over the layout of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesmith.functions import geometry as G
from pagesmith.functions import text as T
from pagesmith.operators import flow as U
from pagesmith.operators import layout as L
from pagesmith.operators import repetition as R_
from pagesmith.operators.scan import SQL_PAGES, SQL_REGIONS, pages, read, regions
from pagesmith.plans.text import KEY, STRIP

Q: dict = {}
S: dict[str, str] = {}
R = SQL_REGIONS

Q["bbox_normalise"] = lambda spark, d: regions(spark, d, "bbox").select("region_id", G.box_of_array(F.slice(F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"), F.lit(1), (F.col("region_id") % 6).cast("int"))).alias("b")).select("region_id", "b.*")
S["bbox_normalise"] = f"SELECT region_id, CASE WHEN region_id % 6 >= 4 THEN bbox.x0 ELSE 0 END AS x0, CASE WHEN region_id % 6 >= 4 THEN bbox.y0 ELSE 0 END AS y0, CASE WHEN region_id % 6 >= 4 THEN bbox.x1 ELSE 0 END AS x1, CASE WHEN region_id % 6 >= 4 THEN bbox.y1 ELSE 0 END AS y1 FROM {R}"

Q["page_sizes"] = lambda spark, d: pages(spark, d).select("job_id", "page_number", "width", "height", G.orientation(F.col("width"), F.col("height")).alias("orientation"), G.to_twips(F.col("width")).alias("twips_w"), F.round(G.to_inches(F.col("height")), 4).alias("inches_h"), G.reading_size(F.col("width"), F.col("height"), 512)["h"].alias("px_h"))
S["page_sizes"] = f"SELECT job_id, page_number, width, height, CASE WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, floor(width * 20 + 0.5)::BIGINT AS twips_w, round(height / 72.0, 4) AS inches_h, floor(height * least(1.0, 512.0 / greatest(width, height)))::INT AS px_h FROM {SQL_PAGES}"

Q["page_range"] = lambda spark, d: regions(spark, d, "job_id", "page_number", "region_type").where(F.col("page_number").between(2, 4) & ~F.col("region_type").isin("header", "footer")).groupBy("job_id").agg(F.count("*").alias("n_regions"), F.countDistinct("page_number").alias("n_pages"))
S["page_range"] = f"SELECT job_id, count(*) AS n_regions, count(DISTINCT page_number) AS n_pages FROM {R} WHERE page_number BETWEEN 2 AND 4 AND region_type NOT IN ('header', 'footer') GROUP BY ALL"

Q["unit_transform"] = lambda spark, d: regions(spark, d, "bbox").where("bbox IS NOT NULL").select("region_id", G.to_twips(F.col("bbox.x0")).alias("x_twips"), G.to_twips(G.width(F.col("bbox"))).alias("w_twips"), F.round(G.to_inches(F.col("bbox.y0")), 4).alias("y_in"), F.round(G.area(F.col("bbox")), 3).alias("area"), F.size(G.polygon(F.col("bbox"))).alias("corners"), G.is_rotated(G.polygon(F.col("bbox"))).alias("rotated"), F.round(G.y_centre(G.polygon(F.col("bbox"))), 4).alias("y_mid"), (G.box_of_polygon(G.polygon(F.col("bbox")))["x1"] == F.col("bbox.x1")).alias("round_trip"))
S["unit_transform"] = f"SELECT region_id, floor(bbox.x0 * 20 + 0.5)::BIGINT AS x_twips, floor((bbox.x1 - bbox.x0) * 20 + 0.5)::BIGINT AS w_twips, round(bbox.y0 / 72.0, 4) AS y_in, round(greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0), 3) AS area, 4 AS corners, false AS rotated, round((bbox.y0 + bbox.y1) / 2, 4) AS y_mid, true AS round_trip FROM {R} WHERE bbox IS NOT NULL"

_TYPES = "('text', 'title', 'list', 'index')"
_LB = f"(SELECT *, (bbox.y1 - bbox.y0) / n AS h FROM (SELECT region_id, job_id, page_number, region_type, bbox, len(string_split(content, chr(10))) AS n FROM {R} WHERE content IS NOT NULL AND bbox IS NOT NULL AND region_type IN {_TYPES}))"
_LINES = f"(SELECT region_id, job_id, page_number, h, (bbox.y0 + h * (i + 1)) - (bbox.y0 + h * i) AS lh FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM {_LB}))"
_LH = f"SELECT job_id, page_number, CASE WHEN count(DISTINCT region_id) >= 3 THEN list_sort(list(lh))[len(list(lh)) // 2 + 1] END AS line_height FROM {_LINES} WHERE lh > 0 GROUP BY ALL"
Q["line_height"] = lambda spark, d: L.line_height(regions(spark, d, "job_id", "page_number", "region_type", "bbox", "content")).select("job_id", "page_number", F.round("line_height", 4).alias("line_height"))
S["line_height"] = f"SELECT job_id, page_number, round(line_height, 4) AS line_height FROM ({_LH})"

_XU = f"SELECT job_id, page_number, min(bbox.x0) AS x0, max(bbox.x1) AS x1 FROM {R} WHERE region_type IN {_TYPES} AND bbox.x1 - bbox.x0 > 0 GROUP BY ALL"
Q["x_union"] = lambda spark, d: L.x_union(regions(spark, d, "job_id", "page_number", "region_type", "bbox"))
S["x_union"] = _XU

Q["decorative"] = lambda spark, d: L.decorative(regions(spark, d, "job_id", "page_number", "region_type", "bbox", "content"), pages(spark, d))
_DECORATIVE = f"""(WITH lh AS ({_LH}), xu AS ({_XU}), b AS (SELECT r.region_id, r.bbox, p.width, lh.line_height, xu.x0 AS ux0, xu.x1 AS ux1, r.bbox.x1 - r.bbox.x0 AS w, r.bbox.y1 - r.bbox.y0 AS h, length({STRIP("coalesce(r.content, '')")}) AS n FROM {R} r JOIN {SQL_PAGES} p USING (job_id, page_number) LEFT JOIN lh USING (job_id, page_number) LEFT JOIN xu USING (job_id, page_number))
 SELECT region_id, CASE WHEN bbox IS NULL OR w <= 0 OR h <= 0 THEN false WHEN h / w > 6 AND w < 60 THEN true WHEN line_height IS NULL OR ux0 IS NULL THEN false WHEN h < 2 * line_height AND greatest(0, least(bbox.x1, ux1) - greatest(bbox.x0, ux0)) > 0.5 * w THEN false
 ELSE (w < 0.15 * width AND h < 100 AND n > 0 AND n <= 10) OR (n > 0 AND n <= 3 AND w < 0.25 * width AND w * h < 50 * width) END AS decorative FROM b)"""
S["decorative"] = f"SELECT * FROM {_DECORATIVE}"

_OPTIONS = "(SELECT job_id, max(include_figures) AS include_figures, max(figure_display) AS figure_display FROM submit_options WHERE job_id IS NOT NULL GROUP BY job_id)"
_DISCARDED = f"""(WITH b AS (SELECT r.*, CASE WHEN coalesce(r.content, '') <> '' THEN {KEY('r.content')} END AS k, p.height FROM {R} r JOIN {SQL_PAGES} p USING (job_id, page_number) WHERE r.region_type IN ('header', 'footer')),
 n AS (SELECT job_id, k, count(DISTINCT page_number) AS n_pages FROM b WHERE k <> '' GROUP BY ALL), t AS (SELECT job_id, count(DISTINCT page_number) AS total FROM {R} GROUP BY ALL),
 f AS (SELECT b.*, coalesce(n.n_pages >= least(3, t.total) OR regexp_matches(k, '^[0-9]{{1,4}}$'), false) AS again, d.decorative, coalesce(o.include_figures, true) AS takes, coalesce(o.figure_display, 'image') AS display, CASE WHEN coalesce(bbox.y0, 0) < height / 2 THEN 'header' ELSE 'footer' END AS half
 FROM b LEFT JOIN n USING (job_id, k) JOIN t USING (job_id) JOIN {_DECORATIVE} d USING (region_id) LEFT JOIN {_OPTIONS} o USING (job_id))
 SELECT region_id, CASE WHEN decorative AND again AND takes AND display = 'image' THEN 'image' WHEN decorative AND again AND NOT takes THEN 'skip' WHEN again THEN half WHEN decorative AND NOT takes THEN 'skip' WHEN decorative AND display = 'image' THEN 'image' ELSE 'text' END AS class FROM f)"""


def discarded(spark, d):
    """Every header and footer region, on its page and by its job's options."""
    return R_.classify_discarded(regions(spark, d, "job_id", "page_number", "region_type", "bbox", "content"), pages(spark, d), read(spark, d, "submit_options"))


Q["discarded_blocks"] = discarded
S["discarded_blocks"] = f"SELECT * FROM {_DISCARDED}"
Q["furniture_classes"] = lambda spark, d: discarded(spark, d).groupBy("class").agg(F.count("*").alias("n_regions"))
S["furniture_classes"] = f"SELECT class, count(*) AS n_regions FROM {_DISCARDED} GROUP BY ALL"

Q["renderable"] = lambda spark, d: L.renderable(regions(spark, d, "bbox", "content", "html", "latex"))
S["renderable"] = f"SELECT region_id FROM {R} WHERE ({STRIP("coalesce(content, '')")} <> '' OR (html IS NOT NULL AND html <> '') OR latex IS NOT NULL) AND greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0) > 0"


def _boxes(spark, d):
    """Boxes of regions moved up by a part of their number, so that some overlap."""
    up = (F.col("region_id") % 4) * 12
    return regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "bbox").where("bbox IS NOT NULL").select("job_id", "page_number", F.col("region_id").alias("id"), F.col("block_idx").alias("ord"), "region_type", G.box(F.col("bbox.x0"), F.col("bbox.y0") - up, F.col("bbox.x1"), F.col("bbox.y1") - up).alias("bbox"), (F.col("bbox.y0") - up).alias("y0"), (F.col("bbox.y1") - up).alias("y1"))


_BX = f"(SELECT job_id, page_number, region_id AS id, block_idx AS ord, region_type, bbox.x0 AS x0, bbox.x1 AS x1, bbox.y0 - (region_id % 4) * 12 AS y0, bbox.y1 - (region_id % 4) * 12 AS y1 FROM {R} WHERE bbox IS NOT NULL)"
Q["best_overlap"] = lambda spark, d: L.best_overlap(_boxes(spark, d).where("region_type IN ('table', 'figure', 'caption')"), _boxes(spark, d).where("region_type IN ('text', 'table')"))
S["best_overlap"] = f"""WITH p AS (SELECT a.id AS left_id, b.id AS right_id, b.ord AS o, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS v FROM {_BX} a JOIN {_BX} b USING (job_id, page_number) WHERE a.region_type IN ('table', 'figure', 'caption') AND b.region_type IN ('text', 'table') AND a.id <> b.id)
 SELECT left_id, right_id FROM p WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY v DESC, o, right_id) = 1"""

Q["dominant_font"] = lambda spark, d: L.dominant_by_centre(L.line_boxes(regions(spark, d, "job_id", "page_number", "bbox", "content", "font_family")).select("job_id", "page_number", (F.col("region_id") * 1000 + F.col("line_no")).alias("ord"), F.coalesce("font_family", F.lit("none")).alias("name"), F.length("line").alias("n_chars"), F.col("line_box").alias("bbox")), _boxes(spark, d).where("region_type = 'text'"))
S["dominant_font"] = f"""WITH s AS (SELECT job_id, page_number, region_id * 1000 + i AS ord, coalesce(font_family, 'none') AS name, length(parts[i + 1]) AS n_chars, (bbox.x0 + bbox.x1) / 2 AS cx, ((bbox.y0 + (bbox.y1 - bbox.y0) / len(parts) * i) + (bbox.y0 + (bbox.y1 - bbox.y0) / len(parts) * (i + 1))) / 2 AS cy FROM (SELECT *, unnest(generate_series(0, len(parts) - 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS parts FROM {R} WHERE content IS NOT NULL AND bbox IS NOT NULL))),
 t AS (SELECT b.id AS block_id, s.name, sum(n_chars) AS n, min(s.ord) AS o FROM s JOIN {_BX} b USING (job_id, page_number) WHERE b.region_type = 'text' AND cx BETWEEN b.x0 AND b.x1 AND cy BETWEEN b.y0 AND b.y1 GROUP BY ALL)
 SELECT block_id, name FROM t QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY n DESC, o) = 1"""

Q["line_islands"] = lambda spark, d: L.line_islands(_boxes(spark, d))
S["line_islands"] = f"""WITH l AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1 FROM {_BX} WINDOW w AS (PARTITION BY job_id, page_number ORDER BY y0, id)), f AS (SELECT *, CASE WHEN p0 IS NULL OR NOT (least(y1 - y0, p1 - p0) > 0 AND (least(y1, p1) - greatest(y0, p0)) / least(y1 - y0, p1 - p0) > 0.6) THEN 1 ELSE 0 END AS new FROM l)
 SELECT id, (sum(new) OVER (PARTITION BY job_id, page_number ORDER BY y0, id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM f"""

Q["interval_union"] = lambda spark, d: L.interval_union(_boxes(spark, d).select("job_id", "page_number", "id", F.floor("y0").alias("lo"), F.floor("y1").alias("hi")))
_IU = lambda src: f"""SELECT job_id, page_number, min(lo) AS start, max(hi) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY job_id, page_number ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY job_id, page_number ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY job_id, page_number ORDER BY lo, hi, id) = 1 THEN 1 ELSE 0 END AS new FROM {src})) GROUP BY job_id, page_number, g"""
S["interval_union"] = _IU(f"(SELECT job_id, page_number, id, floor(y0)::BIGINT AS lo, floor(y1)::BIGINT AS hi FROM {_BX})")

Q["mask_subtract"] = lambda spark, d: L.subtract_masks(_boxes(spark, d).where("region_type = 'text'").select("job_id", "page_number", "id", F.floor("y0").alias("lo"), F.floor("y1").alias("hi")), _boxes(spark, d).where("region_type IN ('formula', 'table', 'figure')").select("job_id", "page_number", "id", F.floor("y0").alias("lo"), F.floor("y1").alias("hi")))
S["mask_subtract"] = f"""WITH i AS (SELECT job_id, page_number, id, floor(y0)::BIGINT AS lo, floor(y1)::BIGINT AS hi FROM {_BX} WHERE region_type = 'text'), m AS ({_IU(f"(SELECT job_id, page_number, id, floor(y0)::BIGINT AS lo, floor(y1)::BIGINT AS hi FROM {_BX} WHERE region_type IN ('formula', 'table', 'figure'))")}),
 h AS (SELECT i.id, i.lo, i.hi, m.start, m.stop, row_number() OVER (PARTITION BY i.id ORDER BY m.start) AS k, lead(m.start) OVER (PARTITION BY i.id ORDER BY m.start) AS nxt FROM i JOIN m USING (job_id, page_number) WHERE m.start <= i.hi AND m.stop >= i.lo)
 SELECT id, lo, start - 1 AS hi FROM h WHERE k = 1 AND lo <= start - 1 UNION ALL SELECT id, stop + 1, coalesce(nxt - 1, hi) FROM h WHERE stop + 1 <= coalesce(nxt - 1, hi) UNION ALL SELECT id, lo, hi FROM i WHERE id NOT IN (SELECT id FROM h)"""

Q["page_order"] = lambda spark, d: L.reading_order(regions(spark, d, "job_id", "page_number", "block_idx", "bbox"))
S["page_order"] = f"SELECT region_id, row_number() OVER (PARTITION BY job_id, page_number ORDER BY coalesce(bbox.y0, 0), block_idx, region_id)::INT AS position FROM {R}"

Q["largest_blocks"] = lambda spark, d: L.largest_blocks(regions(spark, d, "job_id", "page_number", "block_idx", "bbox"))
S["largest_blocks"] = f"SELECT region_id, rank FROM (SELECT region_id, row_number() OVER (PARTITION BY job_id ORDER BY greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0) DESC, page_number, block_idx, region_id)::INT AS rank FROM {R} WHERE bbox IS NOT NULL) WHERE rank <= 10"

Q["overlap_merge"] = lambda spark, d: L.merge_overlaps(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "bbox", "content").withColumn("bbox", F.when(F.col("bbox").isNotNull(), G.box(F.col("bbox.x0"), F.col("bbox.y0") - (F.col("region_id") % 4) * 45, F.col("bbox.x1"), F.col("bbox.y1")))))
_MG = "coalesce(region_type IN ('text', 'title', 'list') AND greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0) > 0, false)"
_MT = lambda big, small: f"NOT {big}.gone AND {big}.id <> {small}.id AND {big}.area >= {small}.area AND greatest(0, least({small}.x1, {big}.x1) - greatest({small}.x0, {big}.x0)) * greatest(0, least({small}.y1, {big}.y1) - greatest({small}.y0, {big}.y0)) / {small}.area >= 0.6"
S["overlap_merge"] = f"""WITH r AS (SELECT job_id, page_number, block_idx, region_id, region_type, coalesce(content, '') AS text, CASE WHEN bbox IS NOT NULL THEN struct_pack(x0 := bbox.x0, y0 := bbox.y0 - (region_id % 4) * 45, x1 := bbox.x1, y1 := bbox.y1) END AS bbox FROM {R}),
 p AS (SELECT job_id, page_number, list({{'id': region_id, 'x0': bbox.x0, 'y0': bbox.y0, 'x1': bbox.x1, 'y1': bbox.y1, 'area': greatest(0, bbox.x1 - bbox.x0) * greatest(0, bbox.y1 - bbox.y0), 'text': text, 'gone': false}} ORDER BY block_idx, region_id) AS b FROM r WHERE {_MG} GROUP BY ALL),
 f AS (SELECT list_reduce(range(1, len(b) + 1), lambda s, i: CASE WHEN s[i].gone THEN s ELSE list_transform(s, lambda x, k: CASE WHEN k = i AND len(list_filter(s, lambda y: {_MT('y', 's[i]')})) > 0 THEN struct_update(x, gone := true)
  WHEN k = coalesce(list_position(list_transform(s, lambda y: {_MT('y', 's[i]')}), true), 0) THEN struct_update(x, text := {STRIP(STRIP('s[i].text') + " || chr(10) || x.text")}) ELSE x END) END, b) AS s FROM p)
 SELECT x.id AS region_id, x.text AS content FROM (SELECT unnest(s) AS x FROM f) WHERE NOT x.gone UNION ALL SELECT region_id, text FROM r WHERE NOT {_MG}"""
Q["overflow_absorb"] = lambda spark, d: L.absorb_overflow(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "bbox", "content"))
_FREE = f"{STRIP("coalesce(content, '')")} = '' AND coalesce(region_type, '') NOT IN ('table', 'figure', 'title', 'image')"
# In SQL without a fold: a block takes those below it as far as each is free and close to what the ones above reach.
S["overflow_absorb"] = f"""WITH r AS (SELECT job_id, page_number, region_id, bbox.y0 AS y0, bbox.y1 AS y1, row_number() OVER (PARTITION BY job_id, page_number ORDER BY block_idx, region_id) AS k, {_FREE} AS free, {STRIP("coalesce(content, '')")} <> '' AND coalesce(region_type, '') NOT IN ('table', 'figure', 'image', 'image_body') AND bbox.y1 - bbox.y0 < 10.0 * (length(coalesce(content, '')) - length(replace(coalesce(content, ''), chr(10), '')) + 1) AS starts FROM {R} WHERE bbox IS NOT NULL),
 c AS (SELECT a.job_id, a.page_number, a.region_id, a.y1, b.k, b.region_id AS other, b.y1 AS y, b.free AND b.y0 - greatest(a.y1, coalesce(max(b.y1) OVER (PARTITION BY a.region_id ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a.y1)) <= 5.0 AS ok FROM r a JOIN r b ON a.job_id = b.job_id AND a.page_number = b.page_number AND b.k > a.k WHERE a.starts),
 g AS (SELECT *, bool_and(ok) OVER (PARTITION BY region_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS taken FROM c)
 SELECT r.region_id, greatest(r.y1, coalesce(m.y, r.y1)) AS y1, t.other IS NOT NULL AS absorbed FROM r LEFT JOIN (SELECT region_id, max(y) AS y FROM g WHERE taken GROUP BY 1) m USING (region_id) LEFT JOIN (SELECT DISTINCT other FROM g WHERE taken) t ON t.other = r.region_id"""
Q["bubble_order"] = lambda spark, d: L.bubble_order(_boxes(spark, d).select("job_id", "page_number", "id", F.col("bbox.x0").alias("x0"), "y0"))
_STOP = "(CASE WHEN abs(x[1].y - s[k].y) < 10.0 AND x[1].x < s[k].x THEN 0 ELSE k END)"
S["bubble_order"] = f"""WITH p AS (SELECT list([{{'id': id, 'x': x0, 'y': y0}}] ORDER BY y0, x0, id) AS b FROM {_BX} GROUP BY job_id, page_number),
 f AS (SELECT list_reduce(b, lambda s, x: s[1:coalesce(list_max(list_transform(range(1, len(s) + 1), lambda k: {_STOP})), 0)] || x || s[coalesce(list_max(list_transform(range(1, len(s) + 1), lambda k: {_STOP})), 0) + 1:]) AS s FROM p)
 SELECT s[i].id AS id, i::INT AS position FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM f)"""

Q["page_unmerge"] = lambda spark, d: U.unmerge_pages(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content").where("region_type = 'text'").select("job_id", "page_number", "block_idx", F.col("region_id").alias("id"), (F.col("region_id") % 3 == 0).alias("emptied"), F.when(F.col("region_id") % 4 == 1, F.col("content")).alias("group")))
S["page_unmerge"] = f"""WITH b AS (SELECT job_id, page_number, block_idx, region_id AS id, region_id % 3 = 0 AS emptied, CASE WHEN region_id % 4 = 1 THEN content END AS grp FROM {R} WHERE region_type = 'text'), e AS (SELECT job_id, page_number, block_idx, id, NULL AS grp, 0 AS push FROM b WHERE emptied UNION ALL SELECT job_id, page_number, block_idx, id, grp, 1 FROM b WHERE grp IS NOT NULL),
 x AS (SELECT *, sum(CASE push WHEN 1 THEN 1 ELSE -1 END) OVER (PARTITION BY job_id ORDER BY page_number, block_idx, id, push ROWS UNBOUNDED PRECEDING) AS x FROM e), m AS (SELECT *, least(0, min(x) OVER (PARTITION BY job_id ORDER BY page_number, block_idx, id, push ROWS UNBOUNDED PRECEDING)) AS m FROM x), q AS (SELECT *, coalesce(lag(x - m) OVER (PARTITION BY job_id ORDER BY page_number, block_idx, id, push), 0) AS waiting FROM m),
 s AS (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY page_number, block_idx, id) AS n FROM q WHERE push = 0 AND waiting > 0), g AS (SELECT job_id, grp, row_number() OVER (PARTITION BY job_id ORDER BY page_number, block_idx, id) AS n FROM q WHERE push = 1) SELECT s.id, g.grp AS given FROM s JOIN g USING (job_id, n)"""


def _titles(spark, d):
    return L.title_heights(regions(spark, d, "job_id", "region_type", "bbox", "content")).select("job_id", "region_id", "height", T.numbering_depth(F.col("content")).alias("depth"))


Q["heading_levels"] = lambda spark, d: L.heading_levels(_titles(spark, d))
S["heading_levels"] = f"""WITH t AS (SELECT job_id, region_id, round((bbox.y1 - bbox.y0) / len(string_split(content, chr(10))), 6) AS height, CASE WHEN regexp_matches({STRIP('content')}, '(?i)^(chapter|part)\\b') THEN 1 WHEN regexp_matches({STRIP('content')}, '(?i)^(section|article)\\b') THEN 2 END AS depth FROM {R} WHERE region_type = 'title' AND bbox IS NOT NULL AND content IS NOT NULL),
 c AS (SELECT job_id, list_sort(list_reduce(list_sort(list_distinct(list(height)), 'DESC'), lambda reps, h: CASE WHEN len(list_filter(reps, lambda r: abs(h - r) <= 2.0)) > 0 THEN list_transform(reps, lambda r, i: CASE WHEN i = list_position(list_transform(reps, lambda q: abs(h - q) <= 2.0), true) THEN (r + h) / 2 ELSE r END) ELSE list_append(reps, h) END, []::DOUBLE[]), 'DESC')[1:6] AS reps FROM t GROUP BY job_id),
 n AS (SELECT job_id, region_id, depth, list_min(list_transform(reps, lambda r, i: struct_pack(d := abs(height - r), level := i))).level AS near FROM t JOIN c USING (job_id))
 SELECT region_id, least(dense_rank() OVER (PARTITION BY job_id ORDER BY least(CASE WHEN abs(depth - near) <= 1 THEN depth ELSE near END, 6)), 6)::INT AS level FROM n"""

Q["apply_corrections"] = lambda spark, d: L.apply_corrections(regions(spark, d, "region_type", "content", "heading_level").where("region_type = 'title' AND content IS NOT NULL"), regions(spark, d, "region_type", "content", "page_number").where("region_type = 'header' AND content IS NOT NULL").select(F.col("region_id").alias("ord"), F.col("content").alias("text"), (F.col("page_number") % 6 + 1).alias("level")))
S["apply_corrections"] = f"WITH c AS (SELECT trim(content) AS k, arg_max(page_number % 6 + 1, region_id) AS lv FROM {R} WHERE region_type = 'header' AND content IS NOT NULL GROUP BY 1) SELECT region_id, coalesce(lv, heading_level)::INT AS level FROM {R} r LEFT JOIN c ON trim(r.content) = c.k WHERE region_type = 'title' AND content IS NOT NULL"

Q["fit_text"] = lambda spark, d: regions(spark, d, "bbox", "content").where("content IS NOT NULL AND bbox IS NOT NULL").select("region_id", F.round(G.fitted_size(F.transform(F.split("content", "\n"), lambda x: F.length(x)), G.width(F.col("bbox")), G.height(F.col("bbox"))), 6).alias("size"))
_NEED = "list_sum(list_transform(ls, lambda n: greatest(1.0, ceil(n / greatest(1.0, floor(w / ((s.lo + s.hi) / 2 * 0.48))))))) * 1.2 * (s.lo + s.hi) / 2 <= h"
S["fit_text"] = f"""WITH r AS (SELECT region_id, list_transform(string_split(content, chr(10)), lambda l: length(l)) AS ls, greatest(0, bbox.x1 - bbox.x0) AS w, greatest(0, bbox.y1 - bbox.y0) AS h FROM {R} WHERE content IS NOT NULL AND bbox IS NOT NULL)
 SELECT region_id, CASE WHEN w > 0 AND h > 0 AND list_sum(ls) > 0 THEN round(list_reduce(list_transform(range(20), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE, 'best': 0.0::DOUBLE}}), lambda s, i: CASE WHEN s.hi - s.lo < 0.5 THEN s WHEN {_NEED} THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi, 'best': (s.lo + s.hi) / 2}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2, 'best': s.best}} END, {{'lo': 1.0::DOUBLE, 'hi': greatest(1.0, h)::DOUBLE, 'best': 1.0::DOUBLE}}).best, 6) ELSE 1.0 END AS size FROM r"""
Q["word_wrap"] = lambda spark, d: regions(spark, d, "region_type", "content").where("region_type = 'text' AND content IS NOT NULL").select("region_id", G.wrap(F.col("content"), F.lit(60)).alias("w")).select("region_id", F.size("w").alias("n_lines"), F.array_max(F.transform("w", lambda x: F.length(x))).alias("longest"))
S["word_wrap"] = rf"""SELECT region_id, len(w)::INT AS n_lines, list_max(list_transform(w, lambda x: length(x)))::INT AS longest FROM (SELECT region_id, list_reduce(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> ''), lambda acc, x: CASE WHEN len(acc) > 0 AND length(acc[-1] || ' ' || x) <= 60 THEN list_append(acc[:-2], acc[-1] || ' ' || x) ELSE list_append(acc, x) END, []::VARCHAR[]) AS w FROM {R} WHERE region_type = 'text' AND content IS NOT NULL)"""
