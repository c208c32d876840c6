"""Queries over formulas, jobs, errors, translation, replies of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesmith.functions import latex as X
from pagesmith.functions import text as T
from pagesmith.operators import jobs as J
from pagesmith.operators.scan import SQL_JOBS, SQL_PAGES, SQL_REGIONS, jobs, pages, read, regions
from pagesmith.plans.text import STRIP

Q: dict = {}
S: dict[str, str] = {}
R = SQL_REGIONS

def _formulas(spark, d):
    return regions(spark, d, "latex", "block_idx", "page_number").where("latex IS NOT NULL").select("region_id", "block_idx", "page_number", F.expr(_FORMULAS).alias("l"))


# Formulas: the tables' own, and measurements made from their numbers.
_FORMULAS = """CASE region_id % 6 WHEN 0 THEN latex WHEN 1 THEN concat(region_id % 90, ' . 0 5 \\\\mathrm{ m M }') WHEN 2 THEN concat(region_id % 40, '^ { \\\\circ } C') WHEN 3 THEN 'C a ^ { 2 + }' WHEN 4 THEN concat('( n = ', region_id % 300, ' )') ELSE latex END"""
_FORMULAS_SQL = r"""(CASE region_id % 6 WHEN 0 THEN latex WHEN 1 THEN (region_id % 90) || ' . 0 5 \mathrm{ m M }' WHEN 2 THEN (region_id % 40) || '^ { \circ } C' WHEN 3 THEN 'C a ^ { 2 + }' WHEN 4 THEN '( n = ' || (region_id % 300) || ' )' ELSE latex END)"""
# The rules on formulas in SQL, for a column l.
_q = lambda x: "'" + x.replace("'", "''") + "'"
_TOKENS = f"regexp_extract_all(l, '{X.TOKEN}', 1)"
_SQL_MAP = lambda m: "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in m.items()) + "}"
_DRAWN = f"array_to_string(list_transform({_TOKENS}, lambda t: coalesce({_SQL_MAP(X.DRAWN)}[t], CASE WHEN starts_with(t, '\\') THEN '{X.OTHER}' END, t)), '')"
_MEASURE = f"regexp_matches({_DRAWN}, '{X.MEASUREMENT}')"
_GROUPS = "|".join(f for f in X.FONTS if f != "mathfrak")
_MATHS = rf"(regexp_matches(regexp_replace(l, '\\(?:{_GROUPS})\s*\{{', '{{', 'g'), '\\[A-Za-z]+|\\[^A-Za-z%#&$ ]') OR regexp_matches({_DRAWN}, '[A-Za-z][\^_]|[\^_][A-Za-z]'))"
_NONE = rf"(coalesce(l, '') = '' OR {_MEASURE} OR (NOT {_MATHS} AND regexp_matches(regexp_replace({_DRAWN}, '[\^_]', '', 'g'), '{X.PLAIN}')))"
_COMPACT_MAP = _SQL_MAP({k: v for k, v in X.DRAWN.items() if v == "" or k in ("\\%", "\\#", "\\&", "\\$")})
_COMPACT = f"translate(regexp_replace(regexp_replace(array_to_string(list_transform({_TOKENS}, lambda t: coalesce({_COMPACT_MAP}[t], CASE WHEN regexp_matches(t, '^\\\\[A-Za-z]') THEN '{X.BEFORE}' || t || '{X.AFTER}' END, t)), ''), '([A-Za-z0-9]){X.BEFORE}', '\\1 ', 'g'), '{X.AFTER}([A-Za-z0-9])', ' \\1', 'g'), '{X.BEFORE}{X.AFTER}', '')"
_INK = _SQL_MAP({"\\%": "%", "\\#": "#", "\\&": "&", "\\$": "$", "^": "", "_": "", **{f"\\{k}": v for k, v in X.SYMBOLS.items()}})
_IS = lambda names: "(" + ", ".join(_q(f"\\{x}") for x in names) + ")"
_STEP = f"""{{'o': CASE WHEN t.o IN {_IS(X.FONTS)} THEN s.o || ' ' WHEN t.o IN ('{{', '}}', '\\it', '\\rm', '\\sf') THEN s.o WHEN t.o IN ('~', '\\ ') AND NOT s.e THEN s.o || ' ' WHEN regexp_matches(t.o, '^\\s$') AND NOT s.e AND s.d = 0 THEN s.o || ' ' WHEN t.o IN ('~', '\\ ') OR regexp_matches(t.o, '^\\s$') THEN s.o ELSE s.o || coalesce({_INK}[t.o], CASE WHEN starts_with(t.o, '\\') THEN '' END, t.o) END,
 'd': CASE WHEN t.o = '{{' AND (s.a OR s.d > 0) THEN s.d + 1 WHEN t.o = '}}' THEN greatest(s.d - 1, 0) ELSE s.d END, 'a': t.o IN {_IS(X.FONTS)} OR (s.a AND regexp_matches(t.o, '^\\s$')), 'e': (regexp_matches(t.o, '^\\\\[A-Za-z]') AND t.o NOT IN {_IS(X.FONTS)}) OR (s.e AND (regexp_matches(t.o, '^\\s$') OR t.o IN ('~', '\\ ', '{{', '}}')))}}"""
_FOLD = f"list_reduce(list_transform({_TOKENS}, lambda t: {{'o': t, 'd': 0, 'a': false, 'e': false}}), lambda s, t: {_STEP}, {{'o': '', 'd': 0, 'a': false, 'e': false}}).o"
for _a, _b in (("([0-9.])\\s+([0-9.])", "\\1\\2"), ("([0-9.])\\s+([0-9.])", "\\1\\2"), ("([0-9])\\s+([+-])", "\\1\\2"), ("([+-])\\s+([0-9])", "\\1\\2"), ("\\s*/\\s*", "/"), ("^\\s+|\\s+$", ""), ("\\s+", " ")):
    _FOLD = f"regexp_replace({_FOLD}, '{_a}', '{_b}', 'g')"
_L = f"(SELECT region_id, block_idx, page_number, {_FORMULAS_SQL} AS l FROM {R} WHERE latex IS NOT NULL)"
Q["measurement_flags"] = lambda spark, d: _formulas(spark, d).select("region_id", X.is_measurement(F.col("l")).alias("measurement"), X.is_no_equation(F.col("l")).alias("no_equation"))
S["measurement_flags"] = f"SELECT region_id, {_MEASURE} AS measurement, {_NONE} AS no_equation FROM {_L}"
Q["latex_plain"] = lambda spark, d: _formulas(spark, d).select("region_id", X.to_plain(F.col("l")).alias("plain"), X.compact(F.col("l")).alias("compact"))
S["latex_plain"] = f"SELECT region_id, {_FOLD} AS plain, {_COMPACT} AS compact FROM {_L}"
Q["equation_spans"] = lambda spark, d: _formulas(spark, d).select("region_id", X.equation_span(F.col("l"), F.col("block_idx"), F.col("page_number") % 2 == 0).alias("span"))
S["equation_spans"] = f"SELECT region_id, CASE WHEN {_NONE} THEN {_FOLD} WHEN page_number % 2 = 0 THEN chr(10) || '{{{{EQ:' || block_idx || '}}}}' || chr(10) ELSE '{{{{EQ:' || block_idx || '}}}}' END AS span FROM {_L}"
# Every shape of the grammar once, and formulas that are none: (formula, measurement, no equation, plain text).
CASES = [
    (r"1 2 \mu \mathrm { g } / \mathrm { m } L", True, True, "12 µ g/m L"), (r"7 5 ~ \mathsf { n M }", True, True, "75 nM"), (r"{ < } 4 0 \%", True, True, "< 40 %"), (r"2 1 ^ { \circ } \mathsf { F }", True, True, "21 ° F"), (r"6 \mu m ^ { 2 }", True, True, "6 µm 2"), (r"9 \mu \iota", True, True, "9 µι"),
    (r"\sim 7 4", True, True, "~74"), (r"\dot \cdot = 0 . 3", True, True, "·= 0.3"), (r"4 0 , 0 0 0 \times", True, True, "40 , 000 ×"), (r"\times 5", True, True, "×5"), (r"\pm \mathsf { S E M }", True, True, "± SEM"), (r"( N = 1 2 )", True, True, "( N = 12 )"), (r"\mathrm { p H } ~ 6 . 5", True, True, "pH 6.5"),
    (r"\mathrm { M g } ^ { 2 + }", True, True, "Mg 2+"), (r"N H _ { 3 }", True, True, "N H 3"), (r"K \Delta 8 8", True, True, "K Δ88"), (r"\mathsf { A B } 2 ^ { 1 4 }", True, True, "AB 214"), (r"\gamma", True, True, "γ"), (r"\cdot \beta", True, True, "·β"), (r"( a - d )", True, True, "( a - d )"), (r"q .", True, True, "q ."),
    (r"\mathsf { P } > 0 . 2", True, True, "P > 0.2"), (r"6 \times 1 0 ^ { 8 }", True, True, "6 ×108"), (r"O D _ { 4 5 0 } = 2", True, True, "O D 450 = 2"), (r"5 \mathrm { \ m M \ K C l }", True, True, "5 mM KCl"), (r"A B C 1 + C a ^ { 2 + }", True, True, "A B C 1+ C a 2+"),
    (r"8 0 \mathrm { K m }", False, True, "80 Km"), ("4 5 6", False, True, "456"), ("", False, True, ""), (r"\frac { p } { q }", False, False, "p q"), (r"v ^ 2", False, False, "v 2"), (r"a _ { n }", False, False, "a n"), (r"u \geq 3", False, False, "u ≥3"), (r"\mathbb { Z }", False, False, "Z"), (r"f ( t ) - t", False, False, "f ( t ) - t"), (r"\mathfrak { g }", True, True, "g"), (r"\mathfrak { g h }", False, False, "gh"),
]
Q["latex_cases"] = lambda spark, d: spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, l string").select("id", X.is_measurement(F.col("l")).alias("measurement"), X.is_no_equation(F.col("l")).alias("no_equation"), X.to_plain(F.col("l")).alias("plain"))
S["latex_cases"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(m).lower()}, {str(n).lower()}, {_q(p)})" for i, (_, m, n, p) in enumerate(CASES)) + ") AS c(id, measurement, no_equation, plain)"

Q["active_jobs"] = lambda spark, d: jobs(spark, d).where("status IN ('queued', 'processing', 'retrying')").select("job_id", "status", "created_at", F.get_json_object("tool_config", "$.ocr_mode").alias("ocr_mode"))
S["active_jobs"] = f"SELECT job_id, status, created_at, json_extract_string(tool_config, '$.ocr_mode') AS ocr_mode FROM {SQL_JOBS} WHERE status IN ('queued', 'processing', 'retrying')"
Q["job_status"] = lambda spark, d: J.recovered(jobs(spark, d)).groupBy("status").agg(F.count("*").alias("n_jobs"), F.sum("total_pages").alias("n_pages"), F.max("retry_count").alias("max_retries"))
S["job_status"] = f"SELECT CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS status, count(*) AS n_jobs, sum(total_pages)::BIGINT AS n_pages, max(retry_count) AS max_retries FROM {SQL_JOBS} GROUP BY 1"
Q["job_latest"] = lambda spark, d: J.latest_state(read(spark, d, "events"))
S["job_latest"] = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n_events, min(ts) FILTER (WHERE event_type = 'click') AS started_at, max(ts) FILTER (WHERE event_type = 'purchase') AS ended_at FROM events GROUP BY user_id"
Q["retry_outcome"] = lambda spark, d: J.run_outcome(read(spark, d, "events").select(F.col("user_id").alias("job"), F.struct("ts", "event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("pages")))
S["retry_outcome"] = """WITH a AS (SELECT user_id AS job, event_type <> 'error' AS ok, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS pages, row_number() OVER w AS k, max((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT job, count(*) AS n_attempts, bool_or(ok) AS ok, sum(pages) AS pages FROM a WHERE k <= 3 AND coalesce(done, 0) = 0 GROUP BY job) SELECT job, CASE WHEN ok OR pages > 0 THEN 'completed' ELSE 'failed' END AS status, n_attempts, n_attempts - 1 AS retry_count FROM g"""
_MSG = "concat(coalesce(error_message, ''), element_at(array('', ' 401 unauthorized', ' rate_limit 429', ' 503 service_unavailable', ' CUDA out of memory', ' network timeout'), cast(pmod(length(job_id) + ascii(substring(job_id, 8, 1)), 6) as int) + 1))"
_MSQ = "(coalesce(error_message, '') || ['', ' 401 unauthorized', ' rate_limit 429', ' 503 service_unavailable', ' CUDA out of memory', ' network timeout'][((length(job_id) + ascii(substring(job_id, 8, 1))) % 6)::INT + 1])"
_CLOUD = "coalesce(tool_config, '') LIKE '%cloud%'"


def _errors(spark, d):
    j = jobs(spark, d).select("job_id", F.expr(_MSG).alias("m"), (~F.expr(_CLOUD)).alias("local"))
    code = J.error_code(F.col("m"), F.col("local"), F.lit(False), F.col("m").contains("table"))
    return j.select("job_id", code.alias("code"), J.message_of(code).alias("message"), J.error_kind(F.col("m")).alias("kind"), J.is_transient(F.lit(200), F.col("m")).alias("transient"))


Q["error_codes"] = _errors
_CODE = f"""CASE WHEN m LIKE '%out of memory%' THEN CASE WHEN local THEN 'LP-OOM' ELSE 'CP-500' END WHEN m LIKE '%401%' OR m LIKE '%unauthorized%' OR m LIKE '%invalid_key%' THEN 'CP-401' WHEN m LIKE '%429%' OR m LIKE '%rate_limit%' THEN 'CP-429' WHEN m LIKE '%503%' OR m LIKE '%service_unavailable%' THEN CASE WHEN m LIKE '%table%' THEN 'CT-503' ELSE 'CP-503' END ELSE CASE WHEN local THEN 'LP-500' ELSE 'CP-500' END END"""
S["error_codes"] = f"""SELECT job_id, code, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in J.MESSAGES.items())} ELSE '{J.DEFAULT_MESSAGE}' END AS message, CASE WHEN m LIKE '%ocr engine%' THEN 'engine_crash' WHEN m LIKE '%rate limit%' OR m LIKE '%429%' THEN 'rate_limited' WHEN m LIKE '%network%' OR m LIKE '%econnreset%' OR m LIKE '%timeout%' OR m LIKE '%fetch failed%' THEN 'network_error' WHEN m LIKE '%partial%' THEN 'partial_failure' ELSE 'llm_api_error' END AS kind,
 raw LIKE '%ECONNRESET%' OR raw LIKE '%ETIMEDOUT%' OR raw LIKE '%ENOTFOUND%' OR raw LIKE '%socket hang up%' OR raw LIKE '%fetch failed%' AS transient FROM (SELECT job_id, {_CODE} AS code, m, raw FROM (SELECT job_id, lower({_MSQ}) AS m, {_MSQ} AS raw, NOT {_CLOUD} AS local FROM {SQL_JOBS}))"""
Q["queue_order"] = lambda spark, d: J.queue_order(jobs(spark, d))
S["queue_order"] = f"SELECT job_id, row_number() OVER (ORDER BY coalesce(total_pages, 0), created_at, job_id)::INT AS position FROM {SQL_JOBS}"
Q["evicted_tasks"] = lambda spark, d: J.evict(jobs(spark, d), 3)
S["evicted_tasks"] = f"SELECT job_id FROM {SQL_JOBS} WHERE status IN ('completed', 'failed', 'permanently_failed') QUALIFY row_number() OVER (ORDER BY created_at DESC, job_id DESC) > 3"
_NOW = "TIMESTAMP '2026-01-01 00:00:00'"
Q["stale_tasks"] = lambda spark, d: J.stale(jobs(spark, d).withColumn("completed_at", F.col("completed_at").cast("timestamp")), F.expr("TIMESTAMP '2026-01-01 00:00:00'"), 120)
S["stale_tasks"] = f"SELECT job_id, (epoch_us({_NOW}) - epoch_us(completed_at)) // 1000 AS age_ms FROM {SQL_JOBS} WHERE completed_at IS NOT NULL AND (epoch_us({_NOW}) - epoch_us(completed_at)) // 1000 > 120000"
Q["elapsed"] = lambda spark, d: jobs(spark, d).where("started_at IS NOT NULL AND completed_at IS NOT NULL").select("job_id", F.floor((F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).alias("elapsed_ms"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
S["elapsed"] = f"SELECT job_id, (epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS elapsed_ms, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM {SQL_JOBS} WHERE started_at IS NOT NULL AND completed_at IS NOT NULL"
Q["capacity"] = lambda spark, d: jobs(spark, d).select("job_id", J.slots((F.col("total_pages") % 64).cast("double")).alias("slots"), J.layout_batch((F.col("total_pages") % 64).cast("double")).alias("batch"), J.back_off(F.col("retry_count")).alias("wait_s"))
S["capacity"] = f"SELECT job_id, greatest(1, floor(((total_pages % 64) - 7) / 4))::INT AS slots, least(32, greatest(1, trunc(((total_pages % 64) - 6) / 0.9)))::INT AS batch, pow(2.0, retry_count) AS wait_s FROM {SQL_JOBS}"
Q["job_pages"] = lambda spark, d: pages(spark, d).groupBy("job_id").agg(F.count("*").alias("n_pages"), F.count_if("scanned").alias("n_scanned")).join(jobs(spark, d).select("job_id", "total_pages"), "job_id", "left").select("job_id", "n_pages", "n_scanned", (F.coalesce(F.nullif("total_pages", F.lit(0)), "n_pages")).cast("bigint").alias("pages_known"))
S["job_pages"] = f"SELECT p.job_id, n_pages, n_scanned, coalesce(nullif(total_pages, 0), n_pages)::BIGINT AS pages_known FROM (SELECT job_id, count(*) AS n_pages, count(*) FILTER (WHERE scanned) AS n_scanned FROM {SQL_PAGES} GROUP BY job_id) p LEFT JOIN {SQL_JOBS} j USING (job_id)"
Q["block_histogram"] = lambda spark, d: regions(spark, d, "job_id", "region_type", "heading_level").groupBy("job_id", "region_type", F.coalesce("heading_level", F.lit(0)).alias("level")).agg(F.count("*").alias("n"))
S["block_histogram"] = f"SELECT job_id, region_type, coalesce(heading_level, 0) AS level, count(*) AS n FROM {R} GROUP BY ALL"

_TGT = "(SELECT DISTINCT tgt FROM (SELECT ['hin_Deva', 'tam_Taml', 'eng_Latn', 'xxx'][(length(file_name) % 4)::INT + 1] AS tgt FROM jobs) WHERE tgt <> 'xxx')"
Q["translation_plan"] = lambda spark, d: J.translation_plan(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content"), read(spark, d, "jobs").select(F.expr("element_at(array('hin_Deva', 'tam_Taml', 'eng_Latn', 'xxx'), length(file_name) % 4 + 1)").alias("tgt")), 16)
S["translation_plan"] = f"""SELECT region_id, tgt, (n // 16)::INT AS chunk, (n % 16)::INT AS slot FROM (SELECT region_id, tgt, row_number() OVER (PARTITION BY job_id, tgt ORDER BY page_number, block_idx, region_id) - 1 AS n FROM {R}, {_TGT} WHERE region_type IN ('text', 'title', 'list', 'caption') AND {STRIP("coalesce(content, '')")} <> '')"""
Q["directions"] = lambda spark, d: read(spark, d, "documents").select("doc_id", F.expr("CASE WHEN lang = 'en' THEN 'eng_Latn' ELSE 'hin_Deva' END").alias("s"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'eng_Latn' ELSE 'tam_Taml' END").alias("t")).select("doc_id", J.direction(F.col("s"), F.col("t")).alias("direction"), J.model_name(J.direction(F.col("s"), F.col("t")), F.col("doc_id") % 3 == 0).alias("model"))
_DIR = "CASE WHEN s = 'eng_Latn' AND t <> 'eng_Latn' THEN 'en-indic' WHEN s <> 'eng_Latn' AND t = 'eng_Latn' THEN 'indic-en' ELSE 'indic-indic' END"
S["directions"] = f"SELECT doc_id, {_DIR} AS direction, 'translator-' || {_DIR} || '-' || CASE WHEN doc_id % 3 = 0 THEN '1B' WHEN {_DIR} = 'indic-indic' THEN 'dist-320M' ELSE 'dist-200M' END AS model FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'eng_Latn' ELSE 'hin_Deva' END AS s, CASE WHEN doc_id % 2 = 0 THEN 'eng_Latn' ELSE 'tam_Taml' END AS t FROM documents)"
Q["confidence"] = lambda spark, d: read(spark, d, "documents").select("doc_id", J.confidence(F.expr("CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) / 100.0D END"), F.col("text")).alias("confidence"))
S["confidence"] = "SELECT doc_id, CASE WHEN s IS NULL THEN CASE WHEN length(text) < 10 THEN 'medium' ELSE 'high' END WHEN s < 0.5 THEN 'low' WHEN s < 0.8 THEN 'medium' ELSE 'high' END AS confidence FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 <> 0 THEN ((doc_id % 100) / 100.0)::DOUBLE END AS s FROM documents)"

_TX = lambda r: r.where("region_type = 'text' AND content IS NOT NULL").select(F.concat_ws("/", "job_id", F.col("page_number").cast("string")).alias("page"), "region_id", "block_idx", "content", F.col("bbox.y0").alias("y"))
Q["box_text_pair"] = lambda spark, d: J.pair_texts(_TX(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content", "bbox")).select("page", F.col("region_id").alias("id"), F.coalesce("y", F.lit(0.0)).alias("y")), _TX(regions(spark, d, "job_id", "page_number", "block_idx", "region_type", "content", "bbox")).select("page", F.struct("block_idx", "region_id").alias("ord"), F.col("content").alias("text"), (F.col("region_id") % 10 / 10.0).alias("score"))).select("page", "box_id", "text", F.round("score", 6).alias("score"))
_TS = f"(SELECT job_id || '/' || page_number AS page, region_id, block_idx, content, coalesce(bbox.y0, 0) AS y FROM {R} WHERE region_type = 'text' AND content IS NOT NULL)"
S["box_text_pair"] = f"""WITH b AS (SELECT page, region_id AS id, row_number() OVER (PARTITION BY page ORDER BY y, region_id) AS k, count(*) OVER (PARTITION BY page) AS n FROM {_TS}), t AS (SELECT page, content AS text, region_id % 10 / 10.0 AS score, row_number() OVER (PARTITION BY page ORDER BY block_idx, region_id) AS i FROM {_TS}),
 g AS (SELECT t.page, least(t.i, n.n) AS k, string_agg(text, ' ' ORDER BY i) AS text, avg(score) AS score FROM t JOIN (SELECT page, max(n) AS n FROM b GROUP BY page) n USING (page) GROUP BY 1, 2) SELECT b.page, b.id AS box_id, g.text, round(g.score, 6) AS score FROM b JOIN g USING (page, k) WHERE g.text <> ''"""
