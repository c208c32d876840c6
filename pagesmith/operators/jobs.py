"""Operators over jobs, their events and their errors, and over plans of work. Times are UTC; a null time is before every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesmith.functions import text as T
from pagesmith.operators.flow import numbered_in_jobs
from pagesmith.operators.scan import numbered

RETRIES = 2
# Codes of errors (fixed values) and what a user is told (own words).
MESSAGES = {
    "CP-401": "The remote service did not accept the credentials.",
    "CP-429": "The remote service takes no more requests for now.",
    "CP-500": "The remote service failed.",
    "CP-503": "The remote service is down.",
    "CT-503": "The remote service for tables is down; tables are read locally.",
    "LP-MDL": "A model file is missing on this machine.",
    "LP-OOM": "This machine has too little memory for the document.",
}
DEFAULT_MESSAGE = "Processing failed for an unknown reason."
# Languages of the translation engine, of which all but English are of India.
TRANSLATION = ["eng_Latn", "hin_Deva", "ben_Beng", "tam_Taml", "tel_Telu", "mar_Deva", "guj_Gujr", "kan_Knda", "mal_Mlym", "pan_Guru", "asm_Beng", "ory_Orya", "san_Deva", "kas_Arab", "snd_Arab", "mai_Deva", "gom_Deva", "npi_Deva", "brx_Deva", "doi_Deva", "mni_Beng", "sat_Olck", "urd_Arab"]


def error_kind(message: Column) -> Column:
    """The kind of a job's error by its message; each kind may be tried again."""
    m = F.lower(message)
    has = lambda *xs: F.greatest(*(m.contains(x) for x in xs), F.lit(False))
    return F.when(message.isNull(), None).when(has("ocr engine"), "engine_crash").when(has("rate limit", "429"), "rate_limited").when(has("network", "econnreset", "timeout", "fetch failed"), "network_error").when(has("partial"), "partial_failure").otherwise("llm_api_error")


def error_code(message: Column, local: Column, missing_file: Column, in_table: Column) -> Column:
    """The code of a processing error, by cause: missing model, memory, authorisation, rate, service, other."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(missing_file & local, "LP-MDL")
        .when(m.contains("out of memory"), F.when(local, "LP-OOM").otherwise("CP-500"))
        .when(m.contains("401") | m.contains("unauthorized") | m.contains("invalid_key"), "CP-401")
        .when(m.contains("429") | m.contains("rate_limit"), "CP-429")
        .when(m.contains("503") | m.contains("service_unavailable"), F.when(in_table, "CT-503").otherwise("CP-503"))
        .otherwise(F.when(local, "LP-500").otherwise("CP-500"))
    )


def message_of(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.lit(DEFAULT_MESSAGE))


def is_transient(status: Column, message: Column) -> Column:
    marks = [message.contains(x) for x in ("ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "socket hang up", "fetch failed")]
    out = status.isin(0, 429) | (status >= 500)
    for x in marks:
        out = out | F.coalesce(x, F.lit(False))
    return out


def back_off(attempt: Column) -> Column:
    """Seconds before the next attempt: doubled each time."""
    return F.pow(F.lit(2.0), attempt)


def slots(gigabytes: Column) -> Column:
    """Documents at a time: one, and one more for every four gigabytes over seven."""
    return F.greatest(F.lit(1), F.floor((gigabytes - 7) / 4)).cast("int")


def layout_batch(gigabytes: Column) -> Column:
    """Pages at a time: one for every 0.9 gigabytes over six, from 1 to 32."""
    return F.least(F.lit(32), F.greatest(F.lit(1), ((gigabytes - 6) / 0.9).cast("int"))).cast("int")


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, last_type, last_value, n_events, started_at, ended_at): an append-only log folded to a row for each job: the last event, the first time it ran, the last purchase as its end."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count("*").alias("n_events"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ended_at"))


def run_outcome(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """(job, status, n_attempts, retry_count): attempts of a job in order, until one succeeds or retries are used up; completed if it succeeded or any page was done, else failed.

    attempts: job, ord, ok, pages. Attempts after the end are not counted.
    """
    w = W.partitionBy("job").orderBy("ord")
    a = attempts.withColumn("k", F.row_number().over(w)).withColumn("done", F.max(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    a = a.where((F.col("k") <= retries + 1) & (F.coalesce("done", F.lit(0)) == 0))
    g = a.groupBy("job").agg(F.count("*").alias("n_attempts"), F.max(F.col("ok").cast("int")).alias("ok"), F.sum("pages").alias("pages"))
    return g.select("job", F.when((F.col("ok") == 1) | (F.col("pages") > 0), "completed").otherwise("failed").alias("status"), "n_attempts", (F.col("n_attempts") - 1).alias("retry_count"))


def queue_order(jobs: DataFrame) -> DataFrame:
    """(job_id, position): short jobs first, in the order of their coming among equals; a null length counts as none. No task sees more than its range of the order."""
    return numbered(jobs.select("job_id", F.coalesce("total_pages", F.lit(0)).alias("n"), "created_at"), ["n", "created_at", "job_id"]).select("job_id", "position")


def evict(tasks: DataFrame, keep: int) -> DataFrame:
    """(job_id): finished tasks but the newest keep of them; unfinished ones are never evicted."""
    done = tasks.where("status IN ('completed', 'failed', 'permanently_failed')")
    newest = done.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(keep).select("job_id")
    return done.join(newest, "job_id", "left_anti").select("job_id")


def stale(tasks: DataFrame, now: Column, seconds: int) -> DataFrame:
    """(job_id, age_ms): tasks that ended more than so many seconds before now."""
    age = F.floor((F.unix_micros(now) - F.unix_micros("completed_at")) / 1000).alias("age_ms")
    return tasks.where("completed_at IS NOT NULL").select("job_id", age).where(F.col("age_ms") > seconds * 1000)


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs as they are after a restart: those that were being processed wait again."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def direction(src: Column, tgt: Column) -> Column:
    return F.when((src == "eng_Latn") & (tgt != "eng_Latn"), "en-indic").when((src != "eng_Latn") & (tgt == "eng_Latn"), "indic-en").otherwise("indic-indic")


def model_name(dir_: Column, large: Column) -> Column:
    size = F.when(large, "1B").when(dir_ == "indic-indic", "dist-320M").otherwise("dist-200M")
    return F.concat_ws("-", F.lit("translator"), dir_, size)


def translatable(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("region_type").isin("text", "title", "list", "caption") & (T.strip(F.coalesce("content", F.lit(""))) != ""))


def translation_plan(regions: DataFrame, targets: DataFrame, batch: int) -> DataFrame:
    """(region_id, tgt, chunk, slot): every block to translate for every language that any request names, in uniform batches of a job and language.

    targets: tgt, at most the languages of the engine, so it is a small fixed dimension to explode by, not a cross join of tables.
    """
    langs = [r["tgt"] for r in targets.select("tgt").where(F.col("tgt").isin(*TRANSLATION)).distinct().orderBy("tgt").limit(len(TRANSLATION)).collect()]
    # A block has the same number in every language, so it is numbered once.
    n = numbered_in_jobs(translatable(regions).select("region_id", "job_id", "page_number", "block_idx"), ["block_idx", "region_id"], "_n")
    tgts = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>")
    return n.select("region_id", F.explode(tgts).alias("tgt"), F.floor(F.col("_n") / batch).cast("int").alias("chunk"), (F.col("_n") % batch).cast("int").alias("slot"))


def confidence(score: Column, text: Column) -> Column:
    return F.when(score.isNull(), F.when(F.length(text) < 10, "medium").otherwise("high")).when(score < 0.5, "low").when(score < 0.8, "medium").otherwise("high")


def pair_texts(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(page, box_id, text, score): boxes from above, texts in order: the i-th box has the i-th text; the last box all that are left, with their mean score; boxes without text are dropped. boxes: page, id, y; texts: page, ord, text, score."""
    b = boxes.withColumn("k", F.row_number().over(W.partitionBy("page").orderBy("y", "id"))).withColumn("n", F.count("*").over(W.partitionBy("page")))
    t = texts.withColumn("i", F.row_number().over(W.partitionBy("page").orderBy("ord")))
    n = b.groupBy("page").agg(F.max("n").alias("n"))
    t = t.join(n, "page").withColumn("k", F.least(F.col("i").cast("bigint"), F.col("n")))
    g = t.groupBy("page", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("text"), F.avg("score").alias("score"))
    return b.join(g, ["page", "k"]).where("text <> ''").select("page", F.col("id").alias("box_id"), "text", "score")


def admitted(jobs: DataFrame, slots: dict[str, int], running: tuple[str, ...] = ("processing", "retrying")) -> DataFrame:
    """(job_id, class, turn): which queued jobs start now: of each class of jobs as many as its slots leave, short ones first, in the order of their coming among equals.

    A class that is full does not hold up the other, so that each class takes the
    first of its own queue. jobs: job_id, job_type, status, total_pages,
    created_at; recognition and headings are one class, all else the other.
    """
    kind = F.when(F.col("job_type").isin("ocr", "heading_correction"), "ocr").otherwise("llm")
    j = jobs.withColumn("class", kind)
    limit = F.create_map(*(F.lit(x) for kv in slots.items() for x in kv))
    busy = j.where(F.col("status").isin(*running)).groupBy("class").agg(F.count("*").alias("busy"))
    most = max(slots.values())
    turn = F.row_number().over(W.partitionBy("class").orderBy(F.coalesce("total_pages", F.lit(0)), "created_at", "job_id"))
    first = j.where("status = 'queued'").withColumn("turn", turn).where(F.col("turn") <= most)
    return first.join(busy, "class", "left").where(F.col("turn") <= F.try_element_at(limit, F.col("class")) - F.coalesce("busy", F.lit(0))).select("job_id", "class", "turn")


def rate_limited(calls: DataFrame) -> DataFrame:
    """(doc, n_calls, n_limited, n_after): of each document the calls, those that were turned away, and those that came through after the first such. calls: doc, ord, limited. The count starts anew with each document."""
    first = calls.groupBy("doc").agg(F.min(F.when(F.col("limited"), F.col("ord"))).alias("_first"))
    c = calls.join(first, "doc", "left")
    return c.groupBy("doc").agg(F.count("*").alias("n_calls"), F.count_if("limited").alias("n_limited"), F.count_if(~F.col("limited") & (F.col("ord") > F.col("_first"))).alias("n_after"))


def last_results(results: DataFrame, n: int) -> DataFrame:
    """Of each group its last n results, in their order. results: grp, ord and others. No task holds more than n of a group that it has not read."""
    k = F.row_number().over(W.partitionBy("grp").orderBy(F.col("ord").desc()))
    return results.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, found by a filter that reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def accepted_uploads(files: DataFrame, largest: int = 100 * 1024 * 1024) -> DataFrame:
    """(name, size, first_id, n): uploads that are documents and not too large, each name and size once: the one that came first. files: id, name, size, at."""
    ok = F.lower("name").endswith(".pdf") & (F.col("size") <= largest)
    return files.where(ok).groupBy("name", "size").agg(F.min_by("id", F.struct("at", "id")).alias("first_id"), F.count("*").alias("n"))


def parsed_reply(reply: Column) -> Column:
    """struct(text, score) of a recogniser's reply: lines of a JSON object, each a text or an object with one; else its text; what is no object counts as text at 0.9; the empty and null reply is unreadable at 0."""
    lines = F.from_json(reply, "lines array<string>, text string")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(reply)).startswith("OBJECT"), F.lit(False))
    each = F.transform(lines["lines"], lambda x: F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(x))
    blank = T.strip(F.coalesce(reply, F.lit(""))) == ""
    text = F.when(blank, "[unreadable]").when(~is_object, reply).otherwise(F.coalesce(F.array_join(each, "\n"), lines["text"], F.lit("")))
    return F.struct(text.alias("text"), F.when(blank, 0.0).when(~is_object, 0.9).otherwise(1.0).alias("score"))


# Kinds of a user's schema and what a value of theirs is called.
KINDS = {"string": "STRING", "number": "DOUBLE|DECIMAL|BIGINT|FLOAT|INT|SMALLINT|TINYINT", "integer": "BIGINT|INT|SMALLINT|TINYINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def against_schema(df: DataFrame, key: str, json: str, schema: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, fault): what in a result does not keep to a user's schema (field: kind): missing, null where it is required, another kind, or not in the schema; fault json for what is no object. Right results give no row."""
    v = df.select(key, F.try_parse_json(F.col(json)).alias("v")).withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    out = v.where(~F.col("ok")).select(key, F.lit(None).cast("string").alias("field"), F.lit("json").alias("fault"))
    good = v.where("ok")

    def fault(name: str) -> Column:
        x = F.try_variant_get("v", f"$['{name}']", "variant")
        kind = F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
        return F.when(x.isNull(), "missing" if name in required else None).when(kind == "VOID", "null" if name in required else None).when(~kind.rlike(f"^(?:{KINDS[schema[name]]})$"), "kind")

    named = good.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("field"), fault(n).alias("fault")) for n in schema))).alias("f")).select(key, "f.*").where("fault IS NOT NULL")
    keys = F.json_object_keys(F.to_json("v"))
    extra = good.select(key, F.explode(keys).alias("field")).where(~F.col("field").isin(*schema)).withColumn("fault", F.lit("unknown"))
    return out.unionByName(named).unionByName(extra)


def heading_prompt(titles: DataFrame) -> DataFrame:
    """(job_id, page_number, prompt): what a model is asked about the headings of a page: one line a heading with its level. titles: job_id, page_number, block_idx, region_id, content, heading_level."""
    line = F.concat(F.lit("- ["), F.coalesce(F.col("heading_level").cast("string"), F.lit("?")), F.lit("] "), "content")
    each = F.sort_array(F.collect_list(F.struct("block_idx", "region_id", line.alias("line"))))
    ask = F.lit("Give every heading its level from 1 to 6 as a JSON list of text and level.\n")
    return titles.groupBy("job_id", "page_number").agg(F.concat(ask, F.array_join(F.transform(each, lambda x: x["line"]), "\n")).alias("prompt"))
