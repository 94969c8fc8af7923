"""Exports, topic documents, windows of activity, and the compositions that have no place elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import rules, spans
from attestry.functions.text import content_id
from attestry.operators import budgets as B
from attestry.operators import documents as D
from attestry.operators import joins as J
from attestry.operators import mutations as M
from attestry.operators import predicates as P
from attestry.operators import retrieval as R
from attestry.operators import windows as W
from attestry.operators.lineage import shared_dir, written
from attestry.plans.core import _GOV, _USABLE, day, governed
from attestry.registry import Inputs, query
from attestry.sources import exports as X
from attestry.streaming import jobs as ST


def _exported(t: Inputs) -> DataFrame:
    """The conversations in the shape of an export: every third message has typed blocks, one of them hidden."""
    c = t.conversations
    block = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hidden").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text")))
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    m = F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("uuid"), sender.alias("sender"), F.lit("2024-01-01").alias("created_at"), F.col("text"), F.when(F.col("turn") % 3 == 0, block).alias("content"), F.col("turn"))
    out = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), m.alias("m")))).alias("ms"))
    return out.select(F.col("conv_id").cast("string").alias("uuid"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("name"), F.lit("2024-01-01").alias("created_at"), F.transform("ms", lambda x: x["m"].dropFields("turn")).alias("chat_messages"))


_EXPORT = "SELECT CAST(conv_id AS STRING) AS conversation_id, concat('Talk ', CAST(conv_id AS STRING)) AS title, CAST(turn AS INT) AS message_no, concat('m', CAST(turn AS STRING)) AS message_id, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'external' END AS role, '2024-01-01' AS created_at, 0 AS block_no, text FROM conversations"


@query("s1_export_scan", _EXPORT)
def s1(t: Inputs) -> DataFrame:
    return X.flatten_conversations(_exported(t))


@query("s1_export_files", _EXPORT)
def s1f(t: Inputs) -> DataFrame:
    """The export written as files of one JSON list each, and read again."""
    folder = f"{shared_dir(t.spark)}/export-{uuid.uuid4().hex}"
    every = _exported(t).select(F.floor(F.col("uuid").cast("long") / 50).alias("f"), F.to_json(F.struct("uuid", "name", "created_at", "chat_messages")).alias("j"))
    # one line a file: a list whose elements follow each other
    lists = every.groupBy("f").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n "), F.lit("]")).alias("value"))
    lists.select("value").repartition("value").write.text(folder)
    return X.read_conversation_export(t.spark, folder)


@query("p1_visible_blocks", "SELECT CAST(conv_id AS STRING) AS conversation_id, concat('m', CAST(turn AS STRING)) AS message_id, 1 AS blocks, length(text) AS chars FROM conversations")
def p1(t: Inputs) -> DataFrame:
    m = _exported(t).select(F.col("uuid").alias("conversation_id"), F.explode("chat_messages").alias("m"))
    seen = X.visible_blocks(F.col("m.content"), F.col("m.text"))
    return m.select("conversation_id", F.col("m.uuid").alias("message_id"), F.size(seen).alias("blocks"), F.length(F.array_join(seen, "")).alias("chars"))


@query(
    "s2_summary_memories",
    """SELECT concat('file:', CAST(doc_id AS STRING)) AS key, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'conversations', md5(text) FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT concat('project:', source), md5(text) FROM documents""",
)
def s2(t: Inputs) -> DataFrame:
    shape = t.documents.select(
        F.when(F.col("doc_id") % 50 == 0, F.col("text")).alias("conversations_memory"),
        F.array(F.struct(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("2024-01-01").alias("updated_at"))).alias("memory_files"),
        F.create_map("source", "text").alias("project_memories"),
    )
    return X.flatten_memories(shape).select("key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("s3_file_manifest")
def s3(t: Inputs) -> DataFrame:
    files = X.scan_manifest(t.spark, t.sf_dir)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "digest")


@query(
    "p10_evidence_class",
    """SELECT record_id, CASE WHEN quote = '' THEN 'missing_quote' WHEN NOT contains(text, quote) AND contains('hidden # text', quote) THEN 'excluded_block_quote' WHEN contains(text, quote) AND source_type = 'imported_summary' THEN 'secondary_quote_present' WHEN contains(text, quote) THEN 'visible_quote_present' ELSE 'quote_missing' END AS class
    FROM (SELECT r.record_id, CASE WHEN k % 5 = 0 THEN '#' WHEN k % 17 = 0 THEN '' ELSE quote END AS quote, m.text, s.source_type FROM v_records r JOIN v_messages m USING (source_id, message_id) JOIN (SELECT source_id, source_type FROM v_sources) s USING (source_id))""",
)
def p10(t: Inputs) -> DataFrame:
    r = J.hydrate(J.with_evidence(t.v_records, t.v_messages), t.v_sources)
    quote = F.when(F.col("k") % 5 == 0, "#").when(F.col("k") % 17 == 0, "").otherwise(F.col("quote"))
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hidden # text").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text")))
    return r.select("record_id", D.evidence_class(quote, blocks, F.col("source_type") == "imported_summary").alias("class"))


def _topic_lines(t: Inputs) -> DataFrame:
    rows, directories = D.topic_pages(D.topic_records(governed(t), t.v_sources, t.v_topics), 8)
    return D.topic_lines(rows, day()).unionByName(D.directory_lines(directories))


@query("a18_topic_documents")
def a18(t: Inputs) -> DataFrame:
    return D.render_topics(_topic_lines(t))


@query(
    "a18_topic_sections",
    f"""WITH r AS (SELECT DISTINCT g.*, t.slug FROM ({_GOV}) g JOIN v_sources s ON s.source_id = g.source_id JOIN (SELECT owner, scope, slug, unnest(prefixes) AS prefix FROM v_topics) t ON t.owner = s.owner AND t.scope = s.scope AND starts_with(s.source_key, t.prefix)),
    s AS (SELECT *, CASE WHEN state = 'verified' THEN CASE WHEN {_USABLE} THEN 1 ELSE 3 END WHEN state = 'historical' THEN 3 WHEN state = 'rejected' THEN 4 WHEN status = 'agent_suggested' THEN 7 ELSE 2 END AS section FROM r),
    k AS (SELECT owner, scope, slug, section, status, kind, state, subject, {{key}} AS said FROM s WHERE lifecycle = 'active')
    SELECT owner, scope, slug, section, count(*) AS n FROM (SELECT DISTINCT owner, scope, slug, status, kind, state, subject, said, last_value(section) OVER (PARTITION BY owner, scope, slug, status, kind, state, subject, said) AS section FROM k) x GROUP BY 1, 2, 3, 4
    UNION ALL SELECT owner, scope, slug, 9, count(*) FROM r WHERE supersedes IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT owner, scope, slug, 10, count(*) FROM r GROUP BY 1, 2, 3""".replace("{key}", "regexp_replace(regexp_replace(statement, '\\s+', '', 'g'), '^[。.!！]+|[。.!！]+$', '', 'g')"),
)
def a18s(t: Inputs) -> DataFrame:
    """How many entries each section of an unpaged document has."""
    lines = D.topic_lines(D.topic_records(governed(t), t.v_sources, t.v_topics), day())
    return lines.where("section > 0 and place.created is not null").groupBy("owner", "scope", "slug", "section").agg(F.count("*").alias("n"))


@query("q6_topic_versions")
def q6(t: Inputs) -> DataFrame:
    new = a18(t).withColumn("digest", F.sha2("text", 256))
    old = new.where("owner <> 'owner-1'").select("owner", "scope", "slug", F.lit(1).alias("revision"), F.when(F.col("slug") == "alpha", "other").otherwise(F.col("digest")).alias("digest"))
    return M.write_topic_versions(new, old)


@query("q7_bulk_plan")
def q7(t: Inputs) -> DataFrame:
    rows = X.flatten_conversations(_exported(t)).where("text is not null")
    parts = spans.split_serialized(rows, 800).withColumn("turn", (F.col("message_no") * 1000 + F.col("part_no")).cast("long"))
    parts = parts.select(F.col("conversation_id").alias("conv_id"), "turn", "message_id", "role", F.col("part").alias("text"))
    segs = parts.join(spans.pack_segments(parts, 100, 2000), ["conv_id", "turn"])
    out = segs.groupBy("conv_id", "segment_index").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("chars"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest"))
    sample = W.timeline_sample(out.withColumn("day", F.concat(F.lit("2024-"), F.lpad((F.col("conv_id").cast("int") % 12 + 1).cast("string"), 2, "0")))).withColumn("phase", F.lit("sample"))
    return out.join(sample, ["conv_id", "segment_index"], "left").withColumn("phase", F.coalesce("phase", F.lit("remaining")))


@query("st1_distinct_sources", "SELECT owner, scope, concat('k', CAST(attempt_id % 97 AS STRING)) AS source_key, CAST(attempt_id % 3 AS STRING) AS digest FROM v_attempts GROUP BY ALL")
def st1(t: Inputs) -> DataFrame:
    a = t.v_attempts.select("owner", "scope", F.concat(F.lit("k"), (F.col("attempt_id") % 97).cast("string")).alias("source_key"), (F.col("attempt_id") % 3).cast("string").alias("digest"), "ts")
    return ST.stream_sources(a).select("owner", "scope", "source_key", "digest")


_BURSTS = """WITH g AS (SELECT owner, scope, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS s FROM v_attempts WINDOW w AS (PARTITION BY owner, scope ORDER BY ts)), n AS (SELECT *, sum(s) OVER (PARTITION BY owner, scope ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g)
    SELECT owner, scope, min(ts) AS started, max(ts) + INTERVAL 5 MINUTE AS ended, count(*) AS arrivals FROM n GROUP BY owner, scope, g"""


@query(
    "st2_scope_bursts",
    _BURSTS,
)
def st2(t: Inputs) -> DataFrame:
    return ST.scope_bursts(t.v_attempts, "5 minutes")


@query(
    "st3_index_upkeep",
    """WITH s AS (SELECT s.source_id, s.digest, v.digest IS NOT NULL AND v.digest = s.digest AND v.index_version = 'idx-2' AS unchanged FROM v_sources s LEFT JOIN v_versions v USING (source_id)),
    n AS (SELECT m.source_id, s.digest, m.message_id, m.text, unnest(range(0, CAST(greatest(1, ceil((length(m.text) - 100) / 900.0)) AS BIGINT))) AS i FROM v_messages m JOIN s USING (source_id) WHERE NOT unchanged AND length(m.text) > 0)
    SELECT m.source_id, s.digest, m.message_id, 0 AS start_char, CAST(length(m.text) AS INT) AS end_char FROM v_messages m JOIN s USING (source_id) WHERE unchanged
    UNION ALL SELECT source_id, digest, message_id, CAST(i * 900 AS INT), CAST(least(i * 900 + 1000, length(text)) AS INT) FROM n WHERE trim(substr(text, CAST(i * 900 + 1 AS INT), 1000)) <> ''
    UNION ALL SELECT source_id, digest, 'm0', 0, 7 FROM v_versions WHERE starts_with(source_id, 'ghost-')""",
)
def st3(t: Inputs) -> DataFrame:
    """All messages as one batch over an index that holds one long chunk a message, some of old digests or versions, and chunks of sources outside the batch."""
    kept: list[DataFrame] = []
    old = t.v_messages.join(t.v_versions.select("source_id", "digest"), "source_id").select("source_id", "digest", "message_id", F.lit(0).alias("start_char"), F.length("text").alias("end_char"))
    ghosts = t.v_versions.where("startswith(source_id, 'ghost-')").select("source_id", "digest", F.lit("m0").alias("message_id"), F.lit(0).alias("start_char"), F.lit(7).alias("end_char"))
    batch = t.v_messages.join(t.v_sources.select("source_id", "digest"), "source_id").select("source_id", "digest", "message_id", "text")
    ST.index_batches(lambda: (old.unionByName(ghosts), t.v_versions), kept.append, "idx-2")(batch, 0)
    return kept[0].select("source_id", "digest", "message_id", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))


@query("st4_review_machine")
def st4(t: Inputs) -> DataFrame:
    r = t.v_reviews.select("record_id", "review_id", "revision", "created")
    return ST.batch_reviews(r.unionByName(r.withColumn("review_id", F.concat("review_id", F.lit("b"))).withColumn("revision", F.lit(1)).withColumn("created", F.col("created") + 1)))


@query("st5_running_ledger", "SELECT owner, scope, count(*) AS attempts, CAST(sum(coalesce(total_tokens, prompt_tokens + completion_tokens, reservation)) AS BIGINT) AS charged FROM v_attempts GROUP BY 1, 2")
def st5(t: Inputs) -> DataFrame:
    return ST.running_ledger(t.v_attempts)


@query("st6_activity_windows", "SELECT operation, time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') AS started, count(*) AS n FROM v_attempts GROUP BY 1, 2")
def st6(t: Inputs) -> DataFrame:
    return ST.activity(t.v_attempts)


def _attempt_stream(t: Inputs) -> DataFrame:
    """The events as a stream of attempts, by the rule of ``v_attempts``."""
    shape = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    events = t.spark.readStream.schema(shape).option("maxFilesPerTrigger", 2).parquet(f"{t.sf_dir}/event[s].parquet")
    return events.select(F.concat(F.lit("owner-"), (F.col("user_id") % 3).cast("string")).alias("owner"), F.concat(F.lit("scope-"), (F.col("user_id") % 4).cast("string")).alias("scope"), F.col("event_type").alias("operation"), F.expr("cast(concat(cast(ts AS string), 'Z') AS timestamp)").alias("ts"))


def _ran(t: Inputs, stream: DataFrame, name: str, mode: str) -> DataFrame:
    out = ST.run_to_end(stream, f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}", mode)
    # watermarks need instants; the given times have no zone
    return out.withColumns({f.name: F.expr(f"convert_timezone(current_timezone(), 'UTC', cast({f.name} AS timestamp_ntz))") for f in out.schema if f.dataType.typeName() == "timestamp"})


@query("st2_bursts_streamed", _BURSTS)
def st2s(t: Inputs) -> DataFrame:
    return _ran(t, ST.scope_bursts(_attempt_stream(t), "5 minutes"), "bursts", "complete")


@query("st6_activity_streamed", "SELECT operation, started, count(*) AS n FROM (SELECT operation, unnest([time_bucket(INTERVAL 12 hour, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 hour, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 hour]) AS started FROM v_attempts) x GROUP BY 1, 2")
def st6s(t: Inputs) -> DataFrame:
    return _ran(t, ST.activity(_attempt_stream(t), "1 day", "12 hours"), "activity", "complete")


def _evidence(t: Inputs, asked: DataFrame) -> DataFrame:
    live = J.live_chunks(t.v_versions, P.eligible(t.v_sources).select("source_id", "digest")).select("source_id", "digest")
    chunks = spans.chunk_text(t.v_messages.join(live, "source_id").select("source_id", "digest", "message_id", "turn", "text"), 400, 40)
    chunks = chunks.withColumn("record_id", content_id("source_id", "digest", "message_id", "start_char"))
    top = R.search_top(chunks.select("record_id", F.col("chunk").alias("statement")), asked, 20, mode="v3")
    # a chunk's size is known by where it stands: its text stays behind
    places = chunks.select("record_id", "source_id", "message_id", "start_char", "end_char", (F.col("end_char") - F.col("start_char") + 80).alias("size"))
    return W.fill_budget_stop(top.join(places, "record_id"), 2000).select("query_id", "rank", "score", F.col("record_id").alias("chunk_id"), "source_id", "message_id", "start_char", "end_char")


@query("q3_source_evidence")
def q3(t: Inputs) -> DataFrame:
    """Chunks of live sources for each task, with locators, within a budget of characters."""
    return _evidence(t, t.v_records.where("k % 50 = 0").select(F.col("record_id").alias("query_id"), F.lower("statement").alias("query")))


@query("q4_task_bundle")
def q4(t: Inputs) -> DataFrame:
    """For each query what is trusted, what is only reported, and the original evidence, within one budget.

    Active records and queries are written once; all three searches read these.
    """
    candidate = (F.col("state") == "candidate").alias("candidate")
    gov = written(governed(t).select("record_id", "k", "statement", "lifecycle", candidate, P.usable_on(day()).alias("usable"), "priority").where("lifecycle = 'active' or k % 50 = 0"), "governed")
    asked = gov.where("k % 50 = 0").select(F.col("record_id").alias("query_id"), F.lower("statement").alias("query"))
    active = gov.where("lifecycle = 'active'")
    sizes = active.select("record_id", (F.length("statement") + 60).alias("size"))
    texts = active.select("record_id", "statement")
    trusted = R.trusted_context(texts, asked, active.where("usable"), 10).join(sizes, "record_id")
    reports = R.search_top(active.where("candidate").select("record_id", "statement"), asked, 10).join(sizes, "record_id")
    found = _evidence(t, asked).withColumn("size", F.col("end_char") - F.col("start_char") + 80)
    return B.evidence_bundle(trusted, reports, found.select("query_id", "rank", "size"), 3000)
