"""New table states as queries: each returns the rows that would be written, tagged with what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.rules import PATTERNS
from attestry.functions.text import content_id
from attestry.operators import budgets as B
from attestry.operators import mutations as M
from attestry.operators.aggregates import charge
from attestry.registry import Inputs, query


@query(
    "s5_idempotent_append",
    """SELECT source_id, there OR n > 1 AS duplicate FROM (SELECT i.*, EXISTS (SELECT 1 FROM v_sources e WHERE e.created % 3 = 0 AND e.owner = i.owner AND e.scope = i.scope AND e.source_key = i.source_key AND e.digest = i.digest) AS there,
    row_number() OVER (PARTITION BY owner, scope, source_key, digest ORDER BY created, source_id) AS n FROM (SELECT source_id, owner, scope, source_key, digest, created FROM v_sources UNION ALL SELECT concat('again-', source_id), owner, scope, source_key, digest, created + 1 FROM v_sources WHERE created % 5 = 0) i) x""",
)
def s5(t: Inputs) -> DataFrame:
    s = t.v_sources.select("source_id", "owner", "scope", "source_key", "digest", "created")
    again = s.where("created % 5 = 0").withColumn("source_id", F.concat(F.lit("again-"), "source_id")).withColumn("created", F.col("created") + 1)
    return M.append_sources(s.where("created % 3 = 0"), s.unionByName(again))[1]


@query(
    "s6_to_sources",
    """SELECT source_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(string_agg(sha256(concat_ws(chr(31), message_id, role, text)), '' ORDER BY turn)) AS digest FROM v_messages GROUP BY 1""",
)
def s6(t: Inputs) -> DataFrame:
    return M.to_sources(t.v_messages)


@query(
    "s7_readable_plan",
    """SELECT conv_id, segment_index, concat('readable:', substr(sha256(concat_ws(':', CAST(conv_id AS STRING), CAST(segment_index AS STRING), digest)), 1, 16)) AS source_key, (conv_id + segment_index) % 3 = 0 AS duplicate FROM v_segments WHERE n_messages > 0 AND chars > 0 AND state <> 'failed'""",
)
def s7(t: Inputs) -> DataFrame:
    key = F.concat(F.lit("readable:"), F.substring(F.sha2(F.concat_ws(":", "conv_id", "segment_index", "digest"), 256), 1, 16))
    there = t.v_segments.where("(conv_id + segment_index) % 3 = 0").select(key.alias("source_key"))
    return M.plan_readable_import(t.v_segments, there)


@query(
    "s8_topic_versions",
    """WITH n AS (SELECT owner, scope, topic AS slug, md5(CAST(count(*) AS STRING)) AS digest FROM v_records GROUP BY 1, 2, 3), v AS (SELECT owner, scope, topic AS slug, 1 AS revision, md5('old') AS digest FROM v_records WHERE k % 5 = 0 GROUP BY 1, 2, 3 UNION ALL SELECT owner, scope, slug, 2, digest FROM n WHERE slug <> 'areas'),
    l AS (SELECT owner, scope, slug, max(revision) AS revision, arg_max(digest, revision) AS digest FROM v GROUP BY 1, 2, 3) SELECT n.owner, n.scope, n.slug, n.digest, CAST(coalesce(l.revision, 0) + 1 AS INT) AS revision FROM n LEFT JOIN l ON n.owner = l.owner AND n.scope = l.scope AND n.slug = l.slug WHERE l.digest IS DISTINCT FROM n.digest""",
)
def s8(t: Inputs) -> DataFrame:
    keys = ["owner", "scope", F.col("topic").alias("slug")]
    new = t.v_records.groupBy(*keys).agg(F.md5(F.count("*").cast("string").cast("binary")).alias("digest"))
    old = t.v_records.where("k % 5 = 0").select(*keys).distinct().withColumns({"revision": F.lit(1), "digest": F.md5(F.lit("old").cast("binary"))})
    return M.write_topic_versions(new, old.unionByName(new.where("slug <> 'areas'").withColumn("revision", F.lit(2)).select("owner", "scope", "slug", "revision", "digest")))


def _has(c: str, k: str) -> str:
    return f"regexp_matches({c}, '(?i){PATTERNS[k]}')"


_DAY = "CASE WHEN created_at LIKE '2024-%' THEN substr(created_at, 1, 10) END"
#: Each rule on its own, over the test claims; no denied obligation occurs in them.
_JUDGED = f"""WITH j AS (SELECT c.*, m.role, m.text, {_DAY} AS day, m.source_title AS title, s.source_type,
    CASE WHEN s.source_type = 'imported_summary' THEN 'imported_summary' WHEN m.role = 'assistant' THEN 'agent_suggested' WHEN m.role = 'user' AND s.trusted_user THEN 'user_stated' ELSE 'source_reported' END AS status
    FROM v_judged c LEFT JOIN v_told m ON m.source_id = c.source_id AND m.message_id = c.message_id LEFT JOIN v_sources s ON s.source_id = c.source_id),
  l AS (SELECT *, concat(coalesce('来源消息日期：' || day || '（非事件成立时间，当前有效性待核实）。', ''), CASE WHEN topic = 'projects' AND title IS NOT NULL THEN '来源对话：' || title || '。' ELSE '' END) AS lead FROM j),
  o AS (SELECT *, CASE WHEN source_type <> 'imported_summary' AND starts_with(statement, lead) THEN substr(statement, length(lead) + 1) ELSE statement END AS own,
    CASE WHEN {_has('quote', 'condition')} THEN 'conditional' WHEN ({_has('quote', 'wish')} OR {_has('quote', 'plan')}) AND {_has('quote', 'asserted')} THEN 'mixed' WHEN {_has('quote', 'wish')} THEN 'wish' WHEN {_has('quote', 'plan')} THEN 'plan' ELSE 'stated' END AS modality,
    count(*) OVER (PARTITION BY source_id) > 3 OR count(*) FILTER (WHERE status = 'agent_suggested') OVER (PARTITION BY source_id) > 1 AS over_cap FROM l),
  p AS (SELECT *, CASE WHEN {_has('quote', 'permission')} AND NOT {_has('quote', 'obligation')} AND {_has('own', 'obligation')} THEN 'permission_to_obligation' WHEN modality IN ('wish', 'plan') AND NOT {_has('quote', 'asserted')} AND ({_has('own', 'asserted')} OR kind IN ('decision', 'event')) THEN 'intention'
    WHEN modality = 'conditional' AND NOT {_has('quote', 'asserted')} AND ({_has('own', 'asserted')} OR {_has('own', 'wish')} OR {_has('own', 'plan')}) AND NOT {_has('own', 'condition')} THEN 'condition_dropped' END AS promotion,
    kind IN ('claim', 'decision') AND quote LIKE '从现在起，这两条要求长期适用，直到我明确更改：回答必须简短' AND NOT (contains(own, '从现在起') AND contains(own, '长期') AND contains(own, '直到我明确更改')) AS split FROM o),
  r AS (SELECT *, list_sort(list_filter([CASE WHEN length(statement) NOT BETWEEN 1 AND 1200 OR length(subject) NOT BETWEEN 1 AND 160 OR length(quote) NOT BETWEEN 1 AND 2000 THEN 'bad_field' END,
    CASE WHEN topic = 'misc' THEN 'bad_topic' END, CASE WHEN kind = 'rumour' THEN 'bad_kind' END, CASE WHEN text IS NULL THEN 'message_missing' END, CASE WHEN text IS NOT NULL AND NOT contains(text, quote) THEN 'quote_not_in_message' END,
    CASE WHEN contains(statement, '李伟（Li Wei）') AND contains(text, 'Li Wei') THEN 'guessed_name' END, CASE WHEN text = '好的。' THEN 'message_only_agrees' END,
    CASE WHEN contains(quote, '希望') AND NOT contains(quote, '决定') AND regexp_matches(own, '用户(?:已|已经)?决定') THEN 'wish_as_decision' END, CASE WHEN contains(own, '请写一篇') THEN 'immediate_command' END,
    CASE WHEN source_type <> 'imported_summary' AND day IS NOT NULL AND NOT contains(statement, day) THEN 'source_date_dropped' END,
    CASE WHEN source_type <> 'imported_summary' AND topic = 'projects' AND title IS NOT NULL AND NOT contains(statement, title) THEN 'project_title_dropped' END,
    CASE WHEN source_type = 'imported_summary' AND NOT contains(statement, '原始时间未知') THEN 'summary_time_claimed' END, CASE WHEN source_type = 'imported_summary' AND NOT starts_with(statement, '摘要记载') THEN 'summary_not_attributed' END,
    CASE WHEN promotion IS NOT NULL THEN 'promoted' END, CASE WHEN split THEN 'rule_split' END, CASE WHEN over_cap THEN 'too_many_claims' END], lambda x: x IS NOT NULL)) AS reasons FROM p)"""


def _validated(t: Inputs) -> DataFrame:
    return M.validate_claims(t.v_judged, t.v_told, t.v_sources, 3, 1)


@query("m1_claim_admission", _JUDGED + " SELECT claim_no, status, modality, array_to_string(reasons, ',') AS reasons FROM r")
def m1(t: Inputs) -> DataFrame:
    return _validated(t).select("claim_no", "status", "modality", F.array_join("reasons", ",").alias("reasons"))


@query(
    "m2_quarantine",
    _JUDGED
    + """, s AS (SELECT claim_no, source_id, CASE WHEN len(list_filter(reasons, lambda x: x <> 'too_many_claims')) > 0 THEN 'quarantined' WHEN over_cap THEN 'batch_review_required' ELSE 'guard_passed_requires_review' END AS state FROM r)
    SELECT claim_no, state, count(*) FILTER (WHERE state = 'quarantined') OVER (PARTITION BY source_id) AS batch_quarantined FROM s""",
)
def m2(t: Inputs) -> DataFrame:
    return M.quarantine(t.v_judged, t.v_told, t.v_sources, 3, 1).select("claim_no", "state", "batch_quarantined")


_EXPECTED = "CASE g WHEN 7 THEN 'promoted' WHEN 8 THEN 'promoted' WHEN 9 THEN 'promoted' WHEN 5 THEN 'message_only_agrees' WHEN 6 THEN 'guessed_name' WHEN 14 THEN 'immediate_command' END"


@query("q13_guard_contract", _JUDGED + f" SELECT claim_no, {_EXPECTED} AS expected, array_to_string(reasons, ',') AS found, {_EXPECTED} IS NULL OR list_contains(reasons, {_EXPECTED}) AS passed FROM r")
def q13(t: Inputs) -> DataFrame:
    """Every case against the reason that its kind of fault must give; all admission rules judge each."""
    rows = _validated(t).withColumn("expected", F.expr(_EXPECTED))
    return rows.select("claim_no", "expected", F.array_join("reasons", ",").alias("found"), (F.col("expected").isNull() | F.array_contains("reasons", F.col("expected"))).alias("passed"))


@query(
    "m3_append_records",
    """SELECT claim_no FROM (SELECT *, row_number() OVER (PARTITION BY source_id, message_id, statement ORDER BY claim_no) AS n FROM v_claims c WHERE NOT EXISTS (SELECT 1 FROM v_records r WHERE r.source_id = c.source_id AND r.message_id = c.message_id AND r.statement = c.statement)) WHERE n = 1""",
)
def m3(t: Inputs) -> DataFrame:
    return M.append_records(t.v_records, t.v_claims).select("claim_no")


_CORRECTED = """WITH j AS (SELECT c.*, r.lifecycle, r.revision AS cur, coalesce(r.lifecycle = 'active' AND r.revision = c.revision, false) AS ok FROM v_corrections c LEFT JOIN (SELECT record_id, lifecycle, revision FROM v_records) r USING (record_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY record_id, ok ORDER BY created, correction_id) AS n FROM j), t AS (SELECT * FROM n WHERE ok AND n = 1)"""


@query(
    "m4_corrections",
    _CORRECTED
    + """ SELECT r.record_id, r.revision, r.statement, r.supersedes, CASE WHEN t.record_id IS NOT NULL THEN 'superseded' ELSE r.lifecycle END AS lifecycle FROM v_records r LEFT JOIN t ON t.record_id = r.record_id
    UNION ALL SELECT concat(record_id, '/', correction_id), cur + 1, statement, record_id, 'active' FROM t""",
)
def m4(t: Inputs) -> DataFrame:
    return M.apply_corrections(t.v_records, t.v_corrections)[0].select("record_id", "revision", "statement", "supersedes", "lifecycle")


@query("m4_correction_conflicts", _CORRECTED + " SELECT correction_id, record_id, CASE WHEN lifecycle IS NULL THEN 'unknown_record' WHEN lifecycle <> 'active' THEN 'not_active' WHEN NOT ok THEN 'stale_revision' ELSE 'already_corrected' END AS reason FROM n WHERE NOT ok OR n > 1")
def m4c(t: Inputs) -> DataFrame:
    return M.apply_corrections(t.v_records, t.v_corrections)[1]


@query(
    "m5_owner_edits",
    """WITH e AS (SELECT owner, scope, concat('k', CAST(k % 150 AS STRING)) AS request_key, md5(CASE WHEN k % 2 = 0 THEN 'same' ELSE statement END) AS digest, k AS created FROM v_records), s AS (SELECT owner, scope, request_key, digest FROM e WHERE created % 40 = 0),
    f AS (SELECT owner, scope, request_key, arg_min(digest, (created, digest)) AS first, min(created) AS at FROM (SELECT owner, scope, request_key, digest, created FROM e UNION ALL SELECT owner, scope, request_key, digest, -1 FROM s) GROUP BY 1, 2, 3)
    SELECT e.*, CASE WHEN f.at = e.created AND e.digest = f.first THEN 'new' WHEN e.digest = f.first THEN 'duplicate' ELSE 'conflict' END AS outcome FROM e JOIN f USING (owner, scope, request_key)""",
)
def m5(t: Inputs) -> DataFrame:
    e = t.v_records.select("owner", "scope", F.concat(F.lit("k"), (F.col("k") % 150).cast("string")).alias("request_key"), F.md5(F.when(F.col("k") % 2 == 0, "same").otherwise(F.col("statement")).cast("binary")).alias("digest"), F.col("k").alias("created"))
    return M.apply_owner_edits(e, e.where("created % 40 = 0").select("owner", "scope", "request_key", "digest"))


_REVIEWED = """WITH j AS (SELECT w.*, r.lifecycle, coalesce(g.revision, 0) AS cur, g.state AS before, coalesce(r.lifecycle = 'active' AND w.revision = coalesce(g.revision, 0), false) AS ok FROM v_reviews w LEFT JOIN (SELECT record_id, lifecycle FROM v_records) r USING (record_id) LEFT JOIN (SELECT record_id, revision, state FROM v_governance) g USING (record_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY record_id, ok ORDER BY created, review_id) AS n FROM j), t AS (SELECT * FROM n WHERE ok AND n = 1)"""


@query("m6_reviews", _REVIEWED + " SELECT record_id, holder, state, priority, as_of, revision FROM v_governance g WHERE record_id NOT IN (SELECT record_id FROM t) UNION ALL SELECT record_id, holder, state, priority, as_of, CAST(cur + 1 AS INT) FROM t")
def m6(t: Inputs) -> DataFrame:
    return M.apply_reviews(t.v_governance, t.v_reviews, t.v_records)[0].select("record_id", "holder", "state", "priority", "as_of", "revision")


@query("m6_review_events", _REVIEWED + " SELECT review_id, record_id, coalesce(before, 'candidate') AS previous_state, state AS current_state FROM t")
def m6e(t: Inputs) -> DataFrame:
    return M.apply_reviews(t.v_governance, t.v_reviews, t.v_records)[1]


@query("m6_review_conflicts", _REVIEWED + " SELECT review_id, record_id, CASE WHEN lifecycle IS NULL THEN 'unknown_record' WHEN lifecycle <> 'active' THEN 'not_active' ELSE 'revision_changed' END AS reason FROM n WHERE NOT (ok AND n = 1)")
def m6c(t: Inputs) -> DataFrame:
    return M.apply_reviews(t.v_governance, t.v_reviews, t.v_records)[2]


_CHANGED = """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY created) AS n FROM v_changes) WHERE n = 1 AND request_key NOT IN (SELECT request_key FROM v_changes WHERE created % 100 = 5)),
    j AS (SELECT f.*, g.as_of AS old, CASE WHEN previous_valid_until IS NOT NULL AND change_kind <> 'viewpoint_change' THEN 'end_not_allowed' WHEN previous_valid_until < g.as_of THEN 'end_before_start' END AS reason FROM f LEFT JOIN (SELECT record_id, as_of FROM v_governance) g USING (record_id))"""


def _changes(t: Inputs) -> tuple[DataFrame, DataFrame]:
    return M.append_changes(t.v_changes, t.v_changes.where("created % 100 = 5"), t.v_governance)


@query("m7_change_audit", _CHANGED + " SELECT request_key, record_id, change_kind, valid_from, previous_valid_until, CASE WHEN change_kind = 'withdrawal' THEN 'rejected' ELSE 'candidate' END AS new_state FROM j WHERE reason IS NULL")
def m7(t: Inputs) -> DataFrame:
    return _changes(t)[0]


@query("m7_changes_refused", _CHANGED + " SELECT request_key, record_id, reason FROM j WHERE reason IS NOT NULL")
def m7r(t: Inputs) -> DataFrame:
    return _changes(t)[1]


@query(
    "m8_entity_registration",
    """WITH i AS (SELECT DISTINCT owner, scope, CASE WHEN k % 10 = 0 THEN concat('owner:', owner) ELSE concat('ent-', CAST(k % 15 AS STRING)) END AS id, CASE WHEN k % 15 = 4 THEN 'Other' ELSE concat('Entity ', CAST(k % 15 AS STRING)) END AS name FROM v_records WHERE k % 3 = 1)
    SELECT i.owner, i.scope, i.id, CASE WHEN starts_with(i.id, 'owner:') THEN 'reserved' WHEN e.name IS NULL THEN 'new' WHEN e.name = i.name THEN 'duplicate' ELSE 'conflict' END AS outcome FROM i LEFT JOIN v_entities e ON e.owner = i.owner AND e.scope = i.scope AND e.id = i.id""",
)
def m8(t: Inputs) -> DataFrame:
    k = F.col("k")
    one = t.v_records.where("k % 3 = 1").select("owner", "scope", F.when(k % 10 == 0, F.concat(F.lit("owner:"), "owner")).otherwise(F.concat(F.lit("ent-"), (k % 15).cast("string"))).alias("id"), F.when(k % 15 == 4, "Other").otherwise(F.concat(F.lit("Entity "), (k % 15).cast("string"))).alias("name"))
    return M.register_entities(t.v_entities, one.distinct())


@query(
    "m9_translations",
    """WITH i AS (SELECT record_id, 'fr' AS language, concat('new: ', statement) AS display_statement, k AS created, CASE WHEN k % 6 = 0 THEN 'stale' ELSE statement END AS original FROM v_records WHERE k % 3 = 0),
    l AS (SELECT i.* FROM i JOIN v_records r ON r.record_id = i.record_id AND r.lifecycle = 'active' AND r.statement = i.original), b AS (SELECT *, 0 AS new FROM v_translations UNION ALL SELECT record_id, language, display_statement, created, 1 FROM l)
    SELECT record_id, language, display_statement FROM (SELECT *, row_number() OVER (PARTITION BY record_id, language ORDER BY new DESC, created DESC) AS n FROM b) WHERE n = 1""",
)
def m9(t: Inputs) -> DataFrame:
    i = t.v_records.where("k % 3 = 0").select("record_id", F.lit("fr").alias("language"), F.concat(F.lit("new: "), "statement").alias("display_statement"), F.col("k").alias("created"), F.when(F.col("k") % 6 == 0, "stale").otherwise(F.col("statement")).alias("original"))
    return M.apply_translations(t.v_translations, i, t.v_records).select("record_id", "language", "display_statement")


def _old_chunks(t: Inputs) -> DataFrame:
    """What an older index would hold: one chunk a message, with the version's digest."""
    m = t.v_messages.join(t.v_versions.select("source_id", "digest"), "source_id")
    return m.select("source_id", "digest", "message_id", F.lit(0).alias("start_char"), F.length("text").alias("end_char"))


@query(
    "m10_index_refresh",
    """WITH p AS (SELECT s.source_id, s.digest, CASE WHEN s.digest = v.digest AND v.index_version = 'idx-2' THEN 'unchanged' ELSE 'redo' END AS a FROM v_sources s LEFT JOIN v_versions v ON s.source_id = v.source_id)
    SELECT m.source_id, p.digest, message_id, 0 AS start_char, CAST(length(text) AS INT) AS end_char FROM v_messages m JOIN p USING (source_id) WHERE a = 'unchanged'
    UNION ALL SELECT source_id, digest, message_id, CAST(i * 180 AS INT), CAST(least(i * 180 + 200, length(text)) AS INT) FROM (SELECT m.*, p.digest, unnest(range(0, CAST(1 + length(text) // 180 AS BIGINT))) AS i FROM v_messages m JOIN p USING (source_id) WHERE a = 'redo' AND length(text) > 0) x
      WHERE i < greatest(1, ceil((length(text) - 20) / 180.0)) AND trim(substr(text, CAST(i * 180 + 1 AS INT), 200)) <> ''""",
)
def m10(t: Inputs) -> DataFrame:
    return M.refresh_index(_old_chunks(t), t.v_versions, t.v_sources, t.v_messages.select("source_id", "message_id", "text"), "idx-2", 200, 20)


_ID = "sha256(concat_ws(chr(31), source_id, message_id, '0', text))"
_EDITED = "SELECT source_id, message_id, CASE WHEN message_id = 'm1' THEN concat(substr(text, 1, 150), '!') ELSE substr(text, 1, 150) END AS text FROM v_messages WHERE text <> ''"
_EDITED_SQL = f"SELECT * FROM ({_EDITED}) x WHERE trim(text) <> ''"


@query(
    "m10_chunk_changes",
    f"""WITH o AS (SELECT {_ID} AS chunk_id, source_id FROM (SELECT source_id, message_id, substr(text, 1, 150) AS text FROM v_messages WHERE text <> '') x),
    p AS (SELECT v.source_id, s.source_id IS NULL AS removed FROM v_versions v LEFT JOIN (SELECT source_id, digest FROM v_sources) s ON s.source_id = v.source_id WHERE s.source_id IS NULL OR s.digest <> v.digest OR v.index_version <> 'idx-2'
      UNION ALL SELECT source_id, false FROM v_sources WHERE source_id NOT IN (SELECT source_id FROM v_versions)),
    f AS (SELECT {_ID} AS chunk_id, source_id FROM ({_EDITED_SQL}) y WHERE source_id IN (SELECT source_id FROM p WHERE NOT removed)),
    h AS (SELECT * FROM o WHERE source_id IN (SELECT source_id FROM p) AND source_id IN (SELECT source_id FROM v_versions))
    SELECT 'added' AS action, chunk_id FROM f WHERE chunk_id NOT IN (SELECT chunk_id FROM h) UNION ALL SELECT 'gone', chunk_id FROM h WHERE chunk_id NOT IN (SELECT chunk_id FROM f)""",
)
def m10c(t: Inputs) -> DataFrame:
    """The beginnings of messages, of which the second of each conversation was edited: an index writes those alone."""
    old = t.v_messages.where("text <> ''").select("source_id", "message_id", F.substring("text", 1, 150).alias("text"))
    chunks = old.select(content_id("source_id", "message_id", F.lit(0), "text").alias("chunk_id"), "source_id").join(t.v_versions.select("source_id"), "source_id", "left_semi")
    new = old.withColumn("text", F.when(F.col("message_id") == "m1", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added, gone = M.chunk_changes(chunks, t.v_versions, t.v_sources, new, "idx-2")
    return added.select(F.lit("added").alias("action"), "chunk_id").unionByName(gone.select(F.lit("gone").alias("action"), "chunk_id"))


@query(
    "m11_budget_admission",
    """WITH RECURSIVE a AS (SELECT attempt_id, owner, scope, coalesce(total_tokens, prompt_tokens + completion_tokens, reservation) AS size, row_number() OVER (PARTITION BY owner, scope ORDER BY attempt_id) AS i FROM v_attempts),
    w AS (SELECT a.owner, a.scope, attempt_id, i, cap, size <= cap AS admitted, CASE WHEN size <= cap THEN size ELSE 0 END AS spent FROM a JOIN v_budgets b ON b.owner = a.owner AND b.scope = a.scope WHERE i = 1
      UNION ALL SELECT a.owner, a.scope, a.attempt_id, a.i, cap, spent + size <= cap, CASE WHEN spent + size <= cap THEN spent + size ELSE spent END FROM w JOIN a ON a.owner = w.owner AND a.scope = w.scope AND a.i = w.i + 1)
    SELECT attempt_id AS request_id, admitted FROM w""",
)
def m11(t: Inputs) -> DataFrame:
    asks = t.v_attempts.select(F.col("attempt_id").alias("request_id"), "owner", "scope", charge().alias("allowance"))
    return B.admit_under_budget(asks, t.v_budgets)


@query("t7_budget_skip")
def t7(t: Inputs) -> DataFrame:
    rows = t.v_messages.select(F.col("source_id").alias("query_id"), F.col("turn").alias("rank"), (F.length("text") + 60).alias("size"))
    return B.fill_budget_skip(rows, 900, 60)


@query(
    "t9_evidence_bundle",
    """WITH e AS (SELECT source_id AS query_id, 'trusted' AS "group", row_number() OVER (PARTITION BY source_id ORDER BY turn) AS rank, length(text) + 40 AS size FROM v_messages WHERE role = 'user'
      UNION ALL SELECT source_id, 'candidate', row_number() OVER (PARTITION BY source_id ORDER BY turn), length(text) + 40 FROM v_messages WHERE role = 'assistant' UNION ALL SELECT source_id, 'original', row_number() OVER (PARTITION BY source_id ORDER BY turn DESC), length(text) + 80 FROM v_messages),
    o AS (SELECT *, CASE "group" WHEN 'trusted' THEN CASE WHEN rank = 1 THEN 0 ELSE 2 END WHEN 'original' THEN CASE WHEN rank = 1 THEN 1 ELSE 3 END ELSE 4 END AS ord FROM e)
    SELECT query_id, "group", CAST(rank AS INT) AS rank FROM (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY ord, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM o) WHERE used <= 1500""",
)
def t9(t: Inputs) -> DataFrame:
    from pyspark.sql.window import Window

    def ranked(df: DataFrame, more: int, *order) -> DataFrame:
        return df.select(F.col("source_id").alias("query_id"), F.row_number().over(Window.partitionBy("source_id").orderBy(*order)).alias("rank"), (F.length("text") + more).alias("size"))

    m = t.v_messages
    return B.evidence_bundle(ranked(m.where("role = 'user'"), 40, "turn"), ranked(m.where("role = 'assistant'"), 40, "turn"), ranked(m, 80, F.desc("turn")), 1500)


@query("t10_text_pages", "SELECT doc_id, CAST(i AS INT) AS page_no, substr(text, CAST(i * 500 + 1 AS INT), 500) AS page, CASE WHEN (i + 1) * 500 < length(text) THEN CAST((i + 1) * 500 AS INT) END AS next_offset FROM (SELECT *, unnest(range(0, CAST(1 + coalesce(length(text), 0) // 500 AS BIGINT))) AS i FROM documents) WHERE i < greatest(1, ceil(length(text) / 500.0))")
def t10(t: Inputs) -> DataFrame:
    return B.paginate_text(t.documents.select("doc_id", "text"), 500)
