"""Overviews, ledgers, audits, metrics and coverage as queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import aggregates as A
from attestry.operators import joins as J
from attestry.operators import windows as W
from attestry.plans.core import _CROSS, _GOV, _REFS, day, governed, readable
from attestry.registry import Inputs, query


@query(
    "a1_scope_overview",
    f"""SELECT coalesce(s.owner, r.owner) AS owner, coalesce(s.scope, r.scope) AS scope, coalesce(sources, 0) AS sources, coalesce(active, 0) AS active, coalesce(usable, 0) AS usable, coalesce(candidate, 0) AS candidate, coalesce(historical, 0) AS historical, coalesce(rejected, 0) AS rejected
    FROM (SELECT owner, scope, count(*) AS sources FROM v_sources WHERE source_type <> 'correction' GROUP BY 1, 2) s FULL JOIN (
    SELECT owner, scope, count(*) FILTER (WHERE lifecycle = 'active') AS active, count(*) FILTER (WHERE lifecycle = 'active' AND state = 'verified' AND holder IS NOT NULL AND subject_id IS NOT NULL AND as_of <= DATE '2024-02-01' AND (valid_until IS NULL OR valid_until > DATE '2024-02-01')) AS usable,
    count(*) FILTER (WHERE lifecycle = 'active' AND state = 'candidate') AS candidate, count(*) FILTER (WHERE state = 'historical') AS historical, count(*) FILTER (WHERE state = 'rejected') AS rejected FROM ({_GOV}) GROUP BY 1, 2) r ON s.owner = r.owner AND s.scope = r.scope""",
)
def a1(t: Inputs) -> DataFrame:
    return A.overview(governed(t), t.v_sources, day())


@query("a2_status_histogram", "SELECT status, lifecycle, count(*) AS n FROM v_records GROUP BY 1, 2")
def a2(t: Inputs) -> DataFrame:
    return A.status_counts(t.v_records, "status", "lifecycle")


@query(
    "a3_batch_status",
    """SELECT phase, count(*) AS total, count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'processing') AS processing, count(*) FILTER (WHERE state = 'applied') AS applied, count(*) FILTER (WHERE state = 'failed') AS failed,
    CAST(sum(spent_tokens) FILTER (WHERE state = 'applied') AS BIGINT) AS spent, CAST(round_even(sum(spent_tokens) FILTER (WHERE state = 'applied')::DOUBLE / count(*) FILTER (WHERE state = 'applied') * count(*), 0) AS BIGINT) AS projected FROM v_segments GROUP BY phase""",
)
def a3(t: Inputs) -> DataFrame:
    return A.batch_status(t.v_segments)


@query(
    "a4_conversation_state",
    """SELECT conv_id, CASE WHEN bad > 0 THEN 'failed' WHEN done = n THEN 'processed' WHEN busy > 0 OR done > 0 THEN 'processing' ELSE 'not_processed' END AS state FROM (
    SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE state = 'failed') AS bad, count(*) FILTER (WHERE state = 'applied') AS done, count(*) FILTER (WHERE state = 'processing') AS busy FROM v_segments GROUP BY 1)""",
)
def a4(t: Inputs) -> DataFrame:
    return A.conversation_state(t.v_segments)


@query(
    "a5_usage_ledger",
    """WITH o AS (SELECT owner, scope, operation, count(*) AS attempts, CAST(sum(coalesce(total_tokens, prompt_tokens + completion_tokens, reservation)) AS BIGINT) AS charged,
    count(*) FILTER (WHERE total_tokens IS NULL AND (prompt_tokens IS NULL OR completion_tokens IS NULL)) AS unresolved FROM v_attempts GROUP BY 1, 2, 3)
    SELECT o.*, CAST(b.cap - sum(charged) OVER (PARTITION BY o.owner, o.scope) AS BIGINT) AS "left" FROM o LEFT JOIN v_budgets b ON b.owner = o.owner AND b.scope = o.scope""",
)
def a5(t: Inputs) -> DataFrame:
    return A.ledger(t.v_attempts, t.v_budgets)


#: Sources as they came: a payload that is cut off, one that is no list, one whose message has no text, and sound ones; some left out, some of another scope.
_CAME = """SELECT source_id, owner, CASE WHEN created % 29 = 6 THEN 'scope-x' ELSE scope END AS scope, source_type,
    CASE WHEN created % 23 = 4 THEN concat('[', source_id) WHEN created % 23 = 7 THEN '{"id": []}' WHEN created % 23 = 9 THEN '[{"id": "m0", "text": 7}]' ELSE concat('[{"id": "', source_id, '", "text": ""}]') END AS payload,
    CASE WHEN created % 3 = 0 THEN map('original_ref', source_key) WHEN created % 3 = 1 THEN map('locator', ' ', 'author', owner) END AS metadata
    FROM {v_sources} WHERE created % 29 <> 5"""
_CAME_SQL = re.sub(r"map\((.*?)\)", lambda m: "MAP {" + re.sub(r"('\w+'), ('.*?'|\w+)", r"\1: \2", m[1]) + "}", _CAME.replace("{v_sources}", "v_sources"))
_DATED = "SELECT source_id, message_id, role, text, CASE WHEN turn % 3 = 0 THEN '2024-02-03' WHEN turn % 3 = 1 THEN '' END AS created_at FROM {v_messages}"
_WRITTEN = "SELECT record_id, holder, subject_id, CASE WHEN record_id LIKE '%21' THEN '2024-2-30' ELSE CAST(as_of AS STRING) END AS as_of, CASE WHEN record_id LIKE '%32' THEN 'soon' ELSE CAST(valid_until AS STRING) END AS valid_until FROM {v_governance}"


def _tables(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    def plain(sql: str, name: str) -> str:
        return sql.replace("{", "{{").replace("}", "}}").replace(f"{{{{{name}}}}}", f"{{{name}}}")

    return tuple(t.spark.sql(plain(sql, name), **{name: getattr(t, name)}) for sql, name in ((_CAME, "v_sources"), (_DATED, "v_messages"), (_WRITTEN, "v_governance")))


_FLAGS = f"""WITH s AS (SELECT *, NOT coalesce(CASE WHEN json_valid(payload) THEN json_type(payload) = 'ARRAY' END, false) AS bad FROM ({_CAME_SQL})),
    e AS (SELECT source_id, message_id, role, text, created_at FROM ({_DATED.replace("{v_messages}", "v_messages")}) m WHERE source_id NOT IN (SELECT source_id FROM s WHERE bad))
    SELECT record_id, status, lifecycle, unnest(list_filter([
    CASE WHEN as_of IS NULL THEN 'as_of_missing' END, CASE WHEN role = 'assistant' THEN 'assistant_statement' END, CASE WHEN role = 'assistant' AND status <> 'agent_suggested' THEN 'attribution_status_mismatch' END,
    CASE WHEN source_type = 'correction' THEN 'explicit_correction' END, CASE WHEN role = 'external' THEN 'external_statement' END, CASE WHEN holder IS NULL THEN 'holder_missing' END, CASE WHEN text IS NULL THEN 'message_missing' END,
    CASE WHEN text IS NOT NULL AND NOT contains(text, quote) THEN 'quote_not_supported' END, CASE WHEN source_type = 'imported_summary' THEN 'secondhand_summary' END, CASE WHEN source_type <> 'correction' OR source_type IS NULL THEN 'semantic_support_not_reviewed' END, CASE WHEN text IS NOT NULL AND coalesce(created_at, '') = '' THEN 'source_date_missing' END, CASE WHEN bad THEN 'source_payload_invalid' END,
    CASE WHEN source_type IS NULL THEN 'source_missing' END, CASE WHEN role NOT IN ('user', 'assistant', 'external') THEN 'speaker_unknown' END, CASE WHEN subject_id IS NULL THEN 'subject_id_missing' END,
    CASE WHEN regexp_matches(statement, '(?i)planned|deadline|completed') THEN 'temporal_claim_needs_review' END, CASE WHEN regexp_matches(statement, '(?i)rewrite|word count') THEN 'transient_task_signal' END], lambda x: x IS NOT NULL)) AS flag
    FROM (SELECT r.*, m.role, m.text, m.created_at, s.bad, s.source_type, g.holder, g.subject_id, g.as_of FROM v_records r LEFT JOIN e m USING (source_id, message_id) LEFT JOIN (SELECT source_id, source_type, bad FROM s) s USING (source_id) LEFT JOIN v_governance g USING (record_id))"""


def _flags(t: Inputs) -> DataFrame:
    sources, messages, _ = _tables(t)
    return A.audit_flags(t.v_records, messages, sources, t.v_governance)


@query("a6_audit_flags", _FLAGS)
def a6(t: Inputs) -> DataFrame:
    return _flags(t)


@query("a6_audit_histogram", f"SELECT flag, status, lifecycle, count(*) AS n FROM ({_FLAGS}) GROUP BY 1, 2, 3")
def a6h(t: Inputs) -> DataFrame:
    return A.status_counts(_flags(t), "flag", "status", "lifecycle")


_GAPS = f"""WITH s AS (SELECT *, CASE WHEN json_valid(payload) THEN json_type(payload) <> 'ARRAY' OR (json_array_length(payload) > 0 AND (coalesce(json_type(payload, '$[0].id'), '') <> 'VARCHAR' OR coalesce(json_type(payload, '$[0].text'), '') <> 'VARCHAR')) ELSE true END AS bad,
        coalesce(trim(metadata['original_ref']) <> '', false) OR coalesce(trim(metadata['locator']) <> '', false) AS located FROM ({_CAME_SQL})),
      g AS (SELECT *, TRY_CAST(as_of AS DATE) AS a, TRY_CAST(valid_until AS DATE) AS v FROM ({_WRITTEN.replace("{v_governance}", "v_governance")})),
      x AS (SELECT r.*, m.text, s.bad, s.located, g.holder, g.subject_id, g.as_of, g.v, (g.as_of IS NULL OR (a IS NOT NULL AND length(g.as_of) = 10)) AND (g.valid_until IS NULL OR v IS NOT NULL) AS ok
        FROM v_records r LEFT JOIN v_messages m ON m.source_id = r.source_id AND m.message_id = r.message_id LEFT JOIN s ON s.source_id = r.source_id AND s.owner = r.owner AND s.scope = r.scope LEFT JOIN g ON g.record_id = r.record_id),
      f AS (SELECT record_id, owner, scope, unnest(list_filter([CASE WHEN ok AND lifecycle = 'active' AND v <= DATE '2024-02-01' THEN 'expired_active' END, CASE WHEN NOT ok THEN 'invalid_effective_date' END, CASE WHEN as_of IS NULL THEN 'missing_as_of' END, CASE WHEN holder IS NULL THEN 'missing_holder' END,
        CASE WHEN subject_id IS NULL THEN 'missing_subject_id' END, CASE WHEN located IS NULL THEN 'source_missing_or_outside_scope' END, CASE WHEN bad THEN 'source_payload_invalid' END, CASE WHEN NOT bad AND text IS NULL THEN 'source_message_missing' END,
        CASE WHEN NOT located THEN 'source_original_locator_missing' END, CASE WHEN NOT bad AND text IS NOT NULL AND NOT contains(text, quote) THEN 'source_quote_missing_or_mismatch' END], lambda x: x IS NOT NULL)) AS category FROM x
      UNION ALL SELECT DISTINCT record_id, owner, scope, 'unresolved_entity_reference' FROM ({_REFS})
      UNION ALL SELECT DISTINCT record_id, owner, scope, 'cross_scope_entity_reference' FROM ({_REFS}) y WHERE {_CROSS}
      UNION ALL SELECT record_id, owner, scope, 'dangling_supersedes' FROM v_records r WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_records p WHERE p.record_id = r.supersedes))
    SELECT owner, scope, category, count(*) AS n, array_to_string(list_slice(list_sort(list(record_id)), 1, 3), ',') AS samples FROM f GROUP BY 1, 2, 3"""


def _gaps(t: Inputs) -> DataFrame:
    sources, _, gov = _tables(t)
    return A.diagnose(t.v_records, gov, t.v_entities, t.v_messages, sources, day(), readable=readable(t))


@query("a7_governance_gaps", _GAPS)
def a7(t: Inputs) -> DataFrame:
    return _gaps(t)


@query("q9_governance_diagnosis", f"SELECT category, CAST(sum(n) AS BIGINT) AS n, count(*) AS scopes FROM ({_GAPS}) GROUP BY category")
def q9(t: Inputs) -> DataFrame:
    return _gaps(t).groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("scopes"))


@query("q8_structural_audit", f"SELECT f.flag, r.record_id, r.status FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY sha256(record_id), record_id) AS n FROM ({_FLAGS})) f JOIN v_records r USING (record_id) WHERE f.n <= 5")
def q8(t: Inputs) -> DataFrame:
    return W.stratified_sample(_flags(t), "flag", "record_id", 5).select("flag", "record_id", "status")


@query("a8_plan_summary", "SELECT count(DISTINCT conv_id) AS conversations, count(*) AS segments, CAST(sum(n_messages) AS BIGINT) AS messages, CAST(sum(chars) AS BIGINT) AS chars, max(chars) AS longest FROM v_segments")
def a8(t: Inputs) -> DataFrame:
    return A.plan_summary(t.v_segments)


@query("a9_import_coverage", "SELECT source_type, count(DISTINCT source_id) AS sources, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_messages JOIN v_sources USING (source_id) GROUP BY 1")
def a9(t: Inputs) -> DataFrame:
    return A.coverage_summary(t.v_messages.join(t.v_sources.select("source_id", "source_type"), "source_id"))


@query("a10_review_counters", "SELECT state, priority, count(*) AS n FROM v_governance GROUP BY 1, 2")
def a10(t: Inputs) -> DataFrame:
    return A.status_counts(t.v_governance, "state", "priority")


def _metrics_sql(by: str, results: str = "v_retrieved") -> str:
    """Per task metrics at 5; ``by`` is empty or a column name."""
    c = f", {by}" if by else ""
    base = f"(SELECT task_id, split{c} FROM v_tasks" + (f", (SELECT DISTINCT {by} FROM {results}) u)" if by else ")")
    on = f"task_id{c}"
    return f"""SELECT task_id, split{c}, coalesce(targets, 0) AS targets, coalesce(returned, 0) AS returned, coalesce(relevant, 0) AS relevant,
    CASE WHEN targets > 0 THEN coalesce(relevant, 0) / 5 END AS precision_at_k, CASE WHEN targets > 0 THEN coalesce(relevant, 0) / targets END AS recall_at_k, CASE WHEN targets > 0 THEN coalesce(1 / first, 0) END AS mrr_at_k,
    coalesce(false_returns, 0) AS false_returns, coalesce(support_only, 0) AS support_only, CASE WHEN targets IS NULL THEN coalesce(returned, 0) = 0 END AS abstained_rightly
    FROM {base} b LEFT JOIN (SELECT task_id, count(*) AS targets FROM v_labels WHERE grade = 2 GROUP BY 1) t USING (task_id)
    LEFT JOIN (SELECT task_id{c}, count(*) AS returned, count(*) FILTER (WHERE grade = 2) AS relevant, min(rank) FILTER (WHERE grade = 2) AS first, count(*) FILTER (WHERE coalesce(grade, 0) = 0) AS false_returns, count(*) FILTER (WHERE grade = 1) AS support_only
      FROM {results} LEFT JOIN v_labels l USING (task_id, doc_id) WHERE rank <= 5 GROUP BY ALL) g USING ({on})"""


def _macro_sql(inner: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS tasks, count(*) FILTER (WHERE targets > 0) AS positive_tasks, round(avg(precision_at_k), 9) AS precision_at_k, round(avg(recall_at_k), 9) AS recall_at_k, round(avg(mrr_at_k), 9) AS mrr_at_k,
    CAST(sum(false_returns) AS BIGINT) AS false_returns, count(*) FILTER (WHERE abstained_rightly) AS abstained_rightly FROM ({inner}) GROUP BY {by}"""


@query("a11_retrieval_metrics", _metrics_sql(""))
def a11(t: Inputs) -> DataFrame:
    return A.score_retrieval(t.v_retrieved, t.v_labels, t.v_tasks, 5)


@query("a12_route_metrics", _macro_sql(_metrics_sql("route"), "route, split"))
def a12(t: Inputs) -> DataFrame:
    return A.macro(A.score_retrieval(t.v_retrieved, t.v_labels, t.v_tasks, 5, ("route",)), "route", "split")


_DIMS = "(SELECT record_id, dimension FROM v_records CROSS JOIN (SELECT DISTINCT dimension FROM v_verdicts) d)"


@query(
    "a13_verdict_rollup",
    f"""SELECT record_id, CASE max(CASE coalesce(verdict, 'not_run') WHEN 'passed' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'not_run' THEN 2 ELSE 3 END) WHEN 0 THEN 'passed' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not_run' ELSE 'failed' END AS verdict
    FROM {_DIMS} e LEFT JOIN v_verdicts v USING (record_id, dimension) GROUP BY 1""",
)
def a13(t: Inputs) -> DataFrame:
    dims = t.v_verdicts.select("dimension").distinct()  # a handful of dimensions
    return A.rollup_verdicts(t.v_records.select("record_id").join(F.broadcast(dims)), t.v_verdicts, "record_id")


@query(
    "q12_semantic_review",
    f"""WITH r AS (SELECT record_id, max(CASE coalesce(verdict, 'not_run') WHEN 'passed' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'not_run' THEN 2 ELSE 3 END) AS s FROM {_DIMS} e LEFT JOIN v_verdicts v USING (record_id, dimension) GROUP BY 1)
    SELECT source_id, CASE max(s) WHEN 0 THEN 'passed' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not_run' ELSE 'failed' END AS verdict, count(*) AS claims FROM r JOIN v_records USING (record_id) GROUP BY 1""",
)
def q12(t: Inputs) -> DataFrame:
    each = a13(t).join(t.v_records.select("record_id", "source_id"), "record_id")
    by_source = A.rollup_verdicts(each.select("source_id").distinct().withColumn("dimension", F.lit("all")), each.select("source_id", "verdict").withColumn("dimension", F.lit("all")), "source_id")
    return by_source.join(each.groupBy("source_id").agg(F.count("*").alias("claims")), "source_id")


_WORDS = ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS UBIGINT)) AS VARCHAR) AS w{i}" for i in range(A.FINGERPRINT_WORDS))


@query(
    "a16_patched_fingerprint",
    f"""SELECT owner, scope, n, sha256(concat_ws(',', CAST(n AS VARCHAR), {", ".join(f"w{i}" for i in range(A.FINGERPRINT_WORDS))})) AS fingerprint
    FROM (SELECT owner, scope, count(*) AS n, {_WORDS} FROM (SELECT owner, scope, sha256(concat_ws(chr(31), record_id, CASE WHEN k % 100 = 7 THEN concat('new ', statement) ELSE statement END)) AS h FROM v_records WHERE k % 50 <> 3) x GROUP BY 1, 2) y""",
)
def a16p(t: Inputs) -> DataFrame:
    """A kept state, patched by the few rows that changed, came or went, is the state of the rows as they are now."""
    by, cols, k = ["owner", "scope"], ("record_id", "statement"), F.col("k")
    r = t.v_records
    before = A.fingerprint_state(r.where(k % 50 != 4), by, *cols)
    changed = r.where((k % 100 == 7) & (k % 50 != 4))
    added = changed.withColumn("statement", F.concat(F.lit("new "), "statement")).unionByName(r.where(k % 50 == 4))
    removed = changed.unionByName(r.where(k % 50 == 3))
    return A.fingerprint_token(A.patch_fingerprint(before, added, removed, by, *cols), by)


@query(
    "a14_suite_gate",
    """WITH e AS (SELECT DISTINCT source_id AS case_id FROM v_sources WHERE created % 6 <> 1), u AS (SELECT source_id AS case_id, CASE WHEN created % 9 = 2 THEN 'failed' WHEN created % 9 <> 4 THEN 'passed' END AS verdict FROM v_sources WHERE created % 5 <> 3 UNION ALL SELECT source_id, 'passed' FROM v_sources WHERE created % 25 = 0),
    r AS (SELECT case_id, count(*) AS runs, count(*) FILTER (WHERE verdict = 'failed') AS failed, count(*) FILTER (WHERE verdict IS NULL) AS pending FROM u GROUP BY 1)
    SELECT coalesce(e.case_id, r.case_id) AS case_id, CASE WHEN r.case_id IS NULL THEN 'missing' WHEN e.case_id IS NULL THEN 'unexpected' WHEN runs > 1 THEN 'duplicate' WHEN failed > 0 THEN 'failed' WHEN pending > 0 THEN 'pending' ELSE 'ok' END AS state FROM e FULL JOIN r ON e.case_id = r.case_id""",
)
def a14(t: Inputs) -> DataFrame:
    s = t.v_sources.withColumnRenamed("source_id", "case_id")
    verdict = F.when(F.col("created") % 9 == 2, "failed").when(F.col("created") % 9 != 4, "passed")
    runs = s.where("created % 5 <> 3").select("case_id", verdict.alias("verdict")).unionByName(s.where("created % 25 = 0").select("case_id", F.lit("passed").alias("verdict")))
    return A.suite_gate(s.where("created % 6 <> 1"), runs)


_COVER = """WITH p AS (SELECT *, coalesce(max(end_char) OVER (PARTITION BY source_id, message_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM v_spans),
    c AS (SELECT source_id, message_id, CAST(sum(greatest(0, end_char - greatest(start_char, past))) AS BIGINT) AS covered FROM p GROUP BY 1, 2)
    SELECT m.source_id, m.message_id, length(m.text) AS size, coalesce(covered, 0) AS covered, length(m.text) - coalesce(covered, 0) AS excluded, coalesce(covered, 0) = 0 AS no_evidence FROM v_messages m LEFT JOIN c USING (source_id, message_id)"""


@query("a15_span_coverage", _COVER)
def a15(t: Inputs) -> DataFrame:
    sizes = t.v_messages.select("source_id", "message_id", F.length("text").cast("long").alias("size"))
    return A.span_coverage(sizes, t.v_spans, ["source_id", "message_id"])


@query(
    "a16_set_fingerprint",
    """WITH h AS (SELECT owner, scope, sha256(concat_ws(chr(31), record_id, statement, coalesce(supersedes, chr(0)))) AS h FROM v_records), p AS (SELECT owner, scope, substr(h, 1, 2) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1, 2, 3)
    SELECT owner, scope, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY part)) AS fingerprint FROM p GROUP BY 1, 2""".replace("chr(0)", "'@null@'"),
)
def a16(t: Inputs) -> DataFrame:
    r = t.v_records.withColumn("supersedes", F.coalesce("supersedes", F.lit("@null@")))
    return A.fingerprint(r, ["owner", "scope"], "record_id", "statement", "supersedes")


@query(
    "a17_assertion_groups",
    rf"""SELECT owner, scope, status, kind, state, subject AS subject_key, regexp_replace(regexp_replace(statement, '\s+', '', 'g'), '^[。.!！]+|[。.!！]+$', '', 'g') AS statement_key, count(*) AS n, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS refs FROM ({_GOV}) WHERE lifecycle = 'active' GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def a17(t: Inputs) -> DataFrame:
    """Every fourth statement is written with full-width letters and a full-width stop, which must make no difference."""
    wide = F.when(F.col("k") % 4 == 1, F.concat(F.translate("statement", "abcXYZ", "ａｂｃＸＹＺ"), F.lit(" ！"))).otherwise(F.col("statement"))
    return A.group_assertions(governed(t).withColumn("statement", wide))


@query(
    "a19_scope_generations",
    """SELECT owner, scope, generation, refreshed, generation > refreshed AS stale FROM (SELECT r.owner, r.scope, count(*) AS generation FROM v_changes c JOIN v_records r USING (record_id) GROUP BY 1, 2) c
    LEFT JOIN (SELECT owner, scope, CASE WHEN owner = 'owner-1' THEN 0 ELSE 7 END AS refreshed FROM (SELECT DISTINCT owner, scope FROM v_sources)) f USING (owner, scope)""",
)
def a19(t: Inputs) -> DataFrame:
    changes = t.v_changes.join(t.v_records.select("record_id", "owner", "scope"), "record_id")
    seen = t.v_sources.select("owner", "scope").distinct().withColumn("generation", F.when(F.col("owner") == "owner-1", 0).otherwise(7))
    return A.scope_generations(changes, seen)


@query(
    "a21_split_leakage",
    """WITH x AS (SELECT t.task_id, t.split, l.doc_id AS conv FROM v_tasks t JOIN v_labels l USING (task_id))
    SELECT 'in_two_splits' AS problem, count(*) AS n FROM (SELECT conv FROM x GROUP BY conv HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'repeated_task', count(*) FROM (SELECT task_id FROM x GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'too_few_tasks', greatest(0, 30 - count(DISTINCT task_id)) FROM x UNION ALL SELECT 'missing_split', greatest(0, 2 - count(DISTINCT split)) FROM x""",
)
def a21(t: Inputs) -> DataFrame:
    return A.split_leakage(t.v_tasks.join(t.v_labels.select("task_id", "doc_id"), "task_id"), "doc_id")


@query(
    "q5_snapshot",
    f"""SELECT record_id, state, priority, s.source_key, s.source_type, coalesce(t.display_statement, g.statement) AS display_statement, m.role, coalesce(contains(m.text, g.quote), false) AS supported,
    coalesce(lifecycle = 'active' AND state = 'verified' AND holder IS NOT NULL AND subject_id IS NOT NULL AND as_of <= DATE '2024-02-01' AND (valid_until IS NULL OR valid_until > DATE '2024-02-01'), false) AS usable
    FROM ({_GOV}) g JOIN (SELECT source_id, source_key, source_type FROM v_sources) s USING (source_id) LEFT JOIN (SELECT source_id, message_id, role, text FROM v_messages) m USING (source_id, message_id) LEFT JOIN v_translations t USING (record_id) WHERE lifecycle = 'active'""",
)
def q5(t: Inputs) -> DataFrame:
    from attestry.operators.predicates import quote_supported, usable_on

    r = J.hydrate(governed(t).where("lifecycle = 'active'"), t.v_sources)
    r = quote_supported(J.with_evidence(J.with_display(r, t.v_translations, "fr"), t.v_messages))
    return r.select("record_id", "state", "priority", "source_key", "source_type", "display_statement", "role", "supported", usable_on(day()).alias("usable"))
