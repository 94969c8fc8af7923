"""Text jobs: chunks, parts, tags and review hints over message and claim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import rules as R
from attestry.functions import spans as S
from attestry.functions import payloads as Y
from attestry.functions.text import content_id, escaped_markdown
from attestry.operators.aggregates import quality_summary, span_coverage
from attestry.operators.predicates import check_dates
from attestry.registry import Inputs, query


@query("f6_chunks", "SELECT doc_id, CAST(i * 900 AS INT) AS start_char, CAST(least(i * 900 + 1000, length(text)) AS INT) AS end_char, md5(substr(text, CAST(i * 900 + 1 AS INT), 1000)) AS chunk_md5 FROM (SELECT *, unnest(range(0, CAST(1 + coalesce(length(text), 0) // 900 AS BIGINT))) AS i FROM documents) WHERE length(text) > 0 AND i < greatest(1, ceil((length(text) - 100) / 900.0)) AND trim(substr(text, CAST(i * 900 + 1 AS INT), 1000)) <> ''")
def f6(t: Inputs) -> DataFrame:
    c = S.chunk_text(t.documents.select("doc_id", "text"))
    return c.select("doc_id", "start_char", "end_char", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("f7_fixed_parts", "SELECT doc_id, CAST(i AS INT) AS part_no, md5(substr(text, CAST(i * 1200 + 1 AS INT), 1200)) AS part_md5 FROM (SELECT *, unnest(range(0, CAST(1 + coalesce(length(text), 0) // 1200 AS BIGINT))) AS i FROM documents) WHERE i < greatest(1, ceil(length(text) / 1200.0))")
def f7(t: Inputs) -> DataFrame:
    return S.split_fixed(t.documents.select("doc_id", "text"), 1200).select("doc_id", "part_no", F.md5(F.col("part").cast("binary")).alias("part_md5"))


@query("f8_serialized_parts")
def f8(t: Inputs) -> DataFrame:
    return S.split_serialized(t.documents.select("doc_id", "text"), 1700).select("doc_id", "part_no", "start_char", "end_char")


@query(
    "f9_packed_segments",
    """WITH RECURSIVE m AS (SELECT conv_id, turn, length(to_json({'message_id': message_id, 'role': role, 'text': text})) + 5 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM v_messages),
    w AS (SELECT conv_id, turn, i, size AS used, 1 AS n, 0 AS segment_index FROM m WHERE i = 1
      UNION ALL SELECT m.conv_id, m.turn, m.i, CASE WHEN n >= 3 OR used + size > 900 THEN size ELSE used + size END, CASE WHEN n >= 3 OR used + size > 900 THEN 1 ELSE n + 1 END, CASE WHEN n >= 3 OR used + size > 900 THEN segment_index + 1 ELSE segment_index END
      FROM w JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1)
    SELECT conv_id, turn, segment_index FROM w""",
)
def f9(t: Inputs) -> DataFrame:
    return S.pack_segments(t.v_messages, 3, 900)


@query("f10_long_source_plan")
def f10(t: Inputs) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("source_id"), F.lit("m0").alias("message_id"), "text")
    return S.segment_plan(d, 2000).select("source_id", "part_no", "start_char", "end_char", "segment_id")


def _instr(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN strpos(text, regexp_extract(text, '{pattern}')) - 1 END"


_ROUTED = rf"""WITH a AS (SELECT *, length(text) AS size, {_instr(R.ROLE)} AS role_at, {_instr(R.CHAPTER)} AS chapter_at, contains(text, '核心观点') AND contains(text, '内容架构') AND contains(text, '章末思考') AS outline FROM v_pasted),
    b AS (SELECT *, CASE WHEN role_at IS NOT NULL AND size - role_at > 400 AND regexp_matches(substr(text, CAST(role_at + 1 AS BIGINT)), '{R.ROLE_WORDS}') THEN 'role' WHEN chapter_at IS NOT NULL AND size - chapter_at > 400 THEN 'chapter' WHEN outline THEN 'outline'
      WHEN size > 800 AND (len(regexp_extract_all(text, '(?m)^(#+\s)')) >= 3 OR len(regexp_extract_all(text, '(?m)^[0-9]+\.')) >= 3) AND regexp_matches(text, '{R.SPECIFIED}') THEN 'spec' END AS kind FROM a),
    c AS (SELECT *, CAST(CASE WHEN source_type = 'conversation' AND role = 'assistant' THEN 0 WHEN kind = 'role' THEN role_at WHEN kind = 'chapter' THEN chapter_at WHEN kind IS NULL THEN size ELSE 0 END AS INT) AS cut,
      CASE kind WHEN 'role' THEN 'role_template' WHEN 'spec' THEN 'role_template' WHEN 'chapter' THEN 'pasted_chapter' WHEN 'outline' THEN 'chapter_outline' END AS reason,
      CAST(CASE WHEN kind = 'role' THEN role_at WHEN kind = 'chapter' THEN chapter_at WHEN kind IS NULL THEN size ELSE 0 END AS BIGINT) AS before FROM b)
    SELECT source_id, message_id, cut, reason, CASE WHEN source_type = 'conversation' AND role = 'assistant' THEN 'assistant_reference' WHEN kind IS NULL THEN 'conversation' WHEN trim(substr(text, 1, before)) <> '' THEN 'mixed_reference_document' ELSE 'reference_document' END AS route FROM c"""


@query("f11_source_routing", _ROUTED)
def f11(t: Inputs) -> DataFrame:
    return R.routed(t.v_pasted).select("source_id", "message_id", "cut", "reason", "route")


@query("f12_evidence_spans")
def f12(t: Inputs) -> DataFrame:
    s = S.cited_spans(R.routed(t.v_pasted))
    return s.select("source_id", "message_id", "start_char", "end_char", R.modality(F.col("part")).alias("modality"), "priority")


@query("f13_clause_policies")
def f13(t: Inputs) -> DataFrame:
    """How many clauses each policy finds in texts that open with an intention, a condition or neither."""
    said = _led(t).select("record_id", F.concat("said", F.lit("! I plan to go on. We hope so")).alias("text"))
    every = None
    for policy in ("plain", "scoped", "explicit"):
        one = S.evidence_spans(said, policy=policy).groupBy("record_id").agg(F.count("*").alias("clauses"), F.max("end_char").alias("covered")).withColumn("policy", F.lit(policy))
        every = one if every is None else every.unionByName(one)
    return every


_M = R.PATTERNS


def _modality_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '(?i){_M['condition']}') THEN 'conditional' WHEN (regexp_matches({c}, '(?i){_M['wish']}') OR regexp_matches({c}, '(?i){_M['plan']}')) AND regexp_matches({c}, '(?i){_M['asserted']}') THEN 'mixed' WHEN regexp_matches({c}, '(?i){_M['wish']}') THEN 'wish' WHEN regexp_matches({c}, '(?i){_M['plan']}') THEN 'plan' ELSE 'stated' END"


#: The test texts name no intentions, so the query puts one before each text.
_LEAD = ["I plan to ", "I wish for ", "if needed, ", "we decided on ", "I hope and have completed ", ""]
_LEAD_SQL = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEAD)) + " END"


def _led(t: Inputs) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, _LEAD)), (F.col("k") % 6 + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, _LEAD)), ((F.col("k") + F.floor(F.col("k") / 7)) % 6 + 1).cast("int"))
    return t.v_records.withColumn("said", F.concat(lead, "statement")).withColumn("claimed", F.concat(other, "statement"))


_LED = f"SELECT *, concat({_LEAD_SQL}, statement) AS said, concat({_LEAD_SQL.replace('k % 6', '(k + CAST(floor(k / 7) AS BIGINT)) % 6')}, statement) AS claimed FROM v_records"


@query("f14_modality", f"SELECT record_id, {_modality_sql('said')} AS modality FROM ({_LED})")
def f14(t: Inputs) -> DataFrame:
    return _led(t).select("record_id", R.modality(F.col("said")).alias("modality"))


def _has(c: str, k: str) -> str:
    return f"regexp_matches({c}, '(?i){_M[k]}')"


@query(
    "f15_modality_promotion",
    f"""SELECT record_id, CASE WHEN {_has('said', 'permission')} AND NOT {_has('said', 'obligation')} AND {_has('claimed', 'obligation')} THEN 'permission_to_obligation'
    WHEN mode IN ('wish', 'plan') AND {_has('claimed', 'asserted')} AND NOT {_has('said', 'asserted')} THEN 'intention_to_done' WHEN mode IN ('wish', 'plan') AND kind IN ('decision', 'event') AND NOT {_has('said', 'asserted')} THEN 'intention_as_decision'
    WHEN mode = 'conditional' AND ({_has('claimed', 'asserted')} OR {_has('claimed', 'wish')} OR {_has('claimed', 'plan')}) AND NOT {_has('claimed', 'condition')} AND NOT {_has('said', 'asserted')} THEN 'condition_dropped' END AS problem
    FROM (SELECT *, {_modality_sql('said')} AS mode FROM ({_LED}))""",
)
def f15(t: Inputs) -> DataFrame:
    return _led(t).select("record_id", R.promotion(F.col("said"), F.col("claimed"), F.col("kind")).alias("problem"))


_RULE = "从现在起，这两条要求长期适用，直到我明确更改：回答必须简短"
_SPLIT = ["回答必须简短", "不是从现在起长期适用，直到我明确更改", "从现在起回答必须简短，直到我明确更改", "从现在起长期适用：回答必须简短", "从现在起长期适用，直到我明确更改：回答必须简短"]
_SPLIT_SQL = "CASE k % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SPLIT)) + " END"


@query(
    "f16_qualifications",
    f"""SELECT record_id, CASE WHEN k % 7 = 0 OR kind NOT IN ('claim', 'decision') THEN NULL WHEN s LIKE '%不是从现在起%' THEN 'start_negated' WHEN NOT contains(s, '从现在起') THEN 'start_missing' WHEN NOT contains(s, '长期') THEN 'duration_missing' WHEN NOT contains(s, '直到我明确更改') THEN 'end_missing' END AS problem
    FROM (SELECT record_id, k, kind, concat({_SPLIT_SQL}, statement) AS s FROM v_records)""",
)
def f16(t: Inputs) -> DataFrame:
    quote = F.when(F.col("k") % 7 == 0, F.col("quote")).otherwise(F.lit(_RULE))
    said = F.concat(F.element_at(F.array(*map(F.lit, _SPLIT)), (F.col("k") % 5 + 1).cast("int")), "statement")
    return t.v_records.select("record_id", R.split_rule(quote, said, F.col("kind")).alias("problem"))


@query("f18_statement_checks", "SELECT record_id, contains(statement, '2024-02-0' || (k % 9 + 1)) OR k % 4 = 0 AS has_date, false AS immediate_command FROM (SELECT record_id, k, concat(CASE WHEN k % 4 = 0 THEN concat('2024年2月', k % 9 + 1, '日 ') WHEN k % 4 = 1 THEN concat('2024-02-0', k % 9 + 1) ELSE '' END, statement) AS statement FROM v_records)")
def f18(t: Inputs) -> DataFrame:
    day = F.concat(F.lit("2024-02-0"), (F.col("k") % 9 + 1).cast("string"))
    text = F.concat(F.when(F.col("k") % 4 == 0, F.concat(F.lit("2024年2月"), (F.col("k") % 9 + 1).cast("string"), F.lit("日 "))).when(F.col("k") % 4 == 1, day).otherwise(""), "statement")
    return t.v_records.select("record_id", R.statement_has_date(text, day).alias("has_date"), R.immediate_command(F.col("statement")).alias("immediate_command"))


@query("f19_signals", "SELECT record_id, regexp_matches(said, '(?i)rewrite|word count') AS transient, regexp_matches(said, '(?i)planned|deadline|completed') AS temporal FROM (" + _LED + ")")
def f19(t: Inputs) -> DataFrame:
    from attestry.operators.aggregates import TEMPORAL, TRANSIENT

    return _led(t).select("record_id", F.col("said").rlike(TRANSIENT).alias("transient"), F.col("said").rlike(TEMPORAL).alias("temporal"))


def _hints(t: Inputs) -> DataFrame:
    c = _led(t).select(F.col("k").alias("claim_no"), "source_id", "topic", "kind", "subject", "status", F.col("claimed").alias("statement"), F.col("said").alias("quote"))
    return R.review_claims(c)


@query("f20_review_hints")
def f20(t: Inputs) -> DataFrame:
    return _hints(t).select("claim_no", "source_id", "codes", "disposition")


@query("a20_quality_summary")
def a20(t: Inputs) -> DataFrame:
    return quality_summary(_hints(t))


@query(
    "f21_missed_sources",
    """SELECT source_id, message_id FROM (SELECT *, concat(CASE WHEN turn % 3 = 0 THEN 'I have a studio; how should it go? ' ELSE '' END, text) AS said FROM v_messages WHERE role = 'user') m
    WHERE regexp_matches(said, '(?i)\\bI\\s+(?:have|own)\\s+(?:(?:a|the|an)\\s+)?(?:domain|studio|business|patent)\\b') AND regexp_matches(said, '(?i)[?？]|\\b(?:how|what should)\\b')
    AND NOT EXISTS (SELECT 1 FROM v_claims c WHERE c.source_id = m.source_id AND c.message_id = m.message_id)""".replace("\\\\", "\\"),
)
def f21(t: Inputs) -> DataFrame:
    m = t.v_messages.withColumn("text", F.concat(F.when(F.col("turn") % 3 == 0, "I have a studio; how should it go? ").otherwise(""), "text"))
    return R.missed_sources(m, t.v_claims).select("source_id", "message_id")


@query(
    "f23_date_check",
    """SELECT k, coalesce(b IS NULL OR b2 >= a2, false) AND a2 IS NOT NULL AND (b IS NULL OR b2 IS NOT NULL) AS dates_ok FROM (SELECT *, CASE WHEN regexp_full_match(a, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(a AS DATE) END AS a2, CASE WHEN regexp_full_match(b, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(b AS DATE) END AS b2 FROM (
    SELECT k, CASE k % 5 WHEN 0 THEN '2024-2-01' WHEN 1 THEN '2024-02-30' ELSE '2024-02-10' END AS a, CASE k % 3 WHEN 0 THEN '2024-02-05' WHEN 1 THEN '2024-03-01' END AS b FROM v_records))""".replace("\\\\", "\\"),
)
def f23(t: Inputs) -> DataFrame:
    k = F.col("k")
    rows = t.v_records.select("k", F.when(k % 5 == 0, "2024-2-01").when(k % 5 == 1, "2024-02-30").otherwise("2024-02-10").alias("as_of_text"), F.when(k % 3 == 0, "2024-02-05").when(k % 3 == 1, "2024-03-01").alias("valid_until_text"))
    return check_dates(rows).select("k", "dates_ok")


@query("f24_content_ids", "SELECT source_id, message_id, sha256(concat_ws(chr(31), source_id, message_id, role, text)) AS content_id FROM v_messages")
def f24(t: Inputs) -> DataFrame:
    return t.v_messages.select("source_id", "message_id", content_id("source_id", "message_id", "role", "text").alias("content_id"))


@query("f28_markdown_escape", r"SELECT doc_id, md5(replace(regexp_replace(replace(replace(replace(concat('a<b> & ', text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]#|])', '\\\1', 'g'), chr(10), ' ')) AS shown FROM documents")
def f28(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", F.md5(escaped_markdown(F.concat(F.lit("a<b> & "), "text")).cast("binary")).alias("shown"))


# the rule's word bounds are those of letters of any script; DuckDB's own \b knows ASCII letters only, and takes one between a Han sign and a word
_POINTS_BACK = R.POINTS_BACK.replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")
_SCOPED = "concat(CASE k % 3 WHEN 0 THEN '项目 Atlas 和项目 Borea：如果批准。它再议！' WHEN 1 THEN '如果批准' ELSE '' END, statement)"


@query(
    "f22_scope_observations",
    rf"""WITH s AS (SELECT record_id, {_SCOPED} AS text FROM v_records), u AS (SELECT *, regexp_extract_all(text, '{R.UNIT}') AS us, regexp_extract_all(text, '{R.PROJECT}', 1) AS projects, len(regexp_extract_all(text, '(?i){R.PATTERNS['condition']}')) AS n FROM s),
    x AS (SELECT *, unnest(us) AS unit, generate_subscripts(us, 1) AS i FROM u)
    SELECT record_id, CAST(i - 1 AS INT) AS unit_no, CAST(length(array_to_string(us[1:i - 1], '')) AS INT) AS start_char, CAST(length(array_to_string(us[1:i], '')) AS INT) AS end_char, unit, CAST(len(regexp_extract_all(unit, '(?i){R.PATTERNS['condition']}')) AS INT) AS n_conditions,
      array_to_string(projects, ',') AS projects, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_filter(['condition_present_scope_unresolved', CASE WHEN len(list_distinct(projects)) > 1 THEN 'distinct_project_surface_names_not_independence' END, CASE WHEN regexp_matches(text, '(?i){_POINTS_BACK}') THEN 'possible_reference_dependency' END,
      CASE WHEN regexp_matches(text, '{R.LIST_ITEM}') OR regexp_matches(text, '{R.QUOTED_OR_TOLD}') THEN 'quoted_or_grouped_context_requires_review' END, CASE WHEN len(us) > 1 AND len(list_filter(us, lambda y: len(regexp_extract_all(y, '(?i){R.PATTERNS['condition']}')) = 0)) > 0 THEN 'condition_free_display_unit_not_unconditional_evidence' END], lambda y: y IS NOT NULL), ',') END AS reasons FROM x""",
)
def f22(t: Inputs) -> DataFrame:
    o = R.scope_observations(t.v_records.select("record_id", F.expr(_SCOPED).alias("text")))
    return o.withColumns({"projects": F.array_join("projects", ","), "reasons": F.array_join("reasons", ",")})


@query("f30_text_files")
def f30(t: Inputs) -> DataFrame:
    return S.split_text_files(t.documents.select("doc_id", "text"), 1500, 1800).select("doc_id", "part_no", "start_char", "end_char")


@query("p2_hidden_spans")
def p2(t: Inputs) -> DataFrame:
    text = F.concat(F.lit("<think>a <thinking>b</thinking> c</think>"), F.col("text"), F.when(F.col("conv_id") % 3 == 0, "<analysis>open").otherwise(""))
    rows = t.v_messages.select("source_id", "message_id", text.alias("text"))
    return rows.select("source_id", "message_id", (F.length("text") == F.length(S.mask_hidden("text"))).alias("same_length"), F.contains(S.mask_hidden("text"), F.lit("b")).alias("still_b"), S.mask_hidden("text").alias("masked"))


@query("q11_input_coverage")
def q11(t: Inputs) -> DataFrame:
    m = R.routed(t.v_pasted)
    spans = S.cited_spans(m)
    sizes = m.select("source_id", "message_id", "route", F.length("text").cast("long").alias("size"))
    return span_coverage(sizes, spans.select("source_id", "message_id", "start_char", "end_char"), ["source_id", "message_id"])


_PAYLOAD = "CASE turn % 5 WHEN 0 THEN concat('[{\"id\": \"', message_id, '\", \"n\": ', CAST(length(text) AS STRING), '}, 7, null]') WHEN 1 THEN text WHEN 2 THEN '{\"id\": []}' WHEN 3 THEN concat('[\"', message_id) ELSE '[]' END"


@query(
    "f26_payload_decode",
    f"SELECT source_id, message_id, NOT coalesce(ok, false) AS invalid, CASE WHEN ok THEN CAST(json_array_length(p) AS INT) ELSE 0 END AS n_elements FROM (SELECT *, CASE WHEN json_valid(p) THEN json_type(p) = 'ARRAY' ELSE false END AS ok FROM (SELECT *, {_PAYLOAD} AS p FROM v_messages))",
)
def f26(t: Inputs) -> DataFrame:
    p = F.expr(_PAYLOAD)
    return t.v_messages.select("source_id", "message_id", Y.payload_invalid(p).alias("invalid"), F.size(Y.decoded_messages(p)).alias("n_elements"))


_SEEN = "CASE turn % 4 WHEN 0 THEN 'visible_only' WHEN 1 THEN 'complete_visible' WHEN 2 THEN 'unknown' ELSE 'all' END"


@query(
    "f27_source_metadata",
    f"""SELECT source_id, message_id, ok AS valid, CASE WHEN seen IS NOT NULL AND seen <> 'all' THEN seen ELSE 'unknown' END AS visibility FROM (
    SELECT *, coalesce(len(list_filter(map_keys(m), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in Y.FIELDS)}))) = 0 AND len(list_filter(map_values(m), lambda x: x IS NULL OR length(x) > {Y.LONGEST_VALUE})) = 0 AND coalesce(seen, 'unknown') IN ({", ".join(f"'{x}'" for x in Y.VISIBILITY)}), false) AS ok
    FROM (SELECT *, CASE WHEN conv_id % 2 = 0 AND conv_id % 11 <> 5 THEN {_SEEN} END AS seen, CASE WHEN conv_id % 11 = 5 THEN NULL WHEN conv_id % 2 = 0 THEN MAP {{'original_ref': source_id, 'locator': text, 'visibility': {_SEEN}}} WHEN turn % 3 = 1 THEN MAP {{'author': role, 'rights': 'all'}} ELSE MAP {{'author': role}} END AS m FROM v_messages))""",
)
def f27(t: Inputs) -> DataFrame:
    m = F.expr(f"CASE WHEN conv_id % 11 = 5 THEN NULL WHEN conv_id % 2 = 0 THEN map('original_ref', source_id, 'locator', text, 'visibility', {_SEEN}) WHEN turn % 3 = 1 THEN map('author', role, 'rights', 'all') ELSE map('author', role) END")
    return t.v_messages.select("source_id", "message_id", Y.metadata_valid(m).alias("valid"), Y.visibility(m).alias("visibility"))
