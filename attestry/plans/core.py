"""Queries over predicates, joins, sets and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import joins as J
from attestry.operators import predicates as P
from attestry.operators import sets as U
from attestry.operators import windows as W
from attestry.registry import Inputs, query

def day() -> Column:
    """The day that reports are for."""
    return F.lit("2024-02-01").cast("date")


@query("s4_table_scan", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey > 100")
def s4(t: Inputs) -> DataFrame:
    return t.orders.where("o_orderkey > 100").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first_key"))


# predicates


@query("p3_eligible_sources", "SELECT source_id, source_type FROM v_sources WHERE source_type <> 'conversation' OR parser_version = 'v2'")
def p3(t: Inputs) -> DataFrame:
    return P.eligible(t.v_sources).select("source_id", "source_type")


@query("p4_authorized_records", "SELECT record_id, owner, scope FROM v_records r WHERE EXISTS (SELECT 1 FROM v_grants g WHERE g.principal = 'reader-0' AND g.owner = r.owner AND list_contains(g.scopes, r.scope) AND list_contains(g.actions, 'source_read'))")
def p4(t: Inputs) -> DataFrame:
    return P.authorized(t.v_records, t.v_grants, "reader-0", "read", "source_read").select("record_id", "owner", "scope")


@query("p5_model_eligible", "SELECT source_id, owner, scope FROM v_sources r WHERE EXISTS (SELECT 1 FROM v_grants g WHERE g.principal = 'reader-1' AND NOT g.archive_only AND g.owner = r.owner AND list_contains(g.scopes, r.scope) AND list_contains(g.actions, 'read'))")
def p5(t: Inputs) -> DataFrame:
    return P.model_eligible(t.v_sources, t.v_grants, "reader-1").select("source_id", "owner", "scope")


@query(
    "p6_message_contract",
    """SELECT source_id, message_id, array_to_string(list_sort(list_filter([CASE WHEN trim(text) = '' THEN 'blank_text' END, CASE WHEN c2 > 1 THEN 'duplicate_id' END,
    CASE WHEN length(text) > 400 THEN 'text_too_long' END, CASE WHEN c1 > 100 THEN 'too_many_messages' END, CASE WHEN role NOT IN ('user', 'assistant', 'external') THEN 'unknown_role' END], lambda x: x IS NOT NULL)), ',') AS violations
    FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS c1, count(*) OVER (PARTITION BY source_id, message_id) AS c2 FROM v_messages) m""",
)
def p6(t: Inputs) -> DataFrame:
    return P.check_messages(t.v_messages, 400).select("source_id", "message_id", F.array_join("violations", ",").alias("violations"))


_SAID = "SELECT source_id, message_id, role, text, CASE WHEN turn % 6 = 5 THEN repeat('t', 280 + CAST(turn AS INT) * 5) END AS source_title FROM v_messages WHERE source_id NOT LIKE '%77'"
_SENT = "SELECT source_id, created, CASE WHEN created % 31 = 2 THEN '' ELSE source_key END AS source_key, CASE WHEN created % 37 = 3 THEN 'letter' ELSE source_type END AS source_type FROM v_sources"


@query(
    "p6_source_contract",
    f"""WITH m AS (SELECT source_id, count(*) AS n, sum(CASE WHEN source_title IS NULL THEN length(to_json({{'id': message_id, 'role': role, 'text': text}})) + 7 ELSE length(to_json({{'id': message_id, 'role': role, 'text': text, 'source_title': source_title}})) + 9 END) AS size,
      max(coalesce(length(source_title), 0)) AS longest, count(*) FILTER (WHERE trim(text) = '' OR role NOT IN ('user', 'assistant', 'external')) AS faulty FROM ({_SAID}) x GROUP BY source_id)
    SELECT s.source_id, array_to_string(list_filter([CASE WHEN source_key = '' THEN 'key_length' END, CASE WHEN coalesce(n, 0) NOT BETWEEN 1 AND 100 THEN 'message_count' END, CASE WHEN faulty > 0 THEN 'message_faulty' END, CASE WHEN longest > 300 THEN 'message_metadata' END,
      CASE WHEN created % 5 = 1 AND length(source_key) > 6 THEN 'metadata_invalid' WHEN created % 5 = 2 THEN 'metadata_invalid' END, CASE WHEN size > 900 THEN 'payload_too_long' END, CASE WHEN source_type = 'letter' THEN 'unknown_type' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM ({_SENT}) s LEFT JOIN m ON m.source_id = s.source_id""",
)
def p6s(t: Inputs) -> DataFrame:
    """Some sources without messages, keys or a known type; descriptions that are sound, missing, of a value too long or of an unknown field."""
    said = t.v_messages.where("source_id not like '%77'").withColumn("source_title", F.when(F.col("turn") % 6 == 5, F.repeat(F.lit("t"), (280 + F.col("turn") * 5).cast("int"))))
    c = F.col("created")
    long = F.create_map(F.lit("author"), F.repeat(F.lit("x"), F.when(F.length("source_key") > 6, 1001).otherwise(1000)))
    described = F.when(c % 5 == 0, F.create_map(F.lit("visibility"), F.lit("visible_only"))).when(c % 5 == 1, long).when(c % 5 == 2, F.create_map(F.lit("mood"), F.lit("good")))
    sent = t.v_sources.select("source_id", "created", F.when(c % 31 == 2, "").otherwise(F.col("source_key")).alias("source_key"), F.when(c % 37 == 3, "letter").otherwise(F.col("source_type")).alias("source_type"))
    return P.check_sources(sent.withColumn("metadata", described), said, 900).select("source_id", F.array_join("violations", ",").alias("violations"))


_GOV = "SELECT r.*, coalesce(g.state, 'candidate') AS state, g.holder, g.subject_id, g.as_of, g.valid_until, coalesce(g.priority, 'P3') AS priority, coalesce(g.revision, 0) AS review_revision FROM v_records r LEFT JOIN v_governance g USING (record_id)"
_USABLE = "lifecycle = 'active' AND state = 'verified' AND holder IS NOT NULL AND subject_id IS NOT NULL AND as_of <= DATE '2024-02-01' AND (valid_until IS NULL OR valid_until > DATE '2024-02-01')"


def governed(t: Inputs) -> DataFrame:
    return J.with_governance(t.v_records, t.v_governance)


@query("p7_state_filter", f"SELECT record_id, state FROM ({_GOV}) WHERE lifecycle = 'active' AND state = 'candidate'")
def p7(t: Inputs) -> DataFrame:
    return P.filter_state(governed(t), "candidate").select("record_id", "state")


@query("p7_history_filter", f"SELECT record_id, state FROM ({_GOV}) WHERE lifecycle <> 'active' OR state = 'historical'")
def p7h(t: Inputs) -> DataFrame:
    return P.filter_state(governed(t), "history").select("record_id", "state")


@query("p8_usable_records", f"SELECT record_id, holder, as_of, valid_until FROM ({_GOV}) WHERE {_USABLE}")
def p8(t: Inputs) -> DataFrame:
    return governed(t).where(P.usable_on(day())).select("record_id", "holder", "as_of", "valid_until")


_EVID = "SELECT r.*, m.role, m.text FROM v_records r LEFT JOIN v_messages m USING (source_id, message_id)"


@query("p9_quote_supported", f"SELECT record_id, coalesce(length(quote) > 0 AND contains(text, quote), false) AS supported FROM ({_EVID})")
def p9(t: Inputs) -> DataFrame:
    return P.quote_supported(J.with_evidence(t.v_records, t.v_messages)).select("record_id", "supported")


@query(
    "p11_derived_status",
    """SELECT source_id, message_id, CASE WHEN source_type = 'imported_summary' THEN 'imported_summary' WHEN role = 'assistant' THEN 'agent_suggested'
    WHEN role = 'user' AND trusted_user AND source_type = 'conversation' THEN 'user_stated' ELSE 'source_reported' END AS status FROM v_messages JOIN v_sources USING (source_id)""",
)
def p11(t: Inputs) -> DataFrame:
    m = t.v_messages.join(t.v_sources.select("source_id", "source_type", "trusted_user"), "source_id")
    return m.select("source_id", "message_id", P.derived_status(F.col("role"), F.col("source_type"), F.col("trusted_user")).alias("status"))


@query("p12_text_filter", "SELECT record_id FROM v_records WHERE contains(lower(concat_ws(' ', topic, statement)), 'people the') OR contains(lower(concat_ws(' ', topic, statement)), 'people an')")
def p12(t: Inputs) -> DataFrame:
    r = t.v_records
    return P.text_contains(r, ["topic", "statement"], "People THE").unionByName(P.text_contains(r, ["topic", "statement"], "people an")).select("record_id").distinct()


@query(
    "p13_candidate_gate",
    """SELECT claim_no, array_to_string(list_sort(list_filter([CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN text IS NULL THEN 'message_missing' END, CASE WHEN role <> 'user' THEN 'not_user' END,
    CASE WHEN NOT contains(text, quote) THEN 'quote_not_exact' END, CASE WHEN status NOT IN ('user_stated', 'source_reported') THEN 'status_not_allowed' END], lambda x: x IS NOT NULL)), ',') AS failures
    FROM (SELECT *, count(*) OVER (PARTITION BY source_id, message_id, statement) AS n FROM v_claims) c LEFT JOIN (SELECT source_id, message_id, role, text FROM v_messages) m USING (source_id, message_id)""",
)
def p13(t: Inputs) -> DataFrame:
    return P.candidate_gate(t.v_claims, t.v_messages).select("claim_no", F.array_join("failures", ",").alias("failures"))


@query(
    "p14_answer_contract",
    """SELECT task_id, array_to_string(list_sort(list_filter([CASE WHEN abstain <> (status = 'abstained') THEN 'abstain_mismatch' END, CASE WHEN status = 'answered' AND answer = '' THEN 'answer_missing' END,
    CASE WHEN len(citations) <> len(list_distinct(citations)) THEN 'citation_duplicate' END, CASE WHEN status = 'answered' AND len(citations) = 0 THEN 'citation_missing' END,
    CASE WHEN len(list_filter(citations, lambda c: NOT list_contains(have, c))) > 0 THEN 'citation_unknown' END], lambda x: x IS NOT NULL)), ',') AS violations
    FROM v_answers LEFT JOIN (SELECT task_id, list(evidence_id) AS have FROM v_evidence GROUP BY task_id) e USING (task_id)""",
)
def p14(t: Inputs) -> DataFrame:
    return P.check_answers(t.v_answers, t.v_evidence).select("task_id", F.array_join("violations", ",").alias("violations"))


SECRETS = {
    "access_key": r"AKIA[0-9A-Z]{16}",
    "bearer": r"[Bb]earer [A-Za-z0-9._-]{20,}",
    "card_number": r"\b[0-9]{16}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip_address": r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "private_path": r"/(home|Users)/[A-Za-z0-9._-]+/",
    "token_prefix": r"\b(sk|ghp|xoxb)[-_][A-Za-z0-9]{16,}",
}


@query("p15_secret_scan", "SELECT doc_id, rule FROM documents JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SECRETS.items()) + ") r(rule, pattern) ON regexp_matches(text, pattern)")
def p15(t: Inputs) -> DataFrame:
    return P.scan_secrets(t.documents.select("doc_id", "text"), "text", SECRETS).select("doc_id", "rule")


#: Documents as files of a tree, with one fault each in some.
_TREE = """SELECT concat(CASE doc_id % 17 WHEN 1 THEN 'private/' WHEN 2 THEN 'notes/private.d/' ELSE 'docs/' END, CASE doc_id % 13 WHEN 3 THEN '.env' WHEN 4 THEN concat('d', CAST(doc_id AS STRING), '.gz') WHEN 5 THEN concat(CAST(doc_id AS STRING), '.json') ELSE concat(CAST(doc_id AS STRING), '.txt') END) AS path,
    CASE WHEN doc_id % 13 = 5 THEN CASE doc_id % 4 WHEN 0 THEN '{"synthetic": true}' WHEN 1 THEN '{"synthetic": "true"}' WHEN 2 THEN '[1]' ELSE '{"a' END
      ELSE concat(text, CASE doc_id % 11 WHEN 1 THEN ' -----BEGIN EC PRIVATE KEY-----' WHEN 2 THEN concat(' ghp_', repeat('aB3', 10)) WHEN 3 THEN concat(' ark-0123abcd-', repeat('0', 20)) WHEN 4 THEN concat(' AKID', repeat('x', 16)) WHEN 5 THEN ' ep-20240101000000-ab' WHEN 6 THEN ' /home/runner/x' WHEN 7 THEN ' /home/runners/x' WHEN 8 THEN ' sk-short' ELSE '' END) END AS text
    FROM {documents}"""
_HOME = "(regexp_matches(text, '/Users/[^/\\s]+/') OR len(list_filter(regexp_extract_all(text, '/home/([^/\\s]+)/', 1), lambda x: NOT regexp_matches(x, '^runner([^A-Za-z0-9_]|$)'))) > 0)"


@query(
    "p15_public_tree",
    f"""SELECT path, unnest(list_filter([CASE WHEN {_HOME} THEN 'user-home-path' END, {", ".join(f"CASE WHEN regexp_matches(text, '{v}') THEN '{k}' END" for k, v in P.PUBLIC_SECRETS.items() if k != "user-home-path")},
      CASE WHEN name = '.env' OR starts_with(path, 'private/') OR ends_with(path, '.gz') THEN 'private-runtime-file' END, CASE WHEN ends_with(path, '.json') AND NOT json_valid(text) THEN 'invalid-json' END,
      CASE WHEN ends_with(path, '.json') AND json_valid(text) AND text <> '{{"synthetic": true}}' THEN 'json-must-be-marked-synthetic' END], lambda x: x IS NOT NULL)) AS rule
    FROM (SELECT *, string_split(path, '/')[-1] AS name FROM ({_TREE.replace("{documents}", "documents")})) x""",
)
def p15t(t: Inputs) -> DataFrame:
    sql = _TREE.replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}")
    return P.scan_tree(t.spark.sql(sql, documents=t.documents))


# joins


@query("j1_hydrate", "SELECT record_id, source_key, source_type, trusted_user FROM v_records JOIN (SELECT source_id, source_key, source_type, trusted_user FROM v_sources) s USING (source_id)")
def j1(t: Inputs) -> DataFrame:
    return J.hydrate(t.v_records, t.v_sources).select("record_id", "source_key", "source_type", "trusted_user")


@query("j2_governance_defaults", f"SELECT record_id, state, priority, review_revision FROM ({_GOV})")
def j2(t: Inputs) -> DataFrame:
    return governed(t).select("record_id", "state", "priority", "review_revision")


@query("j3_display_fallback", "SELECT record_id, coalesce(t.display_statement, r.statement) AS display_statement FROM v_records r LEFT JOIN (SELECT * FROM v_translations WHERE language = 'fr') t USING (record_id)")
def j3(t: Inputs) -> DataFrame:
    return J.with_display(t.v_records, t.v_translations, "fr").select("record_id", "display_statement")


@query("j4_cited_message", f"SELECT record_id, role, length(text) AS text_chars FROM ({_EVID})")
def j4(t: Inputs) -> DataFrame:
    return J.with_evidence(t.v_records, t.v_messages).select("record_id", "role", F.length("text").alias("text_chars"))


@query(
    "j5_material_inventory",
    """SELECT s.source_id, s.owner, s.scope, coalesce(c.n, 0) AS claims, coalesce(c.a, 0) AS active_claims, substr(m.text, 1, 180) AS preview FROM v_sources s
    LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE lifecycle = 'active') AS a FROM v_records GROUP BY 1) c USING (source_id)
    LEFT JOIN (SELECT source_id, arg_min(text, turn) AS text FROM v_messages GROUP BY 1) m USING (source_id)""",
)
def j5(t: Inputs) -> DataFrame:
    return J.material_inventory(t.v_sources, t.v_records, t.v_messages)


#: Sources that may be indexed with the digest of their payload, type and key; the index knows an older one of some.
_INDEXED = "SELECT source_id, digest, sha256(concat_ws(chr(31), digest, source_type, source_key)) AS payload_digest FROM v_sources WHERE source_type <> 'conversation' OR parser_version = 'v2'"
_KNOWN = "SELECT v.source_id, v.digest, index_version, CASE WHEN created % 7 = 3 THEN 'old' ELSE sha256(concat_ws(chr(31), s.digest, source_type, source_key)) END AS payload_digest FROM v_versions v LEFT JOIN (SELECT source_id, digest, source_type, source_key, created FROM v_sources) s ON s.source_id = v.source_id"


def _indexed(t: Inputs) -> tuple[DataFrame, DataFrame]:
    own = J.payload_digest("digest", "source_type", "source_key")
    sources = P.eligible(t.v_sources).withColumn("payload_digest", own)
    told = t.v_sources.select("source_id", F.when(F.col("created") % 7 == 3, "old").otherwise(own).alias("payload_digest"))
    lost = F.sha2(F.lit(""), 256)
    return sources, t.v_versions.join(told, "source_id", "left").withColumn("payload_digest", F.coalesce("payload_digest", lost))


@query(
    "j6_index_plan",
    f"""SELECT coalesce(s.source_id, v.source_id) AS source_id, CASE WHEN v.source_id IS NULL THEN 'new' WHEN s.source_id IS NULL THEN 'removed'
    WHEN s.digest = v.digest AND v.index_version = 'idx-2' AND s.payload_digest = v.payload_digest THEN 'unchanged' ELSE 'changed' END AS action FROM ({_INDEXED}) s FULL JOIN ({_KNOWN}) v ON s.source_id = v.source_id""",
)
def j6(t: Inputs) -> DataFrame:
    return J.plan_index(*_indexed(t), "idx-2")


_CHUNKS = "SELECT v.source_id, v.digest, v.payload_digest, m.message_id, 0 AS start_char FROM ({}) v JOIN v_messages m ON m.source_id = v.source_id"


@query("j7_live_chunks", f"SELECT c.source_id, c.message_id FROM ({_CHUNKS.format(_KNOWN)}) c JOIN ({_INDEXED}) s ON s.source_id = c.source_id AND s.digest = c.digest AND s.payload_digest = c.payload_digest")
def j7(t: Inputs) -> DataFrame:
    sources, versions = _indexed(t)
    chunks = t.v_messages.join(versions.select("source_id", "digest", "payload_digest"), "source_id")
    return J.live_chunks(chunks, sources).select("source_id", "message_id")


@query(
    "j8_verify_archive",
    """SELECT coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN b.source_id IS NULL THEN 'missing' WHEN a.source_id IS NULL THEN 'extra' WHEN a.digest = b.digest THEN 'ok' ELSE 'changed' END AS status
    FROM v_sources a FULL JOIN v_versions b ON a.source_id = b.source_id""",
)
def j8(t: Inputs) -> DataFrame:
    return J.verify_archive(t.v_sources, t.v_versions, "source_id", ("digest",))


_SEQ = "SELECT conv_id, count(*) AS n, sum(chars) AS c, list({{'i': segment_index, 'd': digest}} ORDER BY segment_index) AS q FROM {} GROUP BY conv_id"


@query(
    "j9_compare_plans",
    f"""SELECT coalesce(o.conv_id, w.conv_id) AS conv_id, coalesce(o.n, 0) AS old_segments, coalesce(w.n, 0) AS new_segments, CAST(coalesce(o.c, 0) AS BIGINT) AS old_chars, CAST(coalesce(w.c, 0) AS BIGINT) AS new_chars,
    CASE WHEN o.conv_id IS NULL THEN 'added' WHEN w.conv_id IS NULL THEN 'unmatched' WHEN o.q = w.q THEN 'same' ELSE 'changed' END AS change
    FROM ({_SEQ.format("v_prev_segments")}) o FULL JOIN ({_SEQ.format("v_segments")}) w ON o.conv_id = w.conv_id""",
)
def j9(t: Inputs) -> DataFrame:
    return J.compare_plans(t.v_prev_segments, t.v_segments)


@query(
    "j10_claim_diff",
    """SELECT claim_no, CASE WHEN s.ids IS NOT NULL THEN 'duplicate' WHEN n.ids IS NOT NULL THEN 'related_needs_review' ELSE 'new' END AS relation, coalesce(s.ids, n.ids, '') AS related FROM v_claims c
    LEFT JOIN (SELECT source_id, message_id, statement, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS ids FROM v_records GROUP BY 1, 2, 3) s USING (source_id, message_id, statement)
    LEFT JOIN (SELECT owner, scope, subject, kind, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS ids FROM v_records WHERE lifecycle = 'active' GROUP BY 1, 2, 3, 4) n USING (owner, scope, subject, kind)""",
)
def j10(t: Inputs) -> DataFrame:
    return J.diff_claims(t.v_claims, t.v_records).withColumn("related", F.array_join("related", ","))


_ATTR = "SELECT x.*, s.source_type, m.role FROM {} x JOIN (SELECT source_id, source_type FROM v_sources) s USING (source_id) JOIN (SELECT source_id, message_id, role FROM v_messages) m USING (source_id, message_id)"


def _attributed(t: Inputs, df: DataFrame) -> DataFrame:
    return df.join(t.v_sources.select("source_id", "source_type"), "source_id").join(t.v_messages.select("source_id", "message_id", "role"), ["source_id", "message_id"])


@query(
    "j11_association_links",
    rf"""WITH c AS (SELECT *, trim(regexp_replace(statement, '\s+', ' ', 'g')) AS norm FROM ({_ATTR.format("v_claims")})), r AS (SELECT *, trim(regexp_replace(statement, '\s+', ' ', 'g')) AS norm FROM ({_ATTR.format("v_records")})),
    l AS (SELECT claim_no, record_id, CASE WHEN length(c.norm) >= 5 AND c.norm = r.norm AND c.topic = r.topic AND c.kind = r.kind AND c.subject = r.subject THEN 'exact_statement' ELSE 'same_evidence' END AS relation
      FROM c JOIN r ON c.owner = r.owner AND c.scope = r.scope AND c.source_type = r.source_type AND c.role = r.role AND c.status = r.status
      AND ((length(c.norm) >= 5 AND c.norm = r.norm AND c.topic = r.topic AND c.kind = r.kind AND c.subject = r.subject) OR (c.source_id = r.source_id AND c.message_id = r.message_id AND c.quote = r.quote))),
    n AS (SELECT *, row_number() OVER (PARTITION BY claim_no ORDER BY record_id) AS n FROM l) SELECT claim_no, record_id, relation FROM n WHERE n <= 20""",
)
def j11(t: Inputs) -> DataFrame:
    return J.association_links(_attributed(t, t.v_claims), _attributed(t, t.v_records))


@query(
    "j12_evidence_remap",
    """SELECT record_id, CASE WHEN n = 1 THEN 'mapped' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS mapping FROM (
    SELECT r.record_id, count(*) FILTER (WHERE contains(m.text, r.quote)) AS n FROM v_records r LEFT JOIN (SELECT source_id, message_id, text FROM v_messages UNION ALL SELECT source_id, message_id, substr(text, 1, 60) FROM v_messages WHERE turn % 3 = 0) m USING (source_id, message_id) GROUP BY 1)""",
)
def j12(t: Inputs) -> DataFrame:
    """Messages that were cut into parts: every third one also has its beginning as a part of its own."""
    m = t.v_messages
    parts = m.select("source_id", F.concat("message_id", F.lit("#1")).alias("message_id"), "text")
    return J.map_evidence(t.v_records, parts.unionByName(m.where("turn % 3 = 0").select("source_id", F.concat("message_id", F.lit("#2")).alias("message_id"), F.substring("text", 1, 60).alias("text"))))


_REFS = """SELECT record_id, owner, scope, field, entity_id FROM (
    SELECT r.record_id, r.owner, r.scope, 'holder' AS field, g.holder AS entity_id FROM v_records r JOIN v_governance g USING (record_id)
    UNION ALL SELECT r.record_id, r.owner, r.scope, 'subject_id', g.subject_id FROM v_records r JOIN v_governance g USING (record_id)) x
    WHERE entity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_entities e WHERE e.owner = x.owner AND e.scope = x.scope AND e.id = x.entity_id)"""


#: What some reader may read.
_READABLE = "SELECT DISTINCT owner, unnest(scopes) AS scope FROM v_grants WHERE list_contains(actions, 'read')"
_CROSS = f"EXISTS (SELECT 1 FROM v_entities e JOIN ({_READABLE}) g ON g.owner = e.owner AND g.scope = e.scope WHERE e.owner = y.owner AND e.id = y.entity_id)"


def readable(t: Inputs) -> DataFrame:
    return t.v_grants.where("array_contains(actions, 'read')").select("owner", F.explode("scopes").alias("scope")).distinct()


@query("j13_unresolved_entities", f"SELECT record_id, field, entity_id, {_CROSS} AS cross_scope FROM ({_REFS}) y")
def j13(t: Inputs) -> DataFrame:
    return J.unresolved_entities(t.v_records, t.v_governance, t.v_entities, readable(t))


@query("j14_dangling_supersedes", "SELECT record_id, supersedes FROM v_records r WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_records p WHERE p.record_id = r.supersedes)")
def j14(t: Inputs) -> DataFrame:
    return J.dangling(t.v_records).select("record_id", "supersedes")


_TOPIC = "SELECT DISTINCT s.source_id, x.slug FROM v_sources s JOIN (SELECT owner, scope, slug, unnest(prefixes) AS p FROM v_topics) x ON s.owner = x.owner AND s.scope = x.scope AND starts_with(s.source_key, x.p)"


@query("j15_topic_prefixes", _TOPIC)
def j15(t: Inputs) -> DataFrame:
    return J.assign_topics(t.v_sources, t.v_topics)


@query(
    "j16_document_references",
    r"""SELECT DISTINCT v.version_id, x.record_id FROM (SELECT source_id AS version_id, unnest(regexp_extract_all(text, '\b(r[0-9]+)\b', 1)) AS record_id FROM (
    SELECT source_id, string_agg(concat('see ', record_id, CASE WHEN k % 3 = 0 THEN ' and r999999999' ELSE '' END), '; ') AS text FROM v_records GROUP BY source_id) d) x JOIN (SELECT source_id AS version_id FROM v_sources) v USING (version_id)
    WHERE EXISTS (SELECT 1 FROM v_records r WHERE r.record_id = x.record_id)""",
)
def j16(t: Inputs) -> DataFrame:
    said = F.concat(F.lit("see "), "record_id", F.when(F.col("k") % 3 == 0, " and r999999999").otherwise(""))
    docs = t.v_records.groupBy(F.col("source_id").alias("version_id")).agg(F.array_join(F.collect_list(said), "; ").alias("text"))
    return J.doc_references(docs, t.v_records)


@query(
    "j17_fresh_sample",
    """SELECT source_id, message_id FROM v_messages m WHERE role = 'user' AND length(text) <= 2000 AND turn % 4 <> 1 AND NOT EXISTS (SELECT 1 FROM v_claims c WHERE c.source_id = m.source_id AND c.message_id = m.message_id)
    AND NOT EXISTS (SELECT 1 FROM v_segments s WHERE CAST(s.conv_id AS STRING) = m.source_id AND s.state = 'failed')""",
)
def j17(t: Inputs) -> DataFrame:
    done = t.v_segments.where("state = 'failed'").select(F.col("conv_id").cast("string").alias("source_id"))
    m = t.v_messages
    split = m.where("turn % 4 = 1").withColumn("message_id", F.explode(F.transform(F.array(F.lit("#1"), F.lit("#2")), lambda p: F.concat("message_id", p))))
    return J.select_fresh(m.where("turn % 4 <> 1").unionByName(split), t.v_claims, done).select("source_id", "message_id")


@query(
    "j18_span_resolution",
    """SELECT c.claim_no, CASE WHEN s.m IS NULL THEN 'unknown_span' WHEN s.m <> c.message_id THEN 'conflict' ELSE 'ok' END AS resolution FROM (SELECT *, CAST(claim_no % 5 AS INT) AS span_no FROM v_claims) c
    LEFT JOIN (SELECT source_id, span_no, message_id AS m FROM v_spans WHERE message_id IN ('m0', 'm1')) s ON c.source_id = s.source_id AND c.span_no = s.span_no""",
)
def j18(t: Inputs) -> DataFrame:
    claims = t.v_claims.withColumn("span_no", (F.col("claim_no") % 5).cast("int"))
    return J.resolve_claims(claims, t.v_spans.where("message_id in ('m0', 'm1')")).select("claim_no", "resolution")


@query(
    "j19_valid_on_days",
    f"""SELECT d.day, record_id FROM ({_GOV}) g JOIN (SELECT DISTINCT CAST('2024-01-05' AS DATE) + CAST(item_id % 50 AS INT) AS day FROM benchmark) d ON as_of <= d.day AND (valid_until IS NULL OR valid_until > d.day)
    WHERE lifecycle = 'active' AND state = 'verified' AND holder IS NOT NULL AND subject_id IS NOT NULL AND (valid_until IS NULL OR valid_until > as_of)""",
)
def j19(t: Inputs) -> DataFrame:
    days = t.benchmark.select(F.date_add(F.lit("2024-01-05").cast("date"), (F.col("item_id") % 50).cast("int")).alias("day"))
    return J.valid_on(governed(t), days)


@query(
    "j20_source_dependencies",
    f"""SELECT source_id, records, open_jobs, topic_rules, index_chunks, array_to_string(list_filter([CASE WHEN index_chunks > 0 THEN 'derived_index_dependency' END, CASE WHEN topic_rules > 0 THEN 'projection_and_history_dependency' END,
    CASE WHEN records > 0 THEN 'record_evidence_dependency' END, CASE WHEN open_jobs > 0 THEN 'unfinished_processing' END], lambda x: x IS NOT NULL), ',') AS risks FROM (
    SELECT s.source_id, coalesce(r.n, 0) AS records, coalesce(j.n, 0) AS open_jobs, coalesce(p.n, 0) AS topic_rules, coalesce(c.n, 0) AS index_chunks FROM v_sources s
    LEFT JOIN (SELECT source_id, count(*) AS n FROM v_records GROUP BY 1) r USING (source_id)
    LEFT JOIN (SELECT CAST(conv_id AS STRING) AS source_id, count(*) AS n FROM v_segments WHERE state IN ('queued', 'processing') GROUP BY 1) j USING (source_id)
    LEFT JOIN (SELECT source_id, count(*) AS n FROM ({_TOPIC}) GROUP BY 1) p USING (source_id)
    LEFT JOIN (SELECT source_id, count(*) AS n FROM v_spans GROUP BY 1) c USING (source_id)) x""",
)
def j20(t: Inputs) -> DataFrame:
    jobs = t.v_segments.select(F.col("conv_id").cast("string").alias("source_id"), "state")
    return J.dependencies(t.v_sources, t.v_records, jobs, t.v_topics, t.v_spans)


@query("j21_auto_topics", f"SELECT source_id, concat('source-', substr(sha256(source_key), 1, 12)) AS slug FROM v_sources WHERE source_id IN (SELECT source_id FROM v_records) AND source_id NOT IN (SELECT source_id FROM ({_TOPIC}))")
def j21(t: Inputs) -> DataFrame:
    return J.auto_topics(t.v_sources, t.v_records, t.v_topics)


# sets


@query(
    "u1_union_plans",
    """SELECT CAST(conv_id AS STRING) AS unit, segment_index, n_messages, CAST(NULL AS STRING) AS slug FROM v_segments UNION ALL SELECT source_key, NULL, NULL, owner FROM v_sources WHERE source_type = 'imported_summary'""",
)
def u1(t: Inputs) -> DataFrame:
    a = t.v_segments.select(F.col("conv_id").cast("string").alias("unit"), "segment_index", "n_messages")
    b = t.v_sources.where("source_type = 'imported_summary'").select(F.col("source_key").alias("unit"), F.col("owner").alias("slug"))
    return U.union_segments(a, b)


@query("u2_removed_keys", "SELECT DISTINCT source_id FROM v_versions WHERE source_id NOT IN (SELECT source_id FROM v_sources)")
def u2(t: Inputs) -> DataFrame:
    return U.except_keys(t.v_versions, t.v_sources, ["source_id"])


@query("u3_set_difference", "SELECT source_id, digest, 'left' AS side FROM (SELECT source_id, digest FROM v_sources EXCEPT SELECT source_id, digest FROM v_versions) UNION ALL SELECT source_id, digest, 'right' FROM (SELECT source_id, digest FROM v_versions EXCEPT SELECT source_id, digest FROM v_sources)")
def u3(t: Inputs) -> DataFrame:
    return U.set_diff(t.v_sources.select("source_id", "digest"), t.v_versions.select("source_id", "digest"))


@query("u4_intersection", "SELECT task_id, doc_id FROM v_retrieved INTERSECT SELECT task_id, doc_id FROM v_labels")
def u4(t: Inputs) -> DataFrame:
    return U.intersection(t.v_retrieved.select("task_id", "doc_id"), t.v_labels.select("task_id", "doc_id"))


@query(
    "u5_corpus_union",
    """WITH w AS (SELECT DISTINCT record_id FROM v_records WHERE lifecycle = 'active' OR k % 7 = 0), p AS (SELECT record_id FROM v_records WHERE lifecycle = 'active' UNION SELECT record_id FROM v_records WHERE k % 10 = 0)
    SELECT record_id, 'left' AS side FROM (SELECT * FROM p EXCEPT SELECT * FROM w) UNION ALL SELECT record_id, 'right' FROM (SELECT * FROM w EXCEPT SELECT * FROM p)""",
)
def u5(t: Inputs) -> DataFrame:
    r = t.v_records
    parts = [r.where("lifecycle = 'active'").select("record_id"), r.where("k % 10 = 0").select("record_id")]
    return U.corpus_union_check(parts, r.where("lifecycle = 'active' or k % 7 = 0").select("record_id"))


@query(
    "u6_version_line_diff",
    """WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS s FROM documents), n AS (SELECT doc_id, unnest(string_split(concat('edited', chr(10), replace(text, ' the ', ' a ')), chr(10))) AS line, 1 AS s FROM documents),
    d AS (SELECT doc_id, line, sum(s) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2) SELECT doc_id, line, CASE WHEN n > 0 THEN '+' ELSE '-' END AS mark, CAST(abs(n) AS BIGINT) AS n FROM d WHERE n <> 0""",
)
def u6(t: Inputs) -> DataFrame:
    old = t.documents.select("doc_id", "text")
    return U.version_line_diff(old, old.withColumn("text", F.concat(F.lit("edited\n"), F.replace("text", F.lit(" the "), F.lit(" a ")))), "doc_id")


# windows


@query("w1_latest_revision", "SELECT source_id, record_id, revision FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY revision DESC, k DESC) AS n FROM v_records) WHERE n = 1")
def w1(t: Inputs) -> DataFrame:
    return W.latest_by(t.v_records, ["source_id"], F.desc("revision"), F.desc("k")).select("source_id", "record_id", "revision")


@query("w2_stratified_sample", "SELECT status, record_id FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY sha256(record_id), record_id) AS n FROM v_records) WHERE n <= 5")
def w2(t: Inputs) -> DataFrame:
    return W.stratified_sample(t.v_records, "status", "record_id", 5).select("status", "record_id")


@query(
    "w3_timeline_sample",
    """WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY min(day), conv_id) - 1 AS place, count(*) OVER () AS total FROM v_segments GROUP BY conv_id),
    p AS (SELECT DISTINCT CAST(round_even(i * (total - 1)::DOUBLE / (least(10, total) - 1), 0) AS BIGINT) AS place FROM (SELECT DISTINCT total FROM c), range(0, 10) r(i) WHERE i < total)
    SELECT conv_id, min(segment_index) AS segment_index FROM v_segments WHERE conv_id IN (SELECT conv_id FROM c JOIN p USING (place)) GROUP BY conv_id""",
)
def w3(t: Inputs) -> DataFrame:
    return W.timeline_sample(t.v_segments)


@query(
    "w4_chain_root",
    """WITH RECURSIVE p AS (SELECT record_id, CASE WHEN supersedes IN (SELECT record_id FROM v_records) THEN supersedes END AS up FROM v_records),
    c AS (SELECT record_id, record_id AS root_id FROM p WHERE up IS NULL UNION ALL SELECT p.record_id, c.root_id FROM p JOIN c ON p.up = c.record_id) SELECT record_id, root_id FROM c""",
)
def w4(t: Inputs) -> DataFrame:
    return W.chain_root(t.v_records)


@query("w5_group_pages", "SELECT DISTINCT owner, subject, CAST(floor((dense_rank() OVER (PARTITION BY owner ORDER BY subject) - 1) / 25) AS INT) AS page FROM v_records")
def w5(t: Inputs) -> DataFrame:
    return W.page_groups(t.v_records.select("owner", "subject").distinct(), ["owner"], "subject")


@query("w6_reference_labels", "SELECT source_id, record_id, concat('S', row_number() OVER (PARTITION BY source_id ORDER BY created, record_id)) AS label FROM v_records")
def w6(t: Inputs) -> DataFrame:
    return W.ref_labels(t.v_records, ["source_id"], "created", "record_id").select("source_id", "record_id", "label")


@query("w7_global_offsets", "SELECT source_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, length(text) AS chars FROM v_messages")
def w7(t: Inputs) -> DataFrame:
    return W.global_offsets(t.v_messages, "source_id", "turn").select("source_id", "turn", "start_char", (F.col("end_char") - F.col("start_char")).alias("chars"))


@query("w8_neighbours", "SELECT source_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM v_messages WINDOW w AS (PARTITION BY source_id ORDER BY turn)")
def w8(t: Inputs) -> DataFrame:
    return W.neighbours(t.v_messages, "source_id", "turn").select("source_id", "turn", "previous", "next")


@query("w9_first_duplicate", "SELECT k, CASE WHEN k > m THEN m END AS duplicate_of FROM (SELECT k, min(k) OVER (PARTITION BY topic, kind, subject, status, substr(statement, 1, 2)) AS m FROM v_records)")
def w9(t: Inputs) -> DataFrame:
    r = t.v_records.withColumn("head", F.substring("statement", 1, 2))
    return W.first_duplicate(r, ["topic", "kind", "subject", "status", "head"], "k").select("k", "duplicate_of")


@query(
    "w11_claim_caps",
    "SELECT k, count(*) OVER (PARTITION BY source_id) > 5 OR count(*) FILTER (WHERE status = 'agent_suggested') OVER (PARTITION BY source_id) > 2 AS over_cap FROM v_records",
)
def w11(t: Inputs) -> DataFrame:
    return W.claim_caps(t.v_records, 5, 2).select("k", "over_cap")


@query(
    "w12_segment_check",
    """WITH g AS (SELECT source_id, turn AS segment_no, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) + CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 2 ELSE 0 END AS s, CAST(coalesce(sum(length(text)) OVER w, 0) + length(text) AS BIGINT) AS e, conv_id FROM v_messages
      WINDOW w AS (PARTITION BY source_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT source_id, s <> coalesce(lag(e) OVER (PARTITION BY source_id ORDER BY segment_no), 0) AS gap, e FROM g WHERE NOT (conv_id % 11 = 5 AND segment_no = 1)),
    y AS (SELECT source_id, count(*) FILTER (WHERE gap) AS gaps, max(e) AS covered FROM x GROUP BY 1), z AS (SELECT source_id, CAST(sum(length(text)) AS BIGINT) AS size FROM v_messages GROUP BY 1)
    SELECT source_id, array_to_string(list_filter([CASE WHEN coalesce(gaps, 0) > 0 THEN 'gap_or_overlap' END, CASE WHEN coalesce(covered, 0) <> size THEN 'not_covered' END], lambda v: v IS NOT NULL), ',') AS problems FROM z LEFT JOIN y USING (source_id)""",
)
def w12(t: Inputs) -> DataFrame:
    g = W.global_offsets(t.v_messages, "source_id", "turn").withColumnRenamed("turn", "segment_no")
    g = g.withColumn("start_char", F.col("start_char") + F.when((F.col("conv_id") % 7 == 3) & (F.col("segment_no") == 1), 2).otherwise(0))
    sizes = t.v_messages.groupBy("source_id").agg(F.sum(F.length("text")).alias("size"))
    return W.verify_segments(g.where("not (conv_id % 11 = 5 and segment_no = 1)"), sizes)


@query(
    "w13_clause_overlap",
    r"""WITH c AS (SELECT source_id, 'x' AS topic, 'y' AS subject, 'z' AS status, turn AS claim_no, text AS statement FROM v_messages),
    p AS (SELECT DISTINCT source_id, claim_no, statement, trim(unnest(regexp_split_to_array(statement, '[.,;:!?\n，。；！？、]'))) AS clause FROM c)
    SELECT a.source_id, a.claim_no AS first_no, b.claim_no AS second_no, count(*) AS shared FROM p a JOIN p b ON a.source_id = b.source_id AND a.clause = b.clause AND a.claim_no < b.claim_no AND a.statement <> b.statement WHERE length(a.clause) >= 8 GROUP BY 1, 2, 3""",
)
def w13(t: Inputs) -> DataFrame:
    c = t.v_messages.select("source_id", F.lit("x").alias("topic"), F.lit("y").alias("subject"), F.lit("z").alias("status"), F.col("turn").alias("claim_no"), F.col("text").alias("statement"))
    return W.clause_overlap(c)


@query(
    "w14_conversation_preview",
    """SELECT source_id, substr(w, 1, 300) AS preview, length(w) > 300 AS truncated FROM (SELECT source_id, string_agg(text, chr(10) ORDER BY turn) AS w FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn) AS n FROM v_messages) WHERE n <= 3 GROUP BY 1)""",
)
def w14(t: Inputs) -> DataFrame:
    return W.conversation_preview(t.v_messages, 3, 300)


@query("t6_page_rows", "SELECT record_id, created FROM v_records ORDER BY created DESC, record_id LIMIT 25 OFFSET 10")
def t6(t: Inputs) -> DataFrame:
    return W.page_rows(t.v_records.select("record_id", "created"), 10, 25, F.desc("created"), F.col("record_id"))


@query("t8_budget_stop", "SELECT source_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM v_messages) WHERE used <= 900")
def t8(t: Inputs) -> DataFrame:
    m = t.v_messages.withColumn("size", F.length("text"))
    return W.fill_budget_stop(m, 900, "source_id", "turn").select("source_id", "turn", "used")
