"""Input tables of the registered queries, derived from the given data.

Each entry is SQL that Spark and DuckDB both run; ``{name}`` stands for another entry or a given table, so
the checks see the same inputs. Ids and digests are derived from the data, never random.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("documents", "benchmark", "conversations", "events")

TABLES = {
    "v_messages": """
SELECT conv_id, turn, CAST(conv_id AS STRING) AS source_id, concat('m', CAST(turn AS STRING)) AS message_id,
       CASE role WHEN 'system' THEN 'external' ELSE role END AS role, text
FROM {conversations}""",
    "v_sources": """
SELECT CAST(conv_id AS STRING) AS source_id, concat('owner-', CAST(conv_id % 3 AS STRING)) AS owner, concat('scope-', CAST(conv_id % 4 AS STRING)) AS scope,
       concat('conv:', CAST(conv_id AS STRING)) AS source_key,
       CASE WHEN conv_id % 10 = 0 THEN 'imported_summary' WHEN conv_id % 10 = 1 THEN 'document' ELSE 'conversation' END AS source_type,
       conv_id % 2 = 0 AS trusted_user, conv_id AS created, count(*) AS n_messages,
       md5(concat(CAST(conv_id AS STRING), '|', CAST(count(*) AS STRING), '|', CAST(sum(length(text)) AS STRING))) AS digest,
       CASE conv_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' END AS parser_version
FROM {conversations} GROUP BY conv_id""",
    "v_records": """
SELECT concat('r', CAST(k AS STRING)) AS record_id, k, source_id, message_id, owner, scope,
       CASE k % 6 WHEN 0 THEN 'profile' WHEN 1 THEN 'preferences' WHEN 2 THEN 'people' WHEN 3 THEN 'areas' WHEN 4 THEN 'projects' ELSE 'topics' END AS topic,
       CASE k % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'decision' WHEN 2 THEN 'plan' ELSE 'preference' END AS kind,
       concat('subj-', CAST(k % 50 AS STRING)) AS subject, text AS statement,
       CASE WHEN k % 7 = 0 THEN concat('#', substr(text, 1, 40)) ELSE text END AS quote,
       CASE WHEN role = 'assistant' THEN 'agent_suggested' WHEN k % 13 = 0 THEN 'source_reported' ELSE 'user_stated' END AS status,
       CASE WHEN turn % 4 = 0 AND turn + 2 <= last_turn THEN 'superseded' ELSE 'active' END AS lifecycle,
       CASE WHEN turn % 4 = 2 THEN 2 ELSE 1 END AS revision,
       CASE WHEN k % 97 = 0 THEN 'r-missing' WHEN turn % 4 = 2 THEN concat('r', CAST(k - 2 AS STRING)) END AS supersedes, k AS created
FROM (SELECT m.*, s.owner, s.scope, m.conv_id * 100 + m.turn AS k, max(m.turn) OVER (PARTITION BY m.conv_id) AS last_turn
      FROM {v_messages} m JOIN {v_sources} s ON s.source_id = m.source_id) x""",
    "v_governance": """
SELECT record_id, CASE WHEN k % 11 = 0 THEN NULL ELSE concat('ent-', CAST(k % 9 AS STRING)) END AS holder, concat('ent-', CAST(k % 13 AS STRING)) AS subject_id,
       DATE '2024-01-01' + CAST(k % 60 AS INT) AS as_of, CASE WHEN k % 3 = 0 THEN DATE '2024-01-01' + CAST(k % 60 + k % 30 AS INT) END AS valid_until,
       CASE k % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'historical' ELSE 'rejected' END AS state,
       concat('P', CAST(k % 4 AS STRING)) AS priority, 1 AS revision
FROM {v_records} WHERE k % 5 <> 4""",
    "v_entities": "SELECT DISTINCT owner, scope, concat('ent-', CAST(k % 9 AS STRING)) AS id, concat('Entity ', CAST(k % 9 AS STRING)) AS name FROM {v_records}",
    "v_tasks": "SELECT item_id AS task_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'development' ELSE 'test' END AS split FROM {benchmark}",
    "v_labels": "SELECT b.item_id AS task_id, d.doc_id, 2 AS grade FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)",
    "v_attempts": """
SELECT event_id AS attempt_id, concat('owner-', CAST(user_id % 3 AS STRING)) AS owner, concat('scope-', CAST(user_id % 4 AS STRING)) AS scope,
       event_type AS operation, CAST(floor(value) AS BIGINT) + 100 AS reservation,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS total_tokens,
       CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 50 AS BIGINT) END AS prompt_tokens, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 20 AS BIGINT) END AS completion_tokens, ts
FROM {events}""",
    "v_budgets": "SELECT DISTINCT owner, scope, CAST(40000 AS BIGINT) AS cap FROM {v_attempts}",
    "v_grants": """
SELECT principal, owner, split(scopes, ',') AS scopes, split(actions, ',') AS actions, trusted_user, archive_only FROM (
SELECT 'reader-0' AS principal, 'owner-0' AS owner, 'scope-0,scope-1' AS scopes, 'read,source_read' AS actions, true AS trusted_user, false AS archive_only
UNION ALL SELECT 'reader-1', 'owner-1', 'scope-1,scope-2,scope-3', 'read', false, false
UNION ALL SELECT 'archive-1', 'owner-1', 'scope-1', 'read,write', false, true
UNION ALL SELECT 'writer-2', 'owner-2', 'scope-0,scope-2', 'read,source_read,write', true, false) g""",
    "v_topics": """
SELECT owner, scope, slug, split(prefixes, ',') AS prefixes FROM (
SELECT 'owner-0' AS owner, 'scope-0' AS scope, 'alpha' AS slug, 'conv:1,conv:2' AS prefixes
UNION ALL SELECT 'owner-0', 'scope-1', 'beta', 'conv:3' UNION ALL SELECT 'owner-1', 'scope-1', 'gamma', 'conv:1,conv:12,conv:4'
UNION ALL SELECT 'owner-2', 'scope-2', 'delta', 'conv:2,conv:5,conv:8') t""",
    "v_segments": """
SELECT conv_id, CAST(floor(turn / 3) AS INT) AS segment_index, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS chars,
       md5(concat(CAST(conv_id AS STRING), ':', CAST(min(turn) AS STRING), ':', CAST(sum(length(text)) AS STRING))) AS digest,
       CASE WHEN (conv_id + min(turn)) % 11 = 0 THEN 'failed' WHEN (conv_id + min(turn)) % 4 = 0 THEN 'processing' WHEN (conv_id + min(turn)) % 5 = 0 THEN 'queued' ELSE 'applied' END AS state,
       CASE WHEN conv_id % 9 = 0 THEN 'sample' ELSE 'remaining' END AS phase, CAST((conv_id * 7 + min(turn)) % 500 AS BIGINT) AS spent_tokens,
       concat('2024-', lpad(CAST(conv_id % 12 + 1 AS STRING), 2, '0'), '-01') AS day
FROM {conversations} GROUP BY conv_id, CAST(floor(turn / 3) AS INT)""",
    "v_prev_segments": """
SELECT conv_id, segment_index, n_messages, chars, CASE WHEN (conv_id + segment_index) % 4 = 0 THEN concat('x', digest) ELSE digest END AS digest
FROM {v_segments} WHERE conv_id % 13 <> 0
UNION ALL SELECT -1 - conv_id, segment_index, n_messages, chars, digest FROM {v_segments} WHERE conv_id % 17 = 0""",
    "v_versions": """
SELECT source_id, CASE WHEN created % 10 = 3 THEN concat('old', digest) ELSE digest END AS digest, CASE WHEN created % 14 = 5 THEN 'idx-1' ELSE 'idx-2' END AS index_version
FROM {v_sources} WHERE created % 10 <> 7
UNION ALL SELECT concat('ghost-', source_id), digest, 'idx-2' FROM {v_sources} WHERE created % 20 = 0""",
    "v_claims": """
SELECT k AS claim_no, source_id, message_id, owner, scope, topic, kind, subject, status,
       CASE WHEN k % 3 = 0 THEN statement WHEN k % 3 = 1 THEN concat(statement, ' more') ELSE substr(statement, 1, 60) END AS statement, quote
FROM {v_records} WHERE k % 2 = 0""",
    "v_told": """
SELECT source_id, message_id, conv_id, turn, role, k, g,
       CASE g WHEN 5 THEN '好的。' WHEN 6 THEN concat('Li Wei 来访。', text) WHEN 7 THEN concat('我希望休息。', text) WHEN 8 THEN concat('访客可以带水。', text)
              WHEN 9 THEN concat('如果批准就去。', text) WHEN 10 THEN '从现在起，这两条要求长期适用，直到我明确更改：回答必须简短' ELSE text END AS text,
       CASE k % 5 WHEN 0 THEN '2024-02-03T10:00:00Z' WHEN 2 THEN 'soon' END AS created_at, CASE WHEN conv_id % 4 = 1 THEN concat('Garden ', CAST(conv_id AS STRING)) END AS source_title
FROM (SELECT *, conv_id * 100 + turn AS k, CAST(floor((conv_id * 100 + turn) / 2) AS BIGINT) % 17 AS g FROM {v_messages}) x""",
    "v_judged": """
SELECT k AS claim_no, source_id, CASE WHEN g = 15 THEN 'm-none' ELSE message_id END AS message_id, g, CASE WHEN g = 2 THEN 'rumour' ELSE kind END AS kind, subject,
       CASE g WHEN 3 THEN 'misc' WHEN 6 THEN 'people' ELSE topic END AS topic,
       CASE g WHEN 4 THEN concat('#', substr(text, 1, 40)) WHEN 5 THEN '好的' WHEN 6 THEN 'Li Wei 来访' WHEN 7 THEN '我希望休息' WHEN 8 THEN '访客可以带水' WHEN 9 THEN '如果批准就去' WHEN 10 THEN text ELSE text END AS quote,
       concat(CASE WHEN g = 11 OR CAST(source_id AS BIGINT) % 10 = 0 OR created_at IS NULL OR created_at = 'soon' THEN '' ELSE '来源消息日期：2024-02-03（非事件成立时间，当前有效性待核实）。' END,
         CASE WHEN CAST(source_id AS BIGINT) % 10 <> 0 AND topic = 'projects' AND source_title IS NOT NULL AND k % 7 > 2 THEN concat('来源对话：', source_title, '。') ELSE '' END,
         CASE WHEN CAST(source_id AS BIGINT) % 10 <> 0 OR g = 12 THEN '' WHEN g = 13 THEN '摘要记载：' ELSE '摘要记载，原始时间未知：' END,
         CASE g WHEN 0 THEN '' WHEN 1 THEN repeat('x', 1201) WHEN 5 THEN '用户同意整个方案' WHEN 6 THEN '李伟（Li Wei）来访' WHEN 7 THEN '用户已决定休息' WHEN 8 THEN '访客必须带水' WHEN 9 THEN '计划去'
           WHEN 10 THEN '回答必须简短' WHEN 14 THEN '请写一篇游记' WHEN 16 THEN '从现在起，长期适用，直到我明确更改：回答必须简短' ELSE text END) AS statement
FROM (SELECT t.*, r.kind, r.subject, r.topic FROM {v_told} t JOIN (SELECT k, kind, subject, topic FROM {v_records}) r ON r.k = t.k) x""",
    "v_pasted": """
SELECT source_id, message_id, conv_id, turn, role, source_type,
       concat(CASE WHEN k % 3 = 0 THEN '请写一篇文章，' ELSE '' END, CASE k % 7 WHEN 0 THEN concat('请看：', chr(10), '你是一名编辑。职责：', repeat(text, 10)) WHEN 1 THEN concat('说明。第三章：', repeat(text, 10))
         WHEN 2 THEN concat('核心观点 内容架构 章末思考 ', text) WHEN 3 THEN concat('# a', chr(10), '# b', chr(10), '# c', chr(10), '你是谁 ', repeat(text, 20))
         WHEN 4 THEN concat('1.x', chr(10), '2.y', chr(10), '3.z', chr(10), ' 核心使命 ', repeat(text, 20)) WHEN 5 THEN concat(text, chr(10), chr(10), '继续', chr(10), chr(10), '如果批准，', text) ELSE text END) AS text
FROM (SELECT m.*, s.source_type, m.conv_id * 100 + m.turn AS k FROM {v_messages} m JOIN (SELECT source_id, source_type FROM {v_sources}) s ON s.source_id = m.source_id) x""",
    "v_corrections": """
SELECT concat('c', CAST(k AS STRING)) AS correction_id, record_id, CASE WHEN k % 27 = 0 THEN revision + 5 ELSE revision END AS revision,
       concat('corrected ', statement) AS statement, k AS created FROM {v_records} WHERE k % 9 = 0
UNION ALL SELECT concat('d', CAST(k AS STRING)), record_id, revision, concat('again ', statement), k + 1 FROM {v_records} WHERE k % 18 = 0""",
    "v_reviews": """
SELECT concat('w', CAST(k AS STRING)) AS review_id, record_id, CASE WHEN k % 8 = 0 THEN 7 WHEN k % 5 = 4 THEN 0 ELSE 1 END AS revision,
       concat('ent-', CAST(k % 12 AS STRING)) AS holder, concat('ent-', CAST(k % 7 AS STRING)) AS subject_id, DATE '2024-03-01' AS as_of, CAST(NULL AS DATE) AS valid_until,
       'verified' AS state, 'P1' AS priority, k AS created FROM {v_records} WHERE k % 4 = 0""",
    "v_changes": """
SELECT concat('q', CAST(k % 400 AS STRING)) AS request_key, record_id,
       CASE k % 3 WHEN 0 THEN 'viewpoint_change' WHEN 1 THEN 'withdrawal' ELSE 'correction' END AS change_kind,
       DATE '2024-02-01' + CAST(k % 20 AS INT) AS valid_from, CASE WHEN k % 4 = 0 THEN DATE '2024-01-15' + CAST(k % 40 AS INT) END AS previous_valid_until, k AS created
FROM {v_records} WHERE k % 5 < 3""",
    "v_spans": """
SELECT source_id, message_id, length(text) AS size, s.i AS span_no, least(s.i * 12, length(text)) AS start_char, least(s.i * 12 + CASE WHEN s.i % 2 = 0 THEN 15 ELSE 6 END, length(text)) AS end_char
FROM {v_messages} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 9) s WHERE turn % 5 <> 3""",
    "v_translations": "SELECT record_id, 'fr' AS language, concat('fr: ', statement) AS display_statement, k AS created FROM {v_records} WHERE k % 4 = 1",
    "v_answers": """
SELECT item_id AS task_id, CASE WHEN item_id % 4 = 0 THEN 'abstained' ELSE 'answered' END AS status, item_id % 4 = 0 OR item_id % 9 = 1 AS abstain,
       split(concat('e', CAST(item_id AS STRING), CASE WHEN item_id % 5 = 0 THEN concat(',e', CAST(item_id AS STRING)) WHEN item_id % 7 = 0 THEN ',e-none' ELSE '' END), ',') AS citations,
       CASE WHEN item_id % 6 = 0 THEN '' ELSE substr(text, 1, 30) END AS answer FROM {benchmark}""",
    "v_evidence": "SELECT item_id AS task_id, concat('e', CAST(item_id AS STRING)) AS evidence_id FROM {benchmark}",
    "v_retrieved": """
SELECT task_id, doc_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY (doc_id * 31 + task_id * 17) % 13, doc_id) AS INT) AS rank,
       CASE doc_id % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'candidate' ELSE 'combined' END AS route
FROM (SELECT b.item_id AS task_id, d.doc_id FROM {benchmark} b JOIN {documents} d ON d.doc_id % 140 = b.item_id % 140 UNION SELECT task_id, doc_id FROM {v_labels} WHERE doc_id % 3 <> 1) x""",
    "v_verdicts": """
SELECT record_id, d.dimension, CASE (k + d.n) % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'ambiguous' WHEN 2 THEN NULL ELSE 'passed' END AS verdict
FROM {v_records} CROSS JOIN (SELECT 'fact' AS dimension, 1 AS n UNION ALL SELECT 'scope', 2 UNION ALL SELECT 'time', 3) d WHERE (k + d.n) % 7 <> 0""",
}


def _passage_labels(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    """``v_labels`` by equality: a document that holds a passage holds the words within it, so four of these, the longest, are the key of a join.

    Passages of fewer than six words have no such key; these alone are looked for in every text.
    """

    def grams(first: int, before_end: int) -> Column:
        def of(words: Column) -> Column:
            end = F.size(words) - before_end
            at = F.when(end >= first, F.sequence(F.lit(first), end)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.array_join(F.slice(words, i, 4), " "))

        # the words are bound once, not split again for each place
        return F.element_at(F.transform(F.array(words), of), 1)

    words = F.split("text", " ", -1)
    passages = benchmark.select("item_id", F.col("text").alias("passage"), F.size(words).alias("n"), grams(2, 4).alias("keys"))
    key = F.array_max(F.transform("keys", lambda g: F.struct(F.length(g), g.alias("gram"))))["gram"]
    keyed = passages.where("n >= 6").select("item_id", F.xxhash64(key).alias("key"))
    held = documents.select("doc_id", F.explode(F.array_distinct(F.transform(grams(1, 3), lambda g: F.xxhash64(g)))).alias("key"))
    likely = held.join(keyed, "key").select("item_id", "doc_id").distinct()
    texts = documents.select("doc_id", "text")
    found = likely.join(passages.where("n >= 6").select("item_id", "passage"), "item_id").join(texts, "doc_id").where("contains(text, passage)")
    short = texts.join(passages.where("n < 6").select("item_id", "passage"), F.expr("contains(text, passage)"))
    return found.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).select(F.col("item_id").alias("task_id"), "doc_id", F.lit(2).alias("grade"))


#: Tables whose SQL would be a nested loop in Spark: the same rows by a join on equality.
BY_JOIN = {"v_labels": _passage_labels}


def tables_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """The named table as a DataFrame; shared parts of a query are derived once."""
    seen = {} if seen is None else seen
    if name not in seen:
        if name in TABLES:
            parts = {t: table(spark, sf_dir, t, seen) for t in tables_in(TABLES[name])}
            seen[name] = BY_JOIN[name](**parts) if name in BY_JOIN else spark.sql(TABLES[name], **parts)
        else:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return seen[name]


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in out:
            for t in tables_in(TABLES[name]):
                visit(t)
            out.append(name)

    for n in names:
        visit(n)
    return out


def duckdb_sql(body: str) -> str:
    """``body`` (which may begin with WITH or WITH RECURSIVE) with the tables it names put before it."""
    need = _needed([t for t in re.findall(r"\bv_\w+", body) if t in TABLES])
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', TABLES[n]).strip()})" for n in need]
    body = body.strip()
    head, rest = re.match(r"(WITH RECURSIVE|WITH)?\s*(.*)", body, re.S).groups()
    if head:
        return f"WITH RECURSIVE {', '.join(ctes)}{', ' if ctes else ''}{rest}"
    return f"WITH {', '.join(ctes)} {rest}" if ctes else rest
