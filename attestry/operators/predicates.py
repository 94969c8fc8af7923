"""Row-level rules: who may read a row, which rows are in force, and which are malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.payloads import metadata_valid
from attestry.functions.text import canonical_date, json_size

STATES = ("candidate", "verified", "historical", "rejected")
ROLES = ("user", "assistant", "external")


def authorized(df: DataFrame, grants: DataFrame, principal: str, *actions: str) -> DataFrame:
    """Rows whose owner and scope one principal may use for all ``actions``. A principal has few grant rows: after the filter they are one small side."""
    mine = grants.where(F.col("principal") == principal)
    for a in actions:
        mine = mine.where(F.array_contains("actions", a))
    scopes = mine.select("owner", F.explode("scopes").alias("scope")).distinct()
    return df.join(scopes, ["owner", "scope"], "left_semi")


def model_eligible(df: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """As ``authorized`` for reading, without principals that only archive; an unknown flag closes."""
    return authorized(df, grants.where(F.col("archive_only").eqNullSafe(False)), principal, "read")


def eligible(df: DataFrame, parser: str = "v2") -> DataFrame:
    """Sources that may be indexed: conversations need the current parser version."""
    return df.where((F.col("source_type") != "conversation") | F.col("parser_version").eqNullSafe(parser))


def filter_state(df: DataFrame, state: str) -> DataFrame:
    """Rows in a governance state; a row without one is a candidate. ``history`` is everything not active."""
    own = F.coalesce("state", F.lit("candidate"))
    if state == "history":
        return df.where((F.col("lifecycle") != "active") | (own == "historical"))
    return df.where((own == state) & (F.col("lifecycle") == "active"))


def usable_on(day: Column) -> Column:
    """Active, verified, attributed, and in force on ``day``: from as_of up to, not with, valid_until."""
    known = F.col("holder").isNotNull() & F.col("subject_id").isNotNull() & F.col("as_of").isNotNull()
    in_force = (F.col("as_of") <= day) & (F.col("valid_until").isNull() | (F.col("valid_until") > day))
    return F.coalesce((F.col("lifecycle") == "active") & (F.col("state") == "verified") & known & in_force, F.lit(False))


def quote_supported(df: DataFrame) -> DataFrame:
    """Adds ``supported``: the quote is a verbatim part of the cited text."""
    return df.withColumn("supported", F.coalesce((F.length("quote") > 0) & F.col("text").contains(F.col("quote")), F.lit(False)))


def derived_status(role: Column, source_type: Column, trusted: Column) -> Column:
    """A claim's status follows from who spoke where, never from the claim."""
    return (
        F.when(source_type == "imported_summary", "imported_summary")
        .when(role == "assistant", "agent_suggested")
        .when((role == "user") & trusted & (source_type == "conversation"), "user_stated")
        .otherwise("source_reported")
    )


def text_contains(df: DataFrame, cols: list[str], wanted: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lower(F.lit(wanted))))


def violations(rules: dict[str, Column]) -> Column:
    """Sorted codes of the rules that hold; unknown counts as broken."""
    return F.array_sort(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for code, c in rules.items())), lambda x: x.isNotNull()))


def check_messages(df: DataFrame, most_chars: int = 4000) -> DataFrame:
    """Adds ``violations`` to messages (source_id, message_id, role, text, created)."""
    from pyspark.sql.window import Window

    twice = F.count("*").over(Window.partitionBy("source_id", "message_id")) > 1
    many = F.count("*").over(Window.partitionBy("source_id")) > 100
    rules = {
        "blank_text": F.trim("text") == "",
        "duplicate_id": twice,
        "text_too_long": F.length("text") > most_chars,
        "too_many_messages": many,
        "unknown_role": ~F.col("role").isin(*ROLES),
    }
    return df.withColumn("violations", violations(rules))


def check_sources(sources: DataFrame, messages: DataFrame, most_payload: int = 24_000) -> DataFrame:
    """Adds ``violations`` to sources (source_id, source_key, source_type, metadata) with their messages (source_id, message_id, role, text, and source_title and created_at if there are).

    A batch has 1 to 100 messages of ``most_payload`` characters of JSON altogether; a source without a description is fine, one with a faulty one is not.
    """
    extra = [c for c in ("source_title", "created_at") if c in messages.columns]
    keys = sum((F.col(c).isNotNull().cast("int") for c in extra), F.lit(3))
    size = json_size(F.struct(F.col("message_id").alias("id"), "role", "text", *extra), keys, ignore_nulls=True)
    long = F.array_max(F.array(F.lit(0), *(F.coalesce(F.length(c), F.lit(0)) for c in extra), F.lit(0))) > 300
    faulty = F.coalesce(F.length("message_id").between(1, 100) & (F.trim("text") != "") & F.col("role").isin(*ROLES), F.lit(False))
    told = messages.groupBy("source_id").agg(F.count("*").alias("_n"), F.sum(size + 2).alias("_payload"), F.count_if(long).alias("_long"), F.count_if(~faulty).alias("_faulty"))
    n = F.coalesce("_n", F.lit(0))
    rules = {
        "key_length": ~F.length("source_key").between(1, 300),
        "message_count": ~n.between(1, 100),
        "message_faulty": F.coalesce("_faulty", F.lit(0)) > 0,
        "message_metadata": F.coalesce("_long", F.lit(0)) > 0,
        "metadata_invalid": F.col("metadata").isNotNull() & ~metadata_valid(F.col("metadata")),
        "payload_too_long": F.coalesce("_payload", F.lit(0)) > most_payload,
        "unknown_type": ~F.col("source_type").isin("conversation", "imported_summary", "document"),
    }
    return sources.join(told, "source_id", "left").withColumn("violations", violations(rules)).drop("_n", "_payload", "_long", "_faulty")


def check_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``violations`` to answers (task_id, status, abstain, citations, answer) by the evidence of their tasks."""
    have = evidence.groupBy("task_id").agg(F.collect_set("evidence_id").alias("have"))
    c = F.coalesce("citations", F.array().cast("array<string>"))
    answered = F.col("status") == "answered"
    rules = {
        "abstain_mismatch": F.col("abstain") != (F.col("status") == "abstained"),
        "answer_missing": answered & (F.coalesce("answer", F.lit("")) == ""),
        "citation_duplicate": F.size(c) != F.size(F.array_distinct(c)),
        "citation_missing": answered & (F.size(c) == 0),
        "citation_unknown": F.size(F.array_except(c, F.coalesce("have", F.array().cast("array<string>")))) > 0,
    }
    return answers.join(have, "task_id", "left").withColumn("violations", violations(rules)).drop("have")


def check_dates(df: DataFrame) -> DataFrame:
    """Adds ``dates_ok``: canonical dates, and an end not before the start."""
    a, b = F.col("as_of_text"), F.col("valid_until_text")
    ok = canonical_date(a).isNotNull() & (b.isNull() | (canonical_date(b).isNotNull() & (canonical_date(b) >= canonical_date(a))))
    return df.withColumn("dates_ok", F.coalesce(ok, F.lit(False)))


def scan_secrets(df: DataFrame, column: str, rules: dict[str, str]) -> DataFrame:
    """(columns…, rule) for each rule whose pattern is found; the rules are a short list of constants, so no join is needed."""
    hits = F.filter(F.array(*(F.when(F.col(column).rlike(p), F.lit(n)) for n, p in sorted(rules.items()))), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(hits))


# What must not be in files that are made public, by content and by name.
PUBLIC_SECRETS = {
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github-token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "model-api-key": r"(?:ark-[0-9a-f]{8}-[0-9a-f-]{20,}|sk-[A-Za-z0-9_-]{24,})",
    "cloud-secret": r"AKID[A-Za-z0-9]{16,}",
    "live-model-endpoint": r"ep-[0-9]{14}-[A-Za-z0-9]+",
    "user-home-path": r"/(?:Users)/[^/\s]+/|/(?:home)/(?!runner\b)[^/\s]+/",
}
PRIVATE_NAMES = ("model.json", "grants.json", "browser.json", "owner-token.txt", "service.env", ".env")
PRIVATE_FOLDERS = ("runtime", "archives", "backups", "private", "reports")
PRIVATE_KINDS = ("db", "sqlite3", "dump", "zip", "gz")


def scan_tree(files: DataFrame) -> DataFrame:
    """(path, rule) for each file (path, text) that must not be public: by name or folder, by what it holds, and JSON that isn't marked as synthetic."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    kind = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    told = F.try_variant_get(F.try_parse_json("text"), "$.synthetic", "variant")
    marked = (F.schema_of_variant(told) == "BOOLEAN") & told.try_cast("boolean")
    rules = {rule: F.col("text").rlike(pattern) for rule, pattern in PUBLIC_SECRETS.items()}
    rules |= {
        "private-runtime-file": name.isin(*PRIVATE_NAMES) | F.arrays_overlap(parts, F.array(*map(F.lit, PRIVATE_FOLDERS))) | kind.isin(*PRIVATE_KINDS),
        "invalid-json": (kind == "json") & F.try_parse_json("text").isNull(),
        "json-must-be-marked-synthetic": (kind == "json") & F.try_parse_json("text").isNotNull() & ~F.coalesce(marked, F.lit(False)),
    }
    return files.select("path", F.explode(violations(rules)).alias("rule"))


def candidate_gate(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds ``failures`` to claims: the mechanical reasons why a claim can't become a candidate."""
    from pyspark.sql.window import Window

    again = F.count("*").over(Window.partitionBy("source_id", "message_id", "statement")) > 1
    rows = claims.withColumn("again", again).join(messages.select("source_id", "message_id", "role", "text"), ["source_id", "message_id"], "left")
    rules = {
        "duplicate": F.col("again"),
        "message_missing": F.col("text").isNull(),
        "not_user": F.col("role").isNotNull() & (F.col("role") != "user"),
        "quote_not_exact": F.col("text").isNotNull() & ~F.contains("text", "quote"),
        "status_not_allowed": ~F.col("status").isin("user_stated", "source_reported"),
    }
    return rows.withColumn("failures", violations(rules)).select(*claims.columns, "failures")
