"""New states of tables: appends, revisions and upserts as pure functions that return what to write, and what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions import rules as R
from attestry.functions.spans import chunk_text
from attestry.functions.text import content_id
from attestry.operators.joins import plan_index

SOURCE_KEY = ["owner", "scope", "source_key", "digest"]


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append_sources(existing: DataFrame, incoming: DataFrame, order: str = "created") -> tuple[DataFrame, DataFrame]:
    """(new sources, receipts): one of each key that isn't there yet; every incoming row gets a receipt that says whether it was a duplicate."""
    there = existing.select(*SOURCE_KEY).distinct().withColumn("there", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*SOURCE_KEY).orderBy(order, "source_id"))
    rows = incoming.withColumn("_n", place).join(there, SOURCE_KEY, "left")
    duplicate = F.coalesce("there", F.lit(False)) | (F.col("_n") > 1)
    receipts = rows.select("source_id", duplicate.alias("duplicate"))
    return rows.where(~duplicate).drop("_n", "there"), receipts


def to_sources(messages: DataFrame) -> DataFrame:
    """Sources with their messages in order, and a digest of their contents; texts are hashed before they meet."""
    m = messages.withColumn("h", content_id("message_id", "role", "text"))
    return m.groupBy("source_id").agg(
        F.count("*").alias("n_messages"),
        F.sum(F.length("text")).alias("chars"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"]), ""), 256).alias("digest"),
    )


def plan_readable_import(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """(conv_id, segment_index, source_key, duplicate) of segments that are fit to be read; a plan, nothing is written."""
    fit = segments.where("n_messages > 0 and chars > 0 and state <> 'failed'")
    keyed = fit.withColumn("source_key", F.concat(F.lit("readable:"), F.substring(F.sha2(F.concat_ws(":", "conv_id", "segment_index", "digest"), 256), 1, 16)))
    there = sources.select("source_key").distinct().withColumn("there", F.lit(True))
    return keyed.join(there, "source_key", "left").select("conv_id", "segment_index", "source_key", F.coalesce("there", F.lit(False)).alias("duplicate"))


def write_topic_versions(new: DataFrame, versions: DataFrame) -> DataFrame:
    """Revisions to append: only where the digest differs from the latest one's."""
    latest = first_of(versions, ["owner", "scope", "slug"], F.desc("revision")).select("owner", "scope", "slug", F.col("digest").alias("old"), F.col("revision").alias("last"))
    rows = new.join(latest, ["owner", "scope", "slug"], "left").where(~F.col("digest").eqNullSafe(F.col("old")))
    return rows.select("owner", "scope", "slug", "digest", (F.coalesce("last", F.lit(0)) + 1).alias("revision"))


def append_records(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted claims that no record states already for the same message."""
    key = ["source_id", "message_id", "statement"]
    return first_of(accepted.join(records.select(*key), key, "left_anti"), key, "claim_no")


def apply_corrections(records: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all revisions after, conflicts): a correction takes if it names an active record's revision; of several for one record the earliest does.

    The old revision is superseded; the new one starts without review, with an id derived from both.
    """
    at = corrections.select("correction_id", "record_id", F.col("revision").alias("seen"), F.col("statement").alias("text"), F.col("created").alias("at"))
    rows = at.join(records.select("record_id", "revision", "lifecycle"), "record_id", "left")
    ok = F.coalesce((F.col("lifecycle") == "active") & (F.col("revision") == F.col("seen")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("record_id", ok).orderBy("at", "correction_id"))
    judged = rows.withColumn("ok", ok).withColumn("n", place)
    reason = F.when(F.col("lifecycle").isNull(), "unknown_record").when(F.col("lifecycle") != "active", "not_active").when(~F.col("ok"), "stale_revision").otherwise("already_corrected")
    conflicts = judged.where(~F.col("ok") | (F.col("n") > 1)).select("correction_id", "record_id", reason.alias("reason"))
    taken = judged.where(F.col("ok") & (F.col("n") == 1)).select("record_id", "correction_id", "text")
    both = records.join(taken, "record_id", "left")
    old = both.withColumn("lifecycle", F.when(F.col("text").isNotNull(), "superseded").otherwise(F.col("lifecycle"))).select(*records.columns)
    new = both.where("text is not null").withColumns({
        "supersedes": F.col("record_id"),
        "record_id": F.concat("record_id", F.lit("/"), "correction_id"),
        "revision": F.col("revision") + 1,
        "statement": F.col("text"),
        "lifecycle": F.lit("active"),
    }).select(*records.columns)
    return old.unionByName(new), conflicts


def apply_owner_edits(edits: DataFrame, seen: DataFrame) -> DataFrame:
    """(request_key, digest, outcome): new, duplicate (same key, same content) or conflict (same key, other content)."""
    key = ["owner", "scope", "request_key"]
    first = first_of(edits.select(*key, "digest", "created", F.lit(1).alias("new")).unionByName(seen.select(*key, "digest", F.lit(-1).cast("long").alias("created"), F.lit(0).alias("new"))), key, "created", "digest")
    known = first.select(*key, F.col("digest").alias("first"), F.col("created").alias("at"), "new")
    out = edits.join(known, key)
    own = (F.col("new") == 1) & (F.col("created") == F.col("at")) & (F.col("digest") == F.col("first"))
    return out.select(*key, "digest", "created", F.when(own, "new").when(F.col("digest") == F.col("first"), "duplicate").otherwise("conflict").alias("outcome"))


REVIEW = ("holder", "subject_id", "as_of", "valid_until", "state", "priority")


def apply_reviews(gov: DataFrame, reviews: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(governance after, events with the state before and after, conflicts). A review takes if its revision is the current one (0: none yet) and the record is active; the earliest does."""
    now = gov.select("record_id", F.col("revision").alias("current"), F.col("state").alias("before"))
    rows = reviews.join(now, "record_id", "left").join(records.select("record_id", "lifecycle"), "record_id", "left").withColumn("current", F.coalesce("current", F.lit(0)))
    ok = F.coalesce((F.col("lifecycle") == "active") & (F.col("revision") == F.col("current")), F.lit(False))
    judged = rows.withColumn("ok", ok).withColumn("n", F.row_number().over(Window.partitionBy("record_id", "ok").orderBy("created", "review_id")))
    taken = judged.where("ok and n = 1")
    reason = F.when(F.col("lifecycle").isNull(), "unknown_record").when(F.col("lifecycle") != "active", "not_active").otherwise("revision_changed")
    conflicts = judged.where("not (ok and n = 1)").select("review_id", "record_id", reason.alias("reason"))
    events = taken.select("review_id", "record_id", F.coalesce("before", F.lit("candidate")).alias("previous_state"), F.col("state").alias("current_state"))
    new = taken.select("record_id", *REVIEW, (F.col("current") + 1).alias("revision"))
    after = gov.join(new.select("record_id"), "record_id", "left_anti").select("record_id", *REVIEW, "revision").unionByName(new)
    return after, events, conflicts


def append_changes(changes: DataFrame, seen: DataFrame, gov: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes to append, refused with reasons): request keys are unique; an end of the old fact goes with a change of view only, and not before the old start."""
    rows = first_of(changes, ["request_key"], "created").join(seen.select("request_key"), "request_key", "left_anti")
    rows = rows.join(gov.select("record_id", F.col("as_of").alias("old_as_of")), "record_id", "left")
    ends = F.col("previous_valid_until").isNotNull()
    bad = F.when(ends & (F.col("change_kind") != "viewpoint_change"), "end_not_allowed").when(ends & F.coalesce(F.col("previous_valid_until") < F.col("old_as_of"), F.lit(False)), "end_before_start")
    rows = rows.withColumn("reason", bad).withColumn("new_state", F.when(F.col("change_kind") == "withdrawal", "rejected").otherwise("candidate"))
    cols = ["request_key", "record_id", "change_kind", "valid_from", "previous_valid_until", "new_state"]
    return rows.where("reason is null").select(*cols), rows.where("reason is not null").select("request_key", "record_id", "reason")


def register_entities(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """(owner, scope, id, outcome): new, duplicate, conflict (same id, other name) or reserved."""
    known = entities.select("owner", "scope", "id", F.col("name").alias("old"))
    rows = incoming.join(known, ["owner", "scope", "id"], "left")
    outcome = F.when(F.col("id").startswith("owner:"), "reserved").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("name"), "duplicate").otherwise("conflict")
    return rows.select("owner", "scope", "id", outcome.alias("outcome"))


def apply_translations(translations: DataFrame, incoming: DataFrame, records: DataFrame) -> DataFrame:
    """Translations after: those of active records whose statement is still the one translated; the latest wins."""
    live = incoming.join(records.where("lifecycle = 'active'").select("record_id", F.col("statement").alias("original")), ["record_id", "original"], "left_semi").drop("original")
    both = translations.withColumn("_new", F.lit(0)).unionByName(live.withColumn("_new", F.lit(1)))
    return first_of(both, ["record_id", "language"], F.desc("_new"), F.desc("created"), F.desc("display_statement")).drop("_new")


def refresh_index(chunks: DataFrame, versions: DataFrame, sources: DataFrame, texts: DataFrame, index_version: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks after: those of changed and new sources are cut anew, those of removed ones go, all others stay untouched."""
    plan = plan_index(sources, versions, index_version)
    keep = chunks.join(plan.where("action = 'unchanged'").select("source_id"), "source_id", "left_semi")
    redo = sources.select("source_id", "digest").join(plan.where("action in ('new', 'changed')").select("source_id"), "source_id", "left_semi")
    fresh = chunk_text(texts.join(redo, "source_id"), size, overlap)
    return keep.select("source_id", "digest", "message_id", "start_char", "end_char").unionByName(fresh.select("source_id", "digest", "message_id", "start_char", "end_char"))


def chunk_changes(chunks: DataFrame, versions: DataFrame, sources: DataFrame, texts: DataFrame, index_version: str, size: int = 1000, overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(added, gone): what an index of chunks with ids (chunk_id, source_id) must write and drop, chunk by chunk.

    A chunk's id is made from its place and text, so a source that changed in one message keeps all its other chunks; only
    sources that are new, changed or removed are looked at.
    """
    plan = plan_index(sources, versions, index_version)
    redo = texts.join(plan.where("action in ('new', 'changed')").select("source_id"), "source_id", "left_semi")
    fresh = chunk_text(redo.select("source_id", "message_id", "text"), size, overlap)
    fresh = fresh.withColumn("chunk_id", content_id("source_id", "message_id", "start_char", "chunk"))
    held = chunks.join(plan.where("action in ('changed', 'removed')").select("source_id"), "source_id", "left_semi").select("chunk_id", "source_id")
    return fresh.join(held.select("chunk_id"), "chunk_id", "left_anti"), held.join(fresh.select("chunk_id"), "chunk_id", "left_anti")


# Longest fields, topics and kinds of a claim, and the words that tell a claim's source, date, or want of one.
LONGEST = {"statement": 1200, "subject": 160, "quote": 2000, "message_id": 100}
TOPICS = ("profile", "preferences", "people", "areas", "projects", "topics")
KINDS = ("identity", "preference", "relationship", "decision", "plan", "event", "claim", "suggestion")
DATED = ("来源消息日期：", "（非事件成立时间，当前有效性待核实）。")
TITLED = ("来源对话：", "。")
TIME_UNKNOWN = "原始时间未知"
ATTRIBUTED = "^(?:摘要记载|摘要主张)"
DECIDED = "用户(?:已|已经)?决定"


def claim_status(role: Column, source_type: Column, trusted_user: Column) -> Column:
    """Whose word a claim is; never taken from the claim itself."""
    return F.when(source_type == "imported_summary", "imported_summary").when(role == "assistant", "agent_suggested").when((role == "user") & trusted_user, "user_stated").otherwise("source_reported")


def unprefixed(statement: Column, topic: Column, context: Column) -> Column:
    """A statement without the source's date and, of a project, its title, where it begins with just these."""
    date, title = context["source_date"], context["conversation_title"]
    lead = F.concat(F.coalesce(F.concat(F.lit(DATED[0]), date, F.lit(DATED[1])), F.lit("")), F.when((topic == "projects") & title.isNotNull(), F.concat(F.lit(TITLED[0]), title, F.lit(TITLED[1]))).otherwise(""))
    return F.when((context["scope_policy"] != "secondary_source") & statement.startswith(lead), F.substring(statement, F.length(lead) + 1, F.length(statement))).otherwise(statement)


def claim_rules() -> dict[str, Column]:
    """Rules that a claim must not break; rows have its message (role, text), source (source_type), ``context`` and ``own`` (the statement without its prefix)."""
    s, q, kind, topic, text, context, own = (F.col(c) for c in ("statement", "quote", "kind", "topic", "text", "context", "own"))
    second_hand = F.col("source_type") == "imported_summary"
    sizes = [F.coalesce(F.length(c), F.lit(0)).between(1, n) for c, n in LONGEST.items()]
    fits = sizes[0] & sizes[1] & sizes[2] & sizes[3]
    here = text.isNotNull()
    rules = {
        "bad_field": ~fits,
        "bad_topic": ~F.coalesce(topic.isin(*TOPICS), F.lit(False)),
        "bad_kind": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
        "message_missing": ~here,
        "quote_not_in_message": here & ~F.contains(text, q),
        "guessed_name": here & ((topic == "people") | (kind == "relationship")) & R.guessed_name(s, text),
        "message_only_agrees": here & R.only_agrees(s, text),
        "wish_as_decision": F.contains(q, F.lit("希望")) & ~F.contains(q, F.lit("决定")) & own.rlike(DECIDED),
        "immediate_command": R.immediate_command(own),
        "source_date_dropped": ~second_hand & ~R.statement_has_date(s, context["source_date"]),
        "project_title_dropped": ~second_hand & (topic == "projects") & context["conversation_title"].isNotNull() & ~F.contains(s, context["conversation_title"]),
        "summary_time_claimed": second_hand & ~F.contains(s, F.lit(TIME_UNKNOWN)),
        "summary_not_attributed": second_hand & ~s.rlike(ATTRIBUTED),
        "promoted": R.promotion(q, own, kind).isNotNull(),
        "rule_split": R.split_rule(q, own, kind).isNotNull(),
        "too_many_claims": F.col("over_cap"),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}


def validate_claims(claims: DataFrame, messages: DataFrame, sources: DataFrame, most: int = 12, most_suggested: int = 2) -> DataFrame:
    """Claims with their derived ``status``, the quote's ``modality`` and the ``reasons`` for refusal (empty: accepted).

    ``messages``: source_id, message_id, role, text, created_at, source_title; ``sources``: source_id, source_type, trusted_user. A source's claims
    are one batch. A null or missing field is a bad field; rules whose columns are null don't hold.
    """
    from attestry.operators.predicates import violations
    from attestry.operators.windows import claim_caps

    rows = claims.join(messages.select("source_id", "message_id", "role", "text", "created_at", "source_title"), ["source_id", "message_id"], "left")
    rows = rows.join(sources.select("source_id", "source_type", "trusted_user"), "source_id", "left")
    rows = rows.withColumn("status", claim_status(F.col("role"), F.col("source_type"), F.col("trusted_user")))
    rows = claim_caps(rows, most, most_suggested).withColumn("context", R.source_context(F.col("created_at"), F.col("source_type"), F.col("source_title")))
    rows = rows.withColumn("own", unprefixed(F.col("statement"), F.col("topic"), F.col("context")))
    return rows.withColumns({"modality": R.modality(F.col("quote")), "reasons": violations(claim_rules())}).select(*claims.columns, *(c for c in ("status", "modality", "reasons") if c not in claims.columns))


def quarantine(claims: DataFrame, messages: DataFrame, sources: DataFrame, most: int = 12, most_suggested: int = 2) -> DataFrame:
    """Claims with a state: quarantined for an own fault, batch_review_required if only the batch's cap is broken, else guard_passed_requires_review; and the batch's worst."""
    own = F.array_remove("reasons", "too_many_claims")
    capped = F.array_contains("reasons", "too_many_claims")
    state = F.when(F.size(own) > 0, "quarantined").when(capped, "batch_review_required").otherwise("guard_passed_requires_review")
    rows = validate_claims(claims, messages, sources, most, most_suggested).withColumn("state", state)
    return rows.withColumn("batch_quarantined", F.count_if(F.col("state") == "quarantined").over(Window.partitionBy("source_id")))
