"""Joins of records with what they come from and lean on. Catalyst picks the algorithm; residual conditions ride on equi keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions.text import collapsed, content_id
from attestry.operators.predicates import usable_on


def hydrate(records: DataFrame, sources: DataFrame) -> DataFrame:
    return records.join(sources.select("source_id", "source_key", "source_type", "trusted_user"), "source_id")


def with_governance(records: DataFrame, gov: DataFrame) -> DataFrame:
    """Records with their review; without one a record is a candidate of lowest priority."""
    g = gov.withColumnRenamed("revision", "review_revision")
    out = records.join(g, "record_id", "left")
    return out.withColumns({"state": F.coalesce("state", F.lit("candidate")), "priority": F.coalesce("priority", F.lit("P3")), "review_revision": F.coalesce("review_revision", F.lit(0))})


def with_display(records: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """Records with ``display_statement``: the translation, or the statement itself."""
    t = translations.where(F.col("language") == language).select("record_id", "display_statement")
    return records.join(t, "record_id", "left").withColumn("display_statement", F.coalesce("display_statement", "statement"))


def with_evidence(records: DataFrame, messages: DataFrame) -> DataFrame:
    """Records with the role and text of the message they cite (null if it is gone)."""
    return records.join(messages.select("source_id", "message_id", "role", "text"), ["source_id", "message_id"], "left")


def material_inventory(sources: DataFrame, records: DataFrame, messages: DataFrame, preview: int = 180) -> DataFrame:
    """Sources with their counts of claims and a preview of their first message."""
    claims = records.groupBy("source_id").agg(F.count("*").alias("claims"), F.count_if(F.col("lifecycle") == "active").alias("active_claims"))
    first = messages.groupBy("source_id").agg(F.min_by("text", "turn").alias("text"))
    out = sources.join(claims, "source_id", "left").join(first, "source_id", "left")
    return out.select("source_id", "owner", "scope", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("active_claims", F.lit(0)).alias("active_claims"), F.substring("text", 1, preview).alias("preview"))


def payload_digest(*cols: str) -> Column:
    """What a source's index rests on beside its own digest: its payload, type and key."""
    return content_id(*cols)


def plan_index(sources: DataFrame, versions: DataFrame, index_version: str) -> DataFrame:
    """(source_id, action): new, changed, unchanged or removed against the index's own versions.

    ``sources`` are those that may be indexed: one that may no longer be is removed like one that is gone. Where both tables have a
    ``payload_digest``, it must be the same too for a source to be unchanged.
    """
    both = "payload_digest" in sources.columns and "payload_digest" in versions.columns
    s = sources.select("source_id", "digest", (F.col("payload_digest") if both else F.lit("")).alias("payload"))
    v = versions.select("source_id", F.col("digest").alias("old"), (F.col("payload_digest") if both else F.lit("")).alias("old_payload"), F.col("index_version").alias("at"))
    action = (
        F.when(F.col("at").isNull(), "new")
        .when(F.col("digest").isNull(), "removed")
        .when((F.col("digest") == F.col("old")) & (F.col("at") == index_version) & F.col("payload").eqNullSafe(F.col("old_payload")), "unchanged")
        .otherwise("changed")
    )
    return s.join(v, "source_id", "full_outer").select("source_id", action.alias("action"))


def live_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose source may be read and still has the digest, and the payload digest where both tables have one, that they were cut from."""
    same = ["source_id", "digest", *(["payload_digest"] if "payload_digest" in chunks.columns and "payload_digest" in sources.columns else [])]
    return chunks.join(sources.select(*same), same, "left_semi")


def verify_archive(manifest: DataFrame, observed: DataFrame, key: str = "path", fields: tuple[str, ...] = ("size", "digest")) -> DataFrame:
    """(key, status): ok, missing, extra or changed."""
    m, o = manifest.select(key, F.struct(*fields).alias("m")), observed.select(key, F.struct(*fields).alias("o"))
    status = F.when(F.col("o").isNull(), "missing").when(F.col("m").isNull(), "extra").when(F.col("m") == F.col("o"), "ok").otherwise("changed")
    return m.join(o, key, "full_outer").select(key, status.alias("status"))


def compare_plans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per conversation: counts of segments before and after, and whether the sequence of digests changed."""

    def seq(df: DataFrame, tag: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("segment_index", "digest")))
        return df.groupBy("conv_id").agg(F.count("*").alias(f"{tag}_segments"), F.sum("chars").alias(f"{tag}_chars"), ordered.alias(tag))

    out = seq(old, "old").join(seq(new, "new"), "conv_id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "unmatched").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    nums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("old_segments", "new_segments", "old_chars", "new_chars")]
    return out.select("conv_id", *nums, change.alias("change"))


def diff_claims(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(claim_no, relation, related): duplicate of a record, related to an active one, or new; ``related`` are sorted record ids."""
    same = records.groupBy("source_id", "message_id", "statement").agg(F.sort_array(F.collect_set("record_id")).alias("same"))
    near = records.where("lifecycle = 'active'").groupBy("owner", "scope", "subject", "kind").agg(F.sort_array(F.collect_set("record_id")).alias("near"))
    out = claims.join(same, ["source_id", "message_id", "statement"], "left").join(near, ["owner", "scope", "subject", "kind"], "left")
    relation = F.when(F.col("same").isNotNull(), "duplicate").when(F.col("near").isNotNull(), "related_needs_review").otherwise("new")
    none = F.array().cast("array<string>")
    return out.select("claim_no", relation.alias("relation"), F.coalesce("same", "near", none).alias("related"))


ATTRIBUTION = ("source_type", "role", "status")


def association_links(claims: DataFrame, records: DataFrame, limit: int = 20) -> DataFrame:
    """(claim_no, record_id, relation) of records that repeat a claim's statement or cite the same evidence, at most ``limit`` a claim.

    Both sides carry owner, scope, attribution, statement and evidence. Equal nulls count as equal. An exact statement
    comes before the same evidence; links are taken in order of record_id.
    """
    at = ["owner", "scope", *ATTRIBUTION]

    def keyed(df: DataFrame, own: str, other: str) -> DataFrame:
        cols = {**{c: f"{other}{c}" for c in [*at, "topic", "kind", "subject", "source_id", "message_id", "quote"]}, "norm": f"{other}norm"}
        return df.withColumn("norm", collapsed("statement")).select(own, *(F.col(a).alias(b) for a, b in cols.items()))

    c, r = keyed(claims, "claim_no", "c_"), keyed(records, "record_id", "r_")

    def on(*cols: str):
        cond = F.lit(True)
        for x in cols:
            cond = cond & F.col(f"c_{x}").eqNullSafe(F.col(f"r_{x}"))
        return cond

    exact = c.where(F.length("c_norm") >= 5).join(r, on(*at, "topic", "kind", "subject", "norm")).select("claim_no", "record_id", F.lit("exact_statement").alias("relation"))
    said = c.where("c_source_id <> '' and c_message_id <> '' and c_quote <> ''").join(r, on(*at, "source_id", "message_id", "quote")).select("claim_no", "record_id", F.lit("same_evidence").alias("relation"))
    best = exact.unionByName(said).groupBy("claim_no", "record_id").agg(F.min("relation").alias("relation"))
    place = F.row_number().over(Window.partitionBy("claim_no").orderBy("record_id"))
    return best.withColumn("n", place).where(F.col("n") <= limit).drop("n")


def whole_id(message_id: str = "message_id") -> Column:
    """The id of the message that a part belongs to: parts are numbered after a #."""
    return F.substring_index(message_id, "#", 1)


def map_evidence(records: DataFrame, segments: DataFrame) -> DataFrame:
    """(record_id, mapping): how many parts of the same conversation and message hold the quote."""
    parts = segments.select("source_id", whole_id().alias("whole"), "text")
    hit = records.select("record_id", "source_id", whole_id().alias("whole"), "quote").join(parts, ["source_id", "whole"], "left")
    n = F.count_if(F.coalesce(F.contains("text", "quote"), F.lit(False)))
    out = hit.groupBy("record_id").agg(n.alias("n"))
    return out.select("record_id", F.when(F.col("n") == 1, "mapped").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("mapping"))


def unresolved_entities(records: DataFrame, gov: DataFrame, entities: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """(record_id, field, entity_id, cross_scope): references to no entity of the record's own scope.

    Other scopes are looked into only if they are among ``readable`` (owner, scope); all of the owner's if it is not given.
    """
    refs = records.select("record_id", "owner", "scope").join(gov, "record_id").select("record_id", "owner", "scope", F.expr("stack(2, 'holder', holder, 'subject_id', subject_id) as (field, entity_id)"))
    refs = refs.where("entity_id is not null and entity_id <> concat('owner:', owner)")
    own = entities.select("owner", "scope", F.col("id").alias("entity_id"))
    lost = refs.join(own, ["owner", "scope", "entity_id"], "left_anti")
    # the rest of an owner's scopes: an entity of the same owner anywhere is in another scope here
    seen = own if readable is None else own.join(readable.select("owner", "scope").distinct(), ["owner", "scope"], "left_semi")
    there = seen.select("owner", "entity_id").distinct().withColumn("cross_scope", F.lit(True))
    return lost.join(there, ["owner", "entity_id"], "left").select("record_id", "field", "entity_id", F.coalesce("cross_scope", F.lit(False)).alias("cross_scope"))


def dangling(records: DataFrame) -> DataFrame:
    """Records that supersede one that isn't there."""
    return records.where("supersedes is not null").join(records.select(F.col("record_id").alias("supersedes")), "supersedes", "left_anti")


def assign_topics(sources: DataFrame, topics: DataFrame) -> DataFrame:
    """(source_id, slug) of sources whose key starts with one of a topic's prefixes, within owner and scope."""
    rules = topics.select("owner", "scope", "slug", F.explode("prefixes").alias("prefix"))
    hit = sources.join(rules, ["owner", "scope"]).where(F.col("source_key").startswith(F.col("prefix")))
    return hit.select("source_id", "slug").distinct()


def auto_topics(sources: DataFrame, records: DataFrame, topics: DataFrame) -> DataFrame:
    """(source_id, slug): an own topic for each source with records that no topic takes."""
    with_records = sources.join(records.select("source_id"), "source_id", "left_semi")
    free = with_records.join(assign_topics(sources, topics), "source_id", "left_anti")
    return free.select("source_id", F.concat(F.lit("source-"), F.substring(F.sha2("source_key", 256), 1, 12)).alias("slug"))


def doc_references(versions: DataFrame, records: DataFrame, pattern: str = r"\b(r[0-9]+)\b") -> DataFrame:
    """(version_id, record_id): record ids written in a text, of those that exist."""
    named = versions.select("version_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("record_id"))
    return named.join(records.select("record_id"), "record_id", "left_semi").select("version_id", "record_id")


def select_fresh(messages: DataFrame, receipts: DataFrame, processed: DataFrame, most_chars: int = 2000) -> DataFrame:
    """User messages neither seen nor of a processed conversation, short, and not split into parts."""
    key = ["source_id", "_whole"]
    every = messages.withColumn("_whole", whole_id())
    alone = every.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").select(*key)
    fresh = every.where((F.col("role") == "user") & (F.length("text") <= most_chars)).join(alone, key, "left_semi")
    return fresh.drop("_whole").join(receipts.select("source_id", "message_id"), ["source_id", "message_id"], "left_anti").join(processed.select("source_id"), "source_id", "left_anti")


def resolve_claims(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Claims (claim_no, source_id, message_id, span_no) with the span they name and a state: ok, unknown_span or conflict."""
    s = spans.select("source_id", "span_no", F.col("message_id").alias("span_message"), "start_char", "end_char")
    out = claims.join(s, ["source_id", "span_no"], "left")
    state = F.when(F.col("span_message").isNull(), "unknown_span").when(F.col("span_message") != F.col("message_id"), "conflict").otherwise("ok")
    return out.withColumn("resolution", state)


def valid_on(records: DataFrame, dates: DataFrame) -> DataFrame:
    """(day, record_id): records usable on each of any number of dates.

    Days between the first and the last asked are numbered. A span of days is the union of at most two blocks of each power of two, and
    a day lies in one block of each, so both meet by equality: rows of either side grow with the logarithm of the days, and every match is a result.
    """
    first, last = dates.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return records.sparkSession.createDataFrame([], "day date, record_id string").join(records.select("record_id"), "record_id", "left_semi").select("day", "record_id")
    n = (last - first).days + 1
    levels = range(n.bit_length())
    number = F.datediff("day", F.lit(first))
    days = dates.where("day is not null").select("day").distinct()
    days = days.select("day", F.posexplode(F.array(*(F.shiftright(number, k) for k in levels))).alias("level", "block"))
    lo = F.greatest(F.datediff("as_of", F.lit(first)), F.lit(0))
    hi = F.least(F.coalesce(F.datediff("valid_until", F.lit(first)), F.lit(n)), F.lit(n))
    spans = records.where(usable_on(F.col("as_of"))).select("record_id", lo.alias("lo"), hi.alias("hi"))
    blocks = []
    for k in levels:
        a, b = F.shiftright(F.col("lo") + ((1 << k) - 1), k), F.shiftright("hi", k)
        blocks.append(F.when((a < b) & (a % 2 == 1), F.struct(F.lit(k).alias("level"), a.alias("block"))))
        blocks.append(F.when((a < b) & (b % 2 == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("block"))))
    held = spans.where("lo < hi").select("record_id", F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull())).alias("x")).select("record_id", "x.level", "x.block")
    return held.join(days, ["level", "block"]).select("day", "record_id")


def dependencies(sources: DataFrame, records: DataFrame, jobs: DataFrame, topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: counts of what depends on it, and risk codes."""
    kinds = {
        "records": records.groupBy("source_id").agg(F.count("*").alias("n")),
        "open_jobs": jobs.where("state in ('queued', 'processing')").groupBy("source_id").agg(F.count("*").alias("n")),
        "topic_rules": assign_topics(sources, topics).groupBy("source_id").agg(F.count("*").alias("n")),
        "index_chunks": chunks.groupBy("source_id").agg(F.count("*").alias("n")),
    }
    every = None
    for kind, df in kinds.items():
        one = df.withColumn("kind", F.lit(kind))
        every = one if every is None else every.unionByName(one)
    counts = every.groupBy("source_id").pivot("kind", list(kinds)).agg(F.first("n"))
    out = sources.select("source_id").join(counts, "source_id", "left").fillna(0, list(kinds))
    risks = {
        "derived_index_dependency": F.col("index_chunks") > 0,
        "projection_and_history_dependency": F.col("topic_rules") > 0,
        "record_evidence_dependency": F.col("records") > 0,
        "unfinished_processing": F.col("open_jobs") > 0,
    }
    from attestry.operators.predicates import violations

    return out.withColumn("risks", F.array_join(violations(risks), ","))
