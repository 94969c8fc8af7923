"""Overviews, ledgers, audits, metrics and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.functions.payloads import locator_given, messages_invalid, payload_invalid
from attestry.functions.text import assertion_key, canonical_date, content_id
from attestry.operators.joins import dangling, unresolved_entities, with_evidence
from attestry.operators.predicates import usable_on, violations

TRANSIENT = r"(?i)字数|改写|下一段|继续第|第[一二三四五六七八九十0-9]+章|rewrite|word count"
TEMPORAL = r"(?i)计划|暂定|完成|截止|下周|下月|planned|deadline|completed"


def overview(records: DataFrame, sources: DataFrame, day: Column) -> DataFrame:
    """Per owner and scope: sources, and records by state; ``records`` carry their reviews."""
    s = sources.where("source_type <> 'correction'").groupBy("owner", "scope").agg(F.count("*").alias("sources"))
    active = F.col("lifecycle") == "active"
    counts = {
        "active": active,
        "usable": usable_on(day),
        "candidate": active & (F.col("state") == "candidate"),
        "historical": F.col("state") == "historical",
        "rejected": F.col("state") == "rejected",
    }
    r = records.groupBy("owner", "scope").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return s.join(r, ["owner", "scope"], "full_outer").fillna(0)


def status_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def batch_status(segments: DataFrame) -> DataFrame:
    """Per phase: segments by state, and what all would cost at the mean of those done (rounded half to even)."""
    states = ["queued", "processing", "applied", "failed"]
    done = F.col("state") == "applied"
    out = segments.groupBy("phase").agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("state") == s).alias(s) for s in states),
        F.sum(F.when(done, F.col("spent_tokens"))).alias("spent"),
    )
    return out.withColumn("projected", F.bround(F.col("spent") / F.col("applied") * F.col("total")).cast("long"))


def conversation_state(segments: DataFrame) -> DataFrame:
    bad, done, busy = (F.count_if(F.col("state") == s) for s in ("failed", "applied", "processing"))
    state = F.when(bad > 0, "failed").when(done == F.count("*"), "processed").when((busy > 0) | (done > 0), "processing").otherwise("not_processed")
    return segments.groupBy("conv_id").agg(state.alias("state"))


def charge() -> Column:
    """What an attempt counts for: its total, its two parts, or what was reserved."""
    return F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"), "reservation")


def ledger(attempts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per owner, scope and operation: charges, open attempts, and what is left of the scope's budget."""
    open_ = F.col("total_tokens").isNull() & (F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull())
    by_op = attempts.groupBy("owner", "scope", "operation").agg(F.count("*").alias("attempts"), F.sum(charge()).alias("charged"), F.count_if(open_).alias("unresolved"))
    spent = F.sum("charged").over(Window.partitionBy("owner", "scope"))
    return by_op.join(budgets, ["owner", "scope"], "left").withColumn("left", F.col("cap") - spent).drop("cap")


def audit_flags(records: DataFrame, messages: DataFrame, sources: DataFrame, gov: DataFrame) -> DataFrame:
    """(record_id, status, lifecycle, flag): structural signals of each record.

    ``sources`` may have a ``payload``: the messages of one that is no JSON list count for missing. ``messages`` may have ``created_at``.
    """
    bad = payload_invalid(F.col("payload")) if "payload" in sources.columns else F.lit(False)
    dated = F.coalesce(F.col("created_at") != "", F.lit(False)) if "created_at" in messages.columns else F.lit(True)
    told = messages.select("source_id", "message_id", "role", "text", dated.alias("dated"))
    r = records.join(sources.select("source_id", "source_type", bad.alias("payload_bad")), "source_id", "left")
    r = r.join(told, ["source_id", "message_id"], "left").join(gov.select("record_id", "holder", "subject_id", "as_of"), "record_id", "left")
    there = F.col("text").isNotNull() & ~F.coalesce("payload_bad", F.lit(False))
    rules = {
        "as_of_missing": F.col("as_of").isNull(),
        "assistant_statement": there & (F.col("role") == "assistant"),
        "attribution_status_mismatch": there & (F.col("role") == "assistant") & (F.col("status") != "agent_suggested"),
        "explicit_correction": F.coalesce(F.col("source_type") == "correction", F.lit(False)),
        "external_statement": there & (F.col("role") == "external"),
        "holder_missing": F.col("holder").isNull(),
        "message_missing": ~there,
        "quote_not_supported": there & ~F.coalesce(F.contains("text", "quote") & (F.col("quote") != ""), F.lit(False)),
        "secondhand_summary": F.coalesce(F.col("source_type") == "imported_summary", F.lit(False)),
        "semantic_support_not_reviewed": ~F.coalesce(F.col("source_type") == "correction", F.lit(False)),
        "source_date_missing": there & ~F.col("dated"),
        "source_missing": F.col("source_type").isNull(),
        "source_payload_invalid": F.coalesce("payload_bad", F.lit(False)),
        "speaker_unknown": there & ~F.coalesce(F.col("role").isin("user", "assistant", "external"), F.lit(False)),
        "subject_id_missing": F.col("subject_id").isNull(),
        "temporal_claim_needs_review": F.col("statement").rlike(TEMPORAL),
        "transient_task_signal": F.col("statement").rlike(TRANSIENT),
    }
    return r.select("record_id", "status", "lifecycle", F.explode(violations(rules)).alias("flag"))


def diagnose(records: DataFrame, gov: DataFrame, entities: DataFrame, messages: DataFrame, sources: DataFrame, day: Column, sample: int = 3, readable: DataFrame | None = None) -> DataFrame:
    """(owner, scope, category, n, samples): gaps in governance with the first record ids of each.

    Dates of ``gov`` may be texts, of which only YYYY-MM-DD are valid. A source counts within its own owner and scope alone; it may have a ``payload`` and
    ``metadata`` (a map). ``readable``: the (owner, scope) that may be looked into for entities, all if not given.
    """
    as_of, until = (canonical_date(F.col(c).cast("string")) for c in ("as_of", "valid_until"))
    dates_ok = (F.coalesce(F.col("as_of").cast("string"), F.lit("")).isin("") | as_of.isNotNull()) & (F.coalesce(F.col("valid_until").cast("string"), F.lit("")).isin("") | until.isNotNull())
    bad = messages_invalid(F.col("payload")) if "payload" in sources.columns else F.lit(False)
    located = locator_given(F.col("metadata")) if "metadata" in sources.columns else F.col("parser_version").isNotNull()
    own = sources.select("source_id", "owner", "scope", bad.alias("payload_bad"), F.coalesce(located, F.lit(False)).alias("located"))
    r = with_evidence(records.join(gov.drop("revision"), "record_id", "left"), messages).join(own, ["source_id", "owner", "scope"], "left")
    source, sound = F.col("located").isNotNull(), ~F.coalesce("payload_bad", F.lit(True))
    rules = {
        "expired_active": F.coalesce(dates_ok & (F.col("lifecycle") == "active") & (until <= day), F.lit(False)),
        "invalid_effective_date": ~dates_ok,
        "missing_as_of": F.coalesce(F.col("as_of").cast("string"), F.lit("")) == "",
        "missing_holder": F.coalesce("holder", F.lit("")) == "",
        "missing_subject_id": F.coalesce("subject_id", F.lit("")) == "",
        "source_message_missing": source & sound & F.col("text").isNull(),
        "source_missing_or_outside_scope": ~source,
        "source_original_locator_missing": source & ~F.col("located"),
        "source_payload_invalid": source & ~sound,
        "source_quote_missing_or_mismatch": source & sound & F.col("text").isNotNull() & ~F.coalesce(F.contains("text", "quote") & (F.col("quote") != ""), F.lit(False)),
    }
    own = r.select("record_id", "owner", "scope", F.explode(violations(rules)).alias("category"))
    place = records.select("record_id", "owner", "scope")
    lost = unresolved_entities(records, gov, entities, readable)
    refs = lost.select("record_id", F.explode(F.when(F.col("cross_scope"), F.array(F.lit("unresolved_entity_reference"), F.lit("cross_scope_entity_reference"))).otherwise(F.array(F.lit("unresolved_entity_reference")))).alias("category")).distinct()
    ends = dangling(records).select("record_id", F.lit("dangling_supersedes").alias("category"))
    every = own.unionByName(refs.unionByName(ends).join(place, "record_id"))
    # the first ids by a rank within the category: no list grows beyond the sample
    rank = F.row_number().over(Window.partitionBy("owner", "scope", "category").orderBy("record_id"))
    first = every.withColumn("_n", rank).where(F.col("_n") <= sample).groupBy("owner", "scope", "category").agg(F.array_join(F.sort_array(F.collect_list("record_id")), ",").alias("samples"))
    return status_counts(every, "owner", "scope", "category").join(first, ["owner", "scope", "category"])


def plan_summary(segments: DataFrame) -> DataFrame:
    return segments.agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("segments"), F.sum("n_messages").alias("messages"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))


def coverage_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source_type").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


def prf(results: DataFrame, labels: DataFrame, tasks: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Per task (and ``by``): precision, recall and reciprocal rank at k, null without targets; false and support returns; abstention."""
    top = results.where(F.col("rank") <= k).join(labels, ["task_id", "doc_id"], "left")
    hit = F.col("grade") == 2
    got = top.groupBy("task_id", *by).agg(F.count("*").alias("returned"), F.count_if(hit).alias("relevant"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(F.coalesce("grade", F.lit(0)) == 0).alias("false_returns"), F.count_if(F.col("grade") == 1).alias("support_only"))
    targets = labels.where("grade = 2").groupBy("task_id").agg(F.count("*").alias("targets"))
    base = tasks.select("task_id", "split")
    if by:
        base = base.join(results.select(*by).distinct())  # a few routes
    out = base.join(targets, "task_id", "left").join(got, ["task_id", *by], "left").fillna(0, ["targets", "returned", "relevant", "false_returns", "support_only"])
    some = F.col("targets") > 0
    return out.select(
        "task_id", "split", *by, "targets", "returned", "relevant",
        F.when(some, F.col("relevant") / k).alias("precision_at_k"),
        F.when(some, F.col("relevant") / F.col("targets")).alias("recall_at_k"),
        F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr_at_k"),
        "false_returns", "support_only",
        F.when(~some, F.col("returned") == 0).alias("abstained_rightly"),
    )


score_retrieval = prf


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over tasks with targets, and counts over those without."""
    mean = [F.round(F.avg(c), 9).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr_at_k")]
    return metrics.groupBy(*by).agg(F.count("*").alias("tasks"), F.count_if(F.col("targets") > 0).alias("positive_tasks"), *mean, F.sum("false_returns").alias("false_returns"), F.count_if("abstained_rightly").alias("abstained_rightly"))


SEVERITY = {"passed": 0, "ambiguous": 1, "not_run": 2, "failed": 3}


def rollup_verdicts(expected: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, verdict): the gravest verdict of all expected dimensions; a missing label is not_run, never passed."""
    rows = expected.join(labels, [key, "dimension"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("not_run")))
    grave = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("verdict"))
    worst = rows.groupBy(key).agg(F.max(grave).alias("s"))
    back = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (v, k))), F.col("s"))
    return worst.select(key, back.alias("verdict"))


def suite_gate(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a case: missing, unexpected, duplicate, failed, pending or ok, from expected case ids and runs (case_id, verdict)."""
    r = runs.groupBy("case_id").agg(F.count("*").alias("runs"), F.count_if(F.col("verdict") == "failed").alias("failed"), F.count_if(F.col("verdict").isNull()).alias("pending"))
    e = expected.select("case_id").distinct().withColumn("wanted", F.lit(True))
    out = e.join(r, "case_id", "full_outer")
    state = F.when(F.col("runs").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("runs") > 1, "duplicate").when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "pending").otherwise("ok")
    return out.select("case_id", state.alias("state"))


def span_coverage(sizes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per text: characters covered by the union of its spans, and the rest."""
    w = Window.partitionBy(*keys).orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.max("end_char").over(w), F.lit(0))
    covered = spans.withColumn("own", F.greatest(F.lit(0), F.col("end_char") - F.greatest("start_char", past))).groupBy(*keys).agg(F.sum("own").alias("covered"))
    out = sizes.join(covered, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("excluded", F.col("size") - F.col("covered")).withColumn("no_evidence", F.col("covered") == 0)


def fingerprint(df: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """A digest of each group's set of rows, whatever their order.

    Rows are hashed and hashed again in 256 sorted parts, so what meets for one group is a digest a part, not its rows.
    """
    rows = df.select(*by, content_id(*cols).alias("h")).withColumn("part", F.substring("h", 1, 2))
    parts = rows.groupBy(*by, "part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


#: Words of 32 bits of a row's digest, summed up apart.
FINGERPRINT_WORDS = 8


def fingerprint_state(df: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """(by, n, w0 … w7): how many rows a group has and the sums of their digests' words, to be kept and patched.

    Sums need no order and no list, are pre-aggregated before the shuffle, and a change costs its own rows alone (``patch_fingerprint``).
    """
    rows = df.select(*by, content_id(*cols).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in range(FINGERPRINT_WORDS)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *words)


def patch_fingerprint(state: DataFrame, added: DataFrame, removed: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """The state after some rows came and some went, from the state before and these rows; groups that lost their last row are left out."""
    fields = ["n", *(f"w{i}" for i in range(FINGERPRINT_WORDS))]
    gone = fingerprint_state(removed, by, *cols).select(*by, *((-F.col(f)).alias(f) for f in fields))
    every = state.select(*by, *fields).unionByName(fingerprint_state(added, by, *cols)).unionByName(gone)
    return every.groupBy(*by).agg(*(F.sum(f).cast("long" if f == "n" else "decimal(30,0)").alias(f) for f in fields)).where("n > 0")


def fingerprint_token(state: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, fingerprint): the digest of a state, equal for equal sets of rows."""
    words = [F.col(f"w{i}").cast("decimal(38,0)").cast("string") for i in range(FINGERPRINT_WORDS)]
    return state.select(*by, "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *words), 256).alias("fingerprint"))


def group_assertions(df: DataFrame) -> DataFrame:
    """Active assertions that say the same, in one state of review, with all their references."""
    keys = ["owner", "scope", "status", "kind", "state", assertion_key("subject").alias("subject_key"), assertion_key("statement").alias("statement_key")]
    return df.where("lifecycle = 'active'").groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("record_id")), ",").alias("refs"))


def scope_generations(changes: DataFrame, refreshes: DataFrame) -> DataFrame:
    c = changes.groupBy("owner", "scope").agg(F.count("*").alias("generation"))
    r = refreshes.groupBy("owner", "scope").agg(F.max("generation").alias("refreshed"))
    out = c.join(r, ["owner", "scope"], "left").withColumn("refreshed", F.coalesce("refreshed", F.lit(0)))
    return out.withColumn("stale", F.col("generation") > F.col("refreshed"))


def quality_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("disposition") == "review_required").alias("review_required"), F.count_if(F.col("disposition") == "archive_only").alias("archive_only"))


def split_leakage(tasks: DataFrame, key: str, least: int = 30) -> DataFrame:
    """(problem, n): conversations in several splits, repeated tasks, too few tasks, a missing split."""
    leak = tasks.groupBy(key).agg(F.countDistinct("split").alias("s")).where("s > 1").agg(F.count("*").alias("n")).select(F.lit("in_two_splits").alias("problem"), "n")
    twice = tasks.groupBy("task_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_task").alias("problem"), "n")
    few = tasks.agg(F.countDistinct("task_id").alias("t"), F.countDistinct("split").alias("s"))
    rest = few.select(F.explode(F.array(F.struct(F.lit("too_few_tasks").alias("problem"), F.greatest(F.lit(0), F.lit(least) - F.col("t")).alias("n")), F.struct(F.lit("missing_split").alias("problem"), F.greatest(F.lit(0), F.lit(2) - F.col("s")).alias("n")))).alias("x")).select("x.*")
    return leak.unionByName(twice).unionByName(rest)
