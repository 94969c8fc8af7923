"""Windows: latest rows, samples, offsets, pages and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.lineage import written


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; ranks are cut before rows meet."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of each stratum with the smallest digests of their key: the same at every run."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def timeline_sample(segments: DataFrame, most: int = 10) -> DataFrame:
    """The first segment of up to ``most`` conversations, evenly spaced by (day, conv_id).

    Places are found from counts by day: only the days that hold a wanted place are ordered, each by itself.
    """
    convs = segments.groupBy("conv_id").agg(F.min("day").alias("day"))
    by_day = convs.groupBy("day").agg(F.count("*").alias("n"))
    before = by_day.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = by_day.agg(F.sum("n").alias("total"))
    m = F.least(F.lit(most), F.col("total"))
    step = F.when(m > 1, (F.col("total") - 1) / (m - 1)).otherwise(F.lit(0.0))
    wanted = total.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda i: F.bround(i * step).cast("long")))).alias("place"))
    in_day = F.row_number().over(Window.partitionBy("day").orderBy("conv_id")) - 1
    placed = convs.withColumn("in_day", in_day).join(F.broadcast(before.drop("n")), "day").withColumn("place", F.col("before") + F.col("in_day"))
    chosen = placed.join(F.broadcast(wanted), "place", "left_semi").select("conv_id")
    return latest_by(segments.join(chosen, "conv_id", "left_semi"), ["conv_id"], F.col("segment_index")).select("conv_id", "segment_index")


def chain_root(records: DataFrame, most_passes: int = 40) -> DataFrame:
    """(record_id, root_id): the first revision of each record's chain of ``supersedes``.

    Pointers double at each pass until none changes, so a chain of n revisions takes about log2(n) passes; each pass is written below
    ``spark.checkpoint.dir`` and reads the one before it twice. A chain that ends in a missing record ends at the last that is there; members of a
    cycle keep what they point to when passes run out.
    """
    ids = records.select("record_id", "supersedes")
    known = ids.select(F.col("record_id").alias("supersedes"), F.lit(True).alias("there")).distinct()
    parent = ids.join(known, "supersedes", "left").select("record_id", F.when(F.col("there"), F.col("supersedes")).otherwise(F.col("record_id")).alias("root_id"))
    parent = written(parent, "chain")
    for _ in range(most_passes):
        up = parent.select(F.col("record_id").alias("root_id"), F.col("root_id").alias("next"))
        step = written(parent.join(up, "root_id").select("record_id", F.col("next").alias("root_id"), (F.col("root_id") != F.col("next")).alias("moved")), "chain")
        parent = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return parent


def page_groups(df: DataFrame, partition: list[str], group: str, size: int = 25) -> DataFrame:
    """Adds ``page`` (from 0): ``size`` groups a page, in order of the group's name."""
    w = Window.partitionBy(*partition).orderBy(group)
    return df.withColumn("page", F.floor((F.dense_rank().over(w) - 1) / size).cast("int"))


def ref_labels(df: DataFrame, partition: list[str], *order: str) -> DataFrame:
    return df.withColumn("label", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("string")))


def global_offsets(df: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds start_char and end_char of each text in its source's texts put end to end."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return df.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length(text))


def neighbours(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def first_duplicate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``duplicate_of``: the first row's place among equal rows, null at the first."""
    first = F.min(order).over(Window.partitionBy(*keys))
    return df.withColumn("duplicate_of", F.when(F.col(order) > first, first))


def ranked_window(scored: DataFrame, offset: int, limit: int, ceiling: int = 10_000) -> DataFrame:
    """(query_id, record_id, score, rank, total, continue_offset): ranks offset+1 to offset+limit of each query, best score, newest, then smallest id first."""
    last = min(offset + limit, ceiling)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created"), "record_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= last)
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    return window_of(ranked.join(totals, "query_id"), offset, last)


def window_of(ranked: DataFrame, offset: int, last: int) -> DataFrame:
    """``ranked_window`` of rows that have rank and total already, up to rank ``last`` at least."""
    out = ranked.where((F.col("rank") > offset) & (F.col("rank") <= last))
    return out.select("query_id", "record_id", "score", "rank", "total", F.when(F.col("total") > last, F.lit(last)).alias("continue_offset"))


def claim_caps(claims: DataFrame, most: int = 12, most_suggested: int = 2) -> DataFrame:
    """Adds ``over_cap`` to claims of a source that has too many claims, or too many suggested by an assistant."""
    w = Window.partitionBy("source_id")
    over = (F.count("*").over(w) > most) | (F.count_if(F.col("status") == "agent_suggested").over(w) > most_suggested)
    return claims.withColumn("over_cap", over)


def verify_segments(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source_id, problems): whether segments (source_id, segment_no, start_char, end_char) cover each source's text without gap or overlap."""
    w = Window.partitionBy("source_id").orderBy("segment_no")
    gap = F.col("start_char") != F.coalesce(F.lag("end_char").over(w), F.lit(0))
    rows = segments.withColumn("gap", gap).groupBy("source_id").agg(F.count_if("gap").alias("gaps"), F.max("end_char").alias("covered"))
    out = sizes.join(rows, "source_id", "left")
    from attestry.operators.predicates import violations

    rules = {"gap_or_overlap": F.coalesce("gaps", F.lit(0)) > 0, "not_covered": F.coalesce("covered", F.lit(0)) != F.col("size")}
    return out.select("source_id", F.array_join(violations(rules), ",").alias("problems"))


def clause_overlap(claims: DataFrame, least: int = 8) -> DataFrame:
    """(source_id, first_no, second_no, shared): claims of one source, topic, subject and status that share whole clauses.

    Clauses meet by equality within a source, so a source's own claims bound the pairs.
    """
    keys = ["source_id", "topic", "subject", "status"]
    # a lambda: given F.trim itself, which takes two columns, transform would pass an item's place as what to trim
    parts = claims.select(*keys, "claim_no", "statement", F.explode(F.array_distinct(F.transform(F.split("statement", "[.,;:!?\n，。；！？、]"), lambda c: F.trim(c)))).alias("clause"))
    parts = parts.where(F.length("clause") >= least)
    a = parts.withColumnsRenamed({"claim_no": "first_no", "statement": "first"})
    b = parts.withColumnsRenamed({"claim_no": "second_no", "statement": "second"})
    return a.join(b, [*keys, "clause"]).where("first_no < second_no and first <> second").groupBy("source_id", "first_no", "second_no").agg(F.count("*").alias("shared"))


def conversation_preview(messages: DataFrame, first: int = 3, chars: int = 12_000) -> DataFrame:
    """(source_id, preview, truncated): the first messages of each source, joined and cut."""
    w = Window.partitionBy("source_id").orderBy("turn")
    head = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    out = head.groupBy("source_id").agg(text.alias("whole"))
    return out.select("source_id", F.substring("whole", 1, chars).alias("preview"), (F.length("whole") > chars).alias("truncated"))


def page_rows(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def fill_budget_stop(ranked: DataFrame, budget: int, key: str = "query_id", order: str = "rank", size: str = "size") -> DataFrame:
    """Rows in order while their running size stays within the budget; the first that doesn't fit ends it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
