"""Budgets that are filled item by item, where a later smaller item may still fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.lineage import written
from attestry.operators.ordered import in_ranges, running_from


def _fold(rows: Column, budget: Column) -> Column:
    """Ranks taken, from an ordered array of (rank, size): an item is taken if it fits what is left."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["rank"]))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(rows, zero, step, lambda a: a["taken"])


def fill_budget_skip(ranked: DataFrame, budget: int, least: int, key: str = "query_id") -> DataFrame:
    """Rows (key, rank, size, …) taken in order of rank, skipping what doesn't fit.

    An item is at least ``least`` long. What could never fit is left out first, so that what is folded for one query is bounded by the
    budget, not by how many rows it has.
    """
    fit = ranked.where((F.col("size") <= budget) & (F.col("size") >= least))
    # what is left only shrinks, so of items of one size the first that isn't taken is the last looked at: budget // size of them are enough
    place = F.row_number().over(Window.partitionBy(key, "size").orderBy("rank"))
    near = fit.withColumn("_n", place).where(F.col("_n") * F.col("size") <= budget).drop("_n")
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), F.col("size").cast("long").alias("size"))))
    taken = near.groupBy(key).agg(rows.alias("rows")).select(key, F.explode(_fold(F.col("rows"), F.lit(budget).cast("long"))).alias("rank"))
    return ranked.join(taken, [key, "rank"], "left_semi")


#: Requests of one scope that may be folded in one task.
MOST_FOLDED = 4096


def admit_under_budget(requests: DataFrame, budgets: DataFrame, most_folded: int = MOST_FOLDED) -> DataFrame:
    """(request_id, admitted): per owner and scope in order of id, admitted while spent + allowance stays within the cap; refused ones take nothing.

    Requests that fit together are admitted by their sum, and at most ``most_folded`` that could still fit are folded. Longer lists are
    admitted by stretches: as long as more than half of what is left stays left, every request up to that half fits; the stretch ends with the
    first larger one that fits, or with the one that leaves less than half. Running sums over ranges find the end, so a round at least halves what is
    left and no list meets in one task. Requests without an allowance or below zero, and those of a scope without a cap, are refused.
    """
    keys, size, left = ["owner", "scope"], F.col("_size"), F.col("left")
    cut = in_ranges(requests.select("request_id", *keys, F.col("allowance").cast("long").alias("_size")), keys, ["request_id"], "requests")
    caps = budgets.select(*keys, F.col("cap").cast("long").alias("left"))
    rows = cut.join(caps, keys).where((size >= 0) & (size <= left))
    taken: list[DataFrame] = []
    while True:
        sums = rows.groupBy(*keys, "left").agg(F.count("*").alias("n"), F.sum("_size").alias("sum"))
        way = F.when(F.col("sum") <= left, "all").when(F.col("n") <= most_folded, "fold").otherwise("round")
        scopes = written(sums.select(*keys, way.alias("way")), "scopes")
        tagged = rows.join(scopes, keys)
        listed = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("rank"), size.alias("size"))))
        folded = tagged.where("way = 'fold'").groupBy(*keys, "left").agg(listed.alias("rows")).select(F.explode(_fold(F.col("rows"), left)).alias("_at"))
        done = tagged.where("way = 'all'").select("_at").unionByName(folded)
        if scopes.where("way = 'round'").isEmpty():
            taken.append(done)
            break
        long = tagged.where("way = 'round'").drop("way")
        light = 2 * size <= left
        value = F.when(light, size).otherwise(0)
        # a range holds the end only if its light requests reach the half, or a heavy one may fit
        may_end = (2 * (F.col("_before") + F.col("_total")) >= left) | (F.col("_least") <= left - F.col("_before"))
        run = running_from(long, keys, value, F.when(~light, size), may_end)
        ends = run.where(F.when(light, 2 * F.col("_sum") >= left).otherwise(size <= left - F.col("_sum")))
        used = F.when(light, F.col("_sum")).otherwise(F.col("_sum") + size)
        ends = written(ends.groupBy(*keys).agg(F.min("_at").alias("end"), F.min_by(used, "_at").alias("used")), "ends")
        ended = long.join(ends, keys, "left")
        stretch = ended.where((light & (F.col("end").isNull() | (F.col("_at") <= F.col("end")))) | (F.col("_at") == F.col("end"))).select("_at")
        taken.append(written(done.unionByName(stretch), "taken"))
        rest = ended.where((F.col("_at") > F.col("end")) & (size <= left - F.col("used")))
        rows = written(rest.withColumn("left", left - F.col("used")).drop("end", "used"), "rest")
    every = taken[0]
    for more in taken[1:]:
        every = every.unionByName(more)
    return cut.join(every.withColumn("ok", F.lit(True)), "_at", "left").select("request_id", F.coalesce("ok", F.lit(False)).alias("admitted"))


def evidence_bundle(trusted: DataFrame, candidates: DataFrame, originals: DataFrame, budget: int) -> DataFrame:
    """(query_id, group, rank) that stay within ``budget`` characters a query. Each input: (query_id, rank, size).

    Under pressure candidates go first, the last ones first; then originals down to one, trusted down to one, the last original, the last trusted.
    That is the same as taking in the opposite order while the running size fits: one cumulative sum, no fold.
    Candidates never fill a gap among the trusted.
    """

    def tagged(df: DataFrame, group: str, first: int, rest: int) -> DataFrame:
        return df.select("query_id", "rank", "size", F.lit(group).alias("group"), F.when(F.col("rank") == 1, first).otherwise(rest).alias("order"))

    every = tagged(trusted, "trusted", 0, 2).unionByName(tagged(originals, "original", 1, 3)).unionByName(tagged(candidates, "candidate", 4, 4))
    w = Window.partitionBy("query_id").orderBy("order", "rank").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= budget).select("query_id", "group", "rank")


def paginate_text(df: DataFrame, chars: int, text: str = "text") -> DataFrame:
    """Adds page_no, page and next_offset (null on the last): pages of ``chars`` code points whose concatenation is the text."""
    from attestry.functions.spans import split_fixed

    pages = split_fixed(df.withColumn("_size", F.length(text)), chars, text)
    end = (F.col("part_no") + 1) * chars
    return pages.withColumn("next_offset", F.when(end < F.col("_size"), end)).withColumnsRenamed({"part_no": "page_no", "part": "page"}).drop("_size")
