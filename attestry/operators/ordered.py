"""Work in order over groups of any size: rows are dealt to ranges, ranges are summed up, and only sums meet.

Nothing here gathers a group in one task. What must be the same at each use is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.lineage import written


def in_ranges(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``_range`` and ``_at``: the sort by ``group`` and ``order`` cut into ranges of about the same size, and the place, ascending over all ranges.

    Rows that ``order`` does not tell apart stand in any order that is the same at each use.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = tie.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    return written(cut.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)


def _before(sums: DataFrame, group: list[str], value: str) -> Column:
    """The sum of ``value`` over a group's earlier ranges; a group has at most as many rows as there are ranges."""
    w = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``pos``: 0, 1, … within ``group`` in ``order``."""
    cut = in_ranges(rows, group, order, name)
    counts = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), "_first", _before(counts, group, "_n").alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = F.col("_range") == F.col("_r")
    for s in same:
        on = on & s
    placed = cut.join(starts, on).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.select(*rows.columns, "pos")


def running_from(cut: DataFrame, group: list[str], value: Column, least: Column, wanted: Column) -> DataFrame:
    """Rows of ranges for which ``wanted`` holds, with ``_sum``: the running sum of ``value`` up to and with the row, over the group.

    ``cut`` comes from ``in_ranges``. ``wanted`` may use ``_before`` and ``_total``, the sums of the ranges before and of this range, and ``_least``, the
    smallest ``least`` of its rows; ranges that are not wanted are never sorted.
    """
    rows = cut.withColumn("_value", value)
    sums = rows.groupBy(*group, "_range").agg(F.sum("_value").alias("_total"), F.min(least).alias("_least"))
    ranges = sums.withColumn("_before", _before(sums, group, "_total"))
    w = Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ranges, [*group, "_range"]).where(wanted).withColumn("_sum", F.col("_before") + F.sum("_value").over(w))


def whole_groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Whole groups, one after another, of rows sorted by ``keys`` (never null); holds one group and one batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        new = pd.Series(False, batch.index)
        for k in keys:
            new |= batch[k] != batch[k].shift()
        for n, (_, part) in enumerate(batch.groupby(new.cumsum(), sort=False)):
            if held and (n or any(part[k].iloc[0] != held[0][k].iloc[0] for k in keys)):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
