"""Files that hold one long JSON list, read by many tasks.

Spark's text reader cuts a file into splits, and each split into pieces at closing braces. Whether a split begins within a string, and how deep,
depends on all before it; but a split can say how many quotation marks it has and how brackets balance in either case, which is four
numbers. These are added up along the file, and then each split knows its place and takes its elements apart. Only an element
that lies across splits is put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.operators.lineage import written

_MARK = re.compile(r'\\.|["{}\[\]]', re.S)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}
#: Splits whose places are sent to all tasks (a row of some 100 bytes each); more are joined by a shuffle.
MOST_SENT = 1 << 18


def _balance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split: whether its quotation marks are odd, and the balance of brackets outside strings if it begins outside or within one."""
    sums: dict[tuple, list[int]] = {}
    for batch in batches:
        for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
            s = sums.setdefault((file, block), [0, 0, 0])
            for m in _MARK.finditer(value + "}"):
                if m[0] == '"':
                    s[0] ^= 1
                elif m[0] in _STEP:
                    s[1 + s[0]] += _STEP[m[0]]
    yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["file", "block", "odd", "outside", "within"])


def _begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split whose place is known: how many elements begin in it."""
    counts: dict[tuple, list] = {}
    for batch in batches:
        for file, block, value, quoted, depth in zip(batch["file"], batch["block"], batch["value"], batch["quoted"], batch["depth"], strict=True):
            s = counts.setdefault((file, block), [bool(quoted), int(depth), 0])
            for m in _MARK.finditer(value + "}"):
                if m[0] == '"':
                    s[0] = not s[0]
                elif not s[0] and m[0] in _STEP:
                    s[2] += s[1] == 1 and _STEP[m[0]] > 0
                    s[1] += _STEP[m[0]]
    yield pd.DataFrame([(*k, v[2]) for k, v in counts.items()], columns=["file", "block", "begun"])


def _taken_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The elements of each split; ``whole`` where an element begins and ends in it."""
    at, quoted, depth, n, held, opened = None, False, 0, 0, [], False
    for batch in batches:
        out = []
        for file, block, value, q, d, first in zip(batch["file"], batch["block"], batch["value"], batch["quoted"], batch["depth"], batch["before"], strict=True):
            if (file, block) != at:
                if held:
                    out.append((*at, n, False, "".join(held)))
                at, quoted, depth, n = (file, block), bool(q), int(d), int(first) - 1
                held, opened = [], False
            text, begin = value + "}", 0
            inside = depth > 1
            for m in _MARK.finditer(text):
                if m[0] == '"':
                    quoted = not quoted
                elif not quoted and m[0] in _STEP:
                    depth += _STEP[m[0]]
                    if not inside and depth == 2 and _STEP[m[0]] > 0:
                        inside, begin, opened, n = True, m.start(), True, n + 1
                    elif inside and depth == 1:
                        held.append(text[begin : m.end()])
                        out.append((*at, n, opened, "".join(held)))
                        held, inside, opened = [], False, False
            if inside:
                held.append(text[begin:])
        yield pd.DataFrame(out, columns=["file", "block", "n", "whole", "text"])
    if held:
        yield pd.DataFrame([(*at, n, False, "".join(held))], columns=["file", "block", "n", "whole", "text"])


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, text): the objects and lists that are the elements of the JSON lists at ``path``, numbered from 0 in each file, as JSON.

    Any folder or file that Spark reads; not compressed, or one task reads it. Nothing is kept of elements that are plain values.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = pieces.mapInPandas(_balance, "file string, block long, odd int, outside int, within int").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "odd", "outside", "within"))).alias("splits"))

    def step(acc, s):
        now = F.struct(s["block"].alias("block"), acc["quoted"].alias("quoted"), acc["depth"].alias("depth"))
        turn = F.when(acc["quoted"], s["within"]).otherwise(s["outside"])
        return F.struct((acc["quoted"] != (s["odd"] == 1)).alias("quoted"), (acc["depth"] + turn).cast("int").alias("depth"), F.concat(acc["out"], F.array(now)).alias("out"))

    zero = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("depth"), F.array().cast("array<struct<block:bigint,quoted:boolean,depth:int>>").alias("out"))
    placed = splits.select("file", F.explode(F.aggregate("splits", zero, step, lambda a: a["out"])).alias("s")).select("file", "s.block", "s.quoted", "s.depth")
    placed = written(placed, "splits")
    few = placed.count() <= MOST_SENT

    def told(known: DataFrame) -> DataFrame:
        if few:
            return pieces.join(F.broadcast(known), ["file", "block"])
        rows = pieces.withColumn("_i", F.monotonically_increasing_id()).join(known, ["file", "block"])
        return rows.repartition("file", "block").sortWithinPartitions("file", "block", "_i").drop("_i")

    begun = told(placed).mapInPandas(_begun, "file string, block long, begun long")
    before = F.coalesce(F.sum("begun").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = written(placed.join(begun, ["file", "block"]).withColumn("before", before).drop("begun"), "splits")
    parts = written(told(known).select("file", "block", "value", "quoted", "depth", "before").mapInPandas(_taken_apart, "file string, block long, n long, whole boolean, text string"), "elements")
    across = parts.where("not whole").groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    return parts.where("whole").select("file", "n", "text").unionByName(across)
