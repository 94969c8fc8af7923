"""A Merkle manifest of a data set, with a version of the tree for each changed leaf.

Every row is a leaf; leaves of one group (source) stand in order, and runs of 16 become their parent until one node is
left, the group's root. The groups' roots, in order, become the root of the data set in the same way.

Leaves are dealt to aligned blocks of 16**3: a block is a subtree, and one task builds it whatever the size of its
group. Upper levels are tables, one join-free aggregation a level; going down again each block is told its
*path*, the runs above it (at most 15 digests a level beside its own). A changed leaf makes a version by path copying: only
its ancestors are made anew, first within its block, then along the path; everything else is shared with
the first version. Blocks and paths meet on (group, block), so no key has more than 4 096 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, shuffle_partitions

#: Children of a node, and levels of a block.
RUN, LEVELS = 16, 3
BLOCK = RUN**LEVELS

#: The runs above a node, from below: its place in each run and the run's digests.
PATH = "array<struct<at:int,run:array<string>>>"
VERSIONS = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, new_nodes array<string>"


def digest_of(*values: Column) -> Column:
    """H of values: ``-`` for null, else the count of UTF-8 bytes, a colon and the value, one after another."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, scratch: Scratch, name: str, group: str, *order: str) -> DataFrame:
    """Adds ``pos`` (from 0 within ``group``, in ``order``), by range partitions and their counts: no group meets in one task.

    ``order`` must tell rows apart; the result is a written table, so places stay when tasks run again.
    """
    parts = shuffle_partitions(rows.sparkSession)
    keys = [group, *order]
    sorted_ = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    kept = scratch.keep(f"{name}-sorted", sorted_)
    # a row a group and partition; a partition of ranges meets few groups in common with others
    counts = kept.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "_part", "_first", before.alias("_before"))
    return kept.join(starts, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _parent(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def block_levels(leaves: list[str], levels: int) -> list[list[str]]:
    """The levels of a block from its leaves up; ``levels`` of them above the leaves."""
    out = [leaves]
    for _ in range(levels):
        out.append([_parent(out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def levels_within(number: int, n: int) -> int:
    """Levels above the leaves of block ``number`` with ``n`` leaves: all where its group has other blocks, else as many as lead to one node."""
    n, up = BLOCK if number else n, 0
    while n > 1 and up < LEVELS:
        n, up = -(-n // RUN), up + 1
    return up


def tree_paths(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(grp, idx, root, path) of nodes (grp, idx, digest): each group's root and the runs between each node and it.

    Up: one aggregation a level over a table 16 times smaller. Down: a run hands its own path to its children; no join with
    the level below, only of runs with the paths of their nodes, which are as many.
    """
    level, ups = nodes, []
    while (top := level.agg(F.max("idx").alias("m")).first()["m"]) is not None and top > 0:
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        runs = level.withColumn("up", F.floor(F.col("idx") / RUN)).groupBy("grp", "up").agg(run.alias("run"))
        # a group that is down to one node is carried along without a level
        runs = scratch.keep(f"{name}-runs-{len(ups)}", runs.withColumn("single", (F.col("up") == 0) & (F.size("run") == 1)))
        ups.append(runs)
        digest = F.when(F.col("single"), F.col("run")[0]).otherwise(F.sha2(F.array_join("run", "").cast("binary"), 256))
        level = runs.select("grp", F.col("up").alias("idx"), digest.alias("digest"))
    paths = level.select("grp", "idx", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    for depth, runs in reversed(list(enumerate(ups))):
        told = runs.join(paths.withColumnRenamed("idx", "up"), ["grp", "up"])
        own = F.when(F.col("single"), F.array().cast(PATH)).otherwise(F.array(F.struct(F.col("at").cast("int").alias("at"), F.col("run"))))
        down = told.select("grp", "up", "root", "path", "single", "run", F.posexplode("run").alias("at", "_d"))
        paths = scratch.keep(f"{name}-paths-{depth}", down.select("grp", (F.col("up") * RUN + F.col("at")).alias("idx"), "root", F.concat(own, "path").alias("path")))
    return paths


class _Block:
    """One block's tree with the path above it; versions copy the ancestors of their leaf and share the rest."""

    def __init__(self, number: int, leaves: list[str], path: list):
        self.levels = block_levels(leaves, levels_within(number, len(leaves)))
        self.path = [(p["at"], list(p["run"])) for p in path]
        self.above = "".join(x for at, run in self.path for i, x in enumerate(run) if i != at)
        self.first = self._up(self.levels[-1][0])

    def _up(self, digest: str) -> list[str]:
        out = []
        for at, run in self.path:
            digest = _parent(run[:at] + [digest] + run[at + 1 :])
            out.append(digest)
        return out

    def siblings(self, i: int) -> str:
        out = []
        for level in self.levels[:-1]:
            lo = i - i % RUN
            out += level[lo:i] + level[i + 1 : lo + RUN]
            i //= RUN
        return "".join(out) + self.above

    def copied(self, i: int, leaf: str) -> list[str]:
        """The ancestors of leaf ``i`` in the version where it is ``leaf``, from its parent up to the root."""
        out, digest = [], leaf
        for level in self.levels[:-1]:
            lo = i - i % RUN
            digest = _parent(level[lo:i] + [digest] + level[i + 1 : lo + RUN])
            out.append(digest)
            i //= RUN
        # above the block, versions that changed nothing share the first one's nodes
        return out + (self.first if digest == self.levels[-1][0] else self._up(digest))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks, one after another, of rows sorted by (grp, block, pos); holds one block and one batch."""
    held = []
    for batch in batches:
        same = (batch["grp"] == batch["grp"].shift()) & (batch["block"] == batch["block"].shift())
        for n, (_, part) in enumerate(batch.groupby((~same).cumsum(), sort=False)):
            if held and (n or tuple(part.iloc[0][["grp", "block"]]) != tuple(held[0].iloc[0][["grp", "block"]])):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _blocks(batches):
        number = int(rows["block"].iloc[0])
        levels = block_levels(rows["leaf"].tolist(), levels_within(number, len(rows)))
        yield pd.DataFrame({"grp": [rows["grp"].iloc[0]], "idx": [number], "digest": levels[-1]})


def _versions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for both in _blocks(batches):
        told, rows = both.iloc[0], both.iloc[1:]
        block = _Block(int(told["block"]), rows["leaf"].tolist(), list(told["path"]))
        out = []
        for i, (key, leaf, other) in enumerate(zip(rows["key"], rows["leaf"], rows["other"], strict=True)):
            new = block.copied(i, other or leaf)
            out.append((key, leaf, told["subroot"], told["root"], sha256(block.siblings(i).encode()).hexdigest(), new[-1] if new else other or leaf, new if other else None))
        yield pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "new_nodes"])


def merkle_manifest(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (row, grp, ord, key, leaf, other) as key, leaf, subroot, root, proof_sha256, folded_root and new_nodes.

    ``row`` is a long of its own for each row, ``grp`` and ``key`` are strings, ``ord`` is any sortable column; ``other`` is the leaf of the
    row's changed version or null. ``new_nodes`` are that version's copied ancestors, from the leaf's parent to the root. Equal
    ``ord`` stand by leaf, equal leaves in any order (they are alike); no rows give no rows.
    """
    placed = scratch.keep("placed", numbered(rows, scratch, "leaves", "grp", "ord", "leaf", "row").withColumn("block", F.floor(F.col("pos") / BLOCK)))
    scratch.drop("leaves-sorted")
    # a block's root comes from one task that sees at most 4 096 leaves
    inner = placed.select("grp", "block", "pos", "leaf").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInPandas(_tops, "grp string, idx long, digest string")
    within = tree_paths(scratch.keep("blocks", inner), scratch, "blocks")

    # the groups' own roots are the leaves of one more tree
    one = within.where("idx = 0").select(F.lit("").alias("all"), "grp", F.col("root").alias("digest"))
    groups = scratch.keep("groups", numbered(one, scratch, "groups", "all", "grp"))
    over = tree_paths(groups.select(F.col("all").alias("grp"), F.col("pos").alias("idx"), "digest"), scratch, "groups")
    over = over.select(F.col("idx").alias("pos"), F.col("root").alias("all_root"), F.col("path").alias("over"))
    named = groups.select("grp", F.col("digest").alias("subroot"), "pos").join(over, "pos")
    told = within.join(named, "grp").select("grp", F.col("idx").alias("block"), F.col("all_root").alias("root"), "subroot", F.concat("path", "over").alias("path"))

    # a block's path comes first among its rows
    own = placed.select("grp", "block", "pos", "key", "leaf", "other").unionByName(told.withColumn("pos", F.lit(-1)), allowMissingColumns=True)
    return own.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInPandas(_versions, VERSIONS)


def manifest_of(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and new_nodes of documents (doc_id, source, lang, n_chars, text).

    The changed version of a row whose id's crc32 is divisible by five has A-Z of its text lower-cased. Null columns
    are written ``-``; a null source is a group of its own, before all others; rows without an id stand first in their group and
    are not changed; repeated rows are leaves of their own; an empty table gives no rows. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(
        # null first, then bytewise
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("key"),
        digest_of(*own, F.col("text")).alias("leaf"),
        F.when(touched & F.col("text").isNotNull(), digest_of(*own, lowered)).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    made = merkle_manifest(scratch.keep("digests", leaves), scratch)
    return made.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "new_nodes")
