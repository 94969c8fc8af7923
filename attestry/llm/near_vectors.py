"""Embedding near duplicates: sign hashes of random hyperplanes, exact cosines, connected components.

Equal vectors of one label form a class. Each class goes to one bucket in each of several tables, by the signs of
its products with random hyperplanes. Within a bucket all cosines are computed in blocks; a pair counts in
the first table where it shares a bucket, so it counts once. Only counts and spanning edges leave a
block. A large bucket is split into blocks of bounded size that meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .components import connected_components

#: Vectors of a block; larger buckets are split.
BLOCK = 1024
#: Of pairs right at the threshold, at most this share is missed.
MISSED = 1e-4
SEED = 20_240_601


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits and tables for ``n`` vectors: buckets of a few hundred at most if vectors are spread out, and few pairs missed."""
    bits = min(30, max(12, math.ceil(math.log2(max(1, n) / 256)) if n > 256 else 12))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1 - same))) if same < 1 else 1


def _signed(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            sigs = []
            for v in vectors:
                v = np.array(v, float)
                p = planes.get(len(v))
                if p is None:
                    p = planes[len(v)] = np.random.default_rng([SEED, len(v)]).standard_normal((len(v), bits * tables))
                # scaled, so that no product overflows
                sigs.append(((v / np.abs(v).max()) @ p > 0).reshape(tables, bits) @ weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.astype(np.int32).tolist() for s in sigs], pa.list_(pa.int32()))], names=[*batch.schema.names, "sigs"])

    return run


def _block_links(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, sigs: np.ndarray, table: int, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of a bucket's block, or pair of blocks: ``left`` and ``right`` are places, ``right`` None for a block with itself."""
    counts, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    b = left if right is None else right
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[b].T >= threshold)
        i, j = rows[i], b[j]
        if right is None:
            i, j = i[i < j], j[i < j]
        if table and len(i):
            first = ~(sigs[i, :table] == sigs[j, :table]).any(1)
            i, j = i[first], j[first]
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
    return counts, np.array([find(k) for k in range(len(ids))], np.int64)


def _links(threshold: float):
    """Links within buckets; rows come sorted by bucket, and one bucket's blocks are in hand at a time."""
    keys = ("lab", "dim", "table", "sig", "lo", "hi")

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            col = t[k].combine_chunks()
            v = (col.dictionary_encode().indices if k == "lab" else col).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def linked(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        ids, weight = t["rep"].to_numpy(), t["copies"].to_numpy()
        table, lo, hi, chunk, dim = (t[k].to_numpy() for k in ("table", "lo", "hi", "chunk", "dim"))
        flat, sig = t["vector"].combine_chunks().flatten().to_numpy(), t["sigs"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        offset = np.concatenate(([0], np.cumsum(dim)))
        out: list[tuple] = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
            if b - a < 2:
                continue
            x = flat[offset[a] : offset[b]].reshape(b - a, -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            left = np.flatnonzero(chunk[a:b] == lo[a])
            right = None if lo[a] == hi[a] else np.flatnonzero(chunk[a:b] == hi[a])
            counts, root = _block_links(x, ids[a:b], weight[a:b], sig[a:b], int(table[a]), left, right, threshold)
            some = np.flatnonzero(counts)
            if len(some):
                out.append((ids[a:b][some], counts[some], ids[a:b][root[some]]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held).combine_chunks()
            at = starts(t)
            held = t.slice(int(at[-1])).to_batches() if len(at) else held
            if len(at) > 1:
                yield linked(t.slice(0, int(at[-1])).combine_chunks(), at[:-1])
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield linked(t, starts(t))

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, label, embedding).

    Rows of equal, non-null label link when their cosine, in doubles, is at least ``threshold``; vectors of different
    lengths don't link. Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id
    or label, link with nothing. ``n_links``: other rows linked directly (of pairs right at the threshold, a share of about
    ``MISSED`` may not be found, of closer ones less). ``component_id``: smallest vec_id reachable; ``kept``:
    whether that is the row's own. Repeated rows are linked like any equal vectors. An empty table gives
    no row. Columns besides these three are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound, F.lit(False))
    # the text of a float is exact; + 0.0 makes a negative zero an ordinary one
    key = F.when(takes_part, F.md5(F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).cast("string").cast("binary")))
    keyed = scratch.keep("keyed", rows.withColumn("key", key))
    classes = keyed.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first(F.col("embedding").cast("array<double>")).alias("vector"))
    classes = scratch.keep("classes", classes)
    if bits is None or tables is None:
        bits, tables = plan(classes.count(), threshold)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.drop("key").schema.fields)
    signed = classes.drop("key").mapInArrow(_signed(bits, tables), fields + ", sigs array<int>")
    signed = scratch.keep("signed", signed.withColumn("dim", F.size("vector")))
    place = signed.select("rep", "label", "dim", F.posexplode("sigs").alias("table", "sig"))
    bucket = ["label", "dim", "table", "sig"]
    # only buckets with company; those above BLOCK get several chunks
    shared = place.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    met = signed.select("rep", "copies", "vector", "label", "dim", "sigs", F.posexplode("sigs").alias("table", "sig")).join(shared, bucket)
    met = met.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    order = ["lab", "dim", "table", "sig", "lo", "hi"]
    met = met.withColumn("lab", F.col("label").cast("string")).select(*order, "chunk", "rep", "copies", "vector", "sigs")
    found = met.repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_links(threshold), "rep long, links long, `to` long")
    found = scratch.keep("found", found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("src"), F.col("to").alias("dst")), scratch, "cc")
    of_class = classes.select("label", "key", "rep", "copies").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("label", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "label", "key").join(of_class, ["label", "key"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
