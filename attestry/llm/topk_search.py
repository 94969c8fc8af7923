"""Exact top-k inner products by three-phase uniform thresholds.

A vector's components are dealt into slices; a partition holds a list of partial scores for each slice. (1) Each partition gathers the
vectors that lead its first list, resolves these alone and sends the best k of each query; the k-th best over all partitions is
reached by k vectors, so a safe cutoff. (2) The cutoff goes to all partitions, and the lists are made one by one. A total that reaches the
cutoff has a slice with at least an equal share of it, so a vector whose slices' norms keep it below the share in every list is never
multiplied; nor is one whose partial score and the norms of its remaining slices stay below the cutoff. (3) What is left
is resolved exactly, and the best k of a partition are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Queries handled in one pass over the vectors: what is broadcast is at most so many vectors.
QUERY_BLOCK = 4096
SLICES = 4
ROWS = 1024


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal width from a list column; missing trailing components are zero."""
    off = col.offsets.to_numpy()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(off)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(col), dim), np.int64)
    for i, n in enumerate(size):
        out[i, :n] = flat[off[i] - off[0] : off[i] - off[0] + n]
    return out


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly: in doubles while all sums stay below 2**53, else in whole numbers."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if top < 2.0**53:
        return (x.astype(float) @ q.T.astype(float)).astype(np.int64)
    if top < 2.0**62:
        return x @ q.T
    return (x.astype(object) @ q.T.astype(object)).astype(np.int64)


#: Score and id of an empty place.
NONE, NO_ID = -(2**62), 2**63 - 1
#: A list is made for all rows and queries at once while at least this share of the pairs is left, else pair by pair.
DENSE = 0.05
#: Pairs multiplied one by one at a time.
PAIRS = 1 << 18


def slices(dim: int) -> list[tuple[int, int]]:
    edge = np.linspace(0, dim, min(SLICES, dim) + 1).astype(int).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True))


def _pairwise(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (row, col) alone."""
    parts = []
    small = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2.0**62
    for i in range(0, len(row), PAIRS):
        a, b = x[row[i : i + PAIRS]], q[col[i : i + PAIRS]]
        parts.append(np.einsum("ij,ij->i", a, b) if small else (a.astype(object) * b.astype(object)).sum(1).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Best:
    """The k best (score, id) of each query, ties to smaller ids; an equal pair counts once."""

    def __init__(self, queries: int, k: int):
        self.score, self.id, self.k = np.full((k, queries), NONE), np.full((k, queries), NO_ID), k

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """One column a query; places to leave out have the score NONE and the id NO_ID."""
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        for _ in range(2):
            order = np.lexsort((ids, -score), axis=0)
            score, ids = np.take_along_axis(score, order, 0), np.take_along_axis(ids, order, 0)
            again = (score[1:] == score[:-1]) & (ids[1:] == ids[:-1]) & (ids[1:] != NO_ID)
            if not again.any():
                break
            score[1:][again], ids[1:][again] = NONE, NO_ID
        self.score, self.id = score[: self.k], ids[: self.k]

    def add_pairs(self, col: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Any number of entries for any query: the best k of each are laid out and added."""
        if not len(col):
            return
        order = np.lexsort((ids, -score, col))
        col, score, ids = col[order], score[order], ids[order]
        new = np.append(True, (col[1:] != col[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
        col, score, ids = col[new], score[new], ids[new]
        rank = np.arange(len(col)) - np.searchsorted(col, col)
        top = rank < self.k
        wide, names = np.full(self.score.shape, NONE), np.full(self.id.shape, NO_ID)
        wide[rank[top], col[top]], names[rank[top], col[top]] = score[top], ids[top]
        self.add(wide, names)


def gather(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Phase 1: the leaders of the first list, resolved."""
    a, b = slices(x.shape[1])[0]
    lead = min(best.k + 1, len(ids))  # one more, since the query may lead its own list
    top = np.argpartition(_products(x[:, a:b], q[:, a:b]), len(ids) - lead, axis=0)[len(ids) - lead :]
    col = np.broadcast_to(np.arange(len(qid)), top.shape)
    score = _pairwise(x, q, top.ravel(), col.ravel()).reshape(top.shape)
    own = ids[top] == qid
    best.add(np.where(own, NONE, score), np.where(own, NO_ID, ids[top]))


def resolve(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (row, query, score) of the pairs whose score reaches the query's cutoff, and how many products of components were made."""
    cuts = slices(x.shape[1])
    norms = [(np.sqrt((x[:, a:b].astype(float) ** 2).sum(1)), np.sqrt((q[:, a:b].astype(float) ** 2).sum(1))) for a, b in cuts]
    # norms are rounded, so bounds get some room
    room, low = 1 + 1e-9, cutoff - np.abs(cutoff) * 1e-9 - 1.0
    rows = np.arange(len(ids))
    share = low / len(cuts)
    reach = np.zeros(len(ids), bool)
    for n, m in norms:
        reach |= n * m.max(initial=0) * room >= share.min(initial=np.inf)
    rows = rows[reach]
    partial, row, col, made = None, None, None, 0
    for s, (a, b) in enumerate(cuts):
        if row is None:
            part = _products(x[rows, a:b], q[:, a:b])
            partial = part if partial is None else partial + part
            made += part.size * (b - a)
            rest = np.zeros(part.shape) if s + 1 == len(cuts) else np.stack([n[rows] for n, _ in norms[s + 1 :]], 1) @ np.stack([m for _, m in norms[s + 1 :]])
            alive = (partial + rest * room >= low) & (ids[rows][:, None] != qid)
            if s + 1 == len(cuts) or alive.sum() < DENSE * alive.size:
                at, col = np.nonzero(alive)
                row, partial = rows[at], partial[at, col]
            else:
                some = alive.any(1)
                rows, partial = rows[some], partial[some]
        else:
            partial = partial + _pairwise(x[:, a:b], q[:, a:b], row, col)
            made += len(row) * (b - a)
            rest = sum((norms[t][0][row] * norms[t][1][col] for t in range(s + 1, len(cuts))), np.zeros(len(row)))
            alive = partial + rest * room >= low[col]
            row, col, partial = row[alive], col[alive], partial[alive]
    sure = partial >= cutoff[col]
    return row[sure], col[sure], partial[sure], made


def _scan(shared, k: int, dim: int):
    """Phase 1 without cutoffs in ``shared``, phases 2 and 3 with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, cutoff = shared.value
        best = Best(len(qid), k)
        for batch in batches:
            every_id, every_x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            for i in range(0, len(every_id), ROWS):
                ids, x = every_id[i : i + ROWS], every_x[i : i + ROWS]
                if cutoff is None:
                    gather(ids, x, qid, q, best)
                else:
                    row, col, score, _ = resolve(ids, x, qid, q, cutoff)
                    best.add_pairs(col, score, ids[row])
        place, col = np.nonzero(best.id != NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(qid[col], pa.int64()), pa.array(best.id[place, col], pa.int64()), pa.array(best.score[place, col], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k_search(vectors: DataFrame, is_query: Column, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to smaller ids.

    ``vectors``: vec_id long, vector array<long>; rows with a null id or vector, or a null component, take no part. Queries are the
    rows where ``is_query`` holds, candidates all rows with another id. Shorter vectors
    count as padded by zeros. Equal rows count once; different vectors of one id are candidates of their own, and its smallest vector asks. With fewer than ``k`` candidates all are returned; without queries no row. Each pass over the vectors
    serves ``query_block`` queries. Columns besides these two are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<bigint>").alias("vector"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and vector is not null and forall(vector, x -> x is not null)")
    rows = scratch.keep("vectors", rows)
    size = rows.agg(F.max(F.size("vector")).alias("dim"), F.count_if("asks").alias("asks")).first()
    dim, passes = max(1, size["dim"] or 0), -(-(size["asks"] or 0) // query_block)
    found = None
    for step in range(passes):
        block = rows.where(F.col("asks") & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == step)).groupBy("vec_id").agg(F.min("vector").alias("vector")).toPandas().sort_values("vec_id")
        if not len(block):
            continue
        qid = block["vec_id"].to_numpy(np.int64)
        q = np.zeros((len(block), dim), np.int64)
        for i, v in enumerate(block["vector"]):
            q[i, : len(v)] = v
        kind = "query_id long, vec_id long, score long"
        first = spark.sparkContext.broadcast((qid, q, None))
        gathered = rows.select("vec_id", "vector").mapInArrow(_scan(first, k, dim), kind).distinct()
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        safe = gathered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "score").toPandas()
        # a query with fewer than k candidates so far has no cutoff
        cutoff = np.full(len(qid), NONE + 1, np.int64)
        cutoff[np.searchsorted(qid, safe["query_id"].to_numpy(np.int64))] = safe["score"].to_numpy(np.int64)
        second = spark.sparkContext.broadcast((qid, q, cutoff))
        resolved = rows.select("vec_id", "vector").mapInArrow(_scan(second, k, dim), kind).distinct()
        part = resolved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
