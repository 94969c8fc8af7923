"""Ranked lexical search by blocked matrix products.

Texts are read once for each block of items: a document keeps the terms that some item of the block asks for, with their
counts, as a written table. Its aggregates give the counts that weights need. Then documents are laid out in dense tiles
(documents x terms of the tile, the impact of each term) that are multiplied with the items' weights by BLAS in
float64; products are whole numbers and a partial sum stays below 2**53, so that they are exact in any order of addition.
Each task keeps every item's best rows, ties included as far as they can matter, and these are merged in two rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Items and distinct terms of a block (an item with more terms has a block of its own): bounds what tasks are sent and what the driver holds.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 14
#: Terms of one partial product, and cells of a dense tile (32 MB).
TILE_TERMS, TILE_CELLS = 4096, 1 << 22
#: No impact is above it: (10**9 * tf) div (1000 * tf + 20 * m) with m >= 0.
MOST_IMPACT = 10**6
#: Sums of whole numbers below it are exact in float64.
EXACT = 2**53

# Bytes outside a term become a blank; only A-Z are lowered. Bytes of characters above ASCII belong to terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _bytes(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()


def _counted(terms: list[bytes]):
    """Per document: all terms with repeats, the block's terms in it and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            ids, n, found, counts = batch.column(0), [], [], []
            for text in _bytes(batch.column(1)):
                every = terms_of(text)
                n.append(len(every))
                u, c = np.unique(np.array([number[t] for t in every if t in number], np.int32), return_counts=True)
                found.append(u)
                counts.append(c.astype(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


class Tile:
    """Dense products of documents with the block's items.

    ``weights``: (terms x items) whole numbers, 0 where an item doesn't have a term; a task is sent only its entries.
    """

    def __init__(self, n_terms: int, n_items: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.weights = np.zeros((n_terms, n_items))
        self.weights[rows, cols] = values
        self.width = max(1, min(TILE_TERMS, (EXACT - 1) // max(1, int(values.max(initial=0)) * MOST_IMPACT)))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """(documents x items) as int64, from the entries (doc, term, impact)."""
        out = np.zeros((n_docs, self.weights.shape[1]), np.int64)
        used, place = np.unique(term, return_inverse=True)
        for lo in range(0, len(used), self.width):
            mine = (place >= lo) & (place < lo + self.width)
            dense = np.zeros((n_docs, min(self.width, len(used) - lo)))
            dense[doc[mine], place[mine] - lo] = impact[mine]
            # every partial sum is below width * largest weight * MOST_IMPACT <= 2**53
            out += (dense @ self.weights[used[lo : lo + self.width]]).astype(np.int64)
        return out


class Leaders:
    """Per item the best ``k`` of (score, id): the highest scores, equal ones by ascending id, rows without an id last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n_items

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        for i, held in enumerate(self.rows):
            score = scores[:, i]
            least = held[0][-1] if len(held[0]) >= self.k else 1
            hit = np.flatnonzero(score >= max(least, 1))
            if len(hit) > self.k:
                # all that tie with the last place stay until ids decide
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - self.k)[len(hit) - self.k]]
            if not len(hit):
                continue
            s, n, d = (np.concatenate(p) for p in zip(held, (score[hit], no_id[hit], ids[hit]), strict=True))
            best = np.lexsort((d, n, -s))[: self.k]
            self.rows[i] = s[best], n[best], d[best]


def _ranked(n_terms: int, n_items: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, best = Tile(n_terms, n_items, *entries), Leaders(n_items, k)
        for batch in batches:
            at = 0
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            while at < batch.num_rows:
                # as many documents as keep documents x terms within the tile
                cells = np.minimum(np.cumsum(sizes[at:]), n_terms) * np.arange(1, batch.num_rows - at + 1)
                part = batch.slice(at, max(1, int(np.searchsorted(cells, TILE_CELLS, side="right"))))
                at += part.num_rows
                ids, n, found, counts = part.columns
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(found.offsets)))
                # Python's integers: n * docs may pass 64 bits
                m = np.array([50 + (50 * x * docs) // length for x in n.to_pylist()], np.int64)
                tf = found.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
                impact = (1_000_000_000 * tf[1]) // (1000 * tf[1] + 20 * m[doc])
                best.add(tile.scores(doc, tf[0], impact, part.num_rows), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), np.asarray(pc.is_null(ids).to_numpy(zero_copy_only=False)))
        for i, (score, no_id, ids) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), pa.array(ids, pa.int64(), mask=no_id), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items, fetched a block at a time, with their distinct terms; those without a term are left out."""
    held, seen = [], set()
    for row in items.toLocalIterator():
        terms = sorted(set(terms_of((row[1] or "").encode())))
        if not terms:
            continue
        if held and (len(held) >= BLOCK_ITEMS or len(seen | set(terms)) > BLOCK_TERMS):
            yield held
            held, seen = [], set()
        held.append((row[0], terms))
        seen |= set(terms)
    if held:
        yield held


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its ``k`` best rows of ``docs`` (doc_id, text).

    Terms are runs of digits, ASCII letters (A-Z lowered) and characters above ASCII, of whole texts. Null and empty texts have none: such
    documents are never found, such items have no rows. Equal scores go by doc_id, rows without one last; repeated
    rows of either table count and are ranked one by one, in any order where they are alike. Other columns are ignored. No documents, no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    kind = items.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = 0
    for number, block in enumerate(_blocks(items.select("item_id", "text"))):
        terms = sorted({t for _, own in block for t in own})
        place = {t: i for i, t in enumerate(terms)}
        counted = scratch.keep(f"counted-{number}", texts.mapInArrow(_counted(terms), "doc_id long, n long, terms array<int>, counts array<long>"))
        total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
        if total["docs"]:
            # at most a row a term of the block
            df = dict(map(tuple, counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
            entries = [(place[t], i, term_weight(total["docs"], df.get(place[t], 0))) for i, (_, own) in enumerate(block) for t in own]
            rows, cols, values = (np.array(x, np.int64) for x in zip(*entries, strict=True))
            asked = counted.where(F.size("terms") > 0)
            found = asked.mapInArrow(_ranked(len(terms), len(block), (rows, cols, values), total["docs"], total["length"], k), "item int, doc_id long, score long")
            # first among some tasks each, then among what is left of all
            part = _best(found.withColumn("part", F.spark_partition_id() % 64), k, "item", "part").select("item", "doc_id", "score")
            names = spark.createDataFrame([Row(item=i, item_id=x) for i, (x, _) in enumerate(block)], "item int, item_id " + kind.simpleString())
            ranked = _best(part, k, "item").join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            scratch.keep(f"ranked/block={number}", ranked)
            done += 1
        scratch.drop(f"counted-{number}")
    shape = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    return spark.read.schema(shape).parquet(f"{scratch.root}/ranked").drop("block") if done else spark.createDataFrame([], shape)
