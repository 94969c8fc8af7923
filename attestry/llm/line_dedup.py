"""Line deduplication with two Bloom filters.

Each partition fills two filters of its lines' keys: seen once, and seen twice. Filters merge by OR, and
what two once-filters share goes to the twice-filter, so a key in two documents always has all its bits there. Only
keys found in the merged twice-filter (suspects) are shuffled, as (128-bit digest, doc_id); their documents
are counted exactly and the document that keeps the line is chosen. The most frequent of these keys, a bounded number, are
broadcast, so that no task gathers all documents of one line. Texts are joined with their lists
of lines to drop; a list is no longer than its document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, id_bit, id_words, shuffle_partitions

SPACE = " \t\n\x0b\x0c\r"
#: Bits of a filter's segment (8 KB), the unit that is shuffled and merged.
SEGMENT_BITS = 16
#: Most bits of a filter: 64 MB to broadcast at any input size. A fuller filter only lets more suspects through.
MOST_BITS = 29
#: Most keys that are broadcast instead of shuffled (2 MB). A key counts as frequent from its share of all suspects on, so there can't be more.
MOST_FREQUENT = 1 << 16
#: Least documents of a frequent key.
LEAST_FREQUENT = 1024


def line_key(line: str) -> bytes:
    return line.strip(SPACE).encode("utf-8", "surrogatepass").lower()


def _keys(text: str | None, least: int) -> set[bytes]:
    """The distinct keys of a text's lines with at least ``least`` code points."""
    if not text:
        return set()
    return {s.encode("utf-8", "surrogatepass").lower() for s in (x.strip(SPACE) for x in text.split("\n") if len(x) >= least) if len(s) >= least}


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each 64-bit hash."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _seen(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (table[p >> 6] & _BIT[p & 63]) != 0


def filter_bits(docs: DataFrame) -> int:
    """About eight bits for each expected line, from the size of the input's files, within fixed bounds."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(20, (size // 12).bit_length()))


def _filled(bits: int, least: int):
    """The once- and twice-filters of a partition, by segment."""

    words = 1 << SEGMENT_BITS - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # packed: 64 MB each at most
        once, twice, some = np.zeros(1 << bits - 6, np.uint64), np.zeros(1 << bits - 6, np.uint64), False

        def put(table: np.ndarray, p: np.ndarray) -> None:
            np.bitwise_or.at(table, p >> 6, _BIT[p & 63])

        def add(h: np.ndarray) -> None:
            # hashes of one document are distinct; within a batch of documents, repeats count as a second sight
            u, n = np.unique(h, return_counts=True)
            p, q = _positions(u, bits)
            old = (_seen(once, p) & _seen(once, q)) | (n > 1)
            for at in (p, q):
                put(twice, at[old])
            for at in (p, q):
                put(once, at)

        for batch in batches:
            held: list[int] = []
            for text in batch.column(batch.schema.get_field_index("text")):
                held += map(xxhash.xxh3_64_intdigest, _keys(text.as_py(), least))
            if held:
                some = True
                add(np.array(held, np.uint64))
        if not some:
            return
        o, t = once.reshape(-1, words), twice.reshape(-1, words)
        full = np.flatnonzero(o.any(1))
        for i in range(0, len(full), 256):
            at = full[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([o[k].tobytes() for k in at], pa.binary()), pa.array([t[k].tobytes() for k in at], pa.binary())], names=["segment", "once", "twice"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the filters of each segment; rows come sorted by segment, and one segment is in hand at a time."""
    at, once, twice = None, None, None
    for batch in batches:
        done = []
        for seg, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            if seg == at:
                twice = twice | t | (once & o)
                once = once | o
                continue
            if at is not None and twice.any():
                done.append((at, twice.tobytes()))
            at, once, twice = seg, o, t
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], names=["segment", "twice"])
    if at is not None and twice.any():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])


def repeated_filter(docs: DataFrame, least: int, bits: int) -> bytes:
    """The merged twice-filter, packed; at most 2**MOST_BITS bits."""
    parts = docs.select("text").mapInArrow(_filled(bits, least), "segment int, once binary, twice binary")
    merged = parts.repartition(shuffle_partitions(docs.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, twice binary")
    out, size = bytearray(1 << (bits - 3)), 1 << (SEGMENT_BITS - 3)
    for row in merged.toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = row["twice"]
    return bytes(out)


def _suspects(bits: int, least: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint64)
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _keys(text.as_py(), least)
                keys += own
                ids += [doc_id] * len(own)
            if not keys:
                continue
            p, q = _positions(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
            at = np.flatnonzero(_seen(table, p) & _seen(table, q)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(keys[i]) for i in at], pa.binary()), pa.array([ids[i] for i in at], pa.int64())], names=["key", "doc_id"])

    return run


def _cleaned(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, drop = batch.schema.get_field_index("text"), batch.schema.get_field_index("drop")
            n_lines, n_dropped, kept = [], [], []
            for t, d in zip(batch.column(text), batch.column(drop), strict=True):
                t = t.as_py() or ""
                gone = set(d.as_py() or ())
                if not gone:
                    n_lines.append(t.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(t)
                    continue
                lines = t.split("\n")
                stay = [x for x in lines if len(x) < least or len(x.strip(SPACE)) < least or xxhash.xxh3_128_digest(line_key(x)) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            cols = [c for i, c in enumerate(batch.columns) if i not in (text, drop)]
            names = [x for i, x in enumerate(batch.schema.names) if i not in (text, drop)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, bits: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each row's text without the lines that repeat across documents.

    A line's key is the line stripped of space and 0x09-0x0D, with A-Z lower-cased. A key of at least
    ``least_chars`` code points found in at least ``least_docs`` different doc_ids loses all its lines except
    in the largest doc_id that holds it. A null or empty text is one empty line. Rows with a
    null doc_id are left as they are and are not counted. Repeated rows come back as often as they are
    there; rows with one doc_id count as one document. An empty table gives no row. Columns besides
    doc_id and text are not read, but those named in ``carry`` come back with their row, as a struct ``carried``.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    own = ["carried"] * bool(carry)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.struct(*carry).alias(c) for c in own))
    known_ids = docs.where("doc_id is not null")
    bits = max(SEGMENT_BITS, bits or filter_bits(docs))
    known = docs.sparkSession.sparkContext.broadcast(repeated_filter(known_ids, least_chars, bits))
    suspects = scratch.keep("suspects", known_ids.select("doc_id", "text").mapInArrow(_suspects(bits, least_chars, known), "key binary, doc_id long").distinct())
    doomed = suspects.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)
    doomed = scratch.keep("doomed", doomed)
    # at most MOST_FREQUENT keys can have so large a share of the suspects
    share = max(LEAST_FREQUENT, suspects.count() // MOST_FREQUENT + 1)
    frequent = F.broadcast(doomed.where(F.col("docs") >= share).select("key", "keeper"))
    rare = suspects.join(frequent.select("key"), "key", "left_anti").join(doomed.where(F.col("docs") < share).select("key", "keeper").hint("merge"), "key")
    drops = suspects.join(frequent, "key").unionByName(rare).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("key").alias("drop"))
    drops = scratch.keep("drops", drops)
    scratch.drop("suspects", "doomed")
    # texts that lose no line are not shuffled: a map of bounded size tells which may
    words = scratch.keep("words", id_words(drops))
    marked = docs.withColumn("bit", id_bit(F.col("doc_id"))).withColumn("word", F.shiftright("bit", 5)).join(F.broadcast(words), "word", "left")
    hit = F.coalesce(F.col("doc_id").isNotNull() & (F.expr("shiftright(mask, cast(bit % 32 as int))") % 2 == 1), F.lit(False))
    marked = marked.select("doc_id", "text", *own, hit.alias("hit"))
    rest = marked.where("not hit").select("doc_id", "text", *own, F.lit(None).cast("array<binary>").alias("drop"))
    some = marked.where("hit").drop("hit").join(drops.hint("merge"), "doc_id", "left")
    kind = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in own)])
    kind = kind.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return rest.mapInArrow(_cleaned(least_chars), kind).unionByName(some.mapInArrow(_cleaned(least_chars), kind))
