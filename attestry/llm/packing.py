"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. What is left of a document after its full windows
goes, as one piece, to the open window with the least free room that takes it (best fit). When
none does, the fullest window is filled up by a cut of the piece and emitted, and the rest opens a window in its place.
At a partition's end the windows still open are left over; leftovers of a few partitions at a time are
merged end to end, cut where a sequence is full, and the last tokens of each merge make sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .word_tokens import word_tokens

#: Partitions whose leftovers one task merges.
MERGED_PARTITIONS = 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """A fixed number of windows of ``room`` tokens; emits (pieces of a full window)."""

    def __init__(self, room: int, most: int):
        self.room, self.most = room, most
        self.free: list[tuple[int, int]] = []  # (free room, key), ascending: best fit by bisection
        self.held: dict[int, list[tuple]] = {}
        self.key = 0

    def add(self, piece: tuple[object, int, int, int]) -> Iterator[list[tuple]]:
        """piece: (document, start, length, doc_tokens) with length at most ``room``."""
        doc, start, length, total = piece
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            left, key = self.free.pop(at)
            self.held[key].append(piece)
            if left == length:
                yield self.held.pop(key)
            else:
                bisect.insort(self.free, (left - length, key))
            return
        if len(self.free) >= self.most:
            left, key = self.free.pop(0)
            self.held[key].append((doc, start, left, total))
            yield self.held.pop(key)
            start, length = start + left, length - left
        self.key += 1
        self.held[self.key] = [(doc, start, length, total)]
        if length == self.room:
            yield self.held.pop(self.key)
        else:
            bisect.insort(self.free, (self.room - length, self.key))

    def rest(self) -> list[list[tuple]]:
        """The open windows, fullest first."""
        return [self.held[k] for _, k in self.free]


class _Rows:
    def __init__(self, with_ids: bool):
        self.with_ids, self.cols = with_ids, [[] for _ in range(9)]

    def add(self, pieces: list[tuple], sequence: int, left_over: bool = False) -> None:
        """pieces: ((doc_id, ids), start, length, doc_tokens)."""
        offset = 0
        for (doc_id, ids), start, length, total in pieces:
            own = ids[4 * start : 4 * (start + length)]
            row = (doc_id, start, length, zlib.crc32(own), total, sequence, offset, own if left_over or self.with_ids else None, left_over)
            for c, v in zip(self.cols, row, strict=True):
                c.append(v)
            offset += length

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.cols, kinds, strict=True)], names=[*(x.split()[0] for x in PIECE.split(", ")), "left_over"])
        self.cols = [[] for _ in range(9)]
        return out


def _packed(path: str, room: int, most: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(path), end_id.to_bytes(4, "little")
        windows, rows = OpenWindows(room, most), _Rows(with_ids)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.ids(text.as_py()) + end
                doc, total = (doc_id, ids), len(ids) // 4
                start = 0
                while total - start >= room:
                    rows.add([(doc, start, room, total)], sequence)
                    sequence, start = sequence + 1, start + room
                if start < total:
                    for full in windows.add((doc, start, total - start, total)):
                        rows.add(full, sequence)
                        sequence += 1
                if len(rows.cols[0]) >= 4096:
                    yield rows.batch()
        for left in windows.rest():
            rows.add(left, sequence, True)
            sequence += 1
        yield rows.batch()

    return run


def _merge(room: int, with_ids: bool):
    """Puts the leftover pieces of some partitions end to end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"])
        left = int(pdf["length"].sum())
        sequence = (1 << 62) + (int(pdf["part"].iloc[0]) << 24)
        size = room if left >= room else 1 << (left.bit_length() - 1)
        out, offset = [], 0
        for doc_id, start, total, ids in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["ids"], strict=True):
            done, length = 0, len(ids) // 4
            while done < length:
                n = min(length - done, size - offset)
                own = ids[4 * done : 4 * (done + n)]
                out.append((doc_id, start + done, n, zlib.crc32(own), total, sequence, offset, own if with_ids else None))
                done, offset, left = done + n, offset + n, left - n
                if offset == size and left:
                    sequence, offset = sequence + 1, 0
                    size = room if left >= room else 1 << (left.bit_length() - 1)
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in PIECE.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, windows: int = 64, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of ``docs`` (doc_id, text).

    A document is the ids of its text by the ``tokenizer`` file (no special tokens added), then ``end_id``; a null or
    empty text is ``end_id`` alone. Each id lies in exactly one piece; a sequence's pieces follow each other from offset 0.
    A sequence has ``room`` tokens, or a power of two. ``ids``: the piece's ids as little-endian unsigned
    32-bit integers, only with ``with_ids``. Repeated rows are packed each; a null doc_id stays null; an empty
    table gives no row. Columns besides doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.keep("pieces", docs.mapInArrow(_packed(tokenizer, room, windows, end_id, with_ids), PIECE + ", left_over boolean"))
    whole = pieces.where("not left_over").drop("left_over")
    rest = pieces.where("left_over").withColumn("part", F.shiftright("sequence_id", 40).cast("long") / MERGED_PARTITIONS).withColumn("part", F.floor("part"))
    return whole.unionByName(rest.groupBy("part").applyInPandas(_merge(room, with_ids), PIECE))
