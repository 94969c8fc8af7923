"""SHA-256 of files of any size, each read by many tasks.

SHA-256 goes through a file in order, but what it carries from one byte to the next is 112 bytes. So Spark's text reader cuts the large files
into splits, whose bytes are written as a table by rounds of ``ROUND`` bytes of each file; then round by round the next bytes of
every file are added to its state, which is handed on. No task reads more than its split, or a round of the files it was dealt.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.lineage import shared_dir

#: Files up to this size are hashed whole where they are read.
WHOLE = 1 << 27
#: Bytes of a file that one task adds to its digest.
ROUND = 1 << 27
#: A reader goes at most about this far beyond its split for a separator; a file with a longer run without one is tried with the next.
RUN = 1 << 24
SEPARATORS = ("\n", '"', " ", "\0")
#: Spark's text reader would unpack these by their names.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|lzo|lzo_deflate|snappy|xz|z|zst|zstd|passthrough)$"
#: Rows of megabytes: Parquet looks at its size after each, not after the first hundred, which a task would hold.
_SMALL_GROUPS = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 24), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_BOM = b"\xef\xbb\xbf"
#: OpenSSL's SHA256_CTX: eight words of state, count of bits (low, high), the bytes of the block begun, their number, the digest's length.
_CTX = struct.Struct("=8I2I64s2I")


def _openssl() -> ctypes.CDLL | None:
    """The library that ``hashlib`` is linked to, where there is one."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t)
        return lib
    except (ImportError, AttributeError, OSError):
        return None


_LIB = _openssl()


def _roots() -> tuple[list[int], list[int]]:
    """The constants of SHA-256: 32 bits of the fractions of square roots (8) and cube roots (64) of the first primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
    cubes = []
    for p in primes:
        r = round(p ** (1 / 3) * 2**32)
        while r**3 > p << 96:
            r -= 1
        while (r + 1) ** 3 <= p << 96:
            r += 1
        cubes.append(r & 0xFFFFFFFF)
    return [isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]], cubes


_START, _CUBES = _roots()


def _compress(h: list[int], blocks: np.ndarray) -> list[int]:
    """The state after ``blocks`` (rows of 64 bytes), in Python: 0.4 MB a second, for where OpenSSL's functions are not to be had."""
    w = np.zeros((len(blocks), 64), np.uint32)
    w[:, :16] = blocks.view(">u4")

    def turned(x: np.ndarray, *by: int) -> np.ndarray:
        return np.bitwise_xor.reduce([x >> np.uint32(n) | x << np.uint32(32 - n) for n in by])

    for i in range(16, 64):
        a, b = w[:, i - 15], w[:, i - 2]
        w[:, i] = w[:, i - 16] + w[:, i - 7] + (turned(a, 7, 18) ^ a >> np.uint32(3)) + (turned(b, 17, 19) ^ b >> np.uint32(10))
    w += np.array(_CUBES, np.uint32)
    full = 0xFFFFFFFF
    for row in w:
        a, b, c, d, e, f, g, k = h
        for x in row.tolist():
            ee, aa = e << 32 | e, a << 32 | a
            t = k + ((ee >> 6 ^ ee >> 11 ^ ee >> 25) & full) + (e & f ^ ~e & g) + x
            k, g, f, e = g, f, e, d + t & full
            d, c, b, a = c, b, a, t + ((aa >> 2 ^ aa >> 13 ^ aa >> 22) & full) + (a & b ^ a & c ^ b & c) & full
        h = [x + y & full for x, y in zip(h, (a, b, c, d, e, f, g, k), strict=True)]
    return h


class Sha256:
    """SHA-256 with a state of 112 bytes that another task can go on with."""

    def __init__(self, state: bytes | None = None):
        self._ctx = ctypes.create_string_buffer(state or _CTX.pack(*_START, 0, 0, b"", 0, 32), _CTX.size)

    @property
    def state(self) -> bytes:
        return self._ctx.raw

    @property
    def length(self) -> int:
        """Bytes so far."""
        low, high = struct.unpack_from("=2I", self._ctx, 32)
        return (high << 32 | low) >> 3

    def update(self, data: pa.Buffer) -> Sha256:
        if _LIB:
            _LIB.SHA256_Update(self._ctx, data.address, data.size)
            return self
        *h, _, _, begun, n, size = _CTX.unpack(self._ctx.raw)
        bits = (self.length + data.size) << 3
        raw = np.frombuffer(begun[:n] + data.to_pybytes(), np.uint8)
        cut = len(raw) & -64
        for at in range(0, cut, 1 << 20):
            h = _compress(h, raw[at : min(cut, at + (1 << 20))].reshape(-1, 64))
        self._ctx.raw = _CTX.pack(*h, bits & 0xFFFFFFFF, bits >> 32, raw[cut:].tobytes(), len(raw) - cut, size)
        return self

    def hexdigest(self) -> str:
        *_, n, _ = _CTX.unpack(self._ctx.raw)
        end = b"\x80" + b"\0" * ((55 - n) % 64) + struct.pack(">Q", self.length << 3)
        return struct.pack(">8I", *_CTX.unpack(Sha256(self.state).update(pa.py_buffer(end)).state)[:8]).hex()


def _joined(numbers: dict[str, int]):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a split in a batch as one row, with its place among the task's rows."""
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch["file"].dictionary_encode(), np.asarray(batch["block"])
            code = np.asarray(file.indices)
            begin = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])])
            number = np.array([numbers[f] for f in file.dictionary.to_pylist()], np.int32)[code[begin]]
            data = batch["data"].cast(pa.large_binary())
            at = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)[np.r_[begin, len(data)]]
            pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((at - at[0]).astype(np.int32)), data.buffers()[2].slice(at[0])])
            seq = np.arange(n, n + len(begin))
            n += len(begin)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (number, block[begin], seq, np.diff(at))), pieces], names=["number", "block", "seq", "n", "data"])

    return joined


def _cut(spark: SparkSession, folder: str, separator: str, numbers: dict[str, int]) -> DataFrame:
    """(number, block, seq, n, data, round): the bytes of the numbered files in order of ``block`` (the split's begin) and ``seq``, written as a table."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).option("mapreduce.input.linerecordreader.line.maxlength", RUN).text(folder)
    data = F.concat(F.col("value").cast("binary"), F.lit(separator.encode()))
    lines = text.where(F.col("_metadata.file_path").isin(list(numbers))).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), data.alias("data"))
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    cut = lines.mapInArrow(_joined(numbers), "number int, block long, seq long, n long, data binary").withColumn("round", F.expr(f"block div {ROUND}"))
    cut.write.options(**_SMALL_GROUPS).partitionBy("round").parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a file after the bytes that follow it; ``size`` cuts off the separator that the last row got though the file does not end in one."""
    at = sha = None
    for batch in batches:
        for number, size, data in zip(batch["number"], batch["size"], batch["data"], strict=True):
            piece = data.as_buffer()
            if size.is_valid:
                if sha:
                    yield _told(*at, sha)
                at, sha = (number.as_py(), size.as_py()), Sha256(piece.to_pybytes())
            else:
                sha.update(piece.slice(0, min(piece.size, at[1] - sha.length)))
    if sha:
        yield _told(*at, sha)


def _told(number: int, size: int, sha: Sha256) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([size]), pa.array([sha.state])], names=["number", "size", "state"])


def long_file_digests(spark: SparkSession, folder: str, sizes: dict[str, int]) -> dict[str, str]:
    """Digests of files below ``folder``, without those that no separator cuts; ``sizes``: bytes by ``_metadata.file_path``, of files above ``WHOLE`` only.

    Names, sizes and states of these files are on the driver, some 300 bytes for at least ``WHOLE`` bytes of input.
    """
    files = sorted(sizes)
    left, out = {f: i for i, f in enumerate(files)}, {}
    for separator in SEPARATORS:
        if not left:
            break
        cut = _cut(spark, folder, separator, left)
        # the last row may have a separator too many, and the reader drops a mark of UTF-8 at the begin; where a run was too long, far more is missing
        over = {files[r.number]: r.n - sizes[files[r.number]] for r in cut.groupBy("number").agg(F.sum("n").alias("n")).collect()}
        states = [(left.pop(f), sizes[f], Sha256().update(pa.py_buffer(_BOM if x < 0 else b"")).state) for f, x in over.items() if x in (0, 1, -3, -2)]
        rows = cut.where(F.col("number").isin([i for i, _, _ in states])).withColumn("size", F.lit(None).cast("long"))
        for n in range(max((size for _, size, _ in states), default=-1) // ROUND + 1):
            begun = spark.createDataFrame(states, "number int, size long, data binary").withColumns({"block": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long")})
            dealt = begun.unionByName(rows.where(F.col("round") == n).select(begun.columns)).repartitionById(len(files), "number").sortWithinPartitions("number", "block", "seq")
            states = [tuple(r) for r in dealt.mapInArrow(_advanced, "number int, size long, state binary").collect()]
        for i, size, state in states:
            sha = Sha256(bytes(state))
            if sha.length != size:
                raise ValueError(f"{files[i]} changed while it was read")
            out[files[i]] = sha.hexdigest()
    return out
