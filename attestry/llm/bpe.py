r"""Byte-level BPE of texts, with long texts encoded in parts and joined by tree concatenation.

Texts above ``piece_chars`` are cut anywhere into pieces, which are encoded as rows of their own, by any
executor. The pieces' ids are then joined in pairs, level by level. At a join, the text around it is encoded
again in a window that grows until it agrees with both sides. Where text has a blank between two characters that are not white
space, a word begins there whatever stands before or after, so a window from such a place to another is exact. In text
without such places the window grows until its first ids and its last ids are those of the two sides.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shuffle_partitions, prepare
from .word_tokens import BYTE_CHARS

# Fixed value: how a byte-level pre-tokenizer with its own pattern cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of a piece of a long text.
PIECE_CHARS = 1 << 14
#: Ids that must agree at either end of a window in text without blanks.
AGREED = 8

_BREAK = regex.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """A byte-level BPE tokenizers file; ids as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str):
        rule = json.loads(Tokenizer.from_file(path).to_str())
        pre, model = rule.get("pre_tokenizer") or {}, rule["model"]
        plain = rule.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in rule["added_tokens"]):
            raise ValueError("only plain byte-level BPE files are supported")
        back = {c: b for b, c in BYTE_CHARS.items()}
        special = {x["content"]: x["id"] for x in rule["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        order = [ranks[bytes(back[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if any(a >= b for a, b in zip(order, order[1:], strict=False)):
            raise ValueError("ids must follow the order of merges")
        self.special = special
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max(*ranks.values(), *special.values(), 0) + 1, np.int64)
        self.bytes_of: list[bytes] = [b""] * len(self.lengths)
        for t, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.lengths[i], self.bytes_of[i] = len(t), t

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        return np.array(self.coder.encode(text, allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def joined(self, left: np.ndarray, a: str, right: np.ndarray, b: str) -> np.ndarray:
        """The ids of ``a + b``, given those of both."""
        if not a or not b:
            return right if not a else left
        span = 32
        while span < max(len(a), len(b)):
            out = self._by_blanks(left, a, right, b, span)
            if out is None:
                out = self._by_agreement(left, a, right, b, span)
            if out is not None:
                return out
            span *= 4
        return self.encode(a + b)

    def _at(self, ids: np.ndarray, offset: int) -> int | None:
        """How many of ``ids`` make the first ``offset`` bytes; None if no id ends there."""
        ends = np.cumsum(self.lengths[ids])
        k = int(np.searchsorted(ends, offset))
        if offset == 0:
            return 0
        return k + 1 if k < len(ends) and ends[k] == offset else None

    def _by_blanks(self, left, a, right, b, span):
        tail, head = a[-8 * span :], b[: 8 * span]
        before = [m.start() for m in _BREAK.finditer(tail)]
        before = [x for x in before if len(tail) - x >= span] or ([0] if len(tail) == len(a) else [])
        after = next((m.start() for m in _BREAK.finditer(head) if m.start() >= span), len(head) if len(head) == len(b) else None)
        if not before or after is None:
            return None
        start = before[-1]
        i = self._at(left, len(a.encode()) - len(tail[start:].encode()))
        j = self._at(right, len(head[:after].encode()))
        if i is None or j is None:
            return None
        return np.concatenate((left[:i], self.encode(tail[start:] + head[:after]), right[j:]))

    def _by_agreement(self, left, a, right, b, span):
        i, j = max(0, len(left) - span), min(len(right), span)
        x = b"".join(map(self.bytes_of.__getitem__, left[i:].tolist()))
        y = b"".join(map(self.bytes_of.__getitem__, right[:j].tolist()))
        # ids may end within a character: move both ends outwards to whole characters
        while i > 0 and x and x[0] & 0xC0 == 0x80:
            i -= 1
            x = self.bytes_of[left[i]] + x
        while j < len(right) and self.bytes_of[right[j]][0] & 0xC0 == 0x80:
            y += self.bytes_of[right[j]]
            j += 1
        w = self.encode((x + y).decode())
        p, q = (AGREED if i else 0), (AGREED if j < len(right) else 0)
        if len(w) < p + q or len(left) - i < p or j < q:
            return None
        if not np.array_equal(w[:p], left[i : i + p]) or (q and not np.array_equal(w[-q:], right[j - q : j])):
            return None
        return np.concatenate((left[:i], w, right[j:]))

    def tree(self, nodes: list[tuple[np.ndarray, str]]) -> np.ndarray:
        """Joins neighbours in pairs until one is left."""
        while len(nodes) > 1:
            pairs = [(self.joined(*nodes[k], *nodes[k + 1]), nodes[k][1] + nodes[k + 1][1]) for k in range(0, len(nodes) - 1, 2)]
            nodes = pairs + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][0] if nodes else np.zeros(0, np.uint32)


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _encoded(path: str):
    """Appends ``ids`` to rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ids = [bpe.encode(t.as_py() or "").astype("<u4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    return run


def _together(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe, copies = byte_bpe(path), int((pdf["piece"] == 0).sum())
        pdf = pdf.drop_duplicates("piece").sort_values("piece")
        ids = bpe.tree([(np.frombuffer(i, "<u4"), t) for i, t in zip(pdf["ids"], pdf["text"], strict=True)])
        one = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].astype("Int64"), "ids": [ids.astype("<u4").tobytes()]})
        return pd.concat([one] * copies)

    return run


def encode(docs: DataFrame, tokenizer: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text): token ids as little-endian unsigned 32-bit integers.

    The ids are those that the tokenizers library gives for the whole text without special tokens added. A null
    or empty text has none. Repeated rows come back as often as they are there (equal rows of a long text are encoded once
    each in pieces and joined once); a null doc_id stays null; an empty table gives no row. Columns
    besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.length(F.coalesce("text", F.lit(""))) > piece_chars
    short = docs.where(~long).mapInArrow(_encoded(tokenizer), "doc_id long, text string, ids binary").select("doc_id", "ids")
    n = F.ceil(F.length("text") / piece_chars).cast("int")
    cut = docs.where(long).select("doc_id", F.xxhash64("text").alias("print"), F.length("text").alias("size"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("text"), k * piece_chars + 1, F.lit(piece_chars)))).alias("piece", "text"))
    pieces = cut.repartition(shuffle_partitions(spark)).mapInArrow(_encoded(tokenizer), "doc_id long, print long, size int, piece int, text string, ids binary")
    whole = pieces.groupBy("doc_id", "print", "size").applyInPandas(_together(tokenizer), "doc_id long, ids binary")
    return short.unionByName(whole)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [None if i is None else bpe.decode(np.frombuffer(i, "<u4")) for i in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded): special tokens are written out, bytes that are no text become U+FFFD. Null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(tokenizer), "doc_id long, ids binary, decoded string")
