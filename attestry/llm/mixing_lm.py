"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens, its lower-cased words and one end; a word is written as its bytes and a closing
blank, the end as one line feed, and each byte as eight bits. Every bit is predicted by seven hashed contexts: the last one to five
bytes of the token; the whole token so far; and, for a token's first three bytes, the token so far with the *lead*, the
last word of at most three bytes before it in the text (further on, the last six bytes). Each holds counts of zeros and ones in a table of
bounded size, summed over the whole training corpus. Their logits are combined by weights that a gate chooses by how
much two of the contexts have seen, the part of the token and the bit's place; the weights are learned online over the training
corpus, each token being predicted from counts without itself. An adaptive map refines the probability.
Within a text, predictors that mix in its own words so far are weighed by how well they do there.
All probabilities of a bit add up to one, so those of all texts do.

The training corpus is gathered as two distributed tables that grow with the input: its vocabulary (words and counts), and the
openings of its tokens (lead, first three bytes, count). Whatever depends on a word alone, or on an opening alone, is computed once
for it and remembered by the worker. The vocabulary also gives the base score, the add-one unigram: the most
frequent words (a bounded number) are looked up from memory, all others by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_of, shuffle_partitions
from .hashing import _LOWER, Words, mix, steps

#: Most frequent words whose counts are held in memory for the base score (12 MB); all others are joined.
HEAD_WORDS = 1 << 19
#: Bits of a context table's size at most, for a worker's memory (130 MB where they are counted, 60 MB where weights are learned, 30 MB where texts are scored);
#: fewer for small vocabularies. Beyond 2**17 distinct words a table's places are shared by more and more contexts.
MOST_TABLE_BITS = 21
#: Places in a worker's memory of scores; a word or opening has one place, and the last one there stays.
CACHED = 1 << 21
#: Words that a task counts before it passes them on.
MOST_HELD = 1 << 20
#: Distinct words that one task counts or learns from, at least, since each passes on tables of a fixed size.
TASK_WORDS = 1 << 19
#: How firmly the first weights are held, in tokens.
PRIOR = 2000.0
#: Edges of an online step, and bytes of text or of words handled at once.
BATCH = 1 << 14
TEXT_STEP = 1 << 21
WINDOW = 1 << 19
#: Edges after which the weights are settled enough for the map to learn from them.
SETTLED = 1 << 13
#: Bytes of a token that the lead helps to predict, and the longest word that is a lead.
OPENING = 3
LEAD_BYTES = 3
#: Context lengths in bytes; then the whole token so far, then the lead with it (in the opening) or the last six bytes.
LENGTHS = (1, 2, 3, 4, 5)
WHOLE, LEAD = len(LENGTHS), len(LENGTHS) + 1
CONTEXTS = len(LENGTHS) + 2
INPUTS = CONTEXTS + 1
#: In the gate, beside the whole token: the lead in the opening, then four bytes.
BESIDE = LENGTHS.index(4)
END = b"\n"
CLOSING = 32
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_ALPHA = 0.2
_SEEN = np.array([1, 2, 4, 16, 64, 512])
_LEVEL = np.searchsorted(_SEEN, np.arange(1 << 16), side="right").astype(np.uint8)
_LOG = np.log(np.arange(1 << 16) + _ALPHA).astype(np.float32)
_BESIDE_LEVEL = np.array([0, 1, 1, 1, 2, 2, 2])
#: Gates of one bit place: how much the whole token and the context beside it have seen, and the part of the token.
GATES = 7 * 3 * 2
_SCALE = np.float32(200)
_GRID = 33
_END_HASH = int(mix(np.array([0xE0D], _U))[0].astype(np.int64))
_SEGMENT = 1 << 13


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is)."""
    order = np.argsort(key)
    k = key[order]
    new = np.empty(len(k), bool)
    new[:1] = True
    new[1:] = k[1:] != k[:-1]
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    at = order[new]
    return k[new], at, inverse


class Tokens:
    """Tokens written one after another: ``flat`` bytes, ``start`` of each (and the end), ``lead`` of each or None."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, lead: np.ndarray | None = None):
        self.flat, self.start, self.lead = flat, start, lead
        size = np.diff(start)
        self.row = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(flat)) - start[self.row]
        own = mix((self.place.astype(_U) << _U(8) | flat) + _U(1))
        total = np.cumsum(own)
        base = np.concatenate((np.zeros(1, _U), total))[start[:-1]]
        self.after = total - base[self.row]
        self.before = self.after - own

    @classmethod
    def of_words(cls, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> Tokens:
        """Slices of a buffer, each with its closing blank."""
        size = end - start + 1
        at = np.concatenate(([0], np.cumsum(size)))
        flat = np.full(at[-1], CLOSING, np.uint8)
        inner = np.ones(at[-1], bool)
        inner[at[1:] - 1] = False
        flat[inner] = low[np.arange(at[-1])[inner] + np.repeat(start - at[:-1], size - 1)]
        return cls(flat, at)

    def edges(self, opening: bool) -> Iterator[Edges]:
        """The distinct edges within openings, or beyond them, some bytes of the tokens at a time."""
        for a in range(0, len(self.flat), WINDOW):
            at = np.flatnonzero((self.place[a : a + WINDOW] < OPENING) == opening) + a
            if not len(at):
                continue
            key = self.after[at]
            if opening and self.lead is not None:
                key = key ^ mix(self.lead[self.row[at]].astype(_U) + _STEP)
            _, first, inverse = _distinct(key)
            yield Edges(self, at[first], self.row[at], inverse, opening)

    def byte_before(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th byte before each place within its token, plus one; 0 before the token."""
        return np.where(self.place[at] >= k, self.flat[np.maximum(at - k, 0)].astype(np.int64) + 1, 0)


class Edges:
    """Distinct steps from a token so far to its next byte; ``rows[i]`` is a token that goes along edge ``inverse[i]``."""

    def __init__(self, tokens: Tokens, at: np.ndarray, rows: np.ndarray, inverse: np.ndarray, opening: bool):
        self.rows, self.inverse, self.opening = rows, inverse, opening
        self.byte = tokens.flat[at].astype(np.int64)
        ctx = np.empty((CONTEXTS, len(at)), _U)
        h = np.zeros(len(at), _U)
        for k in range(1, 7):
            h = (h ^ (tokens.byte_before(at, k).astype(_U) + _U(k << 9))) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
            if k in LENGTHS:
                ctx[LENGTHS.index(k)] = h
        whole = mix(tokens.before[at] + _U(0x5851F42D4C957F2D))
        ctx[WHOLE] = whole
        if opening and tokens.lead is not None:
            ctx[LEAD] = whole ^ mix(tokens.lead[tokens.row[at]].astype(_U) + _U(0xD1B54A32D192ED03))
        else:
            ctx[LEAD] = h
        self.ctx = ctx

    def part(self, s: slice) -> Edges:
        out = object.__new__(Edges)
        out.byte, out.ctx, out.opening = self.byte[s], self.ctx[:, s], self.opening
        return out

    def weights(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.inverse, n[self.rows], len(self.byte))

    def bits(self, table_bits: int, which: slice | list[int] = slice(None)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bit, highest first: (its place, its value, its counters' places in the tables of some contexts)."""
        salt = np.zeros(len(self.byte), _U)
        ctx = self.ctx[which]
        table = (np.arange(CONTEXTS)[which] << table_bits)[:, None]
        for half in (1, 0):
            h = (ctx + salt) * _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            # the counters of four bits lie side by side
            base = ((h >> _U(64 - table_bits)).astype(np.int64) & ~15) + table
            node = np.ones(len(self.byte), np.int64)
            for b in range(3, -1, -1):
                place = 4 * half + b
                bit = (self.byte >> place) & 1
                yield place, bit, base + node
                node = 2 * node + bit
            salt = (self.byte >> 4).astype(_U) * _STEP + _STEP


def _leads(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The lead of each word and of each text's end: the hash of the last word of at most LEAD_BYTES before it in its text, or 0."""
    n = len(w.doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(w.n, np.int64)
    last = np.maximum.accumulate(np.where(w.end - w.start <= LEAD_BYTES, np.arange(n), -1))
    first = np.searchsorted(w.doc, np.arange(w.n + 1))
    hashes = w.hash.view(np.int64)

    def lead(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.where(at >= first[doc], hashes[np.maximum(at, 0)], 0)

    docs = np.arange(w.n)
    return lead(np.concatenate(([-1], last[:-1])), w.doc), np.where(first[1:] > first[:-1], lead(last[first[1:] - 1], docs), 0)


def _openings(w: Words, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead, first bytes as a number) of every token: the words, then each text's end."""
    lead, last = _leads(w)
    size = w.end - w.start
    own = np.zeros(len(size), np.int64)
    for k in range(OPENING):
        byte = np.where(size == k, CLOSING, 0)
        if len(low):
            byte = np.where(size > k, low[np.minimum(w.start + k, len(low) - 1)], byte)
        own = own << 8 | byte
    return np.concatenate((lead, last)), np.concatenate((own, np.full(w.n, END[0] << 8 * (OPENING - 1))))


def _written(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Openings as bytes one after another, and where each starts."""
    every = np.stack([heads >> 8 * k & 255 for k in range(OPENING - 1, -1, -1)], 1).astype(np.uint8)
    closed = every == CLOSING
    size = np.where(every[:, 0] == END[0], 1, np.where(closed.any(1), closed.argmax(1) + 1, OPENING))
    return every[np.arange(OPENING) < size[:, None]], np.concatenate(([0], np.cumsum(size)))


def _opening_key(lead: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return (mix(lead.astype(_U) + _STEP) ^ mix(heads.astype(_U))).view(np.int64)


def _binary(flat: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class _Held:
    """Keys with bytes and counts, added up; passed on when there are many."""

    def __init__(self, opening: bool):
        self.opening, self.held, self.size = opening, [], 0

    def add(self, key: np.ndarray, lead: np.ndarray, written: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, lead, written, n))
        self.size += len(key)
        if self.size > MOST_HELD:
            self._merge()
            if self.size > MOST_HELD // 2:
                yield from self.rest()

    def _merge(self) -> None:
        key, lead, n = (np.concatenate([x[k] for x in self.held]) for k in (0, 1, 3))
        u, at, inverse = _distinct(key)
        self.held = [(u, lead[at], pa.concat_arrays([x[2] for x in self.held]).take(pa.array(at)), np.bincount(inverse, n).astype(np.int64))]
        self.size = len(u)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            _, lead, written, n = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), self.opening)), pa.array(lead), written, pa.array(n)], names=["opening", "h", "word", "n"])
        self.held, self.size = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (h: their hash) and openings (h: their lead) with counts."""
    words, openings = _Held(False), _Held(True)
    for batch in batches:
        for _, texts in steps(batch.column(0), TEXT_STEP):
            w = Words(texts)
            low = _LOWER[w.data]
            lead, heads = _openings(w, low)
            key, at, inverse = _distinct(_opening_key(lead, heads))
            yield from openings.add(key, lead[at], _binary(*_written(heads[at])), np.bincount(inverse))
            if len(w.hash):
                h, at, inverse = _distinct(w.hash.view(np.int64))
                start, end = w.start[at], w.end[at]
                bounds = np.concatenate(([0], np.cumsum(end - start)))
                flat = low[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)]
                yield from words.add(h, h, _binary(flat, bounds), np.bincount(inverse))
            yield from words.add(np.array([_END_HASH]), np.array([_END_HASH]), pa.array([END], pa.binary()), np.array([w.n]))
    yield from words.rest()
    yield from openings.rest()


@dataclass
class Model:
    """What a worker needs; every part has a bounded size. ``counts`` while learning, ``table`` for scoring."""

    bits: int
    weights: np.ndarray  # bit place x gate x input
    refine: np.ndarray  # bit place x gate x grid
    counts: np.ndarray | None = None  # (context, place) x bit, uint16
    table: np.ndarray | None = None  # (context, place): logit, and how much was seen in the low four bits
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def settled(self) -> Model:
        """The same model without counts, for scoring."""
        out = np.empty(len(self.counts), np.int16)
        for a in range(0, len(out), 1 << 20):
            zeros, ones = self.counts[a : a + (1 << 20)].T
            level = _LEVEL[np.minimum(zeros.astype(np.int64) + ones, (1 << 16) - 1)]
            out[a : a + (1 << 20)] = np.rint(np.clip(_LOG[ones] - _LOG[zeros], -9, 9) * _SCALE).astype(np.int16) << 4 | level
        return replace(self, counts=None, table=out)


def _gate(whole: np.ndarray, beside: np.ndarray, opening: bool) -> np.ndarray:
    return (whole.astype(np.int64) * 3 + _BESIDE_LEVEL[beside]) * 2 + opening


def _refined(model: Model, place: int, gate: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """The probability of a one: half the mixed one, half the map's."""
    p = 1 / (1 + np.exp(-np.clip(dot, -14, 14)))
    at = np.clip(dot * 2, -15.999, 15.999) + 16
    i = at.astype(np.int64)
    f = at - i
    line = model.refine[place].ravel()
    i += gate * _GRID
    q = line[i] * (1 - f) + line[i + 1] * f
    return np.clip((p + q) / 2, 1e-7, 1 - 1e-7)


def edge_scores(model: Model, edges: Edges) -> np.ndarray:
    """Natural log probability of each edge's byte."""
    out = np.empty(len(edges.byte))
    for a in range(0, len(out), BATCH):
        e = edges.part(slice(a, a + BATCH))
        total = np.ones(len(e.byte))
        for place, bit, at in e.bits(model.bits):
            cell = model.table[at]
            gate = _gate(cell[WHOLE] & 15, cell[LEAD if e.opening else BESIDE] & 15, e.opening)
            x = (cell >> 4).astype(np.float32)
            w = model.weights[place][gate]
            dot = np.einsum("ij,ji->i", w[:, :CONTEXTS], x).astype(float) / _SCALE + w[:, CONTEXTS] * 0.5
            p = _refined(model, place, gate, dot)
            total *= np.where(bit == 1, p, 1 - p)
        out[a : a + BATCH] = np.log(total)
    return out


def token_scores(model: Model, tokens: Tokens, opening: bool) -> np.ndarray:
    """Natural log probability of each token's bytes within its opening, or beyond it."""
    out = np.zeros(len(tokens.start) - 1)
    for e in tokens.edges(opening):
        out += np.bincount(e.rows, edge_scores(model, e)[e.inverse], len(out))
    return out


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16, most: int = 1 << 20) -> Iterator[tuple[bool, Tokens, np.ndarray]]:
    """Tokens and counts of words (written with their closing) and of openings, many at a time."""

    def tokens(held: list[pa.RecordBatch], opening: bool) -> tuple[bool, Tokens, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        word = pa.concat_arrays([c.cast(pa.binary()) for c in t["word"].chunks])
        off = np.frombuffer(word.buffers()[1], np.int32, len(word) + 1, word.offset * 4).astype(np.int64)
        raw = np.frombuffer(word.buffers()[2], np.uint8)
        n = t["n"].to_numpy().astype(float)
        if opening:
            return True, Tokens(raw[off[0] : off[-1]], off - off[0], t["h"].to_numpy()), n
        # the end has nothing beyond its opening
        real = np.flatnonzero(t["h"].to_numpy() != _END_HASH)
        return False, Tokens.of_words(raw, off[:-1][real], off[1:][real]), n[real]

    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    for batch in batches:
        flags = batch.column(batch.schema.get_field_index("opening"))
        for kind, keep in ((True, flags), (False, pc.invert(flags))):
            part = batch.filter(keep)
            if part.num_rows:
                held[kind].append(part)
                if sum(b.num_rows for b in held[kind]) >= rows or sum(b.nbytes for b in held[kind]) >= most:
                    yield tokens(held[kind], kind)
                    held[kind] = []
    for kind in (True, False):
        if held[kind]:
            yield tokens(held[kind], kind)


#: Contexts whose tables one pass fills, for the sake of memory.
TOGETHER = ((0, 1, 2, 3), (4, WHOLE, LEAD))


def _tables(bits: int, own: tuple[int, ...]):
    """Counts of some contexts over some words and openings, in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(own) << bits + 1, np.int64)
        for opening, tokens, n in _gathered(batches):
            # an opening's bytes without their lead are counted with the words
            for part in ((True,) if opening else (True, False)):
                which = [k for k in own if (k == LEAD) == opening or not (opening or part)]
                if not which:
                    continue
                shift = np.array([own.index(k) - k for k in which])[:, None] << bits
                for edges in tokens.edges(part):
                    m = np.rint(edges.weights(n)).astype(np.int64)
                    for a in range(0, len(m), BATCH):
                        mass = m[a : a + BATCH]
                        for _, bit, at in edges.part(slice(a, a + BATCH)).bits(bits, which):
                            for row in (at + shift) * 2 + bit:
                                np.add.at(counts, row, mass)
        flat = counts.reshape(-1, _SEGMENT)
        first = (own[0] << bits + 1) // _SEGMENT  # the contexts of a pass follow each other
        # most segments fit whole numbers of 32 bits
        full = np.flatnonzero(flat.any(1))
        for i in range(0, len(full), 64):
            at = full[i : i + 64]
            blobs = [(flat[k] if flat[k].max() >> 32 else flat[k].astype(np.uint32)).tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array((at + first).astype(np.int32)), pa.array(blobs, pa.binary())], names=["segment", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the segments in whole numbers of 64 bits; rows come sorted by segment. Large counts are scaled down to 16 bits."""
    at, total = None, None

    def out():
        pairs = total.reshape(-1, 2)
        most = pairs.max(1)
        big = most > 65535
        pairs[big] = pairs[big] * 65535 // most[big, None]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pairs.astype(np.uint16).tobytes()], pa.binary())], names=["segment", "counts"])

    for batch in batches:
        for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seg != at:
                if at is not None:
                    yield out()
                at, total = seg, np.zeros(_SEGMENT, np.int64)
            total += np.frombuffer(blob, np.uint32 if len(blob) == 4 * _SEGMENT else np.int64)
    if at is not None:
        yield out()


def _learned(shared):
    """One online pass over some words and openings: weights by gate, and the sums for the refining map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counters = model.counts.view(np.uint32).ravel()
        w, bend = model.weights.astype(float), np.tile(PRIOR * np.eye(INPUTS), (8, GATES, 1, 1))
        hits, seen = np.zeros((8, GATES * _GRID)), np.zeros((8, GATES * _GRID))
        total = total_edges = 0
        for opening, tokens, n in _gathered(batches):
            total += len(n)
            for edges in tokens.edges(opening):
                weights, a = edges.weights(n), 0
                seen_by = [WHOLE, LEAD if opening else BESIDE]
                while a < len(weights):
                    b = a + min(BATCH, 256 + total_edges // 16)  # small steps at first
                    e, mass = edges.part(slice(a, b)), weights[a:b]
                    a, total_edges = b, total_edges + len(mass)
                    for place, bit, at in e.bits(model.bits):
                        pair = counters[at].astype(np.int64)
                        z, o = pair & 65535, pair >> 16
                        z, o = np.maximum(z - (bit == 0), 0), np.maximum(o - (bit == 1), 0)
                        level = _LEVEL[np.minimum(z[seen_by] + o[seen_by], (1 << 16) - 1)]
                        gate = _gate(level[0], level[1], opening)
                        # edges in order of their gates: one product of matrices for each
                        order = np.argsort(gate.astype(np.int8), kind="stable")
                        gate, bit, own = gate[order], bit[order], mass[order]
                        x = np.concatenate((np.clip(_LOG[o] - _LOG[z], -9, 9), np.full((1, len(bit)), 0.5, np.float32)))[:, order]
                        dot = np.einsum("ij,ji->i", w[place][gate], x)
                        p = 1 / (1 + np.exp(-np.clip(dot, -14, 14)))
                        # an online Newton step: the curvature seen so far scales each step
                        err, curve = (p - bit) * own, p * (1 - p) * own
                        cuts = np.flatnonzero(np.concatenate(([True], gate[1:] != gate[:-1], [True])))
                        there = gate[cuts[:-1]]
                        slope = np.empty((len(there), INPUTS))
                        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                            part = x[:, i:j].astype(float)
                            slope[k] = part @ err[i:j]
                            bend[place, there[k]] += (part * curve[i:j]) @ part.T
                        w[place, there] -= np.clip(np.linalg.solve(bend[place, there], slope[:, :, None])[:, :, 0], -0.5, 0.5)
                        if total_edges > SETTLED:  # the map learns from settled weights
                            cell = gate * _GRID + np.clip(np.rint(dot * 2), -16, 16).astype(np.int64) + 16
                            hits[place] += np.bincount(cell, bit * own, GATES * _GRID)
                            seen[place] += np.bincount(cell, own, GATES * _GRID)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([np.concatenate((w.ravel(), hits.ravel(), seen.ravel())).tobytes()], pa.binary())], names=["words", "sums"])

    return run


def _start(bits: int) -> Model:
    # trust in the whole token, and in an opening first in the lead, by how much they have seen
    trust = np.repeat([0.0, 0.2, 0.3, 0.45, 0.6, 0.85, 0.97], 6)
    first = np.tile([0.0, 0.0, 0.0, 0.4, 0.0, 0.85], 7)
    weights = np.zeros((8, GATES, INPUTS), np.float32)
    weights[:, :, :CONTEXTS] = ((1 - first) * (1 - trust))[:, None] * np.array([0.05, 0.1, 0.15, 0.2, 0.2, 0.0, 0.3])
    weights[:, :, WHOLE] = (1 - first) * trust
    weights[:, 1::2, LEAD] = first[1::2]
    flat = 1 / (1 + np.exp(-(np.arange(_GRID) - 16) / 2.0))
    return Model(bits, weights, np.tile(flat, (8, GATES, 1)))


def train(counted: DataFrame, distinct: int, scratch: Scratch) -> Model:
    """The model from a distributed table (opening, h, word, n)."""
    spark = counted.sparkSession
    model = _start(min(MOST_TABLE_BITS, max(14, distinct.bit_length() + 4)))
    # every task sums into tables of a fixed size, so their number follows the number of distinct words
    tasks = max(2, distinct // TASK_WORDS)
    dealt = counted.repartition(tasks)
    parts = reduce(DataFrame.unionByName, (dealt.mapInArrow(_tables(model.bits, own), "segment int, counts binary") for own in TOGETHER))
    sums = parts.repartition(shuffle_partitions(spark), "segment").sortWithinPartitions("segment").mapInArrow(_summed, "segment int, counts binary")
    counts = np.zeros((CONTEXTS << (model.bits + 1)) // _SEGMENT * _SEGMENT, np.uint16).reshape(-1, _SEGMENT)
    for row in sums.toLocalIterator():
        counts[row["segment"]] = np.frombuffer(row["counts"], np.uint16)
    model = replace(model, counts=counts.reshape(-1, 2))
    shared = spark.sparkContext.broadcast(model)
    # words in no order; each task's sums have a fixed size and come to the driver one after another
    mixed = counted.repartition(tasks)
    learned = scratch.keep("learned", mixed.mapInArrow(_learned(shared), "words long, sums binary"))
    split = 8 * GATES * INPUTS
    mass, total = 0, np.zeros(split + 16 * GATES * _GRID)
    for row in learned.toLocalIterator():
        one = np.frombuffer(row["sums"], float).copy()
        one[:split] *= row["words"]
        total += one
        mass += row["words"]
    if mass:
        hits, seen = total[split:].reshape(2, 8, GATES, _GRID)
        model = replace(model, weights=(total[:split] / mass).reshape(8, GATES, INPUTS).astype(np.float32), refine=(hits + PRIOR * model.refine) / (seen + PRIOR))
    scratch.drop("learned")
    shared.destroy()
    return model.settled()


def frequent_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), by hash, of all words at least as frequent as a bound that lets HEAD_WORDS in at most."""
    held, bound = 0, 1
    for row in words.groupBy(F.least(F.col("n"), F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if held + row["words"] > HEAD_WORDS:
            bound = row["n"] + 1
            break
        held += row["words"]
    head = words.where(F.col("n") >= bound).select("h", "n").toArrow()
    h, n = head["h"].to_numpy().astype(np.int64), head["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


#: How much of a text's own history each adaptive predictor mixes in: (share of the words so far, share of what followed the word before).
HISTORIES = [(0.0, 0.0), (0.05, 0.0), (0.15, 0.0), (0.35, 0.0), (0.1, 0.3), (0.1, 0.75)]


def _earlier(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many earlier places hold the same pair of numbers; and the pairs by number."""
    n = len(a)
    wide = int(b.max(initial=0)) + 1
    if n * wide * (int(a.max(initial=0)) + 1) < 1 << 62:
        # sorted with their places in the low digits
        both = np.sort((a * wide + b) * n + np.arange(n))
        key, order = np.divmod(both, max(1, n))
    else:
        order = np.lexsort((b, a))
        key = np.cumsum(np.concatenate(([0], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.flatnonzero(new)
    earlier, number = np.empty(n, np.int64), np.empty(n, np.int64)
    earlier[order] = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    number[order] = np.cumsum(new) - 1
    return earlier, number


def adapted(static: np.ndarray, doc: np.ndarray, word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Natural log probability of each text, from the model's log probabilities of its tokens and of its end.

    Predictors that mix in the text's own history so far are weighed by how well they have done in this text (a Bayesian mixture).
    """
    n = len(end)
    total = np.zeros((len(HISTORIES), n))
    again, some = np.zeros(n, bool), np.zeros(n, bool)
    if len(doc):
        first = np.searchsorted(doc, np.arange(n + 1))
        some = first[1:] > first[:-1]
        place = np.arange(len(doc)) - first[doc]
        seen, own = _earlier(doc, word)
        follows, _ = _earlier(np.where(place > 0, np.concatenate((own[:1], own[:-1])), len(own) + doc), own)
        past = np.concatenate(([0], seen[:-1])) * (place > 0)
        once, twice = seen / np.maximum(place, 1), follows / np.maximum(past, 1)
        # the end was never seen before; what followed the last word may have been
        again[some] = seen[first[1:][some] - 1] > 0
        p = np.exp(np.maximum(static, -700.0))
        start, known = place > 0, past > 0
    for k, (a, b) in enumerate(HISTORIES):
        if len(doc):
            rest = 1 - a * start - b * known
            here = np.where(static > -700, np.log(rest * p + a * once + b * twice), np.log(rest) + static)
            total[k] = np.bincount(doc, here, n)
        total[k] += end + np.log(1 - np.where(some, a, 0.0) - np.where(again, b, 0.0))
    top = total.max(0)
    return top + np.log(np.exp(total - top).mean(0))


class _Remembered:
    """A worker's memory of scores by key: one place each, and what came last stays. It outlives a task, not its model."""

    current: tuple[str, dict] = ("", {})

    @classmethod
    def of(cls, model: Model, kind: str) -> _Remembered:
        if cls.current[0] != model.uid:
            cls.current = (model.uid, {})
        return cls.current[1].setdefault(kind, cls())

    def __init__(self):
        self.keys, self.scores = np.zeros(CACHED, np.int64), np.zeros(CACHED)

    def get(self, key: np.ndarray, scored) -> np.ndarray:
        """Scores of distinct keys; ``scored`` gives those at some places."""
        place = key & (CACHED - 1)
        out = self.scores[place]
        new = np.flatnonzero(self.keys[place] != key)
        if len(new):
            out[new] = scored(new)
            self.keys[place[new]], self.scores[place[new]] = key[new], out[new]
        return out


def text_scores(model: Model, w: Words, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(natural log probability of each text; distinct word hashes, a place of each, and the number of each word among them)."""
    lead, heads = _openings(w, low)
    key, at, inverse = _distinct(_opening_key(lead, heads))
    first = _Remembered.of(model, "openings").get(key, lambda new: token_scores(model, Tokens(*_written(heads[at[new]]), lead[at[new]]), True))[inverse]
    u, place, word = _distinct(w.hash.view(np.int64))
    rest = _Remembered.of(model, "words").get(u, lambda new: token_scores(model, Tokens.of_words(low, w.start[place[new]], w.end[place[new]]), False)) if len(u) else np.zeros(0)
    n = len(w.doc)
    return adapted(rest[word] + first[:n], w.doc, word, first[n:]), u, place, word


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, counts = shared.value
        logs = np.log10(counts + 1.0)
        end_at = np.searchsorted(hashes, _END_HASH)
        end_known = bool(end_at < len(hashes) and hashes[end_at] == _END_HASH)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, texts in steps(batch.column(1), TEXT_STEP):
                w = Words(texts)
                lm, u, _, word = text_scores(model, w, _LOWER[w.data])
                n = np.bincount(w.doc, minlength=w.n)
                known, base = np.zeros(w.n, np.int64), np.zeros(w.n)
                if end_known:
                    known += 1
                    base += logs[end_at]
                tail_doc, tail_hash = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(u):
                    place = np.minimum(np.searchsorted(hashes, u), max(0, len(hashes) - 1))
                    there = hashes[place] == u if len(hashes) else np.zeros(len(u), bool)
                    if len(hashes):
                        known += np.bincount(w.doc, there[word], w.n).astype(np.int64)
                        base += np.bincount(w.doc, np.where(there, logs[place], 0)[word], w.n)
                    rest = ~there[word]
                    tail_doc, tail_hash = w.doc[rest], u[word[rest]]
                offsets = np.concatenate(([0], np.cumsum(np.bincount(tail_doc, minlength=w.n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(w.n), pa.int64()),
                        batch.column(0).slice(row, w.n),
                        pa.array(n + 1, pa.int64()),
                        pa.array(np.diff(w.bounds), pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(lm / np.log(10), pa.float64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(tail_hash, pa.int64())),
                    ],
                    names=["rid", "doc_id", "n_tokens", "n_bytes", "known", "base", "score", "tail"],
                )
                rid += w.n

    return run


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row of ``docs``.

    Rows whose crc32 of the id's text modulo ``folds`` is not ``held_out`` teach the model (rows with a null id
    don't, and count as not held out). Scores are log10 probabilities of whole texts; a null text is an empty one, which is
    its end alone. ``bits_per_byte`` is the model's total over the text's bytes, its end counted as one. Repeated rows teach and come back as often as
    they are there. With nothing to learn from, counts are 0 and the model is its uniform start. An empty table gives no row.
    Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing-lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = docs.where(fold_of(F.col("doc_id"), folds) != held_out)
    counted = learn.select("text").mapInArrow(_count, "opening boolean, h long, word binary, n long").groupBy("opening", "h", "word").agg(F.sum("n").alias("n"))
    counted = scratch.keep("counted", counted)
    words = counted.where("not opening")
    size = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    v, n = size["v"], size["n"] or 0
    shared = spark.sparkContext.broadcast((train(counted, v, scratch), *frequent_words(words)))
    fields = "rid long, doc_id long, n_tokens long, n_bytes long, known long, base double, score double, tail array<bigint>"
    scored = scratch.keep("scored", docs.mapInArrow(_scored(shared), fields))
    tail = scored.select("rid", F.explode("tail").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("times"))
    rest = tail.join(words.select("h", "n"), "h").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("extra"))
    out = scored.drop("tail").join(rest, "rid", "left")
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("extra", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
