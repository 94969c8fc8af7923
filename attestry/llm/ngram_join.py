"""N-gram Jaccard self-join with signature trees.

Documents with equal shingle sets form one class, known by a 64-bit print of the set and its size.
Every pair of classes above the threshold shares one of the first ``n - ceil(t*n) + 1`` shingles of each
set in any order common to all sets (prefix filter). The order puts shingles that many documents hold last,
so that the classes meeting at a shingle are few, or else nearly the same text.

The classes that meet at one shingle (a *run*) are joined by a signature tree: leaves hold a
class's token bitmap and size, inner nodes the OR of their children's bitmaps and the range of sizes. A dual
traversal drops each pair of nodes whose largest possible overlap stays below the least overlap needed
by their sizes, and each pair whose leaves are all linked already. Of the surviving pairs of a run only a spanning forest is verified
first; a second round verifies every surviving pair that still lies in different components, so no component is lost while
a group of thousands of near copies needs no more pairs than it has members, as long as it holds together.

No task holds a whole large run. In the first round a run is dealt to blocks that share a few classes (so that their
forests hang together); what blocks miss of each other is left to the rounds after. There the classes of a run's largest component need not
meet each other: only blocks of the others meet all blocks. Here classes bring a finer map of their set, which drops nearly every pair below
the threshold within the task, so that what leaves it does not grow with the square of a group of near copies. Large runs have one more round
before the last, which links components by a forest of the pairs that are left (sets too long for a finer map try a few pairs each); the
last round gives every pair that still lies in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAP_BITS as MAP_OF_IDS
from .common import Scratch, id_bit, id_words, shuffle_partitions
from .components import connected_components
from .hashing import SHINGLE, mix, shingle_sets, steps

#: Bits of the map of frequent shingles: a fixed size; when it fills up, only the order of shingles gets coarser.
MAP_BITS = 26
#: A shingle held by at least so many documents goes last in the order.
FREQUENT = 24
#: Widest leaf bitmap in bits.
WIDEST = 1 << 14
#: Classes of a block of a run, and how many of them are in all blocks of the first round.
BLOCK, SHARED = 1024, 32
#: Pairs that a class of a large run without a finer map tries before the last round.
TRIES = 4
#: Bits of the finer map, as a power of two, and largest set that has one.
FINE_BITS, FINE = 16, 4096
#: Bytes of input for each bucket of shingles, and most buckets (as a power of two).
BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 20
_U = np.uint64


def _buckets(docs: DataFrame) -> int:
    """A power of two that grows with the input's size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(MOST_BUCKETS, max(6, (size // BUCKET_BYTES).bit_length()))


def _prefix(n: int, num: int) -> int:
    """How many shingles of a set of ``n`` are enough: n - ceil(num/100 * n) + 1."""
    return n - -(-num * n // 100) + 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    col = batch.column(batch.schema.get_field_index("text"))
    for row, part in steps(col):
        yield row, shingle_sets(part)


def _counted(bits: int, most: int = 1 << 22):
    """Blobs of shortened shingle hashes by bucket, for counting the documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            cuts = np.searchsorted(h, np.arange(1 << bits, dtype=_U) << _U(64 - bits))
            low = ((h >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype("<u4")
            ends = np.append(cuts[1:], len(h))
            some = np.flatnonzero(ends > cuts)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cuts[some], ends[some], strict=True)], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, sets in _texts(batch):
                held += sets
                n += sum(map(len, sets))
                if n >= most:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _frequent(bits: int, least: int):
    """A bucket's part of the map: a bit for each shortened hash counted at least ``least`` times."""
    own = MAP_BITS - bits

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(np.concatenate([np.frombuffer(b, "<u4") for b in pdf["blob"]]))
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        often = h[at][np.diff(np.append(at, len(h))) >= least]
        part = np.zeros(1 << own, bool)
        part[often >> np.uint32(32 - own)] = True
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "part": [np.packbits(part).tobytes()]})

    return run


def frequent_map(docs: DataFrame, bits: int, least: int = FREQUENT) -> np.ndarray:
    """The map of frequent shingles, one bit for each value of a hash's top ``MAP_BITS`` bits (8 MB at any input size)."""
    blobs = docs.select("text").mapInArrow(_counted(bits), "bucket int, blob binary")
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = len(out) >> bits
    for row in blobs.groupBy("bucket").applyInPandas(_frequent(bits, least), "bucket int, part binary").toLocalIterator():
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["part"], np.uint8)
    return out


def _print(s: np.ndarray) -> int:
    """A 64-bit print of a sorted set, as a signed long."""
    if not len(s):
        return 0
    return int(mix(np.bitwise_xor.reduce(mix(s + _U(0x5851F42D4C957F2D)), keepdims=True) + mix(s.sum(dtype=_U, keepdims=True)) + _U(1) * np.array([len(s)], _U))[0].astype(np.int64))


def _width(n: int) -> int:
    return min(WIDEST, max(256, 1 << (4 * n - 1).bit_length()))


def _bitmap(s: np.ndarray) -> bytes:
    """Token bitmap: a bit for the top bits of each hash, so that halves of a wider map fold by OR of neighbours."""
    w = _width(len(s))
    m = np.zeros(w, bool)
    m[(s >> _U(64 - (w.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(m).tobytes()


def _fine(s: np.ndarray) -> bytes | None:
    """The places of a set in its finer map, two bytes each."""
    return np.unique(s >> _U(64 - FINE_BITS)).astype("<u2").tobytes() if len(s) <= FINE else None


def _fine_maps(places: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Finer maps as words of 64 bits, and which sets have one."""
    out = np.zeros((len(places), 1 << (FINE_BITS - 3)), np.uint8)
    for row, at in zip(out, places, strict=True):
        if at is not None:
            m = np.zeros(1 << FINE_BITS, bool)
            m[np.frombuffer(at, "<u2")] = True
            row[:] = np.packbits(m)
    return out.view(_U), np.array([at is not None for at in places])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for row, sets in _texts(batch):
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_print(s) for s in sets], pa.int64()),
                    pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "fp", "bits"],
            )


def _postings(bits: int, num: int, often, most: int = 1 << 21):
    """Blobs of (shortened shingle, class print) by bucket, for the prefix of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(often.value, np.uint8)
        toks, prints, n = [], [], 0

        def flush():
            t, f = np.concatenate(toks), np.concatenate(prints)
            order = np.argsort(t, kind="stable")
            t, f = t[order], f[order]
            cuts = np.searchsorted(t, np.arange(1 << bits, dtype=_U) << _U(64 - bits))
            ends = np.append(cuts[1:], len(t))
            some = np.flatnonzero(ends > cuts)
            low = ((t >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([low[a:b].tobytes() + f[a:b].tobytes() for a, b in zip(cuts[some], ends[some], strict=True)], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, sets in _texts(batch):
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets])
                every = np.concatenate(sets)
                top = (every >> _U(64 - MAP_BITS)).astype(np.int64)
                late = (known[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1
                a = 0
                for s, m in zip(sets, sizes, strict=True):
                    if m:
                        p, flag = _prefix(int(m), num), late[a : a + m]
                        first = s[flag == 0][:p]
                        if len(first) < p:
                            first = np.concatenate((first, s[flag == 1][: p - len(first)]))
                        toks.append(first)
                        prints.append(np.full(len(first), _print(s), "<i8"))
                        n += len(first)
                    a += m
                if n >= most:
                    yield flush()
                    toks, prints, n = [], [], 0
        if n:
            yield flush()

    return run


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes that meet at each shingle of a bucket; equal lists of classes once."""
    toks, prints = [], []
    for b in pdf["blob"]:
        n = len(b) // 12
        toks.append(np.frombuffer(b, "<u4", n))
        prints.append(np.frombuffer(b, "<i8", n, 4 * n))
    t, f = np.concatenate(toks), np.concatenate(prints)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (f[1:] != f[:-1])))
    t, f = t[new], f[new]
    at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    end = np.append(at[1:], len(t))
    seen: dict[int, np.ndarray] = {}
    for a, b in zip(at[end - at > 1], end[end - at > 1], strict=True):
        seen.setdefault(hash(f[a:b].tobytes()), f[a:b])
    keys = [_print(np.frombuffer(v.tobytes(), _U)) for v in seen.values()]
    sizes = [len(v) for v in seen.values()]
    return pd.DataFrame({"run": pd.Series(keys, dtype="int64"), "size": pd.Series(sizes, dtype="int64"), "members": pd.Series(list(seen.values()), dtype="object")})


class SignatureTree:
    """A tree over classes in order of size; each node has the OR of its leaves' bitmaps and their range of sizes.

    ``extra`` is how many tokens of a set share a bit with another one of the same set: for two
    sets the tokens in common are at most the bits in common plus the lesser ``extra``.
    """

    FAN = 8

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        n, m = sizes[self.order], maps[self.order]
        self.levels = [(m, n, n, np.maximum(n - np.bitwise_count(m).sum(1), 0))]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, extra = self.levels[-1]
            at = np.arange(0, len(lo), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at, 0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at)))

    def keeps(self, level: int, a: np.ndarray, b: np.ndarray, num: int) -> np.ndarray:
        """Which pairs of nodes may hold a pair of sets above the threshold."""
        m, lo, hi, extra = self.levels[level]
        return self._may(m, lo, hi, extra, a, b, num)

    def close(self, a: np.ndarray, b: np.ndarray, num: int, maps: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The same for leaves by other maps; some pairs at a time, as these are wide."""
        _, lo, hi, _ = self.levels[0]
        parts = [slice(i, i + 256) for i in range(0, len(a), 256)]
        return np.concatenate([np.zeros(0, bool), *(self._may(maps, lo, hi, extra, a[p], b[p], num) for p in parts)])

    @staticmethod
    def _may(m: np.ndarray, lo: np.ndarray, hi: np.ndarray, extra: np.ndarray, a: np.ndarray, b: np.ndarray, num: int) -> np.ndarray:
        most = np.bitwise_count(m[a] & m[b]).sum(1) + np.minimum(extra[a], extra[b])
        most = np.minimum(most, np.minimum(hi[a], hi[b]))
        need = -(-num * (lo[a] + lo[b]) // (100 + num))
        return (most >= need) & (100 * hi[a] >= num * lo[b]) & (100 * hi[b] >= num * lo[a])


class _Labels:
    """Components of leaves, up to date after each link: the smaller one takes the other's label."""

    def __init__(self, of: np.ndarray):
        self.of, self.members = of, [[] for _ in of]
        for k, label in enumerate(of.tolist()):
            self.members[label].append(k)

    def link(self, x: int, y: int) -> bool:
        a, b = int(self.of[x]), int(self.of[y])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def tree_pairs(sizes: np.ndarray, maps: np.ndarray, num: int, group: np.ndarray | None = None, tries: int | None = None, fine: list[bytes | None] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (by position) that a dual traversal of the tree with itself can't drop, nor the finer maps where there are any.

    Without ``group``: a spanning forest of them. With it: all whose groups differ, or with ``tries`` a forest of those with finer maps that links
    the groups, and of the others those that give one of their two sets one of its first so many pairs. A node with itself is never dropped, so that
    the traversal is that of all pairs of siblings, from the lowest upwards: by then the leaves of like siblings are mostly one component, and
    the first link between two such nodes drops all their other pairs.
    """
    tree = SignatureTree(sizes, maps)
    count, fan = len(sizes), SignatureTree.FAN
    order, top = tree.order, len(tree.levels) - 1
    labels, tried = _Labels(np.arange(count) if group is None else np.unique(group[order], return_inverse=True)[1]), [0] * count
    maps, known = _fine_maps([fine[k] for k in order]) if fine is not None else (None, np.zeros(count, bool))
    spare = np.maximum(tree.levels[0][1] - np.bitwise_count(maps).sum(1), 0) if fine is not None else None

    def same() -> list[np.ndarray]:
        """For each node, whether its leaves are all one component."""
        low = high = labels.of
        out = [np.ones(count, bool)]
        for _ in range(top):
            at = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(low == high)
        return out

    def cut(level: int, a: np.ndarray, b: np.ndarray, whole: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that aren't linked already."""
        leaf = fan**level
        done = whole[level][a] & whole[level][b] & (labels.of[a * leaf] == labels.of[b * leaf])
        return a[~done], b[~done]

    one, other = np.triu_indices(fan, 1)
    for above in range(1, top + 1):
        whole = same()
        below = len(tree.levels[above - 1][1])
        parents = np.arange(len(tree.levels[above][1]))[:, None] * fan
        a, b = (parents + one).ravel(), (parents + other).ravel()
        ok = b < below
        a, b = a[ok], b[ok]
        stack = [(above - 1, a[i : i + 4096], b[i : i + 4096]) for i in range(0, len(a), 4096)]
        while stack:
            level, a, b = stack.pop()
            a, b = cut(level, a, b, whole)
            if not len(a):
                continue
            keep = tree.keeps(level, a, b, num)
            a, b = a[keep], b[keep]
            if level == 0:
                if fine is not None and len(a):
                    both = known[a] & known[b]
                    both[both] = ~tree.close(a[both], b[both], num, maps, spare)
                    a, b = a[~both], b[~both]
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if group is None or tries is not None and known[x] and known[y]:
                        if not labels.link(x, y):
                            continue
                    elif tries is not None:
                        if tried[x] >= tries and tried[y] >= tries:
                            continue
                        tried[x] += 1
                        tried[y] += 1
                    yield int(order[x]), int(order[y])
                continue
            below = len(tree.levels[level - 1][1])
            kids = np.arange(fan)
            # few node pairs at a time: the pairs in hand stay bounded, and links found early spare later pairs
            for i in range(0, len(a), 64):
                x = (a[i : i + 64, None] * fan + kids)[:, :, None].repeat(fan, 2).ravel()
                y = (b[i : i + 64, None] * fan + kids)[:, None, :].repeat(fan, 1).ravel()
                ok = (x < below) & (y < below)
                # the first link of two whole nodes ends their search: try a few leaves first
                for j in range(0, len(x), 4096 if level > 1 else 512):
                    part = slice(j, j + (4096 if level > 1 else 512))
                    stack.append((level - 1, x[part][ok[part]], y[part][ok[part]]))


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of a run at the narrowest width among them, as words of 64 bits."""
    width = min(len(b) for b in maps)
    rows = []
    for b in maps:
        bits = np.frombuffer(b, np.uint8)
        if len(bits) > width:
            k = len(bits) // width
            bits = np.packbits(np.unpackbits(bits).reshape(-1, k).any(1))
        rows.append(bits)
    return np.stack(rows).view(_U)


def _may_link(sizes: list[int], maps: list[bytes], num: int) -> bool:
    """The bound of the tree for two sets."""
    (a, b), (x, y) = sizes, _folded(maps)
    extra = min(max(0, a - int(np.bitwise_count(x).sum())), max(0, b - int(np.bitwise_count(y).sum())))
    most = min(int(np.bitwise_count(x & y).sum()) + extra, a, b)
    return most >= -(-num * (a + b) // (100 + num)) and 100 * a >= num * b and 100 * b >= num * a


def _run_pairs(sizes: np.ndarray, reps: np.ndarray, maps: list[bytes], group: np.ndarray | None, num: int, tries: int | None, fine: list[bytes | None] | None = None) -> set[tuple[int, int]]:
    """Surviving pairs of a run's classes, by representative."""
    if len(reps) == 2:
        x, y = int(reps[0]), int(reps[1])
        apart = group is None or group[0] != group[1]
        return {(min(x, y), max(x, y))} if apart and _may_link(sizes.tolist(), maps, num) else set()
    pairs = set()
    # sets of very different sizes have bitmaps of different widths: neighbours in width are enough, as sizes differ by a factor below 2
    widths = np.array([len(b) for b in maps])
    for w in np.unique(widths):
        at = np.flatnonzero((widths == w) | (widths == 2 * w))
        if len(at) > 1:
            for i, j in tree_pairs(sizes[at], _folded([maps[k] for k in at]), num, None if group is None else group[at], tries, None if fine is None else [fine[k] for k in at]):
                x, y = int(reps[at[i]]), int(reps[at[j]])
                pairs.add((min(x, y), max(x, y)))
    return pairs


def _meet(num: int, grouped: bool, tries: int | None):
    """Surviving pairs of each block of a run (of two, if ``grouped``), known by ``run``; rows come sorted by it, and one is in hand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[pa.RecordBatch] = []

        def joined(part: pa.Table) -> None:
            runs = part["run"].to_numpy()
            sizes, reps, maps = part["n"].to_numpy(), part["rep"].to_numpy(), part["bits"].to_pylist()
            group = part["component"].to_numpy() if grouped else None
            fine = part["fine"].to_pylist() if "fine" in part.column_names else None
            edges = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    seen.update(_run_pairs(sizes[a:b], reps[a:b], maps[a:b], None if group is None else group[a:b], num, tries, None if fine is None else fine[a:b]))

        def out() -> pa.RecordBatch:
            both = np.array(sorted(seen), np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            runs = batch.column(batch.schema.get_field_index("run")).to_numpy()
            if not len(runs):
                continue
            last = int(np.searchsorted(runs, runs[-1]))  # where the last run of the batch begins
            if last == 0 and held and held[-1].column(held[-1].schema.get_field_index("run"))[-1].as_py() == runs[-1]:
                held.append(batch)
                continue
            joined(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
            held = [batch.slice(last)]
            if len(seen) > 100_000:
                yield out()
        if held:
            joined(pa.Table.from_batches(held).combine_chunks())
        if seen:
            yield out()

    return run


def _need_map(docs: DataFrame) -> np.ndarray:
    """A map with a bit for the hash of each id of ``docs`` (2 MB at any input size)."""
    out = np.zeros(1 << (MAP_OF_IDS - 5), np.uint32)
    for row in id_words(docs).toLocalIterator():
        out[row["word"]] = row["mask"] & 0xFFFFFFFF
    return out


def _sets(need):
    """(doc_id, sorted shingle hashes, places in the finer map) of the documents marked in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(need.value, np.uint32)
        for batch in batches:
            bit = batch.column(batch.schema.get_field_index("bit")).to_numpy()
            at = np.flatnonzero((known[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1)
            if not len(at):
                continue
            texts = batch.column(batch.schema.get_field_index("text")).take(pa.array(at))
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(at))
            for row, part in steps(texts):
                sets = shingle_sets(part)
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_fine(s) for s in sets], pa.binary())], names=["doc_id", "grams", "fine"])

    return run


def _verified(num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(k)) for k in ("a", "b", "x", "y"))
            keep = []
            for i in range(batch.num_rows):
                s, t = np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U)
                both = np.concatenate((s, t))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= num * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, percent: int = 75, spread: int | None = None, block: int = BLOCK, shared: int = SHARED, tries: int = TRIES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (needs doc_id, text).

    Two rows link when the Jaccard similarity of their sets of 5-word shingles is at least ``percent`` %.
    ``component_id`` is the smallest doc_id reachable by links. Null or empty texts, and texts without
    words, have no shingle and link with nothing. Rows with a null doc_id are counted but link with
    nothing. Repeated rows, also of one doc_id, come back as often as they are there. An empty table gives no
    row. Columns besides doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark, "ngram-join")
    bits = min(MAP_BITS - 6, (spread or _buckets(docs)).bit_length() - 1)
    sketch = scratch.keep("sketch", docs.mapInArrow(_sketch, "doc_id long, n long, fp long, bits binary"))
    often = spark.sparkContext.broadcast(frequent_map(docs, bits).tobytes())
    classes = sketch.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    classes = scratch.keep("classes", classes)
    blobs = docs.where("doc_id is not null").select("text").mapInArrow(_postings(bits, percent, often), "bucket int, blob binary")
    runs = blobs.groupBy("bucket").applyInPandas(_runs, "run long, size long, members array<long>").dropDuplicates(["run"])
    members = scratch.keep("runs", runs.select("run", "size", F.explode("members").alias("fp")))
    blocks, large = F.ceil(F.col("size") / block).cast("int"), F.col("size") > block
    met = members.join(classes, "fp")

    def dealt(salt: int, n: Column) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")

    def surviving(rows: DataFrame, grouped: bool, tries: int | None = None) -> DataFrame:
        cols = ["rep", "n", "bits"] + ["component"] * grouped + ["fine"] * ("fine" in rows.columns)
        rows = rows.select(F.xxhash64("run", "part").alias("run"), *cols)
        return rows.repartition(shuffle_partitions(spark), "run").sortWithinPartitions("run").mapInArrow(_meet(percent, grouped, tries), "a long, b long").distinct()

    in_all = large & (dealt(1, F.col("size")) < shared)
    parts = F.when(in_all, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(dealt(0, blocks)))
    first = scratch.keep("first", surviving(met.withColumn("part", F.explode(parts)), False))
    # classes whose sets may be asked for: those of surviving pairs, and those of runs in several blocks, whose other pairs are still open
    ends = first.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(met.where(large).select(F.col("rep").alias("doc_id"))).distinct()
    ends = scratch.keep("ends", ends)
    need = spark.sparkContext.broadcast(_need_map(ends).tobytes())
    wanted = docs.where("doc_id is not null").select("doc_id", "text", id_bit(F.col("doc_id")).alias("bit"))
    sets = wanted.mapInArrow(_sets(need), "doc_id long, grams binary, fine binary")
    sets = scratch.keep("sets", sets.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long")

    links = scratch.keep("links", verified(first))
    found = scratch.keep("found", connected_components(links, scratch, "cc1", "a", "b"))

    def still_apart(comps: DataFrame, which: Column) -> DataFrame:
        """Classes of runs with several components, with the run's largest one (``main``) and the sizes of it and of the rest."""
        rows = met.where(which).join(ends.withColumnRenamed("doc_id", "rep"), "rep", "left_semi")
        rows = rows.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("piece", dealt(3, blocks))
        counts = rows.groupBy("run", "size", "component").agg(F.count("*").alias("n")).groupBy("run", "size")
        plan = counts.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
        # a large run's plan comes in as many pieces as the run, so that no task joins all of it
        plan = plan.withColumn("piece", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("size")
        return rows.join(plan, ["run", "piece"])

    def facing(rows: DataFrame) -> DataFrame:
        """Large runs by pairs of blocks, with finer maps: the main component's classes come after the others' blocks and don't meet each other."""
        rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "fine"), "rep", "left")
        others, mains = F.ceil((F.col("all") - F.col("most")) / block).cast("int"), F.ceil(F.col("most") / block).cast("int")
        is_main = F.col("component") == F.col("main")
        rows = rows.withColumn("own", F.when(is_main, others + dealt(2, mains)).otherwise(dealt(2, others)))
        met_by = F.sequence(F.lit(0), F.when(is_main, others).otherwise(others + mains) - 1)
        return rows.withColumn("part", F.explode(F.transform(met_by, lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi")))))

    small = surviving(still_apart(found, ~large).withColumn("part", F.lit(0)), True)
    second = scratch.keep("second", small.unionByName(surviving(facing(still_apart(found, large)), True, tries)).join(first, ["a", "b"], "left_anti"))
    more = scratch.keep("more", verified(second))
    comps = scratch.keep("comps2", connected_components(links.unionByName(more), scratch, "cc2", "a", "b"))
    if not members.where(large).isEmpty():
        third = surviving(facing(still_apart(comps, large)), True).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
        rest = scratch.keep("rest", verified(third))
        comps = scratch.keep("comps3", connected_components(links.unionByName(more).unionByName(rest), scratch, "cc3", "a", "b"))
        scratch.drop("rest")
    scratch.drop("runs", "ends", "first", "second", "sets", "links", "more", "found")
    of_class = classes.select("fp", "n", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n", "fp").join(of_class, ["fp", "n"], "left")
    # a row without shingles or without id stands alone
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
