"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import mixing_lm as LM
from attestry.llm import ngram_join as NJ
from attestry.llm.bpe import ByteBpe, decode, encode
from attestry.llm.chat import PARTS, format_chats, read_chats
from attestry.llm.common import Scratch
from attestry.llm.components import connected_components
from attestry.llm.hashing import shingle_sets
from attestry.llm.licences import TEMPLATES, bigrams_of, scan_licences
from attestry.llm.line_dedup import dedup_lines
from attestry.llm.near_vectors import near_vectors
from attestry.llm.ngram_join import _bitmap, _folded, ngram_jaccard_join, tree_pairs
from attestry.llm.packing import pack
from attestry.llm.quality import fit as quality_fit
from attestry.llm.quality import fit_on, with_quality
from attestry.llm.queries import op2_top_k_search
from attestry.llm.topk_search import NONE, Best, gather, resolve, top_k_search
from attestry.llm.word_tokens import WordTokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus():
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefgéß文", k=r.randint(1, 7))) for _ in range(300)]

    def text(n):
        return " ".join(r.choices(vocab, k=n))

    out = [(i, text(r.randint(30, 120))) for i in range(60)]
    base = text(200).split()
    for i in range(60, 90):  # near copies, some at the threshold
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = "edit%d" % r.randint(0, 99)
        out.append((i, " ".join(t)))
    out += [(i, "The Same text again and again " * 3) for i in range(90, 96)]
    line = "A line that many of the documents have in common, word for word."
    out += [(i, f"{text(20)}\n  {line.upper() if i % 2 else line}\t\n{text(12)}\n{line}") for i in range(96, 106)]
    out += [(106, None), (107, ""), (108, " \n\t "), (109, "one two"), (110, "One  Two"), (111, text(4000)), (112, "x" * 5000), (113, "\n\n"), (None, text(30)), (None, None)]
    out += [(0, out[0][1]), (111, out[111][1])]  # repeated rows
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 5, 1, 2) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, bits int, component_id int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -5")


def test_words_and_shingles_are_those_of_the_pattern():
    texts = [t for _, t in corpus()] + ["a\x85b\x1cc d", "ÀB àb"]
    for t, s in zip(texts, shingle_sets(pa.array(texts, pa.string())), strict=True):
        w = words(t)
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)] + [(1000, 1001 + i) for i in range(300)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"), "c").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t"), "c").count() == 0


def near_classes(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = defaultdict(set)
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, empty):
    want = near_classes(corpus())
    got = ngram_jaccard_join(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngram_jaccard_join(empty).count() == 0


@pytest.mark.parametrize("shared", [0, 2])
def test_ngram_join_with_small_blocks(spark, docs, shared):
    """Large runs of near copies, with some that only look alike, split into blocks of four classes."""
    r = random.Random(7)
    base = [f"w{k}" for k in range(40)]
    rows = [x for x in corpus() if x[0] is not None]
    for i in range(200, 260):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            t[r.randrange(40)] = f"new{r.randrange(99)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_jaccard_join(df, spread=64, block=4, shared=shared).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == near_classes(rows)


def test_runs_of_look_alikes_give_few_pairs(spark, monkeypatch):
    """Texts share most of their words and no two of them link, though their bitmaps look alike: what a task hands on is not all their pairs."""
    r, rows, taken = random.Random(11), [], set()
    while len(rows) < 60:
        places = sorted(r.sample(range(30), 3))
        pairs = {(places[0], places[1]), (places[0], places[2]), (places[1], places[2])}
        if pairs & taken:
            continue
        taken |= pairs
        t = [f"w{k}" for k in range(150)]
        for k in places:
            t[k * 5 + 2] = f"new{len(rows)}x{k}"
        rows.append((len(rows), " ".join(t)))
    made, meet = spark.sparkContext.accumulator(0), NJ._meet

    def counted(num, grouped, tries):
        own = meet(num, grouped, tries)

        def run(batches):
            for out in own(batches):
                if grouped:
                    made.add(out.num_rows)
                yield out

        return run

    monkeypatch.setattr(NJ, "_meet", counted)
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spread=64, block=16, shared=2).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == near_classes(rows)
    assert made.value < 2 * len(rows)


def test_tree_is_near_linear_in_near_copies():
    r = np.random.default_rng(0)
    base, took = r.integers(0, 2**63, 200).astype(np.uint64), {}
    for n in (2000, 8000, 20_000):
        maps = []
        for _ in range(n):
            s = base.copy()
            s[r.integers(0, 200, 8)] = r.integers(0, 2**63, 8).astype(np.uint64)
            maps.append(_bitmap(np.unique(s)))
        began = time.process_time()
        found = list(tree_pairs(np.full(n, 200), _folded(maps), 75))
        took[n] = time.process_time() - began
        assert len(found) == n - 1
    assert took[20_000] < 30 * took[2000] + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=40), st.booleans())
def test_tree_loses_no_pair(sets, spread):
    sizes = np.array([len(s) for s in sets])
    maps = np.zeros((len(sets), 256), bool)
    for k, s in enumerate(sets):
        maps[k, [(x * 7 if spread else x // 3) % 256 for x in s]] = True
    packed = np.packbits(maps, axis=1).view(np.uint64)
    found = {tuple(sorted(p)) for p in tree_pairs(sizes, packed, 75, np.arange(len(sets)))}
    # finer maps in which tokens may share a place too, and some sets without one
    fine = [np.unique([x // 2 for x in s]).astype("<u2").tobytes() if k % 5 else None for k, s in enumerate(sets)]
    closer = {tuple(sorted(p)) for p in tree_pairs(sizes, packed, 75, np.arange(len(sets)), None, fine)}
    assert closer <= found
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert (j, i) in found and (j, i) in closer


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [int(x) for x in r.integers(-50, 50, 12)], 1) for i in range(400)] + [(i, [int(x) for x in [3] * 12], 1) for i in range(400, 430)]
    rows += [(900, None, 1), (901, [1, None], 1), (902, [5, 5], 1), (None, [1] * 12, 1), (2, rows[2][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, score int").repartition(4)
    kept = {i: (v + [0] * 12)[:12] for i, v, _ in rows if i is not None and v and None not in v}
    for block in (4096, 7):
        got = defaultdict(list)
        for x in sorted(top_k_search(df, F.col("vec_id") % 20 == 0, 10, block).collect(), key=lambda x: x["rank"]):
            got[x["query_id"]].append((x["score"], x["vec_id"]))
        for q in (i for i in kept if i % 20 == 0):
            best = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q)[:10]
            assert got[q] == [(-s, i) for s, i in best]
    few = top_k_search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert top_k_search(df.where("vec_id = -1"), F.lit(True)).count() == 0


def test_thresholds_save_products_and_lose_nothing():
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 64))
    x = np.floor(1024 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(np.repeat(centres, 20, 0) + 0.05 * r.normal(size=(1200, 64)))).astype(np.int64)
    ids, at = np.arange(1200), np.arange(0, 1200, 50)
    first = Best(len(at), 10)
    for i in range(0, 1200, 400):
        gather(ids[i : i + 400], x[i : i + 400], ids[at], x[at], first)
    full = x @ x[at].T
    full[at, np.arange(len(at))] = NONE
    order = np.lexsort((np.broadcast_to(ids[:, None], full.shape), -full), axis=0)[:10]
    cutoff = first.score[-1]
    assert (cutoff <= np.take_along_axis(full, order, 0)[-1]).all()
    row, col, score, made = resolve(ids, x, ids[at], x[at], cutoff)
    assert made < 0.7 * full.size * 64
    assert set(zip(row.tolist(), col.tolist(), score.tolist(), strict=True)) == {(i, j, int(full[i, j])) for i, j in zip(*np.nonzero(full >= cutoff), strict=True)}
    last = Best(len(at), 10)
    last.add_pairs(col, score, ids[row])
    assert (last.id == order).all() and (last.score == np.take_along_axis(full, order, 0)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 60), st.sampled_from([1, 3, 2**20, 2**30, 2**40]))
def test_resolved_pairs_are_those_that_reach_the_cutoff(seed, dim, n, top):
    r = np.random.default_rng(seed)
    x = r.integers(-top, top + 1, (n, dim))
    q, qid = x[:3], np.arange(len(x[:3]))
    exact = [[sum(int(a) * int(b) for a, b in zip(v, w, strict=True)) for w in q] for v in x]
    if max(abs(s) for v in exact for s in v) >= 2**62:
        return
    full = np.array(exact, dtype=np.int64)
    cutoff = np.sort(full, axis=0)[-min(4, n)]
    row, col, score, _ = resolve(np.arange(n), x, qid, q, cutoff)
    assert sorted(zip(row.tolist(), col.tolist(), score.tolist(), strict=True)) == [(i, j, int(full[i, j])) for i in range(n) for j in range(len(q)) if i != j and full[i, j] >= cutoff[j]]


def test_top_k_query_leaves_unsound_vectors_out(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [nan, 1.0]), (1, [inf, 1.0]), (2, [None, 1.0]), (3, None), (4, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [-1.0, 0.0]), (6, [-1.0, 0.0]), (7, [0.25, 0.0]), (7, [0.75, 0.0])]
    spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in op2_top_k_search(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 786432), (0, 2, 7, 786432), (0, 3, 7, 262144), (0, 4, 5, -1048576), (0, 5, 6, -1048576)]


def test_licences(spark, docs, empty):
    wrapped = "Some words before it.\n# Use of this source code is governed by a BSD-style\n# license that can be found\n# in the LICENSE file.\nand after"
    inside = "word " * 40 + "released under the MIT license, " + "word " * 40
    body = TEMPLATES["MIT-text"].upper().replace(". ", ".\n\n * ")
    rows = [(1, "an introduction of some length\nRELEASED under the  MIT License!\nand an end"), (2, TEMPLATES["Apache-2.0-notice"]), (3, "Released by the MIT"), (4, None), (5, ""), (6, "licensed under cc by-nc 4.0\nlicensed under cc by-nc 4.0"),
            (7, "MIT"), (None, "Released under the MIT License."), (8, "word " * 50_000), (9, wrapped), (10, inside), (11, body), (12, "x " * 60_000 + wrapped), (6, "licensed under cc by-nc 4.0\nlicensed under cc by-nc 4.0")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, matches string")
    found = scan_licences(df).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert (got[1]["licences"], got[1]["n_matches"], got[1]["best_dice"]) == ("MIT", 1, 1.0)
    assert [tuple(m) for m in got[1]["matches"]] == [("MIT", 1.0, 5, 5)]
    assert got[2]["best_licence"] == "Apache-2.0-notice" and got[2]["licences"] == "Apache-2.0,Apache-2.0-notice"
    assert got[6]["licences"] == "CC-BY-NC-4.0" and got[6]["matches"][0]["first_word"] == 0
    assert [got[i]["n_matches"] for i in (3, 4, 5, 7, 8)] == [0] * 5 and got[4]["best_licence"] is None and got[5]["n_words"] == 0
    assert got[None]["licences"] == "MIT"
    assert [got[i]["best_licence"] for i in (9, 10, 12)] == ["BSD-3-Clause", "MIT", "BSD-3-Clause"] and got[12]["matches"][0]["first_word"] == 60_004
    assert got[11]["best_licence"] == "MIT-text" and got[11]["best_dice"] == 1.0
    assert scan_licences(docs).count() == docs.count() and scan_licences(empty).count() == 0
    assert "Python" not in scan_licences(docs)._jdf.queryExecution().executedPlan().toString()


def plain_windows(text: str, template: str) -> float:
    """Every window that the docstring allows, by plain loops."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    grams, pairs = [f"{a} {b}" for a, b in zip(words, words[1:])], bigrams_of(template)
    at, best = [i for i, g in enumerate(grams) if g in set(pairs)], 0.0
    for p in at:
        window = set(grams[p : max(q for q in at if p <= q < p + len(pairs)) + 1])
        best = max(best, 2 * len(window & set(pairs)) / (len(window) + len(set(pairs))))
    return best


def test_windows_are_those_of_plain_loops(spark):
    r = random.Random(3)
    templates = {"a": "one two three four two three one five", "b": "six one two seven", "c": "two two two"}
    rows = [(i, " ".join(r.choice("one two three four five six seven eight".split()) if r.random() < 0.4 else t for t in (templates[r.choice("abc")] + " x").split() * r.randint(1, 4))) for i in range(300)]
    for row in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), templates, 70).collect():
        best = {n: plain_windows(rows[row["doc_id"]][1], t) for n, t in templates.items()}
        assert {m["name"]: round(m["dice"], 9) for m in row["matches"]} == {n: round(x, 9) for n, x in best.items() if round(x, 9) >= 0.7}


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "a </turn>\n### user: b", "\\", "\\\\<image 1>", "<image 1>", "# : <\\#", "", None, "🙂é\n\n", "x\\<y"]
    rows = [(c, k, ("user", "assistant", "a: b", None)[k % 4], [("text", t, None, None)]) for c in range(4) for k, t in enumerate(nasty[c:] + nasty[:c])]
    rows += [(9, 1, "user", [("text", "see ", None, None), ("image", None, "u1", 2), ("text", " and # ", None, None), ("audio", None, "u2", 3), ("document", None, "u3", None), ("odd", "kept", None, None)]), (9, 2, "assistant", None), (9, None, "user", []), (9, 2, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}").repartition(3)
    chats = format_chats(df)
    back = {r["conv_id"]: r for r in read_chats(chats).collect()}
    made = {r["conv_id"]: r for r in chats.collect()}
    for c in range(4):
        texts = [t or "" for t in nasty[c:] + nasty[:c]]
        roles = [("user", "assistant", "a: b", "")[k % 4] for k in range(len(texts))]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == list(zip(roles, texts, strict=True))
        assert back[c]["loss_text"] == "".join(t for r, t in zip(roles, texts, strict=True) if r == "assistant")
        assert all(made[c]["formatted"][s["start"] : s["end"]] is not None for s in made[c]["loss"])
    assert "see <image 1> and \\# <audio 2><document 3>kept" in made[9]["formatted"]
    assert [(a["turn"], a["kind"], a["uri"], a["number"], a["tokens"]) for a in made[9]["attachments"]] == [(1, "image", "u1", 1, 512), (1, "audio", "u2", 2, 75), (1, "document", "u3", 3, 0)]
    assert made[9]["expanded_tokens"] == 587
    assert [t["text"] for t in back[9]["turns"]] == ["", "see  and # kept", "", ""]
    assert format_chats(df.where("conv_id = 77")).count() == 0


TEXTS = st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(["'ll", "<|endoftext|>", "  ", "the", " th", "中文", "😀", " \n", "a", " B", "1½"])), max_size=50).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_joined_pieces_are_the_whole(text, n):
    bpe, lib = ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    text = text * 3
    want = np.array(lib.encode(text, add_special_tokens=False).ids, np.uint32)
    assert np.array_equal(bpe.tree([(bpe.encode(text[i : i + n]), text[i : i + n]) for i in range(0, len(text), n)]), want)
    assert bpe.decode(want) == lib.decode(want.tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_give_the_library_ids(text):
    assert WordTokens(WORD).ids(text) == np.array(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encode_and_decode(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    want = sorted(((i if i is not None else -1), np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in corpus())
    got = decode(encode(docs, BYTE, 300), BYTE).collect()
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert encode(empty, BYTE).count() == 0


def test_pack(docs, empty):
    lib = Tokenizer.from_file(WORD)
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in corpus())
    got = pack(docs, WORD, 64, 5, with_ids=True).collect()
    pieces, lengths = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], ids.tolist()))
        lengths[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sum(r["length"] for r in got) == total
    by_doc = Counter()
    for (i, t), ids in want.items():
        by_doc[i] += len(t) * ids
    assert Counter({i: n for i, n in by_doc.items()}) == Counter({i: sum(x[1] for (d, _), v in pieces.items() if d == i for x in v) for i in by_doc})
    for (i, t), n in want.items():
        if n == 1 and i is not None:
            at = sorted(pieces[i, len(t)])
            assert [x for p in at for x in p[2]] == list(t) and [p[0] for p in at] == list(np.cumsum([0, *(p[1] for p in at[:-1])]))
    for v in lengths.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert pack(empty, WORD).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(8)
    good = [" ".join(r.choices(["river", "stone", "walks", "under", "evening", "light"], k=60)) for _ in range(200)]
    bad = ["$$$ BUY!!! " * r.randint(5, 30) + str(r.random()) for _ in range(200)]
    texts, marks = zip(*sorted([(t, True) for t in good] + [(t, False) for t in bad], key=lambda x: hashlib.md5(x[0].encode()).hexdigest()), strict=True)
    model = fit_on(list(texts[:300]), list(marks[:300]))
    p = model.scores(list(texts[300:]))
    assert ((p >= 0.5) == np.array(marks[300:])).mean() > 0.95
    assert 0 <= model.scores(["", None, "x" * 100_000]).min()
    rows = with_quality(docs, model)
    assert rows.columns == [*docs.columns, "quality_score"] and rows.count() == docs.count()
    assert with_quality(empty, model).count() == 0
    for only in ([], [("a b", True)], [("a b", True), ("c d", True), ("e", False)]):
        assert len(fit_on([t for t, _ in only], [m for _, m in only]).scores(["z"])) == 1


def test_scores(spark, docs, empty):
    rows = corpus()
    train = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), "\n"])
    n, v = sum(train.values()), len(train)
    got = LM.score_texts(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got if r["doc_id"] is not None}
    for i, t in rows:
        if i is None:
            continue
        w, r = [*words(t), "\n"], by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["score"] < 0
    assert LM.score_texts(empty).count() == 0
    assert LM.score_texts(docs.where("doc_id is null")).count() == 2


def some_model(bits=14):
    r = np.random.default_rng(0)
    model = LM._start(bits)
    model.counts = np.minimum(r.integers(0, 70_000, (LM.CONTEXTS << bits, 2)) * (r.random((LM.CONTEXTS << bits, 1)) < 0.2), 65_535).astype(np.uint16)
    model.weights = r.normal(0.2, 0.3, model.weights.shape).astype(np.float32)
    model.refine = np.sort(r.random(model.refine.shape), 2)
    return model.settled()


def test_probabilities_of_a_byte_add_up():
    model = some_model()
    for token, lead in ((b"", 7), (b"ab", 7), (b"abcdefgh", 0)):
        every = b"".join(token + bytes([k]) for k in range(256))
        tokens = LM.Tokens(np.frombuffer(every, np.uint8), np.arange(257) * (len(token) + 1), np.full(256, lead))
        opening = len(token) < LM.OPENING
        before = [e for e in tokens.edges(opening)][0]
        last = np.flatnonzero(np.isin(np.arange(len(before.byte)), before.inverse[len(token) - (0 if opening else LM.OPENING) :: len(token) + 1 - (0 if opening else LM.OPENING)]))
        assert len(last) == 256
        assert math.isclose(np.exp(LM.edge_scores(model, before)[last]).sum(), 1, rel_tol=1e-6)


def slow_score(model, token: bytes, lead: int) -> float:
    """A token's score, one bit at a time, in whole numbers of Python."""
    full, m = 2**64 - 1, 0xD6E8FEB86659FD93

    def mixed(x):
        return int(LM.mix(np.array([x & full], np.uint64))[0])

    total = 0.0
    for place, byte in enumerate(token):
        h, ctx = 0, []
        for k in range(1, 7):
            h = (h ^ ((token[place - k] + 1 if place >= k else 0) + (k << 9))) * 0x9E3779B97F4A7C15 & full
            h ^= h >> 29
            ctx.append(h)
        whole = mixed(sum(mixed((j << 8 | token[j]) + 1) for j in range(place)) + 0x5851F42D4C957F2D)
        opening = place < LM.OPENING
        ctx = [*ctx[:5], whole, whole ^ mixed(lead + 0xD1B54A32D192ED03) if opening else ctx[5]]
        for b in range(7, -1, -1):
            salt = 0 if b > 3 else ((byte >> 4) + 1) * 0x9E3779B97F4A7C15 & full
            node = 1 << (3 - b % 4) | (byte >> (b + 1)) & ((1 << (3 - b % 4)) - 1)
            cells = []
            for k, c in enumerate(ctx):
                h = (c + salt) * m & full
                h = (h ^ h >> 32) * m & full
                cells.append(int(model.table[(k << model.bits) + ((h >> 64 - model.bits) & ~15) + node]))
            level = [c & 15 for c in cells]
            gate = (level[LM.WHOLE] * 3 + int(LM._BESIDE_LEVEL[level[LM.LEAD if opening else LM.BESIDE]])) * 2 + opening
            w = model.weights[b, gate].astype(float)
            dot = sum(w[k] * (cells[k] >> 4) / 200 for k in range(LM.CONTEXTS)) + w[LM.CONTEXTS] / 2
            at = min(max(dot * 2, -15.999), 15.999) + 16
            line = model.refine[b, gate]
            q = line[int(at)] * (1 - at % 1) + line[int(at) + 1] * (at % 1)
            p = min(max((1 / (1 + math.exp(-min(max(dot, -14), 14))) + q) / 2, 1e-7), 1 - 1e-7)
            total += math.log(p if byte >> b & 1 else 1 - p)
    return total


def test_scores_agree_with_a_slow_scorer():
    model = some_model()
    tokens = [b"a", b"the", "größe".encode(), b"extraordinary,", b"x" * 70, b"th", b"thesis"]
    written = b"".join(t + b" " for t in tokens)
    start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in tokens])))
    lead = np.array([0, 5, -9, 12345678901, 5, 5, 7])
    flat = np.frombuffer(written, np.uint8)
    got = LM.token_scores(model, LM.Tokens(flat, start, lead), True) + LM.token_scores(model, LM.Tokens(flat, start), False)
    slow = [slow_score(model, t + b" ", int(x) & (2**64 - 1)) for t, x in zip(tokens, lead, strict=True)]
    assert np.allclose(got, slow, rtol=1e-5)
    # the same through texts: openings and the rest meet
    texts = pa.array(["The Größe a thesis", "", None, "a"])
    w = LM.Words(texts)
    total, *_ = LM.text_scores(model, w, LM._LOWER[w.data])
    assert len(total) == 4 and np.isfinite(total).all()


def test_leads():
    w = LM.Words(pa.array(["the river of stone", "", "stone", "a b"]))
    lead, last = LM._leads(w)
    of = {k: int(LM.Words(pa.array([k])).hash.view(np.int64)[0]) for k in ("the", "of", "a", "b")}
    assert lead.tolist() == [0, of["the"], of["the"], of["of"], 0, 0, of["a"]]
    assert last.tolist() == [of["of"], 0, 0, of["b"]]


def test_score_is_above_the_base_on_held_out_text(spark):
    got = LM.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got)


def test_counts_are_whole_numbers_of_64_bits():
    big = 2**33 + 1
    batch = pa.RecordBatch.from_arrays([pa.array([False]), pa.array([1], pa.int64()), pa.array([b"abcd"], pa.binary()), pa.array([big], pa.int64())], names=["opening", "h", "word", "n"])
    parts = [b for b in LM._tables(14, LM.TOGETHER[0])(iter([batch]))]
    top = max(np.frombuffer(x, np.uint32 if len(x) == 4 * LM._SEGMENT else np.int64).max() for b in parts for x in b.column(1).to_pylist())
    assert top >= big
    both = [pa.RecordBatch.from_arrays([pa.array([3, 3], pa.int32()), pa.array([np.full(LM._SEGMENT, v, np.int64).tobytes() for v in (big, 1)], pa.binary())], names=["segment", "counts"])]
    assert (np.frombuffer(next(iter(LM._summed(iter(both)))).column(1)[0].as_py(), np.uint16) == 65_535).all()


def test_last_byte_alone_predicts(spark):
    marks = [chr(k) for k in range(0x61, 0x7B) if chr(k) not in "qux"]
    train = " ".join(f"{a}{b}qu{c}" for a in marks for b in marks for c in marks[:4])
    at = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, train) for i in range(200, 210) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame([*rows, (at[0], "axqu"), (at[1], "axqj")], "doc_id long, text string")
    by = {r["doc_id"]: r["score"] for r in LM.score_texts(docs).collect()}
    # no word has "xq", but after "q" there is always "u"
    assert by[at[0]] > by[at[1]]


def test_history_of_a_text_that_repeats_itself():
    n = 200
    got = LM.adapted(np.full(n, np.log(1e-6)), np.zeros(n, np.int64), np.arange(n) % 2, np.array([-1.0]))
    assert got[0] > -100
    assert np.isfinite(LM.adapted(np.array([-4000.0]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([-1.0]))).all()


def test_near_vectors(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(12):
        c = r.standard_normal(16)
        for _ in range(r.integers(1, 9)):
            rows.append((len(rows), int(g % 3), [float(x) for x in (c + r.standard_normal(16) * 0.05).astype(np.float32)]))
    rows += [(len(rows) + k, 1, rows[0][2] if k % 2 else [float(x) for x in r.standard_normal(16).astype(np.float32)]) for k in range(6)]
    n = len(rows)
    rows += [(n, 1, None), (n + 1, None, rows[0][2]), (n + 2, 1, [0.0] * 16), (n + 3, 1, [float("nan")] * 16), (n + 4, 1, [1.0, None]), (n + 5, 1, []), (n + 6, 1, [2.0, 2.0]), (n + 7, 1, [1.0, 1.0]), (None, 1, rows[0][2])]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, label int, embedding array<float>, n_links int").repartition(3)
    sound = {i: (lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = defaultdict(set)
    for i, (a, x) in sound.items():
        for j, (b, y) in sound.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["vec_id"] is None:
            continue
        reach, todo = {x["vec_id"]}, [x["vec_id"]]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert (x["n_links"], x["component_id"], x["kept"]) == (len(links[x["vec_id"]]), min(reach), min(reach) == x["vec_id"])
    assert near_vectors(df.where("vec_id < 0")).count() == 0


def test_large_bucket_is_split(spark, monkeypatch):
    r = np.random.default_rng(6)
    c = r.standard_normal(8)
    rows = [(i, 0, [float(x) for x in c + r.standard_normal(8) * 0.01]) for i in range(1500)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).agg(F.min("n_links"), F.max("component_id")).first()
    assert tuple(got) == (1499, 0)


@pytest.mark.parametrize("bits", [16, 20])
def test_line_dedup(docs, empty, bits):
    rows = corpus()
    holders = defaultdict(set)

    def key(x):
        return x.strip(SPACE).translate(LOWER)

    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                holders[key(x)].add(i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in dedup_lines(docs, bits=bits).collect()) == want
    assert dedup_lines(empty).count() == 0


def test_fit_reads_its_own_folds_only(spark):
    r = random.Random(3)
    good, bad = (lambda: " ".join(r.choices(["river", "stone", "walks", "under"], k=40))), (lambda: "$$$ BUY!!! " * r.randint(5, 20) + str(r.random()))
    rows, labels = [], []
    for i in range(400):
        held = zlib.crc32(str(i).encode()) % 3 == 1
        rows.append((i, good() if (i % 2 == 0) != held else bad()))  # in the held-out fold all labels are wrong
        labels.append((i, 1 - i % 2))
    rows += [(500, good()), (501, None), (None, bad())]
    labels += [(500, 0), (500, 1), (501, 1), (None, 1), (502, None)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_fit(docs, lab)
    assert (model.scores([good() for _ in range(50)]) > 0.5).all() and (model.scores([bad() for _ in range(50)]) < 0.5).all()
    one_class = quality_fit(docs, lab.where("quality = 1"))
    assert (one_class.scores(["x", "river stone"]) > 0.99).all()
    assert np.allclose(quality_fit(docs, lab.limit(0)).scores(["x", None]), 0.5)


def test_quality_keeps_clashing_columns(spark):
    model = fit_on(["a b"], [True])
    docs = spark.createDataFrame([(1, "x", 9.0, "y")], "doc_id long, text string, quality_score double, _Quality_score string")
    got = with_quality(docs, model)
    assert got.columns == [*docs.columns, "__quality_score"]
    assert got.collect()[0][:4] == (1, "x", 9.0, "y")


def test_frequent_lines_are_broadcast(spark, monkeypatch):
    from attestry.llm import line_dedup as D

    rows = [(i, f"own line of document {i}, which nobody else has\n" + "the line that all of the documents have in common\n" * 2 + f"a line that only some of the documents have: {i % 7}, no more") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, dedup_lines(docs).collect()))
    monkeypatch.setattr(D, "LEAST_FREQUENT", 20)
    assert sorted(map(tuple, dedup_lines(docs).collect())) == plain
    assert sum(r[2] for r in plain) == 59 * 2 + 60 - 7
