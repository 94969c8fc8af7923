"""Ordered work over groups of any size equals a plain fold: numbering, admission, packing, and splits by JSON size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import spans as S
from attestry.operators.budgets import admit_under_budget
from attestry.operators.ordered import numbered

MESSAGES = "conv_id long, turn long, message_id string, role string, text string"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_numbered(spark):
    r = random.Random(1)
    rows = [(r.choice("aab") if i % 9 else None, r.randint(0, 30), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, o int, i int").repartition(5), ["g"], ["o"], "t").collect()
    by = {}
    for x in got:
        by.setdefault(x.g, []).append((x.pos, x.o))
    assert sum(map(len, by.values())) == 500
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        assert [o for _, o in places] == sorted(o for _, o in places)


def admitted(rows, caps):
    left, out = dict(caps), {}
    for i, s, a in sorted(rows):
        ok = s in left and a is not None and 0 <= a <= left[s]
        if ok:
            left[s] -= a
        out[i] = ok
    return out


@pytest.mark.parametrize(("n", "folded"), [(1, 4), (300, 3), (3000, 16), (60_000, 4096)])
def test_admission_is_the_fold(spark, n, folded):
    """One scope has four of six requests; sizes are mixed, zero, missing or too large; one scope has no cap."""
    r = random.Random(n)
    rows = [(i, r.choice("hhhhab"), r.choice([0, 1, 2, 5, r.randint(1, 900), r.randint(1, 5000), None, -3])) for i in range(n)]
    caps = [("h", r.randint(1000, n * 300 + 1000)), ("a", 50_000)]
    asks = spark.createDataFrame([(i, "o", s, a) for i, s, a in rows], "request_id long, owner string, scope string, allowance long").repartition(7)
    budgets = spark.createDataFrame([("o", s, c) for s, c in caps], "owner string, scope string, cap long")
    got = admit_under_budget(asks, budgets, folded).collect()
    assert len(got) == n
    assert {x.request_id: x.admitted for x in got} == admitted(rows, caps)
    assert admit_under_budget(asks.where("false"), budgets).count() == 0


def packed(rows, most, budget):
    out, now = {}, None
    for c, t, size in sorted(rows):
        if c != now:
            now, seg, n, used = c, 0, 0, 0
        if n and (n + 1 > most or used + size > budget):
            seg, n, used = seg + 1, 0, 0
        n, used = n + 1, used + size
        out[c, t] = seg
    return out


@pytest.mark.parametrize(("sizes", "block", "most", "budget"), [((1, 1, 2, 9, 5, 700, 4000), 7, 5, 1500), ((3, 900), 8, 8, 400), ((1, 100_000), 4096, 100, 20_000)])
def test_packing_is_the_fold(spark, sizes, block, most, budget):
    """Conversations of one message to many blocks (and blocks of blocks)."""
    r = random.Random(4)
    rows = [(c, t * 2, f"m{t}", "u", "x" * r.choice([0, 1, 5, 50, 300, 900, 2000])) for c, n in enumerate(sizes) for t in range(n)]
    got = S.pack_segments(spark.createDataFrame(rows, MESSAGES).repartition(6), most, budget, block).collect()
    assert len(got) == len(rows)
    lengths = [(c, t, len(json.dumps({"message_id": m, "role": u, "text": x}, separators=(",", ":"))) + 5) for c, t, m, u, x in rows]
    assert {(x.conv_id, x.turn): x.segment_index for x in got} == packed(lengths, most, budget)


def by_json(text, budget, back_off=""):
    out, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and len(json.dumps(text[at : end + 1], ensure_ascii=False)) <= budget:
            end += 1
        if back_off and end < len(text):
            cut = text.rfind(back_off, at + (end - at) * 3 // 5, end)
            end = cut + 1 if cut >= 0 else end
        out.append((at, end))
        at = end
    return out


def by_blanks(text, size):
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and text[end].isspace():
            back = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = back + 1 if back >= at + size // 2 else end
        out.append((at, end))
        at = end
    return out


def test_splits_are_the_loops(spark):
    """Quotes, controls, signs beyond 16 bits, and white space of all kinds; no plan has a Python worker."""
    r = random.Random(2)
    signs = 'ab"\\\n\t\x01é😀中 \x7f\xa0\x1c '
    texts = ["", "x", None] + ["".join(r.choices(signs, weights=[5, 5, 1, 1, 2, 1, 1, 1, 1, 1, 3, 1, 1, 1, 1], k=r.randint(1, 400))) for _ in range(200)] + ["\x01" * 300, "\n" * 300, "a" * 1000, "\\" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"source_id": F.col("id").cast("string"), "message_id": F.lit("m")})
    cases = (
        (S.split_serialized(df, 40), lambda t: by_json(t, 40)),
        (S.split_text_files(df, 90, 40), lambda t: [(a + x, a + y) for a in range(0, len(t), 90) for x, y in by_json(t[a : a + 90], 40, "\n")]),
        (S.segment_plan(df, 30), lambda t: by_blanks(t, 30)),
    )
    for out, plain in cases:
        assert "Python" not in plan(out)
        got = {}
        for x in out.collect():
            got.setdefault(x.id, []).append((x.part_no, x.start_char, x.end_char))
            assert x.part == texts[x.id][x.start_char : x.end_char]
        assert {k: [p[1:] for p in sorted(v)] for k, v in got.items()} == {i: plain(t) for i, t in enumerate(texts) if t}


def test_large_texts_are_split_natively(spark):
    text = ('word "quoted"\n' * 200_000) + "end"
    df = spark.createDataFrame([("s", "m", text)], "source_id string, message_id string, text string")
    for out in (S.split_serialized(df, 17_000), S.split_text_files(df), S.segment_plan(df)):
        parts = sorted((x.part_no, x.start_char, x.end_char, x.part) for x in out.collect())
        assert "".join(p[3] for p in parts) == text
        assert all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))
