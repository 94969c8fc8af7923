"""Lexical search, Merkle manifest and HTML extraction against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from attestry.llm import lexical_search as LS
from attestry.llm.html_extraction import extract_pages, from_skeleton, main_text, skeleton
from attestry.llm.lexical_search import lexical_search
from attestry.llm.merkle import manifest_of
from attestry.llm.page_tree import Matching, Node, _measured, page_tree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def search_data():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdé文", k=r.randint(1, 4))) for _ in range(60)]
    docs = [(i, " ,".join(r.choices(vocab, k=r.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, "Same words, same SCORE; ties_by-id") for i in range(30)] + [(3, docs[3][1]), (None, "same words"), (900, None), (901, ""), (902, " .!_ "), (903, "long " + " ".join(vocab) * 400)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(1, 30)))) for i in range(12)] + [(20, "same SAME score"), (21, None), (22, ""), (23, "--"), (24, "nowhere"), (0, "same words"), (None, "ties")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search_is_exact(spark, monkeypatch, small):
    if small:  # many blocks of items, tiles of documents and of terms
        for name, n in (("BLOCK_ITEMS", 4), ("BLOCK_TERMS", 25), ("TILE_TERMS", 3), ("TILE_CELLS", 200)):
            monkeypatch.setattr(LS, name, n)
    docs, items = search_data()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "item": F.lit(2)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = [tuple(x) for x in lexical_search(table, asked, 7).collect()]
    assert sorted(got, key=repr) == ranked(docs, items, 7)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search(docs, items).count() == 0
    assert lexical_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0
    assert lexical_search(items.select(F.col("item_id").alias("doc_id"), "text"), items.where("false")).count() == 0


def test_partial_sums_stay_exact():
    """The width of a partial product keeps its sums below 2**53 whatever the weights."""
    import numpy as np

    tile = LS.Tile(4, 1, np.arange(4), np.zeros(4, np.int64), np.full(4, 2**52 // LS.MOST_IMPACT))
    assert tile.width == 2 or tile.width == 1
    top = np.full(4, LS.MOST_IMPACT, np.int64)
    assert tile.scores(np.zeros(4, np.int64), np.arange(4), top, 1)[0, 0] == 4 * (2**52 // LS.MOST_IMPACT) * LS.MOST_IMPACT


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest(rows):
    groups = {}
    for d, text, lang, source, n in rows:
        leaf = own = h(*map(field, (d, source, lang, n, text)))
        if d is not None and text is not None and zlib.crc32(str(d).encode()) % 5 == 0:
            own = h(*map(field, (d, source, lang, n, text.translate(LOWER))))
        groups.setdefault("" if source is None else "=" + source, []).append(((d is not None, d or 0), leaf, own, d))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    names = sorted(groups, key=str.encode)
    trees = {g: levels([x[1] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for gi, g in enumerate(names):
        for i, (_, leaf, own, d) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            beside, fold = [], own
            for tree, j in ((trees[g], i), (top, gi)):
                for level in tree[:-1]:
                    run, at = level[j - j % 16 : j - j % 16 + 16], j % 16
                    beside += run[:at] + run[at + 1 :]
                    fold, j = h(*run[:at], fold, *run[at + 1 :]), j // 16
            out.append((d, leaf, trees[g][-1][0], top[-1][0], h(*beside), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def leaves_data():
    rows = []
    for i in range(5200):
        source = "hot" if i % 10 else None if i % 50 == 0 else f"s{i % 230}"
        rows.append((i if i % 400 else None, (None, "", f"Abc É {i}", f"low {i}")[i % 4], "en" if i % 3 else None, source, i if i % 11 else None))
    return rows + rows[100:180] + [(7, "x" * 300_000, "en", "é", 1), (8, "", "", "", 0)]


def test_manifest_is_the_trees(spark):
    """A source beyond one block, many small ones, nulls, repeated rows, rows without an id."""
    rows = leaves_data()
    table = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "row": F.lit(1), "grp": F.lit("y"), "pos": F.lit(0)}).repartition(6)
    made = manifest_of(table)
    assert sorted((tuple(x) for x in made.drop("new_nodes").collect()), key=repr) == manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_manifests(spark, n):
    rows = [r for r in leaves_data() if r[3] == "hot"][:n]
    made = manifest_of(spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(x) for x in made.drop("new_nodes").collect()), key=repr) == manifest(rows)


def test_a_version_copies_ancestors_alone(spark):
    rows = [r for r in leaves_data() if r[3] == "hot"][:300]
    for r in manifest_of(spark.createDataFrame(rows, DOCS)).collect():
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and dict((x[0], x[1]) for x in rows)[r.doc_id] is not None
        assert (r.new_nodes is not None) == touched
        if touched:  # 300 leaves: three levels
            assert len(r.new_nodes) == 3 and r.new_nodes[-1] == r.folded_root


# ---- pages


def article_of(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p|ul|li|div)[^>]*>", inner)]
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


FURNITURE = """<header class="site-header"><a href="/">Site</a></header><nav><ul><li>Menu<li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side words</aside><div id="ad-1" class="ad">Buy now</div>"""
AFTER = """<section id="comments"><article class="comment"><p>First!</p></article></section><form><p>Write us<input><button>Go</button></form><footer>&copy; all</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a &lt;b&gt; &amp;amp; &nbsp;&#233;\n c<p>d<br>e", "a <b> &amp; é c\nd e"),
        (f"<html><head><title>T</title><script>if (a<b) '</p>'</script><body>{FURNITURE}<article><h1>Title</h1><p>One <b>two</b>\n three<p>Four</article>{AFTER}", "Title\nOne two three\nFour"),
        (f"<body>{FURNITURE}<main><article><header><h1>Title</h1></header><p>One<div class=share>Share me</div><aside>Note</aside><p>Two</article></main>{AFTER}</body>", "Title\nOne\nTwo"),
        (f"<body>{FURNITURE}<div id=content class='page has-sidebar'><div class=post-content><h2>Head</h2><p>Body text that is long enough</div><div class=related-posts>More</div></div>{AFTER}", "Head\nBody text that is long enough"),
        (f"<body>{FURNITURE}<div role=main><p>By its role</p></div>{AFTER}", "By its role"),
        ("<article><p>cut off in a tag <a hre", "cut off in a tag"),
        ("<article><p>unclosed quote <a href='x>y</a> stays</p><p>here</p></article>", "unclosed quote y stays\nhere"),
        ("<article><p>shown<!-- not <p>this --> on<p hidden>no<p style='display: none'>no</article>", "shown on"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</article>", "deep\nafter"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul><pre>f\n  g</pre></article>", "a\nb\nc\nd\ne\nf g"),
    ],
)
def test_pages_by_their_elements(page, text):
    assert main_text(page_tree(page or "")) == text


def soup(i, words=("alpha", "beta", "gamma", "delta", "kappa", "omega")):
    r = random.Random(i)
    body = "".join(f"<div><p>{' '.join(r.choices(words, k=30))} {i}-{j}</p></div>" for j in range(r.randint(2, 6)))
    return f"<div><div>Home of things</div><div>About this host in many words that never change on any page of it</div></div><div>{body}</div><div><div>All rights kept</div></div>"


def test_wrapper_is_learned_from_a_host(spark):
    """Without any marks, what says the same on a host's pages goes and what varies stays; a lone page keeps all of its region."""
    rows = [(i, f"https://soup.example/{i}", soup(i)) for i in range(30)]
    rows += [(100 + i, f"http://www.copies.example/{i}", "<article><h1>Same</h1><p>One text on many pages</p></article>") for i in range(20)]
    rows += [(200, None, soup(1)), (201, "https://soup.example/x", None), (202, "mailto:x", ""), (5, "https://soup.example/5", soup(5)), (None, "https://soup.example/9", soup(9))]
    rows += [(300 + i, f"https://marked.example/{i}", f"<article><h1>Day {i}</h1><p>Subscribe to our letter today</p><p>{'news ' * 9}{i}</p></article>") for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y"), "bones": F.lit(0)}).repartition(4)
    got = sorted(((r.page_id, r.url, r.text) for r in extract_pages(table).collect()), key=repr)
    assert len(got) == len(rows)
    by = {(p, u): t for p, u, t in got}
    for i in range(30):
        assert by[i, f"https://soup.example/{i}"] == "\n".join(re.findall("<p>(.*?)</p>", soup(i)))
    assert all(by[100 + i, f"http://www.copies.example/{i}"] == "Same\nOne text on many pages" for i in range(20))
    assert by[201, "https://soup.example/x"] == by[202, "mailto:x"] == ""
    assert all(by[300 + i, f"https://marked.example/{i}"] == f"Day {i}\n{('news ' * 9)}{i}" for i in range(12))
    assert extract_pages(table.where("false")).count() == 0


def random_tree(r, depth=0):
    node = Node("div", r.choice("abc"))
    for _ in range(r.randint(0, 5 if depth < 3 else 0)):
        node.children.append(random_tree(r, depth + 1) if r.random() < 0.5 else Node("#text", "#text", text=r.choice("xyzw")))
    return node


def test_matching_is_the_largest():
    """Weights against the plain recursion; tables that are halved give as much as whole ones."""

    def key(n):
        return n.text if n.text is not None else (n.label, *map(key, n.children))

    @lru_cache(None)
    def plain(a, b):
        if isinstance(a, str) or isinstance(b, str):
            return (3 if a == b else 1) if isinstance(a, str) and isinstance(b, str) else 0
        if a[0] != b[0]:
            return 0
        m = [[0] * len(b) for _ in a]
        for i in range(1, len(a)):
            for j in range(1, len(b)):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain(a[i], b[j]))
        return 1 + m[-1][-1]

    r = random.Random(8)
    for _ in range(300):
        a, b = _measured(random_tree(r)), _measured(random_tree(r))
        a.label = b.label = "a"
        for cells in (1 << 22, 3):
            m = Matching()
            m.MOST_CELLS = cells
            assert m.weight(a, b) == plain(key(a), key(b))

            def gained(x, y):
                return (3 if x.text == y.text else 1) if x.text is not None else 1 + sum(gained(p, q) for p, q in m.pairs(x.children, y.children))

            assert gained(a, b) == plain(key(a), key(b))


def test_skeleton_keeps_the_tree():
    for i in range(5):
        root = page_tree(soup(i))
        assert from_skeleton(skeleton(root)).print == root.print
