"""Main texts of web pages by wrapper induction.

Pages of one host share a wrapper: menus, notices and the like stay where they are and say the same, while the content varies.
For each host one page of its most common shape is the reference, the smallest such page. Every page of the host is
aligned with it by simple tree matching, and each leaf of the reference is counted: by how many different pages it is met,
and with the same text. Leaves that say the same nearly everywhere are template; what varies are slots. A page's main
text is what its slots hold within its main region, without furniture (see ``page_tree``).

References are small (labels and 8-byte prints) and pages stay where they are unless the table of references is too large to
broadcast, as Spark decides; a host with very many pages is then a join key that adaptive execution splits.
Votes of a page are its few aligned leaves; copies of a page vote once.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .page_tree import Matching, Node, page_tree, printed

#: A leaf is template when it says the same on this share of the pages that have it, and on so many pages at least; within an article on more.
SHARE, LEAST_PAGES, LEAST_IN_MAIN = 0.9, 3, 10
#: Of a node's text, the part that one child must hold to be the main region in its place.
DOMINANT = 0.7


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def skeleton(root: Node) -> str:
    """A tree as JSON: labels, and prints in place of texts."""
    todo, done = [root], {}
    order = []
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    for node in reversed(order):
        done[id(node)] = node.print.hex() if node.text is not None else [node.label, *(done[id(c)] for c in node.children)]
    return json.dumps(done[id(root)], ensure_ascii=False, separators=(",", ":"))


@lru_cache(256)
def from_skeleton(text: str) -> Node:
    """The reference tree; its leaves are numbered in page order."""
    root, leaves = Node("", ""), 0
    todo = [(json.loads(text), root)]
    every = []
    while todo:
        raw, node = todo.pop()
        every.append(node)
        if isinstance(raw, str):
            node.text, node.label, node.print, node.order = "", "#text", bytes.fromhex(raw), leaves
            leaves += 1
        else:
            node.label = raw[0]
            node.children = [Node("", "") for _ in raw[1:]]
            todo.extend(reversed(list(zip(raw[1:], node.children, strict=True))))
    for node in reversed(every):
        if node.text is None:
            node.print = printed(node.label, node.children)
    return root


def _opened(root: Node) -> set[int]:
    """Orders of nodes that are furniture by name and yet hold a page's article: those are layout."""
    out, todo = set(), [(root, ())]
    while todo:
        node, above = todo.pop()
        if node.tag in ("article", "main") and not node.skip:
            out.update(above)
        held = (*above, node.order) if node.skip and node.tag in ("div", "section") else above
        todo.extend((c, held) for c in node.children)
    return out


def _visible(node: Node, opened: set[int], gone: set[int]) -> list[Node]:
    """Leaves below a node that aren't furniture or template."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x is not node and x.skip and x.order not in opened:
            continue
        if x.text is not None and x.order not in gone:
            out.append(x)
        todo.extend(reversed(x.children))
    return out


def _outermost(root: Node, opened: set[int], wanted) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.skip and x.order not in opened:
            continue
        if wanted(x):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return out


def _chars(leaves: list[Node], linked: bool = True) -> int:
    return sum(len(x.text) - (0 if linked else x.linked) for x in leaves)


def main_text(root: Node, fixed: set[int] = frozenset(), firm: set[int] = frozenset()) -> str:
    """The main text of a page's tree. ``fixed``: orders of leaves that are template; ``firm``: those that also count within an article."""
    opened = _opened(root)
    regions = _outermost(root, opened, lambda x: x.tag == "article")
    marked = bool(regions)
    if not regions:
        regions = [x for x in _outermost(root, opened, lambda x: x.main) if _visible(x, opened, fixed)]
        # from a frame to the one part that holds most of it
        while len(regions) == 1:
            inner = [y for c in regions[0].children for y in _outermost(c, opened, lambda x: x.main)]
            whole = _chars(_visible(regions[0], opened, fixed))
            inner = [y for y in inner if _chars(_visible(y, opened, fixed)) >= DOMINANT * whole]
            if not inner:
                break
            regions = inner[:1]
        marked = bool(regions)
    if not regions:
        node = root
        while True:
            whole = _chars(_visible(node, opened, fixed), linked=False)
            inner = [c for c in node.children if len(c.children) > 1 or any(g.text is None for g in c.children)]
            inner = [c for c in inner if not (c.skip and c.order not in opened) and whole and _chars(_visible(c, opened, fixed), linked=False) >= DOMINANT * whole]
            if not inner:
                break
            node = inner[0]
        regions = [node]
    leaves = [x for r in regions for x in _visible(r, opened, frozenset())]
    gone = firm if marked else fixed
    same = [x for x in leaves if x.order in gone]
    # where most of a region is the same everywhere, the pages are copies of one text and not of one template
    if same and 2 * _chars(same) <= _chars(leaves):
        leaves = [x for x in leaves if x.order not in gone]
    if not marked:
        leaves = [x for x in leaves if 5 * x.linked <= 4 * len(x.text)]
    return "\n".join(x.text for x in leaves)


def _tree(page: str | None, printed: bool = True) -> Node:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    return page_tree(page or "", printed)


def _content_print(root: Node) -> bytes:
    return blake2b(main_text(root).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([skeleton(_tree(page.as_py())) for page in batch.column(1)], pa.string())], ["host", "bones"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, votes = [], []
        for page, bones in zip(batch.column(1), batch.column(2), strict=True):
            root = _tree(page.as_py())
            met = Matching().align(root, from_skeleton(bones.as_py()))
            prints.append(_content_print(root))
            votes.append([2 * leaf + same for leaf, same in met.values()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(votes, pa.list_(pa.int32()))], ["host", "content", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, bones, fixed, firm in zip(*batch.columns[2:], strict=True):
            same, firmly = set(fixed.as_py() or ()), set(firm.as_py() or ())
            root = _tree(page.as_py(), bool(same))
            if same:
                met = {order: leaf for order, (leaf, equal) in Matching().align(root, from_skeleton(bones.as_py())).items() if equal}
                out.append(main_text(root, {o for o, leaf in met.items() if leaf in same}, {o for o, leaf in met.items() if leaf in firmly}))
            else:
                out.append(main_text(root))
        text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pc.utf8_length(text).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, bones, fixed, firm): each host's reference and its template leaves. Hosts with fewer pages than a template needs have none."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host <> '' and html is not null")
    own = hosts.withColumn("digest", F.md5(F.col("html").cast("binary")))
    # a page's shape is the set of its elements; the smallest page of a host's most common shape is its reference
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    sketches = own.select("host", "digest", tags.alias("tags")).select("host", "digest", F.size("tags").alias("size"), F.xxhash64(F.array_sort(F.array_distinct("tags"))).alias("shape"))
    shapes = sketches.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(F.struct("size", "digest")).alias("least"))
    chosen = shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by("least.digest", F.struct("n", "shape")).alias("digest")).where(F.col("pages") >= LEAST_PAGES)
    # written, so that its size is known before the join is planned
    chosen = scratch.keep("chosen", chosen)
    picked = own.join(chosen.select("host", "digest"), ["host", "digest"], "left_semi").dropDuplicates(["host"])
    references = scratch.keep("references", picked.select("host", "html").mapInArrow(_bones, "host string, bones string"))
    votes = hosts.join(references, "host").select("host", "html", "bones").mapInArrow(_votes, "host string, content binary, votes array<int>")
    # copies of one text count once
    each = votes.groupBy("host", "content").agg(F.min("votes").alias("votes")).select("host", F.explode("votes").alias("vote"))
    leaves = each.groupBy("host", F.floor(F.col("vote") / 2).cast("int").alias("leaf")).agg(F.count("*").alias("met"), F.sum(F.col("vote") % 2).alias("same"))
    sure = leaves.where((F.col("same") >= SHARE * F.col("met")) & (F.col("met") >= LEAST_PAGES))
    # no more than the leaves of one reference
    template = sure.groupBy("host").agg(F.sort_array(F.collect_list("leaf")).alias("fixed"), F.sort_array(F.collect_list(F.when(F.col("met") >= LEAST_IN_MAIN, F.col("leaf")))).alias("firm"))
    return scratch.keep("wrappers", references.join(template, "host"))


def extract_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text) of pages (page_id, url, html).

    A null or empty html, and one without main text, gives an empty text. Pages without a host (or whose host has few pages) are read by their
    own elements alone. Repeated pages give a row each and count once for the wrapper. Other columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(pages.sparkSession, "pages")
    known = wrappers(pages, scratch)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    told = rows.join(known, "host", "left").select("page_id", "url", "html", "bones", "fixed", "firm")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return told.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
