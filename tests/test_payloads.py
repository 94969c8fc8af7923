"""Payloads and descriptions of sources, by cases written down."""

from pyspark.sql import functions as F

from attestry.functions import payloads as Y
from attestry.operators.windows import chain_root
from attestry.plans.tables import BY_JOIN


def test_payloads(spark):
    cases = [(None, 0, True), ("", 0, True), ("no json", 0, True), ('{"a": 1}', 0, True), ("[1", 0, True), ("[]", 0, False), ('[1, null, {"a": []}]', 3, False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "p string")
    got = df.select("p", F.size(Y.decoded_messages(F.col("p"))).alias("n"), Y.payload_invalid(F.col("p")).alias("bad")).collect()
    assert [tuple(r) for r in got] == cases


def test_metadata(spark):
    cases = [(None, False, "unknown"), ({}, True, "unknown"), ({"author": "x"}, True, "unknown"), ({"author": None}, False, "unknown"), ({"rights": "all", "visibility": "visible_only"}, False, "visible_only"),
             ({"visibility": "complete_visible"}, True, "complete_visible"), ({"visibility": "all"}, False, "unknown"), ({"locator": "x" * 1000}, True, "unknown"), ({"locator": "x" * 1001}, False, "unknown")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, m map<string,string>")
    got = df.select("i", Y.metadata_valid(F.col("m")).alias("ok"), Y.visibility(F.col("m")).alias("v")).orderBy("i").collect()
    assert [(r["ok"], r["v"]) for r in got] == [c[1:] for c in cases]


def test_long_chains_and_cycles(spark):
    rows = [(f"r{i}", f"r{i - 1}" if i else None) for i in range(200)] + [("a", "gone"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["record_id"]: r["root_id"] for r in chain_root(spark.createDataFrame(rows, "record_id string, supersedes string"), 10).collect()}
    assert all(got[f"r{i}"] == "r0" for i in range(200)) and got["b"] == got["a"] == "a" and got["z"] == "z" and len(got) == len(rows)


def test_labels_are_those_of_every_pair(spark):
    passages = [(1, "one two three four five six"), (2, "wo three"), (3, None), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, ""), (6, "x  y z u v w")]
    texts = [(1, "zone two three four five sixth"), (2, "two three"), (3, None), (4, ""), (5, "a b c d e f g a b c d e f g"), (5, "aa b c d e f gg"), (6, "x y z u v w"), (7, "x  y z u v w")]
    b, d = spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["task_id"], r["doc_id"]) for r in BY_JOIN["v_labels"](b, d).collect())
    assert got == sorted((i, j) for i, p in passages for j, t in texts if p is not None and t is not None and p in t)
