"""The pipeline's stages on small data against plain versions."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_operators import near_classes

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        kept[name] = {r[0]: r[1] for r in rows}
        assert len(kept[name]) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert set(kept["lines"]) == set(kept["quality"])
    want = {i for i, (_, c) in near_classes(list(kept["lines"].items())).items() if i == c}
    assert set(kept["near_duplicates"]) == want
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == want


def test_good_documents_stay(spark):
    larger = "/root/testdata/sf0.01"  # a few hundred labels to learn from
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    kept = {r["doc_id"] for r in cp.quality(spark, docs, larger).select("doc_id").collect()}
    labels = spark.read.parquet(f"{larger}/labels.parquet").join(docs, "doc_id").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_rows_are_neither_lost_nor_multiplied(spark):
    line = "A line that many of the documents have in common, word for word."
    rows = [(i, f"own text of {i}\n{line}", "en", "web", 1) for i in range(6)]
    rows += [(7, "first of two", "en", "web", 12), (7, "the second of two", "de", "book", 17), (8, "twice", "en", "web", 5), (8, "twice", "en", "web", 5)]
    rows += [(None, f"no id\n{line}", "en", "web", 1), (None, "no id either", "en", "web", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = cp.lines(spark, docs, SF)
    assert out.schema == docs.schema
    want = [(i, f"own text of {i}" if i is not None and i < 5 else t, *rest) for i, t, *rest in rows]
    assert Counter(map(tuple, out.collect())) == Counter((i, t, a, b, len(t)) for i, t, a, b, _ in want)
    unlike = docs.where("doc_id is null or doc_id > 6")
    assert Counter(map(tuple, cp.near_duplicates(spark, unlike, SF).collect())) == Counter(r for r in rows if r[0] is None or r[0] > 6)
