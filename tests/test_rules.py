"""Golden rows for rules that the test data doesn't exercise; invariants of spans and budgets; streams equal batches."""

import json
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestry.functions import rules as R
from attestry.functions import spans as S
from attestry.functions.text import assertion_key, compatible, normal
from attestry.operators import budgets as B
from attestry.operators import joins as J
from attestry.operators import mutations as M
from attestry.operators import retrieval as Q
from attestry.operators import windows as W
from attestry.streaming import jobs as ST


def one(spark, values, schema, col):
    return [r[0] for r in spark.createDataFrame(values, schema).select(col).collect()]


@pytest.mark.parametrize(
    ("text", "mode"),
    [
        ("如果下雨就取消郊游", "conditional"),
        ("我希望学会游泳，并且已经完成报名", "mixed"),
        ("想要一辆自行车", "wish"),
        ("打算周末搬家", "plan"),
        ("窗户朝南", "stated"),
        ("unless it rains we walk", "conditional"),
        ("We intend to paint the wall", "plan"),
        ("They deployed it", "stated"),
        ("I hope it is completed", "mixed"),
    ],
)
def test_modality(spark, text, mode):
    assert one(spark, [(text,)], "t string", R.modality(F.col("t"))) == [mode]


@pytest.mark.parametrize(
    ("quote", "statement", "kind", "why"),
    [
        ("访客可以带水", "访客必须带水", "claim", "permission_to_obligation"),
        ("访客可以带水", "访客不要求带水", "claim", None),
        ("我打算换工作", "用户已决定换工作", "claim", "intention_to_done"),
        ("我打算换工作", "用户换工作", "decision", "intention_as_decision"),
        ("如果批准就去东京", "计划去东京", "plan", "condition_dropped"),
        ("如果批准就去东京", "如果批准，计划去东京", "plan", None),
        ("并不希望搬家", "希望搬家", "preference", "negated_wish"),
        ("制作一个游戏，可以支持双人", "必须支持双人", "claim", None),
        ("You may bring a guest", "You must bring a guest", "claim", "permission_to_obligation"),
        ("The wall is blue", "The wall is blue", "claim", None),
    ],
)
def test_promotion(spark, quote, statement, kind, why):
    got = one(spark, [(quote, statement, kind)], "q string, s string, k string", R.promotion(F.col("q"), F.col("s"), F.col("k")))
    assert got == [why]


def test_qualification(spark):
    quote = "从现在起，这两条要求长期适用，直到我明确更改：回答必须简短"
    rows = [(quote, "从现在起长期适用、直到我明确更改：回答必须简短"), (quote, "回答必须简短"), (quote, "从现在起回答必须简短，直到我明确更改"), (quote, "不是从现在起长期适用，直到我明确更改"), ("回答必须简短", "回答必须简短")]
    got = one(spark, rows, "q string, s string", R.split_rule(F.col("q"), F.col("s"), F.lit("claim")))
    assert got == [None, "start_missing", "duration_missing", "start_negated", None]


def test_dates_and_commands(spark):
    rows = [("于2024年2月3日出发", "2024-02-03"), ("on 2024-02-03", "2024-02-03"), ("于2024年02月03日", "2024-02-03"), ("明天", "2024-02-03"), ("x", None)]
    assert one(spark, rows, "s string, d string", R.statement_has_date(F.col("s"), F.col("d"))) == [True, True, True, False, True]
    rows = [("请写一篇游记",), ("继续下一章",), ("上周开始了第六讲",)]
    assert one(spark, rows, "s string", R.immediate_command(F.col("s"))) == [True, True, False]


def test_masking_keeps_length():
    for text in ["a<think>b</think>c", "x<thinking>1<think>2</think>3</thinking>y", "p<analysis>open 🙂", "</think> stray", ""]:
        assert len(S.masked(text)) == len(text)
    assert S.masked("a<think>b</think>c") == "a" + " " * 16 + "c"
    assert S.masked("x<think>1<think>2</think>3</think>y").strip("x y") == ""
    assert S.masked("p<analysis>open").rstrip() == "p"


def test_pages_and_parts_join_to_text(spark):
    df = spark.createDataFrame([(1, "🙂x" * 700), (2, ""), (3, "abc")], "doc_id int, text string")
    pages = B.paginate_text(df, 500).toPandas().sort_values(["doc_id", "page_no"])
    assert pages.groupby("doc_id")["page"].sum().to_dict() == {1: "🙂x" * 700, 2: "", 3: "abc"}
    parts = S.segment_plan(df.select(F.col("doc_id").alias("source_id"), F.lit("m").alias("message_id"), "text"), 300).toPandas().sort_values(["source_id", "part_no"])
    assert parts.groupby("source_id")["part"].sum().to_dict() == {1: "🙂x" * 700, 3: "abc"}


def test_chunks_overlap(spark):
    df = spark.createDataFrame([("a", "x" * 2500), ("b", " " * 50), ("c", "y")], "source_id string, text string")
    got = sorted((r["source_id"], r["start_char"], r["end_char"]) for r in S.chunk_text(df).collect())
    assert got == [("a", 0, 1000), ("a", 900, 1900), ("a", 1800, 2500), ("c", 0, 1)]


def test_budget_skip_equals_plain_fold(spark):
    r = random.Random(5)
    rows = [(q, k, r.randint(60, 400)) for q in range(40) for k in range(60)]
    got = {(x["query_id"], x["rank"]) for x in B.fill_budget_skip(spark.createDataFrame(rows, "query_id int, rank int, size int"), 900, 60).collect()}
    want = set()
    for q in range(40):
        used = 0
        for _, k, s in sorted(x for x in rows if x[0] == q):
            if used + s <= 900:
                used += s
                want.add((q, k))
    assert got == want


def test_bundle_order(spark):
    def df(rows):
        return spark.createDataFrame(rows, "query_id int, rank int, size int")

    trusted, cand, orig = df([(1, 1, 100), (1, 2, 100)]), df([(1, 1, 50)]), df([(1, 1, 100), (1, 2, 100)])
    kept = {b: sorted((r["group"], r["rank"]) for r in B.evidence_bundle(trusted, cand, orig, b).collect()) for b in (450, 400, 300, 200, 100, 99)}
    assert len(kept[450]) == 5
    assert kept[400] == [("original", 1), ("original", 2), ("trusted", 1), ("trusted", 2)]
    assert kept[300] == [("original", 1), ("trusted", 1), ("trusted", 2)]
    assert kept[200] == [("original", 1), ("trusted", 1)]
    assert kept[100] == [("trusted", 1)]
    assert kept[99] == []
    assert B.evidence_bundle(trusted.limit(0), cand, orig.limit(0), 500).collect()[0]["group"] == "candidate"


HAN = [("r1", "蓝湖项目的预算是三万", "项目"), ("r2", "蓝色的湖水", "风景"), ("r3", "project Atlas-2 started", "work"), ("r4", "猫", "猫")]


def test_han_retrieval(spark):
    recs = spark.createDataFrame(HAN, "record_id string, statement string, subject string")

    def found(query, mode):
        q = spark.createDataFrame([("q", query)], "query_id string, query string")
        return {r["record_id"]: r["score"] for r in Q.search(recs, q, mode).collect()}

    assert found("请问蓝湖项目有哪些", "v2").keys() == {"r1"}
    # phrase 2*4, three pairs at their strongest fields 4 + 4 + 6
    assert found("请问蓝湖项目有哪些", "v2")["r1"] == 8 + 14
    assert found("atlas-2", "v2") == {"r3": 8.0}
    assert found("猫", "v2") == {"r4": 12.0}
    assert found("ＡＴＬＡＳ-2", "v2") == {"r3": 8.0}
    assert "r1" in found("预算和蓝湖", "v3")
    assert found("the of", "v2") == {}


def test_search_equals_naive(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "a", "xalphay", "be"]
    recs = [(f"r{i}", " ".join(r.choices(words, k=6)), r.choice(words)) for i in range(60)]
    qs = [(f"q{i}", " ".join(r.choices(words, k=3))) for i in range(10)]
    rd, qd = spark.createDataFrame(recs, "record_id string, statement string, subject string"), spark.createDataFrame(qs, "query_id string, query string")
    got = {(x["query_id"], x["record_id"]): x["score"] for x in Q.search_v1(rd, qd).collect()}
    want = {}
    for q, text in qs:
        for i, s, u in recs:
            hay = f"{s} {u}"
            n = sum(t in hay for t in set(text.split())) + 5 * (text in hay)
            if n:
                want[q, i] = n
    assert got == want


def test_chain_root_of_long_chain_and_cycle(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)] + [("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r["record_id"]: r["root_id"] for r in W.chain_root(spark.createDataFrame(rows, "record_id string, supersedes string"), 12).collect()}
    assert all(got[f"n{i}"] == "n0" for i in range(150))
    assert got["z"] == "z" and got["x"] in ("x", "y")


def test_append_is_idempotent(spark):
    s = spark.createDataFrame([("a", "o", "s", "k", "d", 1), ("b", "o", "s", "k", "d", 2), ("c", "o", "s", "k2", "d", 3)], "source_id string, owner string, scope string, source_key string, digest string, created long")
    new, receipts = M.append_sources(s.limit(0), s)
    assert sorted(r["source_id"] for r in new.collect()) == ["a", "c"]
    assert sum(r["duplicate"] for r in receipts.collect()) == 1
    assert M.append_sources(new, s)[0].count() == 0


def test_verify_archive_tampered(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y"), ("r", 3, "z")], "path string, size int, digest string")
    b = spark.createDataFrame([("p", 1, "x"), ("q", 2, "Y"), ("t", 3, "z")], "path string, size int, digest string")
    assert {r["path"]: r["status"] for r in J.verify_archive(a, b).collect()} == {"p": "ok", "q": "changed", "r": "missing", "t": "extra"}


def test_text_keys(spark):
    assert one(spark, [("ＡＢＣ ①",), ("Plain",), (None,)], "t string", normal("t")) == ["abc 1", "plain", None]
    assert one(spark, [("。 好 的　！",), ("ＡＢＣ Ok.",)], "t string", assertion_key("t")) == ["好的", "ABCOk"]
    texts = ["ﬁn", "e\u0301", "é", "ｱ", "한", "가", "½", "x", "\u00a0", "日本、語", "ĳ"]
    assert one(spark, [(t,) for t in texts], "t string", compatible("t")) == [unicodedata.normalize("NFKC", t) for t in texts]


def run_stream(spark, df, out, tmp, mode="append"):
    name = f"t{abs(hash(tmp)) % 10**9}"
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp}/cp").start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_ledger_and_reviews_equal_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"r{r.randint(0, 5)}", f"w{i:03}", r.randint(0, 3), i) for i in range(120)]
    df = spark.createDataFrame(rows, "record_id string, review_id string, revision int, created long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    with_conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        got = run_stream(spark, df, ST.stream_reviews(stream), f"{tmp_path}/a")
        key = lambda x: sorted(map(tuple, x.select("record_id", "review_id", "accepted", "revision").collect()))
        assert key(got) == key(ST.batch_reviews(df))
    finally:
        for k in with_conf:
            spark.conf.unset(k)
    led = pd.DataFrame({"owner": ["a", "b"] * 10, "scope": "s", "total_tokens": range(20), "prompt_tokens": None, "completion_tokens": None, "reservation": 1})
    led = spark.createDataFrame(led, "owner string, scope string, total_tokens long, prompt_tokens long, completion_tokens long, reservation long")
    led.coalesce(1).write.parquet(f"{tmp_path}/led")
    got = run_stream(spark, led, ST.running_ledger(spark.readStream.schema(led.schema).parquet(f"{tmp_path}/led")), f"{tmp_path}/b", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ST.running_ledger(led).collect()))


@pytest.mark.parametrize(
    ("text", "cut", "summary", "want"),
    [
        ("请写一篇游记，记住我住在海边。", 15, False, ["记住我住在海边。"]),
        ("我住在海边。\n\n好的\n\n继续！", 17, False, ["我住在海边。\n\n"]),
        ("我住在海边，养猫", 6, False, ["我住在海边，"]),
        ("SKILL.md has 30 lines", 21, True, []),
        ("SKILL.md has 30 lines", 21, False, ["SKILL.md has 30 lines"]),
        ("字" * 600 + "。" + "字" * 600, 1201, False, ["字" * 600 + "。", "字" * 600]),
        ("。" + "字" * 1400, 1401, False, ["。" + "字" * 999, "字" * 401]),
        ("", 0, False, []),
    ],
)
def test_cited_ranges(text, cut, summary, want):
    assert [text[a:b] for a, b in S.citable(text, cut, summary)] == want


def test_routes(spark):
    long = "细" * 450
    rows = [
        ("conversation", "assistant", "x", "assistant_reference", 0),
        ("conversation", "user", "看看：\n你是编辑，职责如下" + long, "mixed_reference_document", 3),
        ("conversation", "user", "你将扮演编辑，工作流程" + long, "reference_document", 0),
        ("conversation", "user", "你是编辑，职责如下", "conversation", 9),
        ("document", "assistant", "第二章：" + long, "reference_document", 0),
        ("conversation", "user", "核心观点、内容架构、章末思考", "reference_document", 0),
        ("conversation", "user", "", "conversation", 0),
    ]
    got = R.routed(spark.createDataFrame(rows, "source_type string, role string, text string, want string, at int")).collect()
    assert [(r["route"], r["cut"]) for r in got] == [(r[3], r[4]) for r in rows]


def test_source_context(spark):
    rows = [("2024-02-03T10:00:00Z", "conversation", "Garden"), ("2024-02-03", "imported_summary", ""), ("2024-13-03", "conversation", None), ("soon", "document", None), (None, None, None)]
    got = one(spark, rows, "c string, s string, t string", R.source_context(F.col("c"), F.col("s"), F.col("t")))
    assert [g["source_date"] for g in got] == ["2024-02-03", "2024-02-03", None, None, None]
    assert [g["relative_time_anchor"] for g in got] == ["2024-02-03", None, None, None, None]
    assert [g["conversation_title"] for g in got] == ["Garden", None, None, None, None]
    assert got[1]["date_role"] == "summary_update"


@pytest.mark.parametrize(
    ("quote", "flagged"),
    [
        ("同事建议改用新表格", True),
        ("同事建议改用新表格，我已经决定采纳", False),
        ("同事建议改用新表格，我决定采用，但尚未通知", True),
        ("My advisor recommends it and I have decided to adopt it", False),
        ("My advisor recommends it and I have not adopted it", True),
        ("我决定采用新表格", False),
    ],
)
def test_advice_that_the_owner_adopted(spark, quote, flagged):
    rows = [(1, "s", "t", "claim", "x", "user_stated", "用户改用新表格", quote)]
    claims = spark.createDataFrame(rows, "claim_no int, source_id string, topic string, kind string, subject string, status string, statement string, quote string")
    assert ("third_party_advice_review" in R.review_claims(claims).first()["codes"]) == flagged
