"""Golden rows for the three clause policies, and losslessness."""

import random

import pytest

from attestry.functions.clauses import clause_ranges
from attestry.functions.spans import cited_spans, register

PROJECT = "如果预算通过，我们就扩建花园。另外，我对另一个独立项目 Lotus 的要求是：每周浇水两次。"
ALONE = "我希望院子里有一座小桥，这项期望独立成立，尚未批准实施。如果冬天不冷，我打算种梅花。"


@pytest.mark.parametrize(
    ("text", "policy", "parts"),
    [
        ("我喜欢茶。我们打算种树。", "plain", 2),
        ("我喜欢茶，我希望种树", "plain", 2),
        ("我喜欢茶，咖啡和水", "plain", 1),
        ("我喜欢茶（我们打算。我去）", "plain", 1),
        ("如果下雨。我们回家。", "plain", 1),
        ("- 一\n- 二。我们走", "plain", 1),
        ("清单：\n我走。我来", "plain", 1),
        ("They rest; We plan to walk", "plain", 2),
        (PROJECT, "plain", 1),
        (PROJECT, "scoped", 2),
        (PROJECT.replace("每周", "如果可以每周"), "scoped", 1),
        ("他说" + PROJECT, "scoped", 1),
        (ALONE, "scoped", 1),
        (ALONE, "explicit", 2),
        (ALONE.replace("梅花", "它"), "explicit", 1),
        (ALONE.replace("尚未批准实施", "已批准"), "explicit", 1),
        (PROJECT, "explicit", 2),
        ("", "explicit", 0),
    ],
)
def test_policies(text, policy, parts):
    got = clause_ranges(text, policy)
    assert len(got) == parts
    assert "".join(text[a:b] for a, b in got) == text


def test_ranges_cover_any_text():
    r = random.Random(7)
    bits = ["我希望", "如果", "。", "，", "（", "）", "项目", "\n- ", "：", "so ", "I plan ", "! ", "；"]
    for _ in range(300):
        text = "".join(r.choices(bits, k=12))
        for policy in ("plain", "scoped", "explicit"):
            assert "".join(text[a:b] for a, b in clause_ranges(text, policy)) == text


def test_table_function(spark):
    """SQL over a table, partitioned or not, gives the rows of the DataFrame form; wrong arguments are refused when the query is analysed."""
    register(spark)
    rows = [(i, "imported_summary" if i % 3 == 0 else "conversation", t, len(t) - i % 2) for i, t in enumerate(["我喜欢茶。我们打算种树。", "", "请写一篇游记，记住我住在海边。", "SKILL.md has 30 lines", "字" * 2500, "好的。\n\n我希望休息，我计划走。"] * 4)]
    routed = spark.createDataFrame([*rows, (99, "document", None, None)], "k int, source_type string, text string, cut int")
    routed.createOrReplaceTempView("routed_texts")
    for policy in ("plain", "scoped", "explicit"):
        want = sorted(map(tuple, cited_spans(routed, policy).drop("priority").collect()))
        assert want
        for how in ("", "PARTITION BY (k % 3)", "PARTITION BY (source_type) ORDER BY (k)"):
            got = spark.sql(f"SELECT k, source_type, cut, part_no, start_char, end_char, part FROM cited_spans(TABLE(SELECT * FROM routed_texts) {how}, '{policy}')")
            assert sorted(map(tuple, got.collect())) == want
    whole = spark.sql("SELECT part FROM cited_spans(TABLE(SELECT 'x' AS id, text FROM routed_texts WHERE k = 0), 'plain')").collect()
    assert [r["part"] for r in whole] == ["我喜欢茶。", "我们打算种树。"]
    for call in ("TABLE(SELECT k FROM routed_texts), 'plain'", "TABLE(SELECT text FROM routed_texts), 'other'"):
        with pytest.raises(Exception, match="cited_spans needs|the policy is"):
            spark.sql(f"SELECT * FROM cited_spans({call})")


def test_shared_clauses_are_trimmed(spark):
    """A clause that follows a stop and a blank is the same as one that opens a text."""
    from attestry.operators.windows import clause_overlap

    rows = [(0, "One shared clause, and more of it."), (1, "First this. One shared clause"), (2, "9 of these 12, One shared clause 1")]
    claims = spark.createDataFrame([("s", "t", "u", "v", *r) for r in rows], "source_id string, topic string, subject string, status string, claim_no int, statement string")
    assert {(r.first_no, r.second_no, r.shared) for r in clause_overlap(claims).collect()} == {(0, 1, 1)}
