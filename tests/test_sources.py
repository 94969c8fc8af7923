"""Files of one JSON list are read by many tasks and give what a plain parser gives."""

import json
import random

import pytest

from attestry.sources.exports import read_conversation_export
from attestry.sources.json_lists import read_json_list


def values(r, depth=0):
    kind = r.randint(0, 6 if depth < 4 else 3)
    if kind < 2:
        return "".join(r.choices('ab"\\{}[],: \n\té花', k=r.randint(0, 30)))
    if kind == 2:
        return r.randint(-5, 10**9)
    if kind == 3:
        return r.choice([None, True, 1.5])
    if kind == 4:
        return [values(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {"".join(r.choices('k"}{', k=3)) + str(i): values(r, depth + 1) for i in range(r.randint(0, 4))}


@pytest.mark.parametrize("split", [400, 3000, 1 << 20])
def test_elements_are_the_parsers(spark, tmp_path, split):
    """Splits fall within strings, escapes and nested brackets; one element is longer than many splits."""
    r = random.Random(split)
    lists = [[{"i": i, "v": values(r)} for i in range(60)] + [{"long": "}{\"" * 900}] + [[1, {"a": "]"}], 7, "x", {}] for _ in range(2)] + [[], [{"one": 1}]]
    for n, x in enumerate(lists):
        (tmp_path / f"f{n}.json").write_text(json.dumps(x, ensure_ascii=bool(n % 2), indent=n % 3 or None), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for x in read_json_list(spark, str(tmp_path)).collect():
            got.setdefault(x.file[-7:-5], []).append((x.n, json.loads(x.text)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = {f"f{n}": list(enumerate(v for v in x if isinstance(v, (dict, list)))) for n, x in enumerate(lists)}
    assert {k: sorted(v, key=lambda e: e[0]) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def conversation(uuid):
    return {"uuid": uuid, "name": "n" * 200, "created_at": "d", "chat_messages": [{"uuid": "m", "sender": "human", "text": "flat", "content": [{"type": "thinking", "text": "hid"}, {"type": "text", "text": "seen"}]}, {"uuid": "m2", "sender": "tool", "text": "only flat"}]}


def test_export_with_unique_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([conversation("x"), conversation("y")]))
    got = sorted((r.conversation_id, r.message_id, r.role, r.text, len(r.title)) for r in read_conversation_export(spark, str(tmp_path)).collect())
    assert got == sorted((c, *m, 120) for c in "xy" for m in (("m", "user", "seen"), ("m2", "external", "only flat")))
    (tmp_path / "b.json").write_text(json.dumps([conversation("x")]))
    with pytest.raises(ValueError, match="not unique: x"):
        read_conversation_export(spark, str(tmp_path))
