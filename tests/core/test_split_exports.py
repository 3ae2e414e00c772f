"""Exports in splits against whole ones: layouts, cuts at every place, braces and quotes in texts."""

import json
import random

import pytest

from textloom.sources import exports, split_exports

FIELDS = ("chat_name", "chat_type", "id", "author", "text", "media_only")
TEXTS = ["plain", 'quote " and } and {', "back\\slash\\", "", "[{\"messages\": [{", "é\n\t}", ["a ", {"type": "bold", "text": "b}"}, " c"], None, "x" * 500]


def message(i):
    out = {"id": i, "type": "message", "from_id": "u", "text": TEXTS[i % len(TEXTS)], "reactions": [{"count": 1, "by": [{"x": {}}]}]}
    return out | ({"photo": "p.jpg"} if i % 4 == 0 else {})


def payloads():
    single = {"name": "one } \\ \" chat", "type": "personal_chat", "id": 1, "messages": [message(i) for i in range(40)]}
    chats = [{"name": f"c{n}", "type": "public_channel", "messages": [message(i) for i in range(n * 7)]} for n in range(4)]
    several = {"about": "messages", "contacts": {"list": [{"name": "no", "messages": [{"id": 7}]}]}, "chats": {"about": "x", "list": [*chats, {"messages": [message(3)], "name": "late", "type": "t"}]}, "left_chats": {"list": [{"messages": [message(1)]}]}}
    return {"single": single, "several": several, "none": {"profile": {"name": "x"}}}


@pytest.mark.parametrize("split", [None, 700])
@pytest.mark.parametrize("indent", [None, 1])
def test_as_whole_files(spark, tmp_path, indent, split):
    for name, x in payloads().items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps(x, indent=indent, ensure_ascii=indent is None) + ("\n" if indent else ""))
    rows = lambda df: sorted((r.path, *[r[x] for x in FIELDS]) for r in df.collect())
    order = lambda df: [(r.path, r.id) for r in df.orderBy("path", "chat_pos", "msg_pos").collect()]
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got, bad = split_exports.chat_exports(spark, str(tmp_path), run=300)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, _ = exports.chat_exports(spark, str(tmp_path))
    blank = lambda x: [r if split is None else (r[0], *r[3:]) for r in x]
    assert blank(rows(got)) == blank(rows(want)) and order(got) == order(want) and len(order(want)) == 40 + 42 + 1
    assert [(r.path.split("/")[-2], r.reason) for r in bad.collect()] == [("none", "no export")]


def test_cut_files_give_their_whole_messages(spark, tmp_path):
    rng, want = random.Random(4), {}
    text = json.dumps(payloads()["single"], ensure_ascii=False)
    data, ends = text.encode(), []
    at, decoder = text.index('"messages": [') + 13, json.JSONDecoder()
    while text[at] != "]":
        m, end = decoder.raw_decode(text, at)
        ends.append((len(text[:end].encode()), m["id"]))
        at = end + (2 if text[end] == "," else 0)
    for n, cut in enumerate([*(e for e, _ in ends[:6]), *(rng.randrange(60, len(data) - 1) for _ in range(24)), len(data)]):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "result.json").write_bytes(data[:cut])
        want[str(n)] = [i for e, i in ends if e <= cut]
    got, bad = split_exports.chat_exports(spark, str(tmp_path), run=200)
    found = {n: [] for n in want}
    for r in got.orderBy("path", "msg_pos").collect():
        found[r.path.split("/")[-2]].append(r.id)
    assert found == want
    reasons = {r.path.split("/")[-2]: r.reason for r in bad.collect()}
    assert set(reasons) == set(want) - {"30"} and all(reasons[n] == "cut off" for n in reasons if want[n]) and set(reasons.values()) <= {"cut off", "no export"}


def test_odd_files(spark, tmp_path):
    for name, x in {"empty": "", "text": "no } json {", "types": '{"messages": [{"id": 1, "text": "a"}, {"id" 2}, {"id": "no", "text": []}]}', "list": "[1, 2]"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(x)
    got, bad = split_exports.chat_exports(spark, str(tmp_path))
    assert [(r.id, r.chat_name, r.text) for r in got.orderBy("msg_pos").collect()] == [(1, "unknown", "a"), (None, "unknown", "")]
    assert sorted((r.path.split("/")[-2], r.reason) for r in bad.collect()) == [("list", "no export"), ("text", "no export"), ("types", "message is not JSON")]
