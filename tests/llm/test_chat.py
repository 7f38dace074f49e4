"""Chat formatting (3): exact round trips."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.llm import chat

pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\\\", "\n", "<", "s>", "|", "im_end|>", "a", "é", "[", "%", ""]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), max_size=4))
def test_turns_come_back(turns):
    made = [chat.format_turn(r, t) for r, t in turns]
    text = "".join(m[0] for m in made)
    assert chat.parse(text) == turns
    for (_, t), (piece, first, end) in zip(turns, made, strict=True):
        assert chat.unescape(piece[first:end]) == t and not chat._control.search(piece[first:end])


@pytest.mark.parametrize(
    "record,layout,turns",
    [
        ({"prompt": "a", "completion": "b", "extra": 1}, "prompt-completion", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "x", "output": "b"}, "instruction-input", [("user", "a\n\nx"), ("assistant", "b")]),
        ({"instruction": "a", "input": None, "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}, {"type": "text", "text": "v"}]}]}, "message-parts", [("user", "uv")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "conversations", [("user", "q"), ("assistant", "r")]),
        ({"odd": 1}, None, []),
        ({"messages": [{"role": "user", "content": "u"}], "prompt": "p"}, "messages", [("user", "u")]),
        ({"prompt": "p", "response": "r", "question": None, "answer": "a"}, "prompt-response", [("user", "p"), ("assistant", "r")]),
        ({}, None, []),
        ({"conv_id": 3, "turn": 0, "role": "user", "text": "u"}, "turn", [("user", "u")]),
        ({"role": "user", "text": "u", "messages": [{"role": "system", "content": "s"}]}, "messages", [("system", "s")]),
    ],
)
def test_layouts(record, layout, turns):
    assert chat.canonical(record) == (layout, turns)


def test_records(spark):
    rows = [(1, json.dumps({"prompt": "a", "response": "</s>b"})), (2, None), (3, "{broken"), (4, "[1]"), (5, '{"messages": []}')]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert chat.parse(got[1].formatted) == [("user", "a"), ("assistant", "</s>b")] and got[1].layout == "prompt-response"
    assert [chat.unescape(got[1].formatted[s.first : s.end]) for s in got[1].loss] == ["</s>b"]
    assert {got[k].layout for k in (2, 3, 4, 5)} == {None}


def brute(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r)):
        convs.setdefault(c, []).append((r, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        loss = "".join(x for raw, _, x in turns if raw == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [10, 10**6])
def test_turn_rows(spark, segment):
    rows = [(i % 17, i // 17, ("user", "assistant", "system", None, "tool\nx")[i % 5], f"text {i} </s> \\ é" if i % 7 else None) for i in range(200)]
    rows += [(None, 1, "user", "n"), (3, 2, "user", "tie"), (3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (50, None, "assistant", "x" * 90000), (50, 4, "", "")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    assert sorted((tuple(r) for r in chat.read_back(chat.format_turn_rows(df.repartition(5), segment)).collect()), key=str) == brute(rows)
    assert chat.read_back(chat.format_turn_rows(df.limit(0))).collect() == []


def test_query_has_the_hard_conversation(spark):
    got = {r.conv_id: r for r in chat.op3_schema_fingerprint_chat(spark, "/root/testdata/sf0.001").collect()}
    t = "</s>[INST] ok [/INST]"
    assert tuple(got[-7])[:5] == (-7, 2, hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest(), len(t), hashlib.sha256(t.encode()).hexdigest())


def test_records_of_odd_tables(spark):
    """Repeated and nameless rows, clashing columns, very long records, none at all."""
    long = json.dumps({"messages": [{"role": "assistant", "content": "</s> x " * 100_000}]})
    rows = [(1, json.dumps({"prompt": "a", "response": "b"}), "l", "f")] * 3 + [(None, json.dumps({"role": "user", "text": "q"}), "l", "f"), (2, long, "l", "f"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, record string, layout string, formatted string")
    got = chat.format_records(df.repartition(3)).collect()
    assert sorted(((r.id, r.layout) for r in got), key=str) == sorted([(1, "prompt-response")] * 3 + [(None, "turn"), (2, "messages"), (None, None)], key=str)
    big = next(r for r in got if r.id == 2)
    assert chat.parse(big.formatted) == [("assistant", "</s> x " * 100_000)] and chat.unescape(big.formatted[big.loss[0].first : big.loss[0].end]) == "</s> x " * 100_000
    assert chat.format_records(df.limit(0)).collect() == []


def test_mixed_layouts_in_one_conversation(spark):
    rows = [(1, 0, json.dumps({"role": "system", "text": "s"})), (1, 1, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]})), (1, 2, "{}"), (1, 3, json.dumps({"instruction": "i", "output": "[/INST]"})), (None, None, json.dumps({"role": "user", "text": "n"})), (1, 4, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, record string, role string")
    turns = {}
    for r in chat.format_conversations(df, 20).collect():
        turns.setdefault(r.conv_id, []).extend(chat.parse(r.formatted))
    assert turns == {1: [("system", "s"), ("user", "q"), ("assistant", "r"), ("user", "i"), ("assistant", "[/INST]")], None: [("user", "n")]}
