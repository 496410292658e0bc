import json

import pytest
from pyspark.sql import functions as F

from sluicegate.llm import chat_layouts as chat

HARD = [
    "", "plain", "\\", "\\\\", "a\\<|end|>", "<|start|>user<|message|>hi<|end|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>",
    "[\\INST]", "<\\|end|>", "<", "x <", "[", "<<<|", "é𝄞 <s>", "\\[INST]\n\r\t", "$1 \\1", "long " * 20_000,
]


def read_back(df):
    turns = chat.read_turns(F.col("formatted")).alias("turns")
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    return {r.key: ([tuple(t) for t in r.turns], r.loss, r.formatted) for r in df.select("key", "formatted", turns, loss).collect()}


def test_round_trip_and_mask(frame):
    rows = [(1, i, ("user", "assistant", "<|end|>", None)[i % 4], t) for i, t in enumerate(HARD)]
    rows += [(2, 0, "assistant", None), (None, 0, "user", "no id"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a")]
    rows += [(4, 0, "user", "twice")] * 2
    got = read_back(chat.format_chats(frame(rows, "conv_id bigint, turn bigint, role string, text string")))
    assert got[1][0] == [(r or "", t) for _, _, r, t in rows[: len(HARD)]]
    assert got[1][1] == "".join(t for _, _, r, t in rows[: len(HARD)] if r == "assistant")
    assert got[2][:2] == ([("assistant", "")], "")
    assert got[None][:2] == ([("user", "no id")], "")
    assert got[3][:2] == ([("assistant", "a"), ("assistant", "b")], "ab")
    assert got[4][0] == [("user", "twice")] * 2
    for control in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in got[1][2]
    assert got[1][2].count(chat.END) == len(HARD)


def test_layouts_agree(frame):
    schemas = {
        "conv_id bigint, turn bigint, role string, text string": [(1, 0, "user", "q"), (1, 1, "assistant", "a")],
        "conv_id bigint, messages array<struct<role:string,content:string>>": [(1, [("user", "q"), ("assistant", "a")])],
        "id bigint, conversations array<struct<from:string,value:string>>": [(1, [("human", "q"), ("gpt", "a")])],
        "id bigint, prompt string, response string": [(1, "q", "a")],
        "id bigint, prompt string, completion string": [(1, "q", "a")],
        "id bigint, instruction string, output string": [(1, "q", "a")],
        "id bigint, instruction string, input string, output string": [(1, "q", None, "a")],
    }
    for schema, rows in schemas.items():
        assert read_back(chat.format_chats(frame(rows, schema))) == {
            1: ([("user", "q"), ("assistant", "a")], "a", "<|start|>user<|message|>q<|end|><|start|>assistant<|message|>a<|end|>")
        }
        assert chat.format_chats(frame([], schema)).collect() == []


def test_json_records_of_mixed_layouts(frame):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"id": 3, "response": None, "prompt": "q: X, Y"},
        {"id": 4, "instruction": "i", "input": "n", "output": "o"},
        {"id": 5, "unknown": 1},
        {"conv_id": 6, "messages": []},
    ]
    rows = [(json.dumps(r),) for r in records] + [(None,), ("{broken",), ("[1]",)]
    got = chat.format_json(frame(rows, "record string"))
    by_key = {r.key: r.layout for r in got.collect()}
    assert {k: by_key[k] for k in (1, 2, 3, 4)} == {
        1: "messages", 2: "from and value", 3: "prompt and response", 4: "instruction with input",
    }
    back = read_back(got.filter("layout is not null"))
    assert back[1][0] == back[2][0] == [("user", "q"), ("assistant", "a")]
    assert back[3][0] == [("user", "q: X, Y"), ("assistant", "")]
    assert back[4][0] == [("user", "i\n\nn"), ("assistant", "o")]
    assert got.filter("layout is null and formatted = ''").count() == 5


def test_unknown_schema_is_named(frame):
    with pytest.raises(ValueError, match="surprise"):
        chat.format_chats(frame([], "conv_id bigint, surprise string"))


def test_equal_turns_are_ordered_by_role_and_text(frame):
    rows = [(1, 0, "user", t) for t in ("a!", "a", "a ", "")] + [(1, None, "user", "z"), (1, 0, "assistant", "q")]
    for order in (rows, rows[::-1]):
        told = chat.format_chats(frame(order, "conv_id bigint, turn int, role string, text string"))
        (row,) = told.select(chat.read_turns(F.col("formatted")).alias("turns")).collect()
        assert [(t.role, t.text) for t in row.turns] == [
            ("user", "z"), ("assistant", "q"), ("user", ""), ("user", "a"), ("user", "a "), ("user", "a!"),
        ]


def test_empty_frame(frame):
    assert chat.format_chats(frame([], "conv_id bigint, turn int, role string, text string")).collect() == []
