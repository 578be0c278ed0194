"""Chat formatting: every layout, control strings in any place, masks against Python."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegate.llm import chat_format as C

S, E = C.START, C.END


def test_layouts(spark):
    rows = [
        ('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":null}]}', "messages", ["system:s", "user:u", "assistant:"]),
        ('{"conversations":[{"from":"human","value":"u"},{"from":"gpt","value":"a"}],"system":"s","id":7}', "from-value", ["system:s", "user:u", "assistant:a"]),
        ('{"instruction":"do","input":"it","output":"done","history":[["q","r"]]}', "instruction", ["user:q", "assistant:r", "user:do\n\nit", "assistant:done"]),
        ('{"instruction":"do","output":"done"}', "instruction", ["user:do", "assistant:done"]),
        ('{"prompt":"p","completion":"c"}', "prompt-completion", ["user:p", "assistant:c"]),
        ('{"prompt":"p","response":"","system":"s"}', "prompt-response", ["system:s", "user:p", "assistant:"]),
        ('{"question":"q","context":"c","answer":"a"}', "question-answer", ["user:c\n\nq", "assistant:a"]),
        ('{"dialogue":["x","y","z"]}', "dialogue", ["user:x", "assistant:y", "user:z"]),
        ('{"turns":[]}', "rows", []),
        ('{"prompt":"p","completion":"c","response":"r"}', None, None),
        ('{"unknown":1}', None, None),
        ("no json", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(rows)], "id long, record string")
    out = C.format_chats(C.records(df, ["id"]), ["id"]).withColumn("back", C.parse(F.col("formatted")))
    for r in out.collect():
        _, layout, turns = rows[r["id"]]
        assert r["layout"] == layout
        assert (r["turns"] and [f"{t['role']}:{t['text']}" for t in r["turns"]]) == turns
        assert r["back"] == r["turns"]


PARTS = st.sampled_from(["<|", "<", "|", "\\", S, E, "<\\|im_end|>", "<\\\\|", "\n", "%7C", "%", "assistant", "é", "𝄞", " ", ""])
WORDS = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), WORDS), st.one_of(st.none(), WORDS)), max_size=5), min_size=1, max_size=30))
def test_round_trip(spark, chats):
    rows = [(i, k, role, text) for i, chat in enumerate(chats) for k, (role, text) in enumerate(chat)]
    made = C.gather(spark.createDataFrame(rows or [(0, 0, "user", "")], "conv_id long, turn long, role string, text string"))
    out = C.format_chats(made, ["conv_id"])
    out = out.select("conv_id", "formatted", C.parse(F.col("formatted")).alias("back"), C.masked(F.col("formatted"), F.col("loss")).alias("texts"))
    want = dict(enumerate(chats)) if rows else {0: [("user", "")]}
    for r in out.collect():
        chat = [(role, text or "") for role, text in want[r["conv_id"]]]
        assert [tuple(t) for t in r["back"]] == chat
        assert r["texts"] == [t for role, t in chat if role == "assistant"]
        assert r["formatted"].count(S) == r["formatted"].count(E) == len(chat)


def test_ties_nulls_and_clashes(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, "x"), (None, 0, "assistant", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in C.format_chats(C.gather(df).withColumn("loss", F.lit(1)), ["conv_id", "loss"]).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert len(out[None]["loss"]) == 1 and out[1]["loss"] == []
    assert C.format_chats(df.limit(0).select("conv_id"), ["conv_id"]).count() == 0


@pytest.mark.parametrize("n", [C.BLOCK - 1, C.BLOCK, C.BLOCK + 1, 3000])
def test_many_turns(spark, n):
    rng = random.Random(n)
    rows = [(1, k, "assistant" if k % 2 else "user", "é" * rng.randint(0, 4)) for k in range(n)]
    out = C.format_chats(C.gather(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), ["conv_id"])
    r = out.select("formatted", "loss").first()
    data = r["formatted"].encode()
    assert [data[s["start"] : s["end"]].decode() for s in r["loss"]] == [t for _, k, _, t in rows if k % 2]
