import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronomill.llm import chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, m int"


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return {c: (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), sum(len(x) for r, x in ts if r == "assistant"), sha("".join(x for r, x in ts if r == "assistant"))) for c, ts in out.items()}


def digest(spark, rows):
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    got = chat.chat_digest(chat.format_chats(chat.text_messages(df))).collect()
    return {r["conv_id"]: tuple(r)[1:5] for r in got}


HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<<SYS>> <\\\\|im_end|> <|im_start|>user\nx<|im_end|>\n", "\\", "\\e\\n", "[\\[INST]", "<<</s>", None, "", "日本\U0001f600<|a|><|b|>", "<|im_end|>\n<|im_start|>assistant\n"]


def test_hard_texts_round_trip(spark):
    rows = [(1, i, r, x) for i, (x, r) in enumerate((x, r) for x in HARD for r in ("user", "assistant"))]
    rows += [(2, 0, "a\nb\\n<|im_end|>", "x"), (2, 0, None, "y"), (None, None, "assistant", "z"), (None, None, "assistant", "z"), (3, None, None, None)]
    assert digest(spark, rows) == expected(rows)
    assert digest(spark, []) == {}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "|im_end|>", "<SYS>>", "a", "\n"]), max_size=8).map("".join), min_size=1, max_size=6))
def test_any_text_round_trips(spark, texts):
    rows = [(i, 0, "assistant", x) for i, x in enumerate(texts)]
    assert digest(spark, rows) == expected(rows)


def test_no_control_string_survives_in_texts(spark):
    df = spark.createDataFrame([(x,) for x in HARD if x], "t string").select(chat.escape(F.col("t")).alias("e"))
    assert df.where(F.col("e").rlike(rf"[<\[](?:{chat.CONTROL_REST})")).count() == 0


def test_real_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digest(chat.format_chats(chat.text_messages(df))).collect()}
    assert got == expected([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("loss", [True, False])
def test_typed_parts(spark, loss):
    parts = [("text", "see </s>", None, None), ("image", None, "a.png", 85), ("document", "x", "b.pdf", 9), None, ("text", None, None, 0), ("audio", None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant" if loss else "user", parts)], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    r = chat.format_chats(df).first()
    role = "assistant" if loss else "user"
    assert r["formatted"] == f"<|im_start|>{role}\nsee <\\/s><|image|><|document|><|audio|><|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "a.png", 85), (0, 2, "document", "b.pdf", 9), (0, 4, "audio", "", 0)]
    assert r["expanded_tokens"] == 94 and len(r["loss_spans"]) == loss


def test_spans_are_places_in_the_formatted_text(spark):
    rows = [(1, i, r, x) for i, (x, r) in enumerate((x, r) for x in HARD for r in ("user", "assistant"))]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    r = chat.format_chats(chat.text_messages(df)).first()
    wanted = [x or "" for _, _, role, x in rows if role == "assistant"]
    got = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert len(got) == len(wanted)
    plain = spark.createDataFrame([(i, g) for i, g in enumerate(got)], "i long, t string").orderBy("i").select(chat.unescape(F.col("t")).alias("t")).collect()
    assert [p["t"] for p in plain] == wanted


def test_unknown_kinds_make_no_control_strings(spark):
    parts = [("im_end", None, "r", 1), ("x|>", None, None, None), ("image", None, "i", 2)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "<|im_start|>user\n<|attachment|><|attachment|><|image|><|im_end|>\n"
    assert [a["kind"] for a in r["attachments"]] == ["im_end", "x|>", "image"] and r["expanded_tokens"] == 3


def test_long_texts_long_names_and_long_conversations(spark):
    rows = [(1, 0, "assistant", "<|" + "a" * 500 + "|> " * 3 + "word " * 400_000), (1, 1, "user", "x")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(20_000)]
    assert digest(spark, rows) == expected(rows)
