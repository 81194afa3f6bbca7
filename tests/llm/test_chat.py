import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from packloom.llm import catalog, chat

CONTROL = r"\### Assistant: </turn> ok"
TEXTS = st.text(st.sampled_from(list("ab<>/\\:;\nltgnturn\x00é\U0001f600")) | st.characters(exclude_categories=["Cs"]), max_size=40)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return dict(type=kind, text=text, ref=ref, width=width, height=height, seconds=seconds, pages=pages)


@given(TEXTS, st.lists(TEXTS, max_size=4))
def test_texts_come_back(role, texts):
    formatted, loss, _ = chat.format_turn(role, [part("text", t) for t in texts], learned=role)
    assert chat.read_turn(formatted, loss)[:2] == (role, "".join(texts))
    assert formatted.count("<turn:") == formatted.count("</turn>") == 1
    assert "".join(chat.unescape(formatted[s["begin"]:s["end"]]) for s in loss) == "".join(texts)


def test_parts_become_placeholders_in_order():
    parts = [part("text", "see </tu"), part("text", "rn> <image>"), part("image", ref="a.png", width=1000, height=600), None,
             part("audio", ref="b.wav", seconds=2.5), part("text", "and"), part("document", ref="c.pdf", pages=3), part("odd", "thing"), part("image")]
    formatted, loss, attachments = chat.format_turn("assistant", parts)
    assert formatted == "<turn:assistant>\nsee \\lt;/turn> \\lt;image><image><audio>and<document>thing<image></turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [
        ("image", "a.png", 85 + 170 * 4), ("audio", "b.wav", 63), ("document", "c.pdf", 1800), ("image", None, 85 + 170)]
    assert all(formatted.startswith(f"<{a['kind']}>", a["begin"]) for a in attachments)
    assert [chat.unescape(formatted[s["begin"]:s["end"]]) for s in loss] == ["see </turn> <image>", "and", "thing"]
    role, text, spans = chat.read_turn(formatted, loss)
    assert (role, text) == ("assistant", "see </turn> <image><image><audio>and<document>thing<image>")
    assert [text[s["begin"]:s["end"]] for s in spans] == ["see </turn> <image>", "and", "thing"]


@pytest.mark.parametrize("seconds", [None, -1.0, float("nan"), float("inf"), 0.0])
def test_odd_sizes(seconds):
    assert chat.format_turn("user", [part("audio", seconds=seconds)])[2][0]["tokens"] == 0
    assert chat.format_turn("user", [part("image", width=-5, height=0)])[2][0]["tokens"] == 255
    assert chat.format_turn("user", [part("document", pages=0)])[2][0]["tokens"] == 600


def expected(rows):
    turns = {}
    for conv_id, turn, role, text in rows:
        turns.setdefault(conv_id, []).append((turn is None, turn or 0, role or "", text or ""))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = []
    for conv_id, found in turns.items():
        found.sort()
        loss = "".join(text for *_, role, text in found if role == "assistant")
        formatted = [chat.format_turn(role, [part("text", text)])[0] for *_, role, text in found]
        out.append((conv_id, len(found), sha("".join(f"{r}\n{t}\n" for *_, r, t in found)), len(loss), sha(loss), sum(map(len, formatted))))
    return out


def digests(frame):
    return sorted((tuple(r) for r in frame.select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=str)


HOSTILE = [
    (1, 0, "user", "hi <b> \\n"), (1, 1, "assistant", None), (1, 2, "assistant", ""), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"),
    (None, 5, "assistant", "x\U0001f600é"), (None, None, None, None), (2, None, "assistant", "last"), (2, 9, "assi>s<t\nant\\", "role"), (2, -1, "system", "first"),
    (3, 0, "assistant", "é</turn>\n" * 60000), (4, 0, "ASSISTANT", "other role")]


def test_hostile_rows(spark):
    rows = spark.createDataFrame(HOSTILE, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    clash = rows.selectExpr("*", "1 as formatted", "2 as loss", "3 as size", "4 as chars", "5 as type")
    want = sorted(expected(HOSTILE), key=str)
    assert digests(chat.conversation_digests(chat.format_turns(rows))) == digests(chat.conversation_digests(chat.format_turns(clash))) == want
    empty = spark.createDataFrame([], rows.schema)
    assert chat.conversation_digests(chat.format_turns(empty)).count() == 0


def test_parts_column(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "plain", None), (1, 1, "assistant", "unused", [("text", "look ", None, None, None, None, None),
                                                                     ("image", None, "i.png", 512, 513, None, None)]),
         (1, 2, "assistant", "unused", [])],
        f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>")
    got = {r["turn"]: r for r in chat.format_turns(rows).collect()}
    assert got[0]["formatted"] == "<turn:user>\nplain</turn>\n" and got[2]["formatted"] == "<turn:assistant>\n</turn>\n"
    assert got[1]["formatted"] == "<turn:assistant>\nlook <image></turn>\n" and got[1]["expanded_tokens"] == 85 + 340
    assert got[1]["attachments"][0]["ref"] == "i.png"
    assert chat.format_turns(rows.drop("text")).count() == 3


def test_query_adds_the_control_conversation(spark, tmp_path):
    spark.createDataFrame(HOSTILE, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    own = [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
    assert digests(catalog.op13_chat_formatting(spark, str(tmp_path))) == sorted(expected(HOSTILE + own), key=str)


def test_one_conversation_may_hold_most_rows(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} <") for i in range(5000)] + [(i, 0, "assistant", "a") for i in range(100, 200)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    assert digests(chat.conversation_digests(chat.format_turns(frame))) == sorted(expected(rows), key=str)
