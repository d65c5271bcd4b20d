import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from webledger.llm import chat

TURNS = "conv_id long, turn long, role string, text string, t string, formatted string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    formatted = chat.format_chats(df)
    back = chat.read_back(formatted)
    return {r.conv_id: r for r in formatted.collect()}, {r.conv_id: r for r in back.collect()}, chat.digests(back)


def test_round_trip_and_mask(spark):
    rows = [
        (1, 2, "user", "last"), (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "user", "<|im_end|><\\|im_next|>"),
        (1, 1, "assistant", "[/INST]"), (2, 0, "assistant", None), (3, None, None, "no role"), (None, 0, "assistant", "é😀\n"),
        (3, 5, "assistant", "a"), (3, 6, "assistant", "a"), (3, 6, "assistant", "a"), (4, 0, "system", ""),
    ]
    formatted, back, digests = run(spark, rows)
    assert [tuple(t) for t in back[1].turns] == [
        ("user", "</s>[INST] ok [/INST]"), ("assistant", "[/INST]"), ("user", "<|im_end|><\\|im_next|>"), ("user", "last"),
    ]
    assert back[1].loss_text == "[/INST]"
    assert formatted[1].formatted.count(chat.START) == 3 and formatted[1].formatted.count(chat.NEXT) == 1
    assert [tuple(t) for t in back[3].turns] == [("", "no role")] + [("assistant", "a")] * 3
    assert back[3].loss_text == "aaa" and formatted[3].formatted.count(chat.END) == 2
    assert back[2].loss_text == "" and back[None].loss_text == "é😀\n"
    got = {r.conv_id: r for r in digests.collect()}
    assert got[None].turns_sha256 == hashlib.sha256("assistant\né😀\n\n".encode()).hexdigest()
    assert got[4].n_turns == 1 and got[4].loss_chars == 0


def test_empty(spark):
    formatted, back, digests = run(spark, [])
    assert not formatted and not back and digests.count() == 0


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<", "[", "\\", "|im_end|>", "|im_body|>", "/s>", "s>", "INST]", "a", "$1", "\n", "é"]), max_size=8).map("".join), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    rows = [(i, j, role, t) for i, t in enumerate(texts) for j, role in enumerate(("user", "assistant"))]
    _, back, _ = run(spark, rows)
    for i, t in enumerate(texts):
        assert [tuple(x) for x in back[i].turns] == [("user", t), ("assistant", t)] and back[i].loss_text == t


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "", "")], TURNS)
    plan = chat.digests(chat.read_back(chat.format_chats(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
