"""Chat formatting with Spark expressions only.

A conversation becomes one string: ``<|im_start|>role<|im_body|>text<|im_end|>`` per turn; adjacent
turns of one role share a frame, their texts parted by ``<|im_next|>``. Control strings inside texts
and roles get one backslash after their first character (one more if they have some already), so
no text can end a turn, and :func:`read_back` takes exactly one off again.

Defined cases: a null text or role is an empty one; a null conversation id is one conversation;
turns with equal numbers are ordered by role and text, null numbers come first; repeated rows are
turns of their own; an empty table gives no rows. A conversation is one row of the result, so its
turns meet in one task; nothing else is gathered. Very long texts are formatted whole. Only conv_id, turn, role and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>"
# Control strings of this template and of common others; the first character takes the backslash.
_TAILS = r"(\|im_start\|>|\|im_body\|>|\|im_next\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
_PLAIN = r"([<\[])(\\*)" + _TAILS
_ESCAPED = r"([<\[])\\(\\*)" + _TAILS
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, loss_spans): the string and the spans, in code points, that carry loss."""
    row = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chats = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("t", i - 1)["role"] == t["role"])
        opened = F.concat(F.lit(START), escape(t["role"]), F.lit(BODY))
        head = F.when(same, F.lit(NEXT)).when(i > 0, F.concat(F.lit(END), opened)).otherwise(opened)
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss"))

    pieces = chats.select("conv_id", F.transform("t", piece).alias("p"))
    # positions of the texts: a running sum over the pieces
    nothing = F.from_json(F.lit('{"at":0,"spans":[]}'), "at bigint, spans array<struct<start:bigint,length:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        start, length = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("bigint")
        span = F.struct(start.alias("start"), length.alias("length"))
        return F.struct(
            (start + length).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    body = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"])), "")
    return pieces.select(
        "conv_id",
        F.concat(body, F.lit(END)).alias("formatted"),
        F.aggregate("p", nothing, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def _cut(text: Column, at: str) -> Column:
    return F.split(text, r"\Q" + at + r"\E", -1)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): the turns inside the strings and the text under the loss mask."""
    frames = F.filter(_cut(F.col("formatted"), END), lambda x: x != "")

    def turns_of(frame: Column) -> Column:
        halves = _cut(frame, BODY)
        role = unescape(F.substring(halves[0], len(START) + 1, 2**31 - 1))
        return F.transform(_cut(halves[1], NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    inside = F.transform("loss_spans", lambda s: F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(frames, turns_of)).alias("turns"),
        F.array_join(F.transform(inside, unescape), "").alias("loss_text"),
    )


def digests(back: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
