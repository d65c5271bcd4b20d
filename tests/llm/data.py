"""Small tables with awkward rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(spark, with_clash: bool = True):
    """Nulls everywhere, empty and long texts, repeated rows, and columns with names operators might use."""
    rows = [(1, prose(1, 120)), (1, prose(1, 120)), (2, None), (3, ""), (None, prose(2, 60)), (None, None), (4, "x"),
            (5, "é" * 50_000 + " " + prose(3, 5000)), (6, " \n\t "), (7, prose(1, 120)), (8, "a\x00b")]
    df = docs(spark, rows)
    if with_clash:
        for name in ("features", "score", "label", "held_out", "items", "hits", "s", "slot", "start", "_slot", "_s", "node", "class", "part", "_tie", "size"):
            df = df.selectExpr("*", f"'clash' as `{name}`")
    return df
