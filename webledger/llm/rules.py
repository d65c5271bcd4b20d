"""Quality rules as a ledger of bits.

Every document is measured once; each rule sets one bit of ``fail_bits`` when it fails. Policies
are versioned sets of bits, applied later to the stored ledger without reading a text again, and
ablations are counted by bitwise tests on it.

Defined cases: a null text has no words and fails what an empty one fails; a null or repeated
doc_id is carried along, each row measured alone; a measurement equal to a rule's limit passes or fails as the rule says;
very long texts are measured whole, a few rows at a time; only doc_id and text are read, so other columns cannot clash; an
empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import SPACE, in_pieces, texts

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

# Rule names in the order of their bits, with the SQL condition under which a document fails.
# Integer arithmetic, so that every engine agrees.
RULES = {
    "few_words": "n_words < 50",
    "repetition": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
# Policies by version: the rules whose failure removes a document.
POLICIES = {
    "v1": ("few_words", "repetition"),
    "v2": ("few_words", "repetition", "symbols", "dup_lines", "short_words", "long_words", "capitals"),
}
BASE, CURRENT = "v1", "v2"


def mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = np.zeros(n, bool)
    again = np.flatnonzero(counts[which] > 1)
    for shift in range(3):
        hit[again + shift] = True
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    bare = text.translate(None, SPACE)
    continuing = len(bare) - len(bare.decode("utf-8", "replace"))
    lines = text.split(b"\n")
    worded = [line for line in lines if line.strip(SPACE)]
    return (
        len(words),
        len(bare) - continuing,
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(worded) - len(set(worded)),
        repeated_words(words),
        len(worded),
        len(text) - len(text.translate(None, _UPPER)),
    )


def _measured(batches):
    for batch in in_pieces(batches):
        found = np.array([measure(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
        columns = {"doc_id": batch.column("doc_id")} | {name: pa.array(found[:, i]) for i, name in enumerate(MEASURES)}
        yield pa.RecordBatch.from_pydict(columns)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements…, fail_bits): one pass over the texts."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = F.lit(0).cast("bigint")
    for i, condition in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0))
    return measured.withColumn("fail_bits", bits)


def fails(version: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(version)).cast("bigint")) != 0


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents it fails, and how many fail nothing else.

    Also the bits that any document fails, from one bitwise aggregate over the ledger.
    """
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("bigint"))
    names = list(RULES)
    counts = [F.bit_or(own).alias("any_bits"), F.count(F.lit(1)).alias("n_docs")]
    for rule in POLICIES[version]:
        bit = 1 << names.index(rule)
        counts.append(F.count_if(own.bitwiseAND(F.lit(bit).cast("bigint")) != 0).alias(f"{rule}_failed"))
        counts.append(F.count_if(own == bit).alias(f"{rule}_alone"))
    total = rows.agg(*counts)
    listed = F.explode(
        F.array(*[
            F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_alone").alias("n_alone"))
            for r in POLICIES[version]
        ])
    )
    return total.select(F.lit(version).alias("version"), "n_docs", "any_bits", listed.alias("r")).select(
        "version", "n_docs", "any_bits", "r.*"
    )


def verdicts(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    base = fails(BASE)
    return rows.withColumn("base_failed", base).withColumn("kept", ~(base | fails(version)))
