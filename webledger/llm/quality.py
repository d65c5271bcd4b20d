"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

One pass measures every document; the trees are fitted on at most ``learn.SAMPLE_ROWS`` labelled
training rows and applied to the stored measurements of all documents, vectorised in numpy. Ids,
labels, language and source are never measured.

Defined cases: null texts are empty ones and get a score too; null or repeated doc_ids are scored
row by row (a null id counts as the empty text when folds are dealt); without labels every score
is 0.5; with labels of one class only, scores lean to it; of equally good splits of a tree the one of the first
feature and the lowest threshold is taken; very long texts are measured whole, a few rows at a time; only doc_id, text and
the labels are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.llm import learn
from webledger.llm.common import SPACE, claim, fold, in_pieces, texts
from webledger.llm.rules import repeated_words
from webledger.scale import store

_UPPER, _DIGITS, _STOPS, _ODD = bytes(range(65, 91)), b"0123456789", b".,;:?", b"#*$%&|<>!@^_~=+{}[]\\/"
_HIGH = bytes(range(128, 256))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes) -> list[float]:
    """What the trees see of a text."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    distinct_lines = len(set(lines))
    letters = sum(map(len, words))
    return [
        float(len(words)),
        letters / n,
        _count(text, _UPPER) / size,
        text.count(b"!") / n,
        text.count(b"|") / n,
        _count(text, _ODD) / n,
        _count(text, _DIGITS) / size,
        _count(text, _STOPS) / n,
        _count(text, _HIGH) / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        repeated_words(words) / n,
        sum(map(eq, words, words[1:])) / n,
        float(len(lines)),
        (len(lines) - distinct_lines) / max(len(lines), 1),
        n / max(len(lines), 1),
        sum(1 for w in words if len(w) <= 2) / n,
        sum(1 for w in words if len(w) >= 14) / n,
        sum(1 for c in counts.values() if c == 1) / n,
    ]


def _measured(batches):
    claim("quality", int)
    for batch in in_pieces(batches):
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"]
        )


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every document, stored."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return store(rows.mapInArrow(_measured, f"doc_id {kind}, features array<double>"), "quality")


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = learn.SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    features = measure(docs)
    picked = learn.labelled_ids(labels, "quality", fold(3) != 1, sample_rows)
    trees = learn.BoostedTrees().fit(*learn.training_matrix(features, picked))
    return learn.score_all(features, fold(3) == 1, trees.predict)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    Rows are matched by doc_id: a document goes when every row of its id is rejected; rows
    without an id cannot be named and stay.
    """
    scored = score_quality(docs, labels)
    rejected = scored.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0 AND doc_id IS NOT NULL")
    return docs.join(rejected.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
