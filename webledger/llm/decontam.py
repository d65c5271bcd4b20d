"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Items and documents are reduced to words of letters, digits and non-ASCII bytes in lower case. The
automaton's alphabet is the vocabulary of the benchmark: a document is turned into word numbers
(0: no benchmark word) and run through it once; hits are word ranges, and byte offsets of those
words in the original text are found only for documents that have hits.

The benchmark is the bounded side. Its windows are cut into blocks of at most ``BLOCK_WINDOWS``;
there is one automaton, and one scan, unless it has more windows than that, and then one scan
for each block over stored rows, so memory stays bounded whatever the benchmark's size.

Defined cases: null and empty texts have no words and no hits; an item of fewer words than a window
is one window; an item without words is never found; repeated item ids are one item; a null item id
reads as the empty string; repeated or null doc_ids are rows of their own; an empty benchmark
leaves every document clean; windows that several items share count for each of them; very long texts are scanned whole, a
few rows at a time; only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import claim, in_pieces, texts
from webledger.scale import store

WINDOW = 13
BLOCK_WINDOWS = 400_000
# A document is contaminated when at least 1/SHARE of its words are hit.
SHARE = 20

# Letters to lower case, ASCII other than letters and digits to blanks, the rest as it is.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if words and len(words) < size:
        yield tuple(words)
    for i in range(len(words) - size + 1):
        yield tuple(words[i : i + size])


def window_blocks(benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_WINDOWS) -> Iterator[dict]:
    """Distinct windows with the items that hold them, in blocks of a bounded number."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for row in texts(benchmark, "item_id").toLocalIterator():
        item = "" if row["item_id"] is None else str(row["item_id"])
        for window in windows_of(words_of(bytes(row["text"])), size):
            block.setdefault(window, set()).add(item)
            if len(block) >= limit:
                yield block
                block = {}
    if block:
        yield block


class Scanner:
    """The automaton of one block; built once in each Python worker."""

    def __init__(self, block: dict):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in block.items():
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
            self.tree.add_word(key, (len(key), len(self.items)))
            self.items.append(sorted(items))
        self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [first, end) of occurrences, and the items found."""
        number = self.number
        ranges, items = [], set()
        for end, (length, which) in self.tree.iter(tuple([number.get(w, 0) for w in words])):
            ranges.append((end - length + 1, end + 1))
            items.update(self.items[which])
        return ranges, items


_BUILT: dict[str, Scanner] = {}


def _scanner(key: str, block: dict) -> Scanner:
    claim("decontam", _BUILT.clear)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(block)
    return _BUILT[key]


def byte_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte offsets [start, end) in the original text of runs of hit words (folding keeps lengths)."""
    raw = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], raw.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    flips = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(flips[::2], flips[1::2], strict=True)]


_CARRIED = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, hits binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(key: str, shared) -> Callable:
    def run(batches):
        scanner = _scanner(key, shared.value) if shared is not None else None
        for batch in in_pieces(batches):
            bodies = batch.column("text").to_pylist()
            before = zip(batch.column("items").to_pylist(), batch.column("hits").to_pylist(), strict=True)
            out: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "items", "spans", "hits")}
            for text, (old_items, old_hits) in zip(bodies, before, strict=True):
                words = words_of(text)
                ranges, items = scanner.scan(words) if scanner and words else ([], set())
                spans, packed = [], old_hits
                hit = None
                if ranges or old_hits:
                    hit = np.zeros(len(words), bool)
                    if old_hits:
                        hit |= np.unpackbits(np.frombuffer(old_hits, np.uint8), count=len(words)).astype(bool)
                    for first, end in ranges:
                        hit[first:end] = True
                    packed = np.packbits(hit).tobytes()
                    spans = [{"start": a, "end": b} for a, b in byte_spans(text, hit)]
                out["n_words"].append(len(words))
                out["n_hit"].append(0 if hit is None else int(hit.sum()))
                out["items"].append(sorted(items.union(old_items or ())))
                out["spans"].append(spans)
                out["hits"].append(packed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_hit"], pa.int64()),
                    pa.array(out["items"], pa.list_(pa.string())),
                    pa.array(out["spans"], _SPANS),
                    pa.array(out["hits"], pa.binary()),
                ],
                names=["doc_id", "text", "n_words", "n_hit", "items", "spans", "hits"],
            )

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """(doc_id, text, n_words, n_hit, items, spans, contaminated) for every document.

    ``spans`` are byte offsets of hit passages in the UTF-8 text.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text binary, {_CARRIED}"
    state = rows.select(
        "*", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("binary").alias("hits")
    )
    done = None
    for block in window_blocks(benchmark, window, block_windows):
        source = state if done is None else store(done, "decontam").select("doc_id", "text", "items", "hits")
        shared = spark.sparkContext.broadcast(block)
        done = source.mapInArrow(_scan(uuid.uuid4().hex, shared), schema)
    if done is None:
        done = state.mapInArrow(_scan("", None), schema)
    dirty = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return done.drop("hits").withColumn("contaminated", dirty)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Rows are matched by doc_id: rows of an id of which any is contaminated go; rows without an id
    cannot be named and stay.
    """
    dirty = find_contamination(docs, benchmark).where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(docs.columns)
