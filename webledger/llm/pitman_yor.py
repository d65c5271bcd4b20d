"""A hierarchical Pitman-Yor language model: seating by blocked Gibbs sampling, spread over words.

A word is drawn in the restaurant of its context, the word before it; the first of a text in that of the
end token, which no other word follows. The parent of a context's restaurant is that of its class (one of ``CONTEXTS``, by
the ending of the word before), so that rare words lean on words that end alike. All classes share one parent, whose
base is uniform over the training vocabulary and one unknown word. In each restaurant, for a word w
with c customers at t tables, and the chance P(w) that the parent gives it::

    p(w) = (c - d t + (s + d T) P(w)) / (s + N)

with N customers at T tables in the whole restaurant, and the tables of its children as a parent's customers.

The texts are read once. Each task numbers the words of a block of documents and keeps the documents
as word numbers; the block's words are packed by the hash part they belong to, a row per block and part. Parts
number their words, the most frequent first, so a word is a number anywhere: that in its part, and the part. With
these numbers each block counts its (word, word before) cells and packs them by the part of the word. A part
holds all counts of its words, so the seating of a word lives in one place; what couples the parts are
restaurant totals alone. The totals of the classes are summed by the driver, those of a word as a context by the part of that
word, and asked of it: before
the chain, at one table per cell, by the parts that have cells of several customers; after it, for every sample, by the
blocks. So probabilities have exactly the totals of their sample, and sum to one. During the chain,
totals of the other words stand at one table per cell (the state
of approximate distributed Gibbs sampling before its first exchange). Probabilities are averaged
over samples by the blocks that asked for them.

A sweep of the chain seats all customers of all cells anew: a cell's number of tables is drawn from its
exact conditional (``_tables``), whatever its count. There are ``BURN_IN`` + ``SAMPLES`` sweeps, each
preceded by draws of the classes' and of the shared parent's tables.

Discounts are estimated from the counts of counts of the whole training part.

Defined cases: a null text is empty and has the end token only; null or repeated doc_ids are scored
row by row (a null id counts as the empty text when folds are dealt); with no training text every
token is the unknown word with probability one; a chain has no ties to break; very
long texts are scored whole, a few rows at a time; only doc_id and text are read, so other columns cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import fold, in_pieces, texts
from webledger.scale import store, store_bucketed

# Classes of words, as contexts above the words themselves.
CONTEXTS = 128
BURN_IN, SAMPLES = 4, 4
STRENGTH = 5.0
# Tokens of a block of documents, about; what one task holds at a time.
BLOCK_TOKENS = 2_000_000
# Bytes of words that wait to be numbered together.
WORD_BYTES = 64 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # what ``_split`` does to letters
_MARKS = b".,;:!?|%$&*#\"'()"
END = b""  # words are never empty


def context_of(word: bytes) -> int:
    """The class of a word."""
    return 0 if not word else 1 + zlib.crc32(word.rstrip(_MARKS)[-2:]) % (CONTEXTS - 1)


def _zip(a: np.ndarray | bytes) -> bytes:
    return pa.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True)


def _pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, with their type and count in front."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return a.dtype.str.encode() + len(a).to_bytes(8, "little") + (_zip(planes) if len(a) else b"")


def _unpack(data: bytes) -> np.ndarray:
    kind, count = np.dtype(data[:3].decode()), int.from_bytes(data[3:11], "little")
    if not count:
        return np.empty(0, kind)
    raw = pa.decompress(data[11:], count * kind.itemsize, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, count).T.copy().view(kind).ravel()


def _whole(a: np.ndarray) -> bytes:
    """Numbers from 0 on, packed in the narrower type that holds them."""
    return _pack(a.astype(np.uint32 if not len(a) or a.max() < 1 << 32 else np.uint64))


def _numbers(data: bytes) -> np.ndarray:
    return _unpack(data).astype(np.int64)


def _steps(a: np.ndarray, sizes: np.ndarray) -> bytes:
    """Runs of growing numbers, packed as the steps between them."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.diff(a, prepend=0)
    out[starts] = a[starts]
    return _whole(out)


def _runs(data: bytes, sizes: np.ndarray) -> np.ndarray:
    steps = _numbers(data)
    upto = np.cumsum(steps)
    some = sizes[sizes > 0]
    starts = np.cumsum(some) - some
    return upto - np.repeat(upto[starts] - steps[starts], some)


_BLOCKS = "block bigint, doc_id {kind}, held_out boolean, ids binary, part int, words binary, size bigint, counts binary"


class _Block:
    """Documents of one block: word numbers, and the cells that they ask for."""

    def __init__(self, number: int, parts: int):
        self.number, self.parts = number, parts
        self.docs: list[tuple] = []
        self.words: list[pa.Array] = []
        self.coded: list[pa.DictionaryArray] = []
        self.tokens = 0

    def add(self, doc_ids: list, held_out: list, sizes: np.ndarray, words: pa.Array) -> None:
        """Documents by the numbers of their words, and all words."""
        self.docs += zip(doc_ids, held_out, sizes.tolist(), strict=True)
        self.words.append(words)
        self.tokens += len(words) + len(doc_ids)
        if sum(w.nbytes for w in self.words) > WORD_BYTES:
            self.number_words()

    def number_words(self) -> None:
        if self.words:
            self.coded.append(pa.concat_arrays(self.words).dictionary_encode())
            self.words = []

    def rows(self, names: list[str], schema: pa.Schema):
        self.number_words()
        coded = pa.chunked_array(self.coded).unify_dictionaries()
        words = [END, *coded.chunk(0).dictionary.to_pylist()]
        sizes = np.array([size for _, _, size in self.docs])
        ids = np.concatenate([x.indices.to_numpy() for x in coded.chunks]) + 1
        # every text ends with the end token
        ids = np.insert(ids, np.cumsum(sizes), 0)
        part = np.array([zlib.crc32(w) % self.parts for w in words])
        order = np.argsort(part, kind="stable")
        renamed = np.empty(len(words), np.int32)
        renamed[order] = np.arange(len(words), dtype=np.int32)
        train = np.repeat([not held_out for _, held_out, _ in self.docs], sizes + 1)
        counts = np.bincount(ids[train], minlength=len(words))[order]
        ids = renamed[ids]
        ends = np.cumsum(sizes + 1)
        columns: dict[str, list] = {n: [] for n in ("block", "doc_id", "held_out", "ids")}
        for (doc_id, held_out, size), end in zip(self.docs, ends.tolist(), strict=True):
            columns["block"].append(self.number)
            columns["doc_id"].append(doc_id)
            columns["held_out"].append(held_out)
            columns["ids"].append(_pack(ids[end - size - 1 : end]))
        yield _batch(columns, names, schema)
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        columns = {n: [] for n in ("block", "part", "words", "size", "counts")}
        for p in np.flatnonzero(np.diff(cuts)):
            joined = b" ".join([words[i] for i in order[cuts[p] : cuts[p + 1]]])
            columns["block"].append(self.number)
            columns["part"].append(int(p))
            columns["words"].append(_zip(joined) if joined else b"")
            columns["size"].append(len(joined))
            columns["counts"].append(_whole(counts[cuts[p] : cuts[p + 1]]))
        yield _batch(columns, names, schema)


def _batch(columns: dict[str, list], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), schema.field(c).type) for c in names], schema=schema)


class _Cells:
    """The cells that a block's documents ask for, in the order of (part of the word, its number, number of the word before).

    ``part`` and ``number`` are those of the block's words; a word as a context is ``number * parts + part``.
    """

    def __init__(self, all_ids: list[np.ndarray], part: np.ndarray, number: np.ndarray, parts: int):
        order = np.lexsort((number, part))
        self.part, self.number = part[order], number[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.sizes = np.array([len(a) for a in all_ids])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = rank[np.concatenate(all_ids)]
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.ids[:-1]
        # a text ends with the end token, and begins as if after one
        before[0] = self.ids[-1]
        name = self.number * parts + self.part
        by_name = np.argsort(name)
        place = np.empty(len(order), np.int64)
        place[by_name] = np.arange(len(order))
        cells, self.back = np.unique(self.ids * len(order) + place[before], return_inverse=True)
        self.word, self.before = cells // len(order), by_name[cells % len(order)]
        self.context = name[self.before]

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and class of the distinct (word, class of the word before), and which of them each cell belongs to."""
        found, up = np.unique(self.word * CONTEXTS + self.number[self.before] % CONTEXTS, return_inverse=True)
        return found // CONTEXTS, found % CONTEXTS, up


def _ids_of(numbered: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Part and number of a block's words, in the order of the block."""
    rows = sorted(numbered.select(["part", "numbers"]).to_pylist(), key=lambda r: r["part"])
    numbers = [_numbers(r["numbers"]) for r in rows]
    return np.repeat(np.array([r["part"] for r in rows], np.int64), [len(n) for n in numbers]), np.concatenate(numbers)


def _split(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of words of texts in UTF-8, and the words, in lower-case."""
    # only seen as a string: nothing looks beyond ASCII
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.view(pa.string())))
    words = lists.flatten().view(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return np.diff(upto[ends], prepend=0), words.filter(real)


def _blocked(parts: int, names: list[str], schema: pa.Schema):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        block = _Block(number, parts)
        for batch in in_pieces(batches):
            doc_ids, held_out = (batch.column(c).to_pylist() for c in ("doc_id", "held_out"))
            sizes, words = _split(batch.column("text"))
            upto = np.concatenate(([0], np.cumsum(sizes)))
            done = 0
            while done < len(sizes):
                # all that fit, and the one that fills the block
                tokens = block.tokens + np.cumsum(sizes[done:] + 1)
                cut = done + min(int(np.searchsorted(tokens, BLOCK_TOKENS)) + 1, len(tokens))
                block.add(doc_ids[done:cut], held_out[done:cut], sizes[done:cut], words.slice(upto[done], upto[cut] - upto[done]))
                done = cut
                if block.tokens >= BLOCK_TOKENS:
                    yield from block.rows(names, schema)
                    number += 1
                    block = _Block(number, parts)
        if block.docs:
            yield from block.rows(names, schema)

    return run


def _number(table: pa.Table) -> pa.Table:
    """The words of a part in numbers, the most frequent of a class first: a row for every block that has some.

    What a number leaves over when divided by ``CONTEXTS`` is the word's class.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    index: dict[bytes, int] = {}
    asked, counts = [], []
    for r in rows:
        joined = pa.decompress(r["words"], r["size"], "zstd", asbytes=True) if r["size"] else b""
        words = joined.split(b" ")
        asked.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        counts.append(_numbers(r["counts"]))
    total = np.bincount(np.concatenate(asked), np.concatenate(counts), len(index))
    kind = np.array([context_of(w) for w in index], np.int64)
    order = np.lexsort((-total, kind))
    sizes = np.bincount(kind)
    number = np.empty(len(index), np.int64)
    number[order] = (np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * CONTEXTS + kind[order]
    return pa.table({
        "block": pa.array([r["block"] for r in rows], pa.int64()),
        "part": pa.array([r["part"] for r in rows], pa.int32()),
        "numbers": pa.array([_whole(number[a]) for a in asked], pa.binary()),
    })


_ASKED = "block bigint, part int, words binary, n_cells binary, contexts binary, counts binary"


def _counted(parts: int):
    """The cells of a block with their training counts, packed by the part of the word."""

    def run(docs: pa.Table, numbered: pa.Table) -> pa.Table:
        docs = docs.select(["block", "held_out", "ids"]).to_pydict()
        cells = _Cells([_unpack(x) for x in docs["ids"]], *_ids_of(numbered), parts)
        train = np.repeat(~np.array(docs["held_out"], bool), cells.sizes)
        counts = np.bincount(cells.back, train, len(cells.word)).astype(np.int64)
        n_cells = np.bincount(cells.word, minlength=len(cells.part))
        found = np.unique(cells.part)
        low, high = np.searchsorted(cells.part, found), np.searchsorted(cells.part, found, side="right")
        first, last = np.searchsorted(cells.word, low), np.searchsorted(cells.word, high)
        words = [slice(a, b) for a, b in zip(low, high, strict=True)]
        inside = [slice(a, b) for a, b in zip(first, last, strict=True)]
        return pa.table({
            "block": pa.array(np.full(len(found), docs["block"][0], np.int64)),
            "part": pa.array(found.astype(np.int32)),
            "words": pa.array([_steps(cells.number[x], np.array([x.stop - x.start])) for x in words], pa.binary()),
            "n_cells": pa.array([_whole(n_cells[x]) for x in words], pa.binary()),
            "contexts": pa.array([_steps(cells.context[y], n_cells[x]) for x, y in zip(words, inside, strict=True)], pa.binary()),
            "counts": pa.array([_whole(counts[y]) for y in inside], pa.binary()),
        })

    return run


_MERGED = (
    "part int, names binary, n_cells binary, contexts binary, counts binary, "
    "blocks binary, words_each binary, cells_each binary, asked_words binary, asked_cells binary, stats array<bigint>"
)


def _merge(parts: int):
    """All rows of a part: the cells of its words with training counts, and who asked for which."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        asked, each, context, counts = [], [], [], []
        for r in rows:
            n_cells = _numbers(r["n_cells"])
            asked.append(_runs(r["words"], np.array([len(n_cells)])))
            each.append(n_cells)
            context.append(_runs(r["contexts"], n_cells))
            counts.append(_numbers(r["counts"]))
        words_each, cells_each = (np.array([len(a) for a in some], np.int64) for some in (asked, counts))
        names, asked_words = np.unique(np.concatenate(asked), return_inverse=True)
        word, context = np.repeat(asked_words, np.concatenate(each)), np.concatenate(context)
        most = int(context.max()) + 1
        cells, back = np.unique(word * most + context, return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), len(cells)).astype(np.int64)
        word, context = cells // most, cells % most
        n_cells = np.bincount(word)
        total = np.bincount(word, count)
        live = count > 0
        kind = context[live] // parts % CONTEXTS
        above, opened = np.unique(word[live] * CONTEXTS + kind, return_counts=True)
        kinds = np.bincount(above // CONTEXTS, minlength=len(names))
        ones = lambda *some: [(x == n).sum() for x in some for n in (1, 2)]
        stats = [(total > 0).sum(), *ones(kinds, opened, count), total.sum()]
        stats += [*np.bincount(kind, minlength=CONTEXTS), *np.bincount(above % CONTEXTS, minlength=CONTEXTS)]
        out = {
            "part": [rows[0]["part"]],
            "names": [_steps(names, np.array([len(names)]))],
            "n_cells": [_whole(n_cells)],
            "contexts": [_steps(context, n_cells)],
            "counts": [_whole(count)],
            "blocks": [_pack(np.array([r["block"] for r in rows], np.int64))],
            "words_each": [_pack(words_each)],
            "cells_each": [_pack(cells_each)],
            "asked_words": [_steps(asked_words, words_each)],
            "asked_cells": [_steps(back, cells_each)],
            "stats": [[int(x) for x in stats]],
        }
        types = {"part": pa.int32(), "stats": pa.list_(pa.int64())}
        return pa.table({n: pa.array(v, types.get(n, pa.binary())) for n, v in out.items()})

    return run


class _Part:
    """The cells of a part's words, and the contexts in which training text has them, by part and number."""

    def __init__(self, row: dict, parts: int):
        self.part, self.parts = row["part"], parts
        n_cells = _numbers(row["n_cells"])
        self.n_words = len(n_cells)
        self.word = np.repeat(np.arange(self.n_words), n_cells)
        self.count = _numbers(row["counts"])
        name = _runs(row["contexts"], n_cells)
        self.kind = name // parts % CONTEXTS
        live = self.count > 0
        most = int(name.max()) // parts + 1
        found, back, self.opened = np.unique(name[live] % parts * most + name[live] // parts, return_inverse=True, return_counts=True)
        # of the contexts of live cells; the others are never looked at
        self.context = np.zeros(len(name), np.int64)
        self.context[live] = back
        self.owner, self.number = found // most, found % most
        # whose totals have a say in the chain
        self.wanted = np.bincount(back, self.count[live] > 1, len(found)) > 0

    def by_owner(self):
        """(part, its slice of the contexts)."""
        owners = np.unique(self.owner)
        ends = np.searchsorted(self.owner, owners, side="right")
        for owner, first, last in zip(owners, np.searchsorted(self.owner, owners), ends, strict=True):
            yield int(owner), slice(int(first), int(last))


def _opened(parts: int):
    """What each part says to each other one: in how many cells the other's words are contexts, and which totals it wants."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = _Part(row, parts)
                rows = [
                    (owner, part.part, _steps(part.number[x], np.array([x.stop - x.start])), _whole(part.opened[x]), _pack(part.wanted[x]))
                    for owner, x in part.by_owner()
                ]
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([r[0] for r in rows], pa.int32()),
                        "asker": pa.array([r[1] for r in rows], pa.int32()),
                        "numbers": pa.array([r[2] for r in rows], pa.binary()),
                        "opened": pa.array([r[3] for r in rows], pa.binary()),
                        "wanted": pa.array([r[4] for r in rows], pa.binary()),
                    })

    return run


def _summed(numbers: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(numbers), np.concatenate(values)).astype(np.int64)


def _open(table: pa.Table) -> pa.Table:
    """Tables of a part's words as contexts, at one per cell, to the parts that want them."""
    rows = table.to_pylist()
    opened = [_numbers(r["opened"]) for r in rows]
    numbers = [_runs(r["numbers"], np.array([len(o)])) for r, o in zip(rows, opened, strict=True)]
    tables = _summed(numbers, opened)
    wanted = [_unpack(r["wanted"]) for r in rows]
    return pa.table({
        "part": pa.array([r["asker"] for r in rows], pa.int32()),
        "owner": pa.array([r["part"] for r in rows], pa.int32()),
        "tables": pa.array([_whole(tables[n[w]]) for n, w in zip(numbers, wanted, strict=True)], pa.binary()),
    })


class Totals:
    """What is known of the whole corpus: counts, discounts, tables at one per cell."""

    def __init__(self, stats: np.ndarray, contexts: int = CONTEXTS):
        self.vocabulary = int(stats[0])
        ratio = lambda one, two: float(np.clip(one / (one + 2.0 * two), 0.1, 0.95)) if one + two else 0.5
        self.root_discount, self.discount = ratio(stats[1], stats[2]), ratio(stats[3], stats[4])
        self.customers = stats[5 : 5 + contexts].astype(float)
        self.tables = stats[5 + contexts :].astype(float)
        self.tokens = int(self.customers.sum())
        self.everyone = float(self.tables.sum())
        self.base = 1.0 / (self.vocabulary + 1)

    @classmethod
    def with_classes(cls, stats: np.ndarray) -> Totals:
        """From the sums of what ``_merge`` has found; the contexts of a part are to follow (see :meth:`of`)."""
        customers, tables = stats[8 : 8 + CONTEXTS].astype(float), stats[8 + CONTEXTS :].astype(float)
        out = cls(np.concatenate((stats[[0, 1, 2, 5, 6, 7]], [tables.sum()])), contexts=1)
        out.class_discount = cls(np.concatenate((stats[[0, 1, 2, 3, 4, 7]], [0])), contexts=1).discount
        out.class_customers, out.class_tables = customers, tables
        return out

    def of(self, tables: np.ndarray) -> Totals:
        """The same with the tables of the contexts that one part has to do with."""
        out = copy(self)
        out.tables = tables.astype(float)
        return out


def _sequential(rng: np.random.Generator, c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """Tables of c customers seated one after another, in runs of doubling length."""
    t, seated = np.ones(len(c), np.int64), 1
    while (more := c > seated).any():
        run = np.minimum(c[more], 2 * seated) - seated
        chance = new[more] / (new[more] + np.maximum(seated + run / 2 - d * t[more], 1e-9))
        t[more] += rng.binomial(run, np.minimum(chance, 1.0))
        seated *= 2
    return np.minimum(t, np.maximum(c, 1))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series beyond 10."""
    low = np.flatnonzero(x < 10)
    shift, x = np.ones(len(low)), x.copy()
    for _ in range(10 if len(low) else 0):
        shift *= x[low]
        x[low] += 1
    out = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    out[low] -= np.log(shift)
    return out


_FEW = 64
# Beyond so much a new table weighs, powers of its weight are kept as logarithms.
_HEAVY = 1e4


def _log_stirling(d: float) -> np.ndarray:
    """Logarithms of generalized Stirling numbers S_d(c, t) for c and t up to ``_FEW``."""
    out = np.full((_FEW + 1, _FEW + 1), -np.inf)
    out[1, 1] = 0.0
    for m in range(1, _FEW):
        t = np.arange(1, m + 1)
        out[m + 1, 1 : m + 1] = out[m, 1 : m + 1] + np.log(m - d * t)
        out[m + 1, 1:] = np.logaddexp(out[m + 1, 1:], out[m, :-1])
    return out


def _tables(rng: np.random.Generator, c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """Tables of every cell, drawn anew and exactly given its customers c and the weight ``new`` of a new table.

    The chance of t tables goes with new^t S_d(c, t), S_d being generalized Stirling numbers: what single
    customers who get up and sit down again come to after any number of rounds.
    """
    t = np.ones(len(c), np.int64)
    kinds = np.where((c > 1) & (c <= _FEW), c, 0).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    order = order[np.searchsorted(kinds[order], 1) :]
    if len(order):
        t[order] = _few_tables(rng.random(len(order)), kinds[order], new[order], d)
    many = np.flatnonzero(c > _FEW)
    if len(many):
        t[many] = _many_tables(rng, c[many].astype(float), new[many], d)
    return t


def _few_tables(u: np.ndarray, c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """``_tables`` of 2 to ``_FEW`` customers, the fewest first: where the chances of 1, 2, 3... tables sum up to ``u``."""
    t = np.ones(len(c), np.int64)
    stirling = _log_stirling(d)
    heavy = new > _HEAVY
    for i in np.flatnonzero(heavy):
        logs = np.log(new[i]) * np.arange(1, c[i] + 1) + stirling[c[i], 1 : c[i] + 1]
        upto = np.cumsum(np.exp(logs - logs.max()))
        t[i] += (upto < u[i] * upto[-1]).sum()
    # by tables and customers, with one table as one
    share = np.vstack((np.zeros(_FEW + 1), np.exp(stirling[1:] - stirling[1:, 1:2]))).T.copy()
    weight, whole = np.where(heavy, 0.0, new), np.zeros(len(c))
    cuts = np.searchsorted(c, np.arange(_FEW + 1, dtype=c.dtype))
    for n in range(int(c[-1]), 0, -1):
        some = slice(cuts[n], None)
        whole[some] = whole[some] * weight[some] + share[n][c[some]]
    on = np.flatnonzero(~heavy)
    goal, seen, power, n = (u * whole)[on], np.ones(len(on)), np.ones(len(on)), 1
    weight, c = weight[on], c[on]
    # a sum's last digits may say otherwise, but c customers have c tables at most
    while (more := (seen < goal) & (c > n)).any():
        on, goal, seen, power, weight, c = (x[more] for x in (on, goal, seen, power, weight, c))
        n += 1
        t[on] = n
        power = power * weight
        seen = seen + power * share[n][c]
    return t


# Cells of more tables than this, about, are drawn by their chances, not table by table.
_STEPS = 200


def _expected(c: np.ndarray, new: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """About how many tables c customers have: where new^t S_d(c, t) is largest; and 1 - z at the saddle point that says so."""
    low, high = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(40):
        w = (low + high) / 2
        beyond = np.log(new) + (d - 1) * w + np.log(-np.expm1(w)) > np.log(c)
        low, high = np.where(beyond, w, low), np.where(beyond, high, w)
    return np.clip(-new / d * np.expm1(d * high), 1, c), np.exp(high)


def _by_chances(u: float, c: float, new: float, d: float, about: float, saddle: float) -> int:
    """``_tables`` of one cell of many tables: the chances of all numbers that have any, summed up to ``u``.

    S_d(c, t) is c! / (t! d^t) times the coefficient of z^c in (1 - (1 - z)^d)^t. Cauchy's integral for it
    goes around the cut from 1 on, along a parabola through (about) the saddle point, where the trapezoidal rule has the
    precision of the numbers themselves. One path does for all t in question.
    """
    # 1 - z of the path's vertex: no nearer to the cut than the integrand can tell
    vertex = max(saddle, min(4.0 / c, 0.5))
    # steps are small against the integrand's width there
    power = vertex**d
    bend = about * d * power * (1 - d + (2 * d - 1) * power) / (1 - power) ** 2 + c * (vertex / (1 - vertex)) ** 2
    at = np.arange(400.0) * min(0.12, 0.2 / np.sqrt(bend))
    w = vertex * (1 + 1j * at) ** 2
    base, rest = np.log(1 - w**d), np.log(1 + 1j * at) - (c + 1) * np.log1p(-w)
    height = (about * base + rest).real
    near = height > height[0] - 45
    base, rest, top, here = base[near], rest[near], base[0].real, rest[0].real
    rest[0] -= np.log(2)
    width = 10 * np.sqrt(about) + 20
    while True:
        t = np.arange(max(1.0, np.floor(about - width)), min(c, np.ceil(about + width)) + 1)
        lead = t * (np.log(new / d) + top) - _log_gamma(t + 1)
        some = np.array_split(t, len(t) // 2000 + 1)
        value = np.concatenate([np.exp(x[:, None] * (base - top) + (rest - here)).real.sum(1) for x in some])
        upto = np.cumsum(np.exp(lead - lead.max()) * np.maximum(value, 0))
        first, last = upto[0], upto[-1] - upto[-2]
        if max(first * (t[0] > 1), last * (t[-1] < c)) < 1e-13 * upto[-1]:
            return int(t[np.searchsorted(upto, u * upto[-1])])
        width *= 2


def _many_tables(rng: np.random.Generator, c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """``_tables`` by rejection, with a step for each table, not for each customer.

    A restaurant of its own with strength q gives t tables with a chance that goes with
    (q + d) (q + 2 d) ... (q + (t - 1) d) S_d(c, t); how far the chance wanted is above that has its maximum
    where q + d t is ``new``. Of some strengths, the one that turns the fewest tries down is taken. With t
    tables and m customers, those to come open the next table as if each did so with one chance, drawn from
    Beta(q + d t, m - d t). A try is given up when no later table can make it pass. ``e`` is q + d.
    Cells of very many tables, for which steps would take long, are drawn by their chances, unless most customers have
    tables of their own.
    """
    t = np.zeros(len(c), np.int64)
    about, saddle = _expected(c, new, d)
    by_steps = (about <= _STEPS) | (saddle > 0.5)
    large = np.flatnonzero(~by_steps)
    for i, u in zip(large, rng.random(len(large)), strict=True):
        t[i] = _by_chances(u, c[i], new[i], d, about[i], saddle[i])

    every = np.flatnonzero(by_steps)
    own, weight = c[every], new[every]
    lead = np.log(weight / d)

    def peak(e):
        best = np.minimum(np.floor((weight - e) / d) + 2, own)
        return best * lead + _log_gamma(e / d) - _log_gamma(e / d + (best - 1))

    # among 25 strengths, every fourth, and nearer and nearer to the best so far: there is one minimum
    shares, best, least = np.geomspace(1e-3, 1.0, 25), np.zeros(len(every), np.int64), np.full(len(every), np.inf)
    for near in (lambda: range(0, 25, 4), lambda: (best - 2, best + 2), lambda: (best - 1, best + 1)):
        for k in near():
            k = np.clip(k, 0, 24)
            tried = weight * shares[k]
            cost = peak(tried) + _log_gamma(tried - d + own) - _log_gamma(tried + 1 - d)
            best, least = np.where(cost < least, k, best), np.minimum(cost, least)
    e, first = np.empty(len(c)), np.empty(len(c))
    e[every] = weight * shares[best]
    first[every] = lead - peak(e[every])
    while len(every):
        # several tries at once for the last few cells
        cell = np.repeat(every, max(1, min(64, 4096 // len(every))))
        fate = np.log(1.0 - rng.random(len(cell)))
        now, drawn = first[cell], np.ones(len(cell), np.int64)
        on, m, n = np.arange(len(cell)), np.ones(len(cell)), 1
        at, most, start, gain = now.copy(), c[cell], e[cell], np.log(new[cell] / d)
        while len(on):
            chance = rng.beta(start + d * (n - 1), m - d * n)
            with np.errstate(divide="ignore"):
                m += 1 + np.floor(np.log(1.0 - rng.random(len(on))) / np.log1p(-np.maximum(chance, 1e-300)))
            kept = m <= most
            now[on], drawn[on] = at, n
            if not kept.all():
                on, m, at, most, start, gain = (x[kept] for x in (on, m, at, most, start, gain))
            step = gain - np.log(start / d + (n - 1))
            at += step
            n += 1
            kept = (step > 0) | (at >= fate[on])
            if not kept.all():
                lost = on[~kept]
                now[lost], drawn[lost] = at[~kept], n
                on, m, at, most, start, gain = (x[kept] for x in (on, m, at, most, start, gain))
        taken = now >= fate
        found, tries = np.unique(cell[taken], return_index=True)
        t[found] = drawn[taken][tries]
        every = np.setdiff1d(every, found, assume_unique=True)
    return t


def _sizes(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each table, its customers): Dirichlet shares of the customers beyond one a table."""
    cell = np.repeat(np.arange(len(c)), t)
    share = rng.gamma(1.0 - d, size=len(cell)) + 1e-12
    ends = np.cumsum(t)
    running = np.cumsum(share)
    before = np.concatenate(([0.0], running))[ends - t][cell]
    whole = np.bincount(cell, share, len(c))[cell]
    upto = np.floor((running - before) / whole * (c - t)[cell] + 1e-9).astype(np.int64)
    upto[ends - 1] = c - t
    size = np.diff(upto, prepend=0)
    size[ends - t] = upto[ends - t]
    return cell, size + 1


class Chain:
    """The seating of one part's words; iterating runs the Gibbs sampler and gives its samples."""

    def __init__(
        self, part: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, totals: Totals, kind: np.ndarray | None = None
    ):
        self.rng = np.random.default_rng([part, 20_011])
        self.totals = totals
        self.live = np.flatnonzero(count > 0)
        self.word, self.context, self.count = word[self.live], context[self.live], count[self.live]
        self.n_words = n_words
        # whose tables are customers of the shared parent: cells, or those of the classes above them
        self.top_word, self.classes = self.word, None
        if kind is not None:
            found, self.up = np.unique(self.word * CONTEXTS + kind[self.live], return_inverse=True)
            self.top_word, self.classes = found // CONTEXTS, found % CONTEXTS
            self.class_customers, self.class_tables = np.bincount(self.up, minlength=len(found)), np.ones(len(found), np.int64)

    def root(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers of the parent per word, and tables at which they sit (drawn anew)."""
        o = self.totals
        r = np.bincount(self.top_word, t, self.n_words).astype(np.int64)
        new = np.full(self.n_words, (STRENGTH + o.root_discount * o.vocabulary) * o.base)
        return r, np.where(r > 0, _tables(self.rng, r, new, o.root_discount), 0)

    def samples(self):
        """(tables per live cell, parent customers per word, parent tables per word) of each sample.

        With classes, ``class_customers`` and ``class_tables`` are those of the same sample.
        """
        o, rng, d = self.totals, self.rng, self.totals.discount
        t = np.ones(len(self.live), np.int64)
        # the others have one table, whatever is drawn
        multi = np.flatnonzero(self.count > 1)
        c, open_new = self.count[multi], STRENGTH + d * o.tables[self.context[multi]]
        if self.classes is not None:
            up = self.up[multi]
            single = np.bincount(self.up, self.count == 1, len(self.classes)).astype(np.int64)
        everyone = STRENGTH + o.everyone
        r = s = None

        def parent():
            smooth = (STRENGTH + o.root_discount * o.vocabulary) * o.base
            return (r - o.root_discount * s + smooth) / everyone

        def above():
            """What the restaurants above the cells of several customers, drawn anew, say of the cells' words."""
            nonlocal r, s
            if self.classes is None:
                r, s = self.root(t)
                return parent()[self.word[multi]]
            if r is None:
                r, s = self.root(self.class_tables)
            e, new = o.class_discount, STRENGTH + o.class_discount * o.class_tables[self.classes]
            self.class_customers = single + np.bincount(up, t[multi], len(self.classes)).astype(np.int64)
            self.class_tables = _tables(rng, self.class_customers, new * parent()[self.top_word], e)
            r, s = self.root(self.class_tables)
            chance = self.class_customers - e * self.class_tables + new * parent()[self.top_word]
            return (chance / (STRENGTH + o.class_customers[self.classes]))[up]

        t[multi] = _sequential(rng, c, open_new * above(), d)
        for step in range(BURN_IN + SAMPLES):
            t[multi] = _tables(rng, c, open_new * above(), d)
            if step >= BURN_IN:
                above()
                yield t.copy(), r, s

    @staticmethod
    def _reseat(rng, cell, size, c, new, d, times: int = 4):
        """In every cell: one customer, picked at random, gets up and sits down again; some times over.

        Not part of the chain: tests hold ``_tables`` against many such moves.
        """
        for _ in range(times):
            tables = np.bincount(cell, minlength=len(c))
            ends = np.cumsum(tables)
            upto = np.cumsum(size)
            floor = np.concatenate(([0], upto))[ends - tables]
            left = np.searchsorted(upto, floor + rng.integers(0, c), side="right")
            size = size.copy()
            size[left] -= 1
            gone = size[left] == 0
            weight = np.maximum(size - d, 0.0)
            old = np.bincount(cell, weight, len(c))
            fresh = rng.random(len(c)) * (new + old) < new
            running = np.cumsum(weight)
            low = np.concatenate(([0.0], running))[ends - tables]
            to = np.searchsorted(running, low + rng.random(len(c)) * old, side="right")
            to = np.clip(to, ends - tables, ends - 1)
            # a rounding error must not seat anyone at an empty table
            fresh |= size[to] == 0
            size[to[~fresh]] += 1
            size[left[fresh & gone]] = 1
            added = np.flatnonzero(fresh & ~gone)
            cell, size = np.concatenate((cell, added)), np.concatenate((size, np.ones(len(added), size.dtype)))
            kept = size > 0
            cell, size = cell[kept], size[kept]
            order = np.argsort(cell, kind="stable")
            cell, size = cell[order], size[order]
        return cell, size


_SEATED = (
    "block bigint, part int, counts binary, customers binary, tables binary, cells binary, seats binary, "
    "few binary, class_customers binary, class_tables binary, numbers binary, sums array<bigint>"
)


def _seated(totals: Totals, parts: int):
    """Runs the chain of a part. Rows for the blocks (of their words: training count, customers and tables at the shared parent in
    each sample; of these by class: customers, 2 for more, and where there are more, customers and tables in each sample; of their
    cells: count, and tables of all samples where there is a choice), for the parts (tables of their words as contexts in each
    sample), and one with the sums of each sample: customers and tables of every class, parent tables.
    """

    def run(merged: pa.Table, opened: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _SEATED.split(", ")}

        def add(**values) -> None:
            for name, column in out.items():
                column.append(values.get(name))

        for row in merged.to_pylist():
            part = _Part(row, parts)
            replies = sorted(opened.to_pylist(), key=lambda r: r["owner"])
            tables = np.ones(len(part.number))
            if replies:
                tables[part.wanted] = np.concatenate([_numbers(r["tables"]) for r in replies])
            chain = Chain(part.part, part.word, part.context, part.count, part.n_words, totals.of(tables), part.kind)
            by_class = chain.top_word * CONTEXTS + chain.classes
            seats = np.zeros(len(part.word), np.int64)
            customers, at_parent, found, in_class, at_class, sums = [], [], [], [], [], []
            for t, r, s in chain.samples():
                seats[chain.live] += t
                customers.append(r)
                at_parent.append(s)
                found.append(np.bincount(chain.context, t, len(part.number)).astype(np.int64))
                in_class.append(chain.class_customers)
                at_class.append(chain.class_tables)
                for x in (in_class[-1], at_class[-1]):
                    sums += [int(n) for n in np.bincount(chain.classes, x, CONTEXTS)]
                sums.append(int(s.sum()))
            add(sums=sums)
            found, customers, at_parent, in_class, at_class = (np.array(x) for x in (found, customers, at_parent, in_class, at_class))
            few = np.minimum(in_class.max(0), 2) if len(by_class) else np.zeros(0, np.int64)
            for owner, x in part.by_owner():
                add(part=owner, tables=_whole(found[:, x].ravel()), numbers=_steps(part.number[x], np.array([x.stop - x.start])))
            total = np.bincount(part.word, part.count, part.n_words).astype(np.int64)
            words_each, cells_each = _unpack(row["words_each"]), _unpack(row["cells_each"])
            words, cells = _runs(row["asked_words"], words_each), _runs(row["asked_cells"], cells_each)
            w, c = (np.concatenate(([0], np.cumsum(x))) for x in (words_each, cells_each))
            for i, block in enumerate(_unpack(row["blocks"])):
                word, cell = words[w[i] : w[i + 1]], cells[c[i] : c[i + 1]]
                count = part.count[cell]
                asked = np.unique(part.word[cell] * CONTEXTS + part.kind[cell])
                at = np.searchsorted(by_class, asked)
                known = np.zeros(len(asked), bool)
                known[at < len(by_class)] = by_class[at[at < len(by_class)]] == asked[at < len(by_class)]
                kinds = np.zeros(len(asked), np.uint8)
                kinds[known] = few[at[known]]
                more = at[kinds == 2]
                add(
                    block=int(block), part=part.part, counts=_whole(total[word]), customers=_whole(customers[:, word].ravel()),
                    tables=_whole(at_parent[:, word].ravel()), cells=_whole(count), seats=_whole(seats[cell[count > 1]]),
                    few=_pack(kinds), class_customers=_whole(in_class[:, more].ravel()), class_tables=_whole(at_class[:, more].ravel()),
                )
        types = {"block": pa.int64(), "part": pa.int32(), "sums": pa.list_(pa.int64())}
        return pa.table({n: pa.array(v, types.get(n, pa.binary())) for n, v in out.items()})

    return run


_TOTALLED = "block bigint, part int, restaurants binary"


def _totalled(merged: pa.Table, seated: pa.Table) -> pa.Table:
    """Tables of a part's words as contexts in each sample, to the blocks that have these words."""
    numbers, tables = [], []
    for r in seated.to_pylist():
        found = _numbers(r["tables"]).reshape(SAMPLES, -1)
        numbers.append(_runs(r["numbers"], np.array([found.shape[1]])))
        tables.append(found)
    blocks, parts, answers = [], [], []
    for row in merged.to_pylist():
        words_each = _unpack(row["words_each"])
        words = _runs(row["asked_words"], words_each)
        names = _runs(row["names"], np.array([int(words.max()) + 1]))
        whole = np.zeros((SAMPLES, len(names)), np.int64)
        for n, t in zip(numbers, tables, strict=True):
            whole[:, np.searchsorted(names, n)] += t
        ends = np.cumsum(words_each)
        for block, first, last in zip(_unpack(row["blocks"]), ends - words_each, ends, strict=True):
            blocks.append(int(block))
            parts.append(row["part"])
            answers.append(_whole(whole[:, words[first:last]].ravel()))
    return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array(parts, pa.int32()), "restaurants": pa.array(answers, pa.binary())})


def _scores(totals: Totals, sampled: np.ndarray, parts: int):
    """Scores of a block's documents; ``sampled``: of each sample, customers and tables of every class, and all parent tables."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        told = sorted(answers.to_pylist(), key=lambda r: r["part"])
        columns = lambda name: [_numbers(r[name]) for r in told if r[name] is not None]
        by_sample = lambda name: np.concatenate([x.reshape(SAMPLES, -1) for x in columns(name)], 1)
        all_ids = [_unpack(x) for x in docs.column("ids").to_pylist()]
        numbered = answers.filter(answers.column("numbers").is_valid())
        cells = _Cells(all_ids, *_ids_of(numbered), parts)
        counts, own = np.concatenate(columns("counts")), np.concatenate(columns("cells"))
        if len(counts) != len(cells.part) or len(own) != len(cells.word):
            raise ValueError("a block's answers do not fit its documents")
        d, e, root = totals.discount, totals.class_discount, totals.root_discount
        in_class, at_class, top = np.split(sampled.reshape(SAMPLES, -1), (CONTEXTS, 2 * CONTEXTS), 1)
        smooth = (STRENGTH + root * top) * totals.base
        parent = (by_sample("customers") - root * by_sample("tables") + smooth) / (STRENGTH + at_class.sum(1, keepdims=True))
        word, kind, up = cells.classes()
        few = np.concatenate(columns("few"))
        if len(few) != len(word):
            raise ValueError("a block's answers do not fit its documents")
        customers, tables, more = np.minimum(few, 1), np.minimum(few, 1), few > 1
        above = []
        for i, (c, t) in enumerate(zip(by_sample("class_customers"), by_sample("class_tables"), strict=True)):
            customers[more], tables[more] = c, t
            above.append((customers - e * tables + (STRENGTH + e * at_class[i, kind]) * parent[i, word]) / (STRENGTH + in_class[i, kind]))
        seats = np.where(own > 0, float(SAMPLES), 0.0)
        seats[own > 1] = np.concatenate(columns("seats"))
        mean = own - d * seats / SAMPLES
        for opened, p in zip(by_sample("restaurants"), above, strict=True):
            mean += (STRENGTH + d * opened[cells.before]) / SAMPLES * p[up]
        # the customers of a context are its own occurrences in training text
        logs = np.log10(mean / (STRENGTH + counts[cells.before]))
        plain = np.log10((counts + 1) / (totals.tokens + totals.vocabulary + 1))
        n = len(all_ids)
        return pa.table({
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(cells.sizes.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((counts[cells.ids] > 0).astype(np.int64), cells.starts)),
            "train_tokens": pa.array(np.full(n, totals.tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(plain[cells.ids], cells.starts)),
            "score": pa.array(np.add.reduceat(logs[cells.back], cells.starts)),
        })

    return run


def _added(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Sums of a column of arrays, place by place."""
    out = np.zeros(width, np.int64)
    for r in rows.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def score_texts(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model learns from the rows where ``held_out`` is false.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("held_out", held_out if held_out is not None else fold(7) == 2)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    schema = _BLOCKS.format(kind=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = pa.schema([(n, arrow[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
    # bucketed: documents and merged cells are joined to more than once, and do not move for it
    blocks = store_bucketed(rows.mapInArrow(_blocked(parts, names, fields), schema), "lm_blocks", ["block"])
    texts_of = blocks.where("ids IS NOT NULL").select("block", "doc_id", "held_out", "ids")
    words = blocks.where("part IS NOT NULL").select("block", "part", "words", "size", "counts")
    numbered = store(words.groupBy("part").applyInArrow(_number, "block bigint, part int, numbers binary"), "lm-numbers")

    counted = texts_of.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(_counted(parts), _ASKED)
    merged = store_bucketed(counted.groupBy("part").applyInArrow(_merge(parts), _MERGED), "lm_parts", ["part"])
    totals = Totals.with_classes(_added(merged, "stats", 8 + 2 * CONTEXTS))

    opened = merged.select("part", "n_cells", "contexts", "counts").mapInArrow(
        _opened(parts), "part int, asker int, numbers binary, opened binary, wanted binary"
    )
    opened = opened.groupBy("part").applyInArrow(_open, "part int, owner int, tables binary")
    seated = store(merged.groupBy("part").cogroup(opened.groupBy("part")).applyInArrow(_seated(totals, parts), _SEATED), "lm-seats")
    sampled = _added(seated, "sums", SAMPLES * (2 * CONTEXTS + 1)).astype(float)

    asked = merged.select("part", "names", "blocks", "words_each", "asked_words")
    found = seated.where("block IS NULL AND part IS NOT NULL").select("part", "numbers", "tables")
    totalled = asked.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_totalled, _TOTALLED)
    answers = seated.where("block IS NOT NULL").drop("sums", "numbers").unionByName(numbered, True).unionByName(totalled, True)
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts_of.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(totals, sampled, parts), out)
