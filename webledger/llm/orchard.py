"""Vector codes: product quantisation whose nearest entries are found by Orchard's search.

Vectors of floats become vectors of integers, ``floor(SCALE * x)``, cut into ``PARTS`` equal parts; each
part position has a codebook of ``ENTRIES`` entries, refined by ``ROUNDS`` rounds of assignment and means.

Orchard's search keeps, for every entry, the list of the other entries sorted by distance. It walks the
list of the entry that is best so far, skips entries that it has seen (a bit each), jumps to the list of
an entry that is better, and stops at a neighbour further than twice the best distance: by the triangle
inequality neither that one nor any behind it can be nearer. Distances are integers (squared, so
twice the distance is four times its square), so the search is exact, ties included: it stops only beyond the
bound, and of equal distances the lower index wins. All parts of many rows walk at the same time
in numpy, each with its own entry, place and bits.

On Spark: the integer vectors are stored once; a round is one pass over them, in which every task gives the
sums and counts of its rows by entry, a few hundred rows whatever the table's size. The entries, ``PARTS * ENTRIES``
short vectors, are all that goes to the driver and back. Sums of a label are added up by Spark.

Defined cases: a vector that is null, or holds a null, a NaN or an infinity, is left out. Of vectors of
several lengths, those of the commonest length count (ties: the longest), the others are left out too; a length that
the parts do not divide is filled up with zeros at the end. Integers beyond ±2**27 count as
that bound, so that no distance overflows. Null vec_ids come last when the first entries are picked;
repeated vec_ids are rows of their own, in the order of their vectors; with fewer rows than entries the
codebooks are shorter. Null labels are one label. Very long vectors are held a batch at a time. Columns other than the
three named ones are never read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.scale import join_small, store

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_BOUND = 2**27
# Rows that walk together: short batches are put together up to this.
_ROWS = 8192


class Orchard:
    """Codebooks (parts x entries x positions, integers) and the search of nearest entries."""

    def __init__(self, books: np.ndarray):
        self.books = np.ascontiguousarray(books, np.int64)
        parts, entries, _ = self.books.shape
        gaps = self.books[:, :, None, :] - self.books[:, None, :, :]
        squares = (gaps * gaps).sum(3)
        order = np.argsort(squares, axis=2, kind="stable")
        # an entry is no neighbour of itself, though another one may be equal to it
        order = np.array([[[k for k in order[p, e] if k != e] for e in range(entries)] for p in range(parts)], np.int64)
        order = order.reshape(parts, entries, max(entries - 1, 0))
        self.lists = order.reshape(parts * entries, -1)
        self.far = np.take_along_axis(squares, order, 2).reshape(parts * entries, -1)
        self.flat = self.books.reshape(parts * entries, -1)
        # sums of squares stay exact in floats while they are below 2**53
        self.small = int(np.abs(self.flat).max(initial=0)) < 2**21

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each part of each row; ``rows``: n x parts x positions."""
        n, parts, width = rows.shape
        entries = self.books.shape[1]
        exact_in_floats = self.small and int(np.abs(rows).max(initial=0)) < 2**21 and width < 2**8
        kind = np.float64 if exact_in_floats else np.int64
        points, flat = rows.reshape(n * parts, width).astype(kind), self.flat.astype(kind)

        def distance(which: np.ndarray, entry: np.ndarray) -> np.ndarray:
            gap = points[which] - flat[entry]
            return np.einsum("ij,ij->i", gap, gap).astype(np.int64)

        base = np.tile(np.arange(parts) * entries, n)
        best = np.zeros(n * parts, np.int64)
        square = distance(np.arange(n * parts), base)
        seen = np.ones(n * parts, np.int64)
        place = np.zeros(n * parts, np.int64)
        walking = np.arange(n * parts) if entries > 1 else np.empty(0, np.int64)
        while len(walking):
            at = base[walking] + best[walking]
            here = place[walking]
            go = self.far[at, here] <= 4 * square[walking]
            walking, at, here = walking[go], at[go], here[go]
            ask = self.lists[at, here]
            place[walking] = here + 1
            fresh = (seen[walking] >> ask) & 1 == 0
            who, asked = walking[fresh], ask[fresh]
            seen[who] |= 1 << asked
            d = distance(who, base[who] + asked)
            better = (d < square[who]) | ((d == square[who]) & (asked < best[who]))
            who, asked = who[better], asked[better]
            best[who], square[who], place[who] = asked, d[better], 0
            walking = walking[place[walking] < entries - 1]
        return best.reshape(n, parts), square.reshape(n, parts)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, parts: int) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), parts, -1)


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, vector as 32-bit integers) of all rows that count, stored."""
    v = F.col("vector")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(v.isNotNull() & ~bad)
    common = rows.groupBy(F.size(v).alias("width")).count().agg(F.max(F.struct("count", "width"))["width"].alias("width")).first()["width"]
    width = common or 0
    filled = -(-max(width, 1) // parts) * parts
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches):
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            whole = np.zeros((batch.num_rows, filled), "<i4")
            whole[:, :width] = np.clip(np.floor(SCALE * flat), -_BOUND, _BOUND)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in whole], pa.binary())],
                names=["vec_id", "label", "vector"],
            )

    return store(rows.where(F.size(v) == width).mapInArrow(run, f"vec_id {ids}, label {labels}, vector binary"), "vectors")


def first_entries(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest vec_ids."""
    order = [F.col("vec_id").isNull(), "vec_id", "vector"]
    picked = [bytes(r["vector"]) for r in rows.orderBy(*order).limit(entries).collect()]
    if not picked:
        return np.zeros((parts, 0, 1), np.int64)
    return np.frombuffer(b"".join(picked), "<i4").reshape(len(picked), parts, -1).transpose(1, 0, 2).astype(np.int64)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x positions) after ``rounds`` rounds over all rows."""
    books = first_entries(rows, parts, entries)
    if not books.size:
        return books
    _, entries, width = books.shape
    for _ in range(rounds):
        orchard = Orchard(books)

        def run(batches, orchard=orchard):
            sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
            for batch in _gathered(batches):
                points = _matrix(batch.column("vector"), parts)
                nearest = (orchard.search(points)[0] + np.arange(parts) * entries).ravel()
                order = np.argsort(nearest, kind="stable")
                found, starts = np.unique(nearest[order], return_index=True)
                sums[found] += np.add.reduceat(points.reshape(-1, width)[order].astype(np.int64), starts, axis=0)
                counts += np.bincount(nearest, minlength=parts * entries)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array(np.repeat(used, width)), "position": pa.array(np.tile(np.arange(width), len(used))),
                "total": pa.array(sums[used].ravel()), "n": pa.array(np.repeat(counts[used], width)),
            })

        moved = rows.select("vector").mapInArrow(run, "entry bigint, position bigint, total bigint, n bigint")
        # at most parts * entries * positions rows, at any size of the table
        wide = moved.groupBy("entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in wide.collect():
            part, entry = divmod(r["entry"], entries)
            books[part, entry, r["position"]] = int(r["total"]) // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, codes binary, error) of all rows."""
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    parts = books.shape[0]
    orchard = Orchard(books) if books.size else None

    def run(batches):
        for batch in _gathered(batches):
            best, square = orchard.search(_matrix(batch.column("vector"), parts))
            codes = pa.array([r.tobytes() for r in best.astype(np.uint8)], pa.binary())
            for out in pa.table(
                {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "codes": codes, "error": pa.array(square.sum(1))}
            ).to_batches():
                yield out

    return rows.mapInArrow(run, f"vec_id {ids}, label {labels}, codes binary, error bigint")


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in integers."""
    return books[np.arange(len(books)), np.frombuffer(codes, np.uint8)].ravel()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of every vector, stored, and the codebooks."""
    rows = integers(vectors, key, vector, label)
    books = train(rows)
    return store(encode(rows, books), "codes"), books


def digests(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    named = coded.withColumn("_no", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    by_label = named.groupBy("_no", "_label").agg(F.sum("error").alias("label_error"))
    joined = join_small(named, by_label, ["_no", "_label"], ["vec_id"])
    return joined.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
