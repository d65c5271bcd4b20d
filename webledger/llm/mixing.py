"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

A source is its documents in a fixed shuffled order, laid end to end and cut into blocks of equal
length. With weight w, its block i (from 0) is released at slot floor(i/w) and due at slot
ceil((i+1)/w); giving every slot to the released block with the earliest deadline meets all
deadlines, so at any time a source is less than one block away from its share.

Weights are rounded to multiples of 1/PERIOD, which makes the schedule repeat: one period is
worked out on the driver, and the slot of any block follows from it by arithmetic inside the tasks.
When a source runs out, a new phase begins in which the others share its weight. No document is
dropped. What the driver sees: one row per source and one per partition.

Defined cases: documents without a source form a source of their own; a null or empty text has length
1, like a single character; repeated rows are mixed one by one; ties of the order are broken by
doc_id, then length; sources that the weights do not name follow after the named ones; a weight of
zero or less counts as not named; a text counts by its length, however long; helper columns have names of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger.scale import store

BLOCK_CHARS = 65_536
PERIOD = 4096
# Default weights: shares of characters, flattened by this power.
ALPHA = 0.7
# The schedule is broadcast; this bounds its size.
MAX_SOURCES = 20_000


def _key(source: str = "source") -> Column:
    """The source as text that is never null: '' for none, else '=' and its name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def quantised(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period per source, at least one each, by largest remainders."""
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    slots = {s: 1 + int(x) for s, x in exact.items()}
    left = period - sum(slots.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        slots[s] += 1
    return slots


def one_period(slots: Mapping[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source within a period, earliest deadline first."""
    period = sum(slots.values())
    releases: dict[int, list[str]] = {}
    done = dict.fromkeys(slots, 0)
    for s in slots:
        releases.setdefault(0, []).append(s)
    ready: list[tuple[int, str]] = []
    given: dict[str, list[int]] = {s: [] for s in slots}
    for now in range(period):
        for s in releases.pop(now, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * period // slots[s]), s))
        _, s = heapq.heappop(ready)
        given[s].append(now)
        done[s] += 1
        if done[s] < slots[s]:
            releases.setdefault(max(now + 1, done[s] * period // slots[s]), []).append(s)
    return {s: np.array(g, np.int64) for s, g in given.items()}


class Schedule:
    """Phases of a mix: which blocks of which source they hold, and the slot of each."""

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD):
        self.phases: dict[str, list[tuple[int, int, int, int, np.ndarray]]] = {s: [] for s in blocks}
        left = {s: n for s, n in blocks.items() if n > 0}
        taken = dict.fromkeys(blocks, 0)
        start = 0
        while left:
            named = {s: weights[s] for s in left if weights.get(s, 0) > 0}
            chosen = named or {s: float(n) for s, n in left.items()}
            size = max(period, 1 << (8 * len(chosen)).bit_length())
            slots = quantised(chosen, size)
            pattern = one_period(slots)
            ends = {s: (left[s] - 1) // slots[s] * size + pattern[s][(left[s] - 1) % slots[s]] + 1 for s in chosen}
            end = int(min(ends.values()))
            for s in chosen:
                n = end // size * slots[s] + int(np.searchsorted(pattern[s], end % size))
                if n:
                    self.phases[s].append((taken[s], start, slots[s], size, pattern[s]))
                    taken[s] += n
                    left[s] -= n
                    if not left[s]:
                        del left[s]
            start += end

    def slot(self, source: str, blocks: np.ndarray) -> np.ndarray:
        phases = self.phases[source]
        which = np.searchsorted([p[0] for p in phases], blocks, side="right") - 1
        out = np.empty(len(blocks), np.int64)
        for i in np.unique(which):
            first, start, slots, size, pattern = phases[i]
            at = which == i
            turn, inside = np.divmod(blocks[at] - first, slots)
            out[at] = start + turn * size + pattern[inside]
        return out


def _running(batches):
    """Characters of the same source before each document, within the partition, and its number."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy(zero_copy_only=False)
        coded = batch.column("s").dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        before = np.empty(len(size), np.int64)
        for c in np.unique(code):
            at = np.flatnonzero(code == c)
            base = total if names[c] == last else 0
            before[at] = base + np.cumsum(size[at]) - size[at]
        last, total = names[code[-1]], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "s": batch.column("s"), "size": batch.column("size"),
            "before": pa.array(before), "part": pa.array(np.full(len(size), part, np.int32)),
        })


def schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
    size: Column | None = None,
) -> DataFrame:
    """(doc_id, source, block, slot, start): read by (slot, start), the rows are the mix.

    ``weights`` by source name (None: documents without one); by default characters to the power
    of ``ALPHA``. ``start`` is the place of the document in its source, in characters.
    """
    spark = docs.sparkSession
    size = F.length(F.coalesce("text", F.lit(""))) + 1 if size is None else size
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", _key().alias("s"), size.cast("bigint").alias("size"))
    # written first: the range shuffle samples its input, and should not read texts twice for it
    slim = store(slim.withColumn("at", F.xxhash64("doc_id")), "mix-sizes")
    keys = ["s", "at", "doc_id", "size"]
    laid = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "s", "size")
    laid = store(laid.mapInArrow(_running, f"doc_id {kind}, s string, size bigint, before bigint, part int"), "mix-laid")
    pieces = laid.groupBy("s", "part").agg(F.sum("size").alias("n")).collect()
    offsets, totals = [], {}
    for r in sorted(pieces, key=lambda r: (r["s"], r["part"])):
        offsets.append((r["s"], r["part"], totals.get(r["s"], 0)))
        totals[r["s"]] = totals.get(r["s"], 0) + r["n"]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"{len(totals)} sources; a mix is made of at most {MAX_SOURCES}")
    named = {"" if s is None else f"={s}": w for s, w in weights.items()} if weights is not None else {
        s: n**ALPHA for s, n in totals.items()
    }
    plan = spark.sparkContext.broadcast(Schedule({s: -(-n // block_chars) for s, n in totals.items()}, named, period))

    def place(batches):
        for batch in batches:
            start = batch.column("start").to_numpy(zero_copy_only=False)
            block = start // block_chars
            slot = np.empty(len(start), np.int64)
            coded = batch.column("s").dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            names = coded.dictionary.to_pylist()
            for c in np.unique(code):
                at = code == c
                slot[at] = plan.value.slot(names[c], block[at])
            source = pa.array([n[1:] if n else None for n in names], pa.string()).take(coded.indices)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), source, pa.array(block), pa.array(slot), pa.array(start)],
                names=["doc_id", "source", "block", "slot", "start"],
            )

    listed = spark.createDataFrame(offsets, "s string, part int, base bigint")
    started = laid.join(F.broadcast(listed), ["s", "part"]).select("doc_id", "s", (F.col("base") + F.col("before")).alias("start"))
    return started.mapInArrow(place, f"doc_id {kind}, source string, block bigint, slot bigint, start bigint")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """All documents with all their columns, in the order of the mix, range by range.

    Rows that repeat a doc_id within a source share its place; rows without a doc_id come last.
    """
    taken = set(docs.columns)
    new = {n: next(c for c in (f"_{n}", f"_{n}_", f"_mix_{n}", f"_mix_{n}_") if c not in taken) for n in ("s", "slot", "start")}
    once = docs.where("doc_id IS NOT NULL").groupBy("doc_id", "source").agg(
        F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("size")
    )
    placed = schedule(once, weights, size=F.col("size")).select(
        "doc_id", _key().alias(new["s"]), F.col("slot").alias(new["slot"]), F.col("start").alias(new["start"])
    )
    joined = docs.withColumn(new["s"], _key()).join(placed, ["doc_id", new["s"]], "left")
    order = [F.col(new["slot"]).asc_nulls_last(), F.col(new["start"]), F.col(new["s"]), F.col("doc_id")]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(docs.columns)
