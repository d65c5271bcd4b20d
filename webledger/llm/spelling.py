"""Spelling variants: words one edit apart, found by permuterm rotations.

A word is marked at its end (``MARK``) and rotated. Turned so that one letter comes last, its rotation is the
rest of the word, ``after MARK before``, then that letter. So among all rotations in sorted order, those that
agree in everything but a last letter stand together: words with another letter in that place
(replacements), and, in front of them, the rotation that ends there, a word without that letter (an insertion or a
deletion). Such a range is the group of one prefix, and holds at most one word per letter of the alphabet and one more,
however many words there are.

On Spark: tasks count the words of their texts and Spark adds the counts up. The rotations are dealt by
prefix, sorted within partitions, and scanned in order; a range gives each of its words the number of its
neighbours there and the best of them, never the pairs, so the work grows with the rotations. A pair that
differs by one letter of a run of equal ones (``oo``) would meet in a range for each letter of the run; only the first
counts. What the ranges say of a word is added up by word. The chain of forms is followed by doubling: a form
is at least ``RATIO`` times as frequent as its word, so a chain is short, and each round halves it.

Defined cases: null texts have no words, and a null doc_id counts as the empty text in the checksum; repeated
rows count again; runs whose edited form is short or seen once are no words; ties between forms go to the word
that comes first in code-point order; very long texts are cut into words a document at a time; an empty table gives an
empty result. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import claim, in_pieces, texts
from webledger.scale import store

MARK = "$"
LETTERS, OFTEN, RATIO, EDITED = 7, 2, 10, 31
# Counted words that a task holds before it hands them on.
_HELD = 200_000

_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]*")
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def runs(body: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, as UTF-8.

    All of the range above ASCII begin with the byte C3; characters with other first bytes part words.
    """
    if not body.isascii():
        body = _OTHER.sub(b" ", body)
    return body.translate(_TABLE).split()


def edited(run: bytes, checksum: int) -> bytes:
    """The run, without one of its characters where EDITED divides the checksum."""
    if checksum % EDITED:
        return run
    word = run.decode()
    at = checksum % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def _counted(batches):
    claim("spelling", int)
    held: Counter[bytes] = Counter()

    def out():
        names = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([held[w] for w in names], pa.int64())], names=["word", "n"])
        held.clear()

    for batch in in_pieces(batches):
        for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            # a word of LETTERS letters has at least as many bytes
            for run, n in Counter([w for w in runs(body) if len(w) >= LETTERS]).items():
                word = edited(run, zlib.crc32(run, start))
                if len(word) - word.count(b"\xc3") >= LETTERS:
                    held[word] += n
        if len(held) > _HELD:
            yield from out()
    yield from out()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words, stored."""
    counted = texts(docs).mapInArrow(_counted, "word binary, n bigint")
    whole = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return store(whole.select(F.col("word").cast("string").alias("word"), "n"), "words")


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, n): all rotations, cut before their last letter, and whole ones with an empty last letter."""
    word, size = F.col("word"), F.length("word")

    def turned(i, skip):
        return F.concat(F.substring(word, i + skip + F.lit(1), size), F.lit(MARK), F.substring(word, F.lit(1), i))

    places = F.sequence(F.lit(0), size)
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(turned(i, F.lit(1)).alias("prefix"), F.substring(word, i + 1, F.lit(1)).alias("last")))
    whole = F.transform(places, lambda i: F.struct(turned(i, F.lit(0)).alias("prefix"), F.lit("").alias("last")))
    return words.select(F.explode(F.concat(cut, whole)).alias("r"), "n").select("r.prefix", "r.last", "n")


def neighbours(prefix: str, members: list[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
    """(word, neighbours here, the best one's n, the best one) for the words of one range."""
    after, _, before = prefix.partition(MARK)
    # by frequency, ties in code-point order; the word without a letter stands among them
    rows = sorted((-n, before + last + after, last) for last, n in members)
    letters = sum(last != "" for _, _, last in rows)
    shorter = letters < len(rows)
    first = sum(last != "" and last != before[-1:] for _, _, last in rows)
    out = []
    for n, word, last in rows:
        if last == "":
            near, fits = first, lambda other: other != "" and other != before[-1:]
        else:
            own = last != before[-1:]
            near, fits = letters - 1 + (shorter and own), lambda other, own=own: other != "" or own
        if near:
            best = next(r for r in rows if r[1] != word and fits(r[2]))
            out.append((word, near, best[0], best[1]))
    return out


_FOUND = "word string, n_near bigint, less bigint, best string"


def _scanned(batches):
    """Sorted rotations, range by range; the last range of a batch waits for the next one."""
    names, rest = [part.split()[0] for part in _FOUND.split(", ")], None
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def found(rows: pa.Table) -> pa.RecordBatch:
        # most ranges have one row; those are left out without a look
        key = rows.column("prefix").combine_chunks()
        same = pc.equal(key.slice(1), key.slice(0, max(len(key) - 1, 0)))
        none = pa.array([False] * min(1, len(key)))
        with_before, with_next = pa.concat_arrays([none, same]), pa.concat_arrays([same, none])
        some = rows.filter(pc.or_(with_before, with_next))
        columns = zip(*(some.column(c).to_pylist() for c in ("prefix", "last", "n")), strict=True)
        out = [x for prefix, group in groupby(columns, key=lambda r: r[0]) for x in neighbours(prefix, [(r[1], r[2]) for r in group])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < 20_000:
            continue
        key = rest.column("prefix")
        cut = pc.index(key, key[-1]).as_py()
        if cut:
            yield found(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None:
        yield found(rest)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): the number of words one edit away, and the most frequent of them."""
    ranges = rotations(words).repartition("prefix").sortWithinPartitions("prefix", "last")
    told = ranges.mapInArrow(_scanned, _FOUND)
    best = told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    return best.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain, by doubling."""
    links = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        moved = store(moved, "roots")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def group_spellings(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = count_words(docs)
    near = words.join(near_words(words), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("bigint"))
    has = F.col("best_n") >= RATIO * F.col("n")
    near = store(near.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    ends = roots(near.where("form IS NOT NULL"))
    joined = near.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
