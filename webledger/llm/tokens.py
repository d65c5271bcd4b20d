"""Token ids in packed binary files.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs,
in blocks of ``BLOCK`` ids that start at whole bytes. A footer lists documents and block offsets, so
any range of ids is read by seeking to its blocks and unpacking them with numpy::

    blocks | doc ids (int64) | doc id is null (uint8) | doc starts (int64) | block offsets (uint64) | footer

Documents are dealt by ranges of their order to tasks; every task writes one file, then starts of
files are summed from one manifest row per file. A task that is run again writes a file of another
name; only files in the manifest count.

Words repeat, so each Python worker encodes a piece of text once and keeps its ids in a table of at
most ``KNOWN`` pieces. Texts of about ``AT_ONCE`` bytes are cut together with numpy, their pieces are numbered by
Arrow, and only different ones are looked up; ids of all places are gathered by these numbers. Pieces end at white
space if the tokenizer drops it and never looks across;
for one that also lower-cases and parts words from marks, ASCII letters are lowered and
ASCII marks between a word and white space are a piece of their own, as far as the tokenizer parts them. In texts with marks that compose with ASCII letters, only
pieces that are all ASCII are lowered: a
tokenizer composes characters before it lower-cases, and a capital with a combining mark need not have
a composed form where the small letter has one. Unchanged stay texts that hold the name of an added token, in
any case. Words of small ASCII letters go to the tokenizer's model at once, if its normalizer and pre-tokenizer
would hand them on as they are. Which of this holds is asked of the tokenizer itself; one that does none of it encodes whole
texts.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; repeated
doc_ids are documents of their own, ordered by a hash of their texts; rows that agree in both are alike in every figure but
their place; very long texts are encoded whole; only doc_id, text and the order are read, so other columns cannot clash; an
empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice
from pathlib import Path
from string import ascii_letters, ascii_lowercase, punctuation

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import SPACE, claim, in_pieces, new_folder, open_folder, texts
from webledger.scale import store

BLOCK = 4096
KNOWN = 350_000
AT_ONCE = 1 << 22
_MAGIC = b"WLPACK01"
_FOOTER = struct.Struct("<8sBxxxIQQQQ")  # magic, bits, ids a block, ids, documents, blocks, bytes of blocks


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids become ``bits`` bytes, lowest bits first; the tail is filled up with zeros."""
    groups = -(-len(ids) // 8)
    wide = np.zeros(groups * 8, np.uint64)
    wide[: len(ids)] = ids
    wide = wide.reshape(groups, 8)
    out = np.zeros((groups, bits), np.uint8)
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        moved = wide[:, i] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, first + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes, as uint32."""
    packed = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.empty((len(packed), 8), np.uint32)
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        wide = np.zeros(len(packed), np.uint64)
        for k in range((shift + bits + 7) // 8):
            wide |= packed[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, i] = (wide >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


# The first byte of every mark that composes with an ASCII letter (U+0300 to U+0338).
_MARK = b"\xcc"
# Bytes by kind; zero is all else.
_SPACE, _LETTER, _STOP = 1, 2, 3
_KINDS = bytearray(256)
for _kind, _bytes in ((_SPACE, SPACE), (_LETTER, ascii_letters.encode())):
    for _byte in _bytes:
        _KINDS[_byte] = _kind


# What a model must read alone as the whole tokenizer does: all letters, all pairs of them, and some words.
_WORDS = [*ascii_lowercase, "".join(a + b for a in ascii_lowercase for b in ascii_lowercase), "the", "unbelievably", "isnt", "ll", "re", "ve"]


class Encoder:
    """Text to ids, as little-endian uint32 bytes, through a bounded table of known pieces."""

    _own: dict[str, Encoder] = {}

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, bytes] = {}
        # names of added tokens are looked for in the text as written, where case matters
        self.names = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.drops_space = ids(" ab\n\t c ") == ids("ab") + ids("c") and all(len(n.split()) == 1 for n in self.names)
        same_case = ids("THE End") == ids("the") + ids("end") and ids("\u00c9T\u00c9") == ids("\u00e9t\u00e9")
        self.folds = self.drops_space and same_case and ids("ab, c. d.") == sum(map(ids, ("ab", ",", "c", ".", "d", ".")), [])
        self.kinds = bytearray(_KINDS)
        for mark in punctuation:
            if ids(f"ab{mark} c") == ids("ab") + ids(mark) + ids("c"):
                self.kinds[ord(mark)] = _STOP
        self.model = self.tokenizer.model
        # an added token inside a word of letters would be one of letters
        self.plain = not any(n.isalpha() for n in self.names) and all(ids(w) == self.word(w) for w in _WORDS)

    def word(self, word: str) -> list[int]:
        """Ids of one word, by the model alone."""
        return [t.id for t in self.model.tokenize(word)]

    def split(self, bodies: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in a row, and how many of them there are up to the end of each text."""
        whole = b"\n".join([*bodies, b""])
        ends = np.cumsum([len(b) + 1 for b in bodies])
        kinds = np.frombuffer(whole.translate(self.kinds), np.uint8)
        inside = kinds != _SPACE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        as_is, marked = np.zeros(len(bodies), bool), np.zeros(len(bodies), bool)
        if self.folds:
            low = whole.lower()
            if any(name in low for name in self.names):
                as_is = np.array([any(name in b.lower() for name in self.names) for b in bodies])
            if _MARK in whole:
                marked = np.array([_MARK in b for b in bodies])
            stops = np.flatnonzero(kinds == _STOP)
            alone = np.diff(stops) > 1
            first, after = stops[np.append(True, alone)[: len(stops)]], stops[np.append(alone, True)[: len(stops)]] + 1
            # the last byte is a space, so there is one after each run, and the one before the first is no letter
            stops = first[(kinds[first - 1] == _LETTER) & (kinds[after] == _SPACE)]
            if as_is.any():
                stops = stops[~as_is[np.searchsorted(ends, stops, "right")]]
            begins[stops] = True
        else:
            low = whole
        counts = np.searchsorted(np.flatnonzero(begins), ends)
        starts = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside))
        text = low.translate(None, SPACE)
        if as_is.any() or marked.any():
            written = np.frombuffer(whole.translate(None, SPACE), np.uint8)
            others = np.append(0, np.cumsum(written > 127))
            of = np.repeat(np.arange(len(bodies)), np.diff(counts, prepend=0))
            stay = as_is[of] | (marked[of] & (others[starts[1:]] > others[starts[:-1]]))
            text = np.where(np.repeat(stay, np.diff(starts)), written, np.frombuffer(text, np.uint8))
        data = [None, pa.py_buffer(starts), pa.py_buffer(text)]
        return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, data), counts

    @classmethod
    def of(cls, key: str, model: str) -> Encoder:
        claim("tokens", cls._own.clear)
        if key not in cls._own:
            cls._own.clear()
            cls._own[key] = cls(model)
        return cls._own[key]

    def pieces(self, missing: Sequence[bytes], at_once: int = 1000) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        if self.plain:
            for piece in missing:
                if piece.isalpha() and piece.islower():
                    ids = self.word(piece.decode())
                    out[piece] = struct.pack(f"<{len(ids)}I", *ids)
            missing = [p for p in missing if p not in out]
        for start in range(0, len(missing), at_once):
            part = missing[start : start + at_once]
            done = self.tokenizer.encode([p.decode("utf-8") for p in part], is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(done.ids, "<u4"), np.array(done.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            for i, piece in enumerate(part):
                out[piece] = ids[cuts[i] : cuts[i + 1]].tobytes()
        return out

    def ids(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of different pieces, from the table or anew."""
        found = [self.known.get(word) for word in words]
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = self.pieces([words[i] for i in missing])
        for i in missing:
            found[i] = fresh[words[i]]
        room = KNOWN - len(self.known)
        self.known.update(fresh if room >= len(fresh) else islice(fresh.items(), max(room, 0)))
        return found

    def encode(self, bodies: Sequence[bytes]) -> list[bytes]:
        if not self.drops_space:
            found = self.tokenizer.encode_batch([b.decode("utf-8") for b in bodies], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        pieces, counts = self.split(bodies)
        numbered = pieces.dictionary_encode()
        found = self.ids(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        which = numbered.indices.to_numpy()
        # place k of the result is place k - at of a piece that stands at ``at`` there
        long = sizes[which]
        ends = np.append(0, np.cumsum(long))
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], long)
        at += np.arange(len(at))
        ids, cuts = flat[at], ends[np.append(0, counts)]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class _Writer:
    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.rest, self.waiting = [], 0
        self.ids, self.bytes = 0, 0
        self.doc_ids, self.missing, self.starts, self.offsets = [], bytearray(), [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.missing.append(doc_id is None)
        self.starts.append(self.ids)
        self.rest.append(ids)
        self.ids += len(ids) // 4
        self.waiting += len(ids) // 4
        if self.waiting >= 64 * BLOCK:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id does not fit the vocabulary")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK
        for start in range(0, whole, BLOCK):
            self.offsets.append(self.bytes + start // 8 * self.bits)
        packed = pack(ids[:whole], self.bits)
        self.sink.write(packed)
        self.bytes += len(packed)
        self.rest, self.waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self.flush(last=True)
        self.sink.write(np.array(self.doc_ids, "<i8").tobytes() + bytes(self.missing))
        self.sink.write(np.array(self.starts, "<i8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        counts = (self.ids, len(self.doc_ids), len(self.offsets), self.bytes)
        self.sink.write(_FOOTER.pack(_MAGIC, self.bits, BLOCK, *counts))


class TokenFile:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _FOOTER.size)
        magic, self.bits, self.block, self.n_ids, self.n_docs, self.n_blocks, at = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(at)
        read = lambda kind, n: np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
        self.doc_ids, self.missing = read("<i8", self.n_docs), read("u1", self.n_docs).astype(bool)
        self.starts = np.append(read("<i8", self.n_docs), self.n_ids)
        self.offsets = np.append(read("<u8", self.n_blocks), np.uint64(at)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file; only their blocks are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        here = unpack(data, self.bits, min(self.n_ids, (last + 1) * self.block) - first * self.block)
        return here[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def file_order(docs: DataFrame) -> list[Column] | None:
    """Columns by which rows stand in the Parquet files behind ``docs``; None if there are no files.

    Spark numbers the files that it writes; the number has five digits or more, so it is taken as one.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), name, F.col("_metadata.row_index")]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Doc ids and texts, rows of about ``AT_ONCE`` bytes at a time; a longer text ends its group."""
    doc_ids, bodies, size = [], [], 0
    for batch in in_pieces(batches):
        for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            doc_ids.append(doc_id)
            bodies.append(body)
            size += len(body) + 100  # an empty text takes room, too
            if size >= AT_ONCE:
                yield doc_ids, bodies
                doc_ids, bodies, size = [], [], 0
    if bodies:
        yield doc_ids, bodies


_MANIFEST = "part int, path string, n_ids bigint, n_docs bigint"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, order: Sequence[Column] | None = None) -> DataFrame:
    """Write all texts as ids in files of a new shared folder; the stored manifest, a row per file.

    ``tokenizer`` is a path on the driver. ``order``: columns of ``docs`` to write by, else doc_id.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, Path(tokenizer).read_text(encoding="utf-8")))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = Encoder.of(*shared.value)
        writer, path = None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.bin"
        end = np.array([end_id], "<u4").tobytes()
        for doc_ids, bodies in groups(batches):
            if writer is None:
                system, inside = open_folder(path)
                system.create_dir(inside.rpartition("/")[0], recursive=True)
                sink = system.open_output_stream(inside)
                writer = _Writer(sink, bits_for(encoder.vocabulary))
            for doc_id, ids in zip(doc_ids, encoder.encode(bodies), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "n_ids": [writer.ids], "n_docs": [len(writer.doc_ids)]}
            )

    if order is None:
        rows, keys = texts(docs), ["doc_id", "_tie"]
    else:
        names = [f"_o{i}" for i in range(len(order))]
        ordered = docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(order, names, strict=True)])
        rows = ordered.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *names)
        keys = [*names, "doc_id", "_tie"]
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return store(dealt.mapInArrow(run, _MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each file. It has one row per file, so the driver sums it."""
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    out, before = [], 0
    for row in rows:
        out.append((*row, before))
        before += row["n_ids"]
    spark = manifest.sparkSession
    return spark.createDataFrame(out, _MANIFEST + ", before bigint").repartition(max(1, len(out)), "part")


def read_tokens(manifest: DataFrame, documents_at_once: int = 256) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, inside = open_folder(row["path"])
                with system.open_input_file(inside) as source:
                    file = TokenFile(source)
                    for first in range(0, file.n_docs, documents_at_once):
                        last = min(first + documents_at_once, file.n_docs)
                        starts = file.starts[first : last + 1]
                        ids = file.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        local = starts - starts[0]
                        sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(local[:-1], local[1:], strict=True)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(file.doc_ids[first:last], mask=file.missing[first:last]),
                            "start": pa.array(starts[:-1] + row["before"], pa.int64()),
                            "n_tokens": pa.array(np.diff(starts), pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        })

    return with_starts(manifest).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
