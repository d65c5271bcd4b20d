"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text becomes a set of word shingles, and a signature of ``COORDINATES`` minima. Texts with
   equal sets are one class from here on; a class is one node.
2. The number of coordinates that a pair must agree
   in follows from the similarity asked for (:func:`matches_for`; 34 of 64 at 0.8): two sets just alike enough agree in
   fewer with a chance under ``MISS``. A signature is posted under keys of ``width`` coordinates and their values
   (:func:`width_for`; 2 at 0.8): COORDINATES - m coordinates that differ spoil as many keys at most, so pairs that
   agree in m or more share at least k of their keys (2 of 32 at 0.8), and texts that have a few common shingles
   seldom share one. Of its keys, all but k - 1 then do, in any
   common order; rarest keys first, this prefix leaves out what many texts have in common, and
   keys that one node alone has are dropped before anything is paired. Sets of very different size
   cannot be linked: a list is split into classes of size, each a quarter larger than the one before (at 0.8),
   and a node stands in its own class and the next.
3. Every list is named by its most central node, and lists of one name are put together: the nodes of
   a group of near copies share dozens of keys, but meet a few times only. In a table of at most
   ``LIST_BLOCK`` nodes, collisions of signatures are counted pair by pair in one task; only nodes with
   a partner above the threshold have their texts fetched. Then these pairs
   are confirmed on their full sets, and pairs that are connected already are
   skipped. Of a larger one, all nodes are first compared with its centre and one more, the
   confirmed pairs are merged into components, and only pairs across components are looked at, in
   blocks of bounded size. So a large group of near copies costs about one comparison per member,
   and no list of all pairs is ever made.

Links are exact: every one is confirmed on the full shingle sets (64-bit hashes). n nodes that
are alike beyond the threshold of collisions and yet unlinked cost n² comparisons, spread over
blocks.

Defined cases: null texts and texts without words have an empty set, link to nothing and stay; of
fewer words than a shingle, the whole sequence is one; a row without a doc_id takes part, names no
component, and is kept only where its component has no document with one; rows that repeat a doc_id
are judged by their own texts; ties between rows of one class go to the smallest doc_id; very long texts are
hashed whole; only doc_id and text are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webledger.llm.common import claim, in_pieces, texts
from webledger.scale import BROADCAST_BYTES, store

COORDINATES = 64
# The chance, at most, that two sets just alike enough agree in fewer coordinates than are asked for.
MISS = 1e-6
# The numbers of nodes end in their class of size, in so many bits.
_SIZE_BITS = 6
# Bits of the filter that keeps texts nobody asks for out of a join: 2 MB at any size of the corpus.
_FILTER_BITS = 24
# Nodes that are compared with each other in one task.
LIST_BLOCK = 512
_WORDS = 100_000



def matches_for(num: int, den: int) -> int:
    """Coordinates that two sets of similarity ``num / den`` must agree in: as many as keeps the chance under ``MISS``."""
    alike, chance = num / den, 0.0
    for k in range(COORDINATES + 1):
        chance += comb(COORDINATES, k) * alike**k * (1 - alike) ** (COORDINATES - k)
        if chance > MISS:
            if not k:
                raise ValueError(f"{COORDINATES} coordinates are too few for a similarity of {num}/{den}")
            return k
    return COORDINATES


def width_for(matches: int) -> int:
    """Coordinates in a key: as many, a power of two, as leave pairs that agree in ``matches`` a key in common."""
    width = 1
    while COORDINATES // (2 * width) > COORDINATES - matches:
        width *= 2
    return width


_A = np.array([int.from_bytes(hashlib.sha256(f"a{i}".encode()).digest()[:8], "big") | 1 for i in range(COORDINATES)], np.uint64)
_B = np.array([int.from_bytes(hashlib.sha256(f"b{i}".encode()).digest()[:8], "big") for i in range(COORDINATES)], np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


_known: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > _WORDS:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter((_known[w] for w in words), np.uint64, len(words))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of all shingles of ``size`` words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    width = min(size, len(words))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """32 mixed bits of each minimum: what agrees by chance is one more pair to look at, and no link is lost."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out=out)
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def keys_of(signatures: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key for every ``width`` coordinates and their values; their place is in its lowest bits."""
    places = np.arange(COORDINATES // width, dtype=np.uint64)
    mixed = np.repeat(_mixed(places + np.uint64(1))[None, :], len(signatures), 0)
    for i in range(width):
        mixed = _mixed((mixed ^ signatures[:, i::width]) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed & ~np.uint64(COORDINATES - 1)) | places).view(np.int64)


def _class(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(size: int):
    def run(batches):
        claim("neardup", _known.clear)
        for batch in in_pieces(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("body_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "body_key", "n_shingles", "class", "signature"],
            )

    return run


def _posted(width: int):
    def run(batches):
        for batch in in_pieces(batches, 2000):
            if not batch.num_rows:
                continue
            found = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            node = np.repeat(batch.column("node").to_numpy(), COORDINATES // width)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys_of(found, width).ravel())], names=["node", "key"])

    return run


def agreeing(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).sum())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a ∩ b| >= num * |a ∪ b| for sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if den * small < num * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges (a, b); only linked nodes.

    Large-star and small-star rounds until nothing moves; every round is a stored table.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = store(e, "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("x")).select("x.*").where("u <> v").distinct()
        e = store(small, "edges")
        after = state(e)
        if after == before:
            break
        before = after
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.withColumn("label", F.col("node")))


def _bodies(size: int):
    """Texts of nodes, compressed; rows whose text is not that of the class are left out."""

    def run(batches):
        claim("neardup", _known.clear)
        for batch in in_pieces(batches):
            nodes, classes, bodies = [], [], []
            for text, node, known in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "class")), strict=True):
                text = zlib.decompress(text)
                own = _class(shingle_set(text, size))
                if known in (None, own):
                    nodes.append(node)
                    classes.append(own)
                    bodies.append(zlib.compress(text, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bodies, pa.binary())],
                names=["node", "class", "body"],
            )

    return run


def _asked_for(asked):
    """Rows whose place may be asked for, without it."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(asked.value, np.uint8), bitorder="little")
        for batch in in_pieces(batches):
            found = batch.filter(pa.array(bits[batch.column("place").to_numpy()].astype(bool)))
            yield found.select([c for c in found.schema.names if c != "place"])

    return run


def _squeezed(asked):
    """Texts compressed; only those whose doc_id may be asked for (or is null)."""

    def run(batches):
        for batch in _asked_for(asked)(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([zlib.compress(t, 1) for t in batch.column("text").to_pylist()], pa.binary())],
                names=["doc_id", "text"],
            )

    return run


def _place(key: str):
    """The bit of a key in the filter; a null has one too."""
    return F.pmod(F.xxhash64(key), F.lit(1 << _FILTER_BITS)).cast("int")


def _filter_of(needed: DataFrame, key: str):
    """A bit for every key, broadcast as bytes: the words of 32 bits that are not zero come to the driver."""
    words = needed.select(_place(key).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, p & 31)")).alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(1 << (_FILTER_BITS - 5), "<u4")
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype("<u4")
    return needed.sparkSession.sparkContext.broadcast(out.tobytes())


def _pairs_confirmed(size: int, num: int, den: int):
    def run(batches):
        for batch in in_pieces(batches):
            a, b = ([shingle_set(zlib.decompress(x), size) for x in batch.column(c).to_pylist()] for c in ("sa", "sb"))
            keep = [linked(x, y, num, den) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _colliding(matches: int):
    def run(batches):
        for batch in in_pieces(batches, 2000):
            a, b = batch.column("ga").to_pylist(), batch.column("gb").to_pylist()
            keep = [agreeing(x, y) >= matches for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fitting(sig: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, num: int, den: int, matches: int) -> np.ndarray:
    """Those of the others that agree with node i in enough coordinates, and are of a size that can be linked."""
    others = others[den * np.minimum(n[others], n[i]) >= num * np.maximum(n[others], n[i])]
    return others[(sig[others] == sig[i]).sum(1) >= matches]


_PLACED = "head bigint, node bigint, label bigint, block int, left int, right int, n bigint, signature binary"


def _list_partners(num: int, den: int, matches: int):
    """Of the nodes in one block (or in two) those that agree enough with one of another component."""

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        label, n, own = (table.column(c).to_numpy() for c in ("label", "n", "block"))
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        first, second = np.flatnonzero(own == left), np.flatnonzero(own == right)
        keep = np.zeros(len(own), bool)
        for at, i in enumerate(first):
            found = _fitting(sig, n, i, second[at + 1 :] if left == right else second, num, den, matches)
            found = found[label[found] != label[i]]
            keep[found] = True
            keep[i] |= len(found) > 0
        return table.filter(pa.array(keep))

    return run


def _list_links(size: int, num: int, den: int, matches: int):
    """Links between components inside one block (or across two blocks) of nodes that share keys."""

    def run(table: pa.Table) -> pa.Table:
        claim("neardup", _known.clear)
        rows = table.to_pydict()
        sig = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(-1, COORDINATES)
        label, n, own = rows["label"], np.array(rows["n"]), np.array(rows["block"])
        left, right = rows["left"][0], rows["right"][0]
        first, second = np.flatnonzero(own == left), np.flatnonzero(own == right)
        top = {x: x for x in label}

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        @lru_cache(maxsize=None)
        def shingles(i):
            return shingle_set(zlib.decompress(rows["body"][i]), size)

        found = []
        for at, i in enumerate(first):
            others = second[at + 1 :] if left == right else second
            for j in _fitting(sig, n, i, others, num, den, matches):
                x, y = find(label[i]), find(label[j])
                if x != y and linked(shingles(i), shingles(j), num, den):
                    top[y] = x
                    found.append((label[i], label[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, list_block: int = LIST_BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    signed, named = _named(docs, shingle_words, num, den, list_block)
    lowest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = named.join(lowest, "label").select("class", "component_id")
    alone = signed.where("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = signed.where("class IS NOT NULL").select("doc_id", "n_shingles", "class").join(named, "class", "left").drop("class")
    return alone.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _named(docs: DataFrame, shingle_words: int, num: int, den: int, list_block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body_key, n_shingles, class, signature) of every row, and (class, doc, label) of every class.

    ``body_key`` is a hash of the text, ``doc`` the smallest doc_id of a class, ``label`` its component.
    """
    matches = matches_for(num, den)
    width = width_for(matches)
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    source = rows.withColumn("body_key", F.xxhash64("text"))
    signed = source.mapInArrow(_signed(shingle_words), f"doc_id {kind}, body_key bigint, n_shingles bigint, class binary, signature binary")
    signed = store(signed, "signed")
    nodes = signed.where("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    # sets within the limit differ by less than one class of size, whatever the threshold
    grown = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9) if num < den else F.lit(0)
    grown = F.least(grown, F.lit((1 << _SIZE_BITS) - 1)).cast("bigint")
    numbered = F.monotonically_increasing_id() * (1 << _SIZE_BITS) + grown
    nodes = store(nodes.withColumn("node", numbered), "nodes")

    # the rarest keys of each node, without those that it alone has
    posted = nodes.select("node", "signature").mapInArrow(_posted(width), "node bigint, key bigint")
    often = posted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    shared = often.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"), F.sum("n").alias("central"))
    in_common = COORDINATES // width - (COORDINATES - matches)
    room = F.lit(1 - in_common) + F.size("keys")
    shared = shared.where(room > 0).select("node", "central", F.slice("keys", F.lit(1), room).alias("keys"))
    lists = store(shared.select("node", "central", F.explode("keys.key").alias("key")), "lists")
    grade = F.col("node").bitwiseAND(F.lit((1 << _SIZE_BITS) - 1).cast("bigint"))
    graded = lists.withColumn("grade", F.explode(F.array(grade, grade + 1)))
    heads = graded.groupBy("key", "grade").agg(
        F.max(F.struct("central", "node"))["node"].alias("head"), F.count(F.lit(1)).alias("size")
    ).where("size > 1")
    members = graded.select("node", "key", "grade").join(heads, ["key", "grade"]).select("head", "node").distinct()
    members = store(members, "members")
    sizes = members.groupBy("head").agg(F.count(F.lit(1)).alias("members"))

    # the signatures of the nodes that share keys
    marked = nodes.select("node", "n", "signature", _place("node").alias("place"))
    signatures = marked.mapInArrow(_asked_for(_filter_of(members, "node")), "node bigint, n bigint, signature binary")

    def bodies_of(wanted: DataFrame) -> DataFrame:
        """(node, body) of nodes."""
        needed = store(wanted.select("node").distinct().join(nodes.select("node", "doc", "class"), "node"), "needed")
        asked = _filter_of(needed, "doc")
        squeezed = rows.withColumn("place", _place("doc_id")).mapInArrow(_squeezed(asked), f"doc_id {kind}, text binary")
        by_id = squeezed.join(needed.where("doc IS NOT NULL").withColumnRenamed("doc", "doc_id"), "doc_id").select("text", "node", "class")
        no_id = squeezed.where("doc_id IS NULL").select("text", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("binary").alias("class"))
        found = by_id.unionByName(no_id).mapInArrow(_bodies(shingle_words), "node bigint, class binary, body binary")
        nameless = found.where("node IS NULL").select("class", "body").join(needed.where("doc IS NULL").select("node", "class"), "class")
        bodies = found.where("node IS NOT NULL").select("node", "body").unionByName(nameless.select("node", "body"))
        return bodies.groupBy("node").agg(F.first("body").alias("body"))

    def linked_within(placed: DataFrame) -> DataFrame:
        """Links among rows (head, node, label, block, left, right)."""
        blocks = placed.join(signatures, "node").groupBy("head", "left", "right")
        partners = store(blocks.applyInArrow(_list_partners(num, den, matches), _PLACED), "partners")
        full = partners.join(bodies_of(partners), "node")
        return full.groupBy("head", "left", "right").applyInArrow(_list_links(shingle_words, num, den, matches), "a bigint, b bigint")

    zero = F.lit(0)
    small = members.join(sizes.where(F.col("members") <= list_block), "head").select(
        "head", "node", F.col("node").alias("label"), zero.alias("block"), zero.alias("left"), zero.alias("right")
    )
    links = store(linked_within(small), "links")
    large = members.join(sizes.where(F.col("members") > list_block), "head")
    if not large.isEmpty():
        links = links.unionByName(_links_of_large(large.select("head", "node"), signatures, bodies_of, linked_within, shingle_words, num, den, matches, list_block))
    final = store(components(links), "labels")
    named = nodes.select("node", "class", "doc").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return signed, named.select("class", "doc", "label")


def _links_of_large(
    large: DataFrame, signatures: DataFrame, bodies_of, linked_within, size: int, num: int, den: int, matches: int, list_block: int
) -> DataFrame:
    """Links that connect the nodes of large tables (head, node) as far as they are connected."""
    large = store(large, "large")
    # all nodes against the centre and one more
    second = large.groupBy("head").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("q"))
    pairs = large.join(second, "head").select("node", F.explode(F.array_distinct(F.array("head", "q"))).alias("p")).where("node <> p")
    pairs = pairs.select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).distinct()
    slim = signatures.select("node", "signature")
    pairs = pairs.join(slim.toDF("a", "ga"), "a").join(slim.toDF("b", "gb"), "b").mapInArrow(_colliding(matches), "a bigint, b bigint")
    pairs = store(pairs, "pairs")
    bodies = store(bodies_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "bodies")
    pairs = pairs.join(bodies.toDF("a", "sa"), "a").join(bodies.toDF("b", "sb"), "b")
    stars = store(pairs.mapInArrow(_pairs_confirmed(size, num, den), "a bigint, b bigint"), "stars")
    labels = store(components(stars), "labels")

    # across components: the largest of a table against the others, and the others among themselves
    labelled = store(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    parts = labelled.groupBy("head", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("head").agg(
        F.count(F.lit(1)).alias("n_labels"), F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("k")
    ).where("n_labels > 1").select("head", F.col("top.label").alias("major"), F.col("top.k").alias("k_major"), "k")
    blocks_major = F.ceil(F.col("k_major") / list_block).cast("int")
    blocks_minor = F.ceil((F.col("k") - F.col("k_major")) / list_block).cast("int")
    is_major = F.col("label") == F.col("major")
    own = F.when(is_major, -1 - F.pmod(F.xxhash64("node"), blocks_major)).otherwise(F.pmod(F.xxhash64("node"), blocks_minor)).cast("int")
    minors, majors = F.sequence(F.lit(0), blocks_minor - 1), F.sequence(F.lit(-1), -blocks_major, F.lit(-1))
    partners = F.when(is_major, minors).otherwise(F.concat(minors, majors))
    pair = lambda y: F.struct(F.greatest("block", y).alias("left"), F.least("block", y).alias("right"))
    placed = labelled.join(parts, "head").withColumn("block", own).withColumn("w", F.explode(F.transform(partners, pair)))
    across = store(linked_within(placed.select("head", "node", "label", "block", "w.left", "w.right")), "across")
    return across.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest doc_id (nulls last).

    Rows are told apart by doc_id and text, so rows that share a doc_id but not a text are judged each for themselves; of
    rows that share both, one stays. Rows without words are linked with nothing and stay.
    """
    signed, named = _named(docs, shingle_words, 80, 100, LIST_BLOCK)
    rows = signed.where("class IS NOT NULL").select("doc_id", "body_key", "class").join(named.select("class", "label"), "class")
    rows = rows.groupBy("label", "doc_id", "body_key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body_key")
    first = rows.groupBy("label").agg(F.min(order).alias("f"))
    judged = rows.join(first, "label").withColumn("first", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("body_key") == F.col("f.body_key")))
    judged = store(judged.where("NOT first OR n > 1").select("doc_id", "body_key", "first"), "judged")
    # two numbers a row: as long as they are few, the texts need not move to be told apart
    small = judged.count() * _ROW_BYTES <= BROADCAST_BYTES
    keyed = docs.withColumn(_KEY, F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")))

    def among(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(F.col("doc_id").alias("_other"), F.col("body_key").alias("_other_key"))
        other = F.broadcast(other) if small else other
        return left.join(other, F.col("doc_id").eqNullSafe(F.col("_other")) & (F.col(_KEY) == F.col("_other_key")), how)

    kept = among(keyed, judged.where("NOT first"), "left_anti")
    twice = judged.where("first")
    if not twice.isEmpty():
        again = among(kept, twice, "left_semi").dropDuplicates(["doc_id", _KEY])
        kept = among(kept, twice, "left_anti").unionByName(again)
    return kept.select(docs.columns)


_KEY = "_neardup_body_key"
# A row of (doc_id, body_key) in the hash table of a broadcast.
_ROW_BYTES = 48
