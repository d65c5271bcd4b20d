"""Secrets: a linear-chain conditional random field over the words of whole texts, beside fixed patterns.

Words (runs without ASCII white space) get one of three tags: outside, begin or inside a secret. The score of a
tag adds weights of the word's own features (shape, length, kinds of characters, the word itself where it is one),
of the same features of the two words before and the one after, and of the file (how much of it
is assignments, digits, brackets); weights between neighbouring tags do the rest. Viterbi finds the best tags.

Most words are so clearly outside that no tags around them could change it: the lead of "outside" is larger
than all that the weights between tags can give. The best path goes through "outside" there, whatever stands around, so a text
falls into short stretches between such words, and Viterbi runs on these alone. The result is that of the whole
text. Features of a word are worked out once per Python worker and kept in a table of bounded size.

There are no labels for secrets, so the field learns from what the patterns find (``BASE``), with the word itself
hidden from it now and then, so that shape and neighbours must do. It is fitted on windows of words from at most
``SAMPLE_DOCS`` documents, picked by a hash of the id: at most ``SAMPLE_WINDOWS`` with a secret, and ``OUTSIDE_WINDOWS`` times as
many around odd words that are none and around any word; only numbers of features and words without digits reach the driver. Windows without a
secret are few of all there are, so "outside" gets the logarithm of that ratio on top. What it finds beyond the patterns is added; the patterns' spans stay as they are.

Defined cases: null texts are empty and have no spans; null and repeated doc_ids are scanned row by row; a text that
is one long word is one word; very long texts are scanned whole, a few documents at a time; ties between tags go to
"outside"; without any secret in the sample the field adds nothing; an empty table gives an empty result. Only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.llm.common import claim, in_pieces, texts
from webledger.scale import store

SAMPLE_DOCS, SAMPLE_WINDOWS = 20_000, 2_000
# Words of a window on each side of a secret.
AROUND = 8
# Windows around odd words of a document that are no secrets, and windows without a secret to each with one.
ODD_WINDOWS, OUTSIDE_WINDOWS = 3, 3
# A word counts by name if so many windows with a secret have it.
NAME_WINDOWS = 3
O, B, I = 0, 1, 2
# The word itself, the first and the second before it, the one after it.
ROLES = (0, -1, -2, 1)
_KNOWN, _LONG = 100_000, 256

# Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
LEARNED = "crf"
_ORDER = {kind: i for i, kind in enumerate([*(b[0] for b in BASE), LEARNED])}
# What a text must hold for a pattern to match at all, asked of its bytes.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api")
_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LONG_HEX = b"h" * 24

Span = tuple[str, int, int]


def base_spans(body: bytes, text: str | None = None) -> list[Span]:
    """(kind, start, end) of the patterns' matches, in code points, by start and kind."""
    low = body.lower()
    asked = (any(n in low for n in _NAMES), b"AKIA" in body, _LONG_HEX in body.translate(_HEX))
    if not any(asked):
        return []
    text = body.decode("utf-8", "replace") if text is None else text
    out = []
    for (kind, pattern, group, least), ask in zip(BASE, asked, strict=True):
        if ask:
            out += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=_place)


def _place(span: Span):
    return span[1], _ORDER[span[0]]


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`()[]{}<>,;:.!?=|"
_EDGE_BYTES = _EDGE.encode()
# Letters, capitals, digits and bytes above ASCII by kind; other bytes stay.
_KIND = bytes(97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256))
# ASCII lowered, marks of an edge as NUL, so that words can be stripped of them.
_LOW = bytes(0 if b in _EDGE_BYTES else b + 32 if 65 <= b <= 90 else b for b in range(256))
_TWICE = re.compile(rb"(.)\1+", re.DOTALL)


def _numbers(features: list[str]) -> tuple[int, ...]:
    return tuple(zlib.crc32(f.encode()) for f in features)


def _letters(kinds: bytes) -> int:
    """Characters of a word; two bytes above ASCII count as one, which holds for most letters."""
    return len(kinds) - kinds.count(b"u") // 2


def kind_features(kinds: bytes) -> tuple[int, ...]:
    """What the kinds of a word's characters tell: shape, length, digits, capitals, marks."""
    core = kinds.strip(_EDGE_BYTES)
    shape = _TWICE.sub(rb"\1", core)
    n = max(_letters(core), 1)
    marks = kinds.decode("latin-1")
    return _numbers([
        "any",
        f"s{shape if len(shape) <= 4 else 'long'}",
        f"l{min(n.bit_length(), 8)}",
        f"d{8 * core.count(b'9') // n}",
        f"c{8 * core.count(b'A') // n}",
        f"t{min(len(shape).bit_length(), 6)}",
        f"q{marks[0] in _EDGE and marks[0]}{marks[-1] in _EDGE and marks[-1]}",
        f"={b'=' in core or b':' in core}{marks if len(marks) == 1 and marks in _EDGE else ''}",
    ])


def made(kinds: bytes) -> bool:
    """Whether a word of these kinds is looked at for its make, having digits or being very long."""
    return b"9" in kinds or _letters(kinds.strip(_EDGE_BYTES)) >= 20


def make_features(word: bytes) -> tuple[int, ...]:
    core = word.strip(_EDGE_BYTES)
    n = max(len(core), 1)
    return _numbers([
        f"v{min(n.bit_length(), 6)} {8 * len(set(core)) // min(n, 32)}",
        f"h{n >= 16 and not core.strip(b'0123456789abcdef')}",
        f"p{core[:4]}" if n >= 12 else "p",
        f"@{b'@' in core}{core.count(b'.') >= 2}",
    ])


def name_feature(name: bytes) -> int:
    return zlib.crc32(b"w" + name)


def file_features(body: bytes, n_words: int) -> tuple[int, ...]:
    n = max(n_words, 1)
    return _numbers([
        f"F={min((64 * body.count(b'=') // n).bit_length(), 6)}",
        f"F:{min((64 * body.count(b':') // n).bit_length(), 6)}",
        f"F{{{min((64 * (body.count(b'{') + body.count(b'(')) // n).bit_length(), 6)}",
        f"F|{min((64 * body.count(b'|') // n).bit_length(), 6)}",
        f"Fn{min(n.bit_length(), 16)}",
    ])


_NOTHING = _numbers(["edge"])


class Field:
    """Weights of the field: per role, feature and tag; per file feature and tag; per pair of tags.

    Row 0 of the features is that of all that were not seen when the field was fitted; it stays zero.
    """

    def __init__(self):
        self.row: dict[int, int] = {}
        self.names: list[bytes] = []
        self.role = np.zeros((len(ROLES), 1, 3))
        self.file = np.zeros((1, 3))
        self.pair = np.zeros((3, 3))
        self.rare = 0.0
        self.learned = False

    def rows(self, features: Sequence[int]) -> list[int]:
        return [self.row.get(f, 0) for f in features]

    def role_scores(self, features: Sequence[int]) -> np.ndarray:
        """roles x tags"""
        return self.role[:, self.rows(features)].sum(1)

    def file_scores(self, features: Sequence[int]) -> np.ndarray:
        out = self.file[self.rows(features)].sum(0)
        out[O] += self.rare
        return out

    def lead(self) -> np.ndarray:
        """For begin and inside: by how much "outside" must lead to be on the best path for certain."""
        into, out = self.pair - self.pair[:, [O]], self.pair - self.pair[[O], :]
        return (into.max(0) + out.max(1))[[B, I]]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a stretch with "outside" on both sides; of equal ones the lower."""
        pair = self.pair.tolist()
        rows = scores.tolist()
        best = [pair[O][s] + rows[0][s] for s in range(3)]
        back = []
        for row in rows[1:]:
            came = [max(range(3), key=lambda p, s=s: best[p] + pair[p][s]) for s in range(3)]
            best = [best[came[s]] + pair[came[s]][s] + row[s] for s in range(3)]
            back.append(came)
        at = max(range(3), key=lambda s: best[s] + pair[s][O])
        tags = [at]
        for came in reversed(back):
            at = came[at]
            tags.append(at)
        return tags[::-1]

    def tags(self, scores: np.ndarray) -> dict[int, int]:
        """Place and tag of all words that are not outside, for the scores of a whole text."""
        safe = ((scores[:, [O]] - scores[:, [B, I]]) > self.lead()).all(1)
        open_ = np.flatnonzero(~safe)
        out: dict[int, int] = {}
        if not len(open_):
            return out
        for stretch in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            for i, tag in zip(stretch.tolist(), self.viterbi(scores[stretch]), strict=True):
                if tag != O:
                    out[i] = tag
        return out

    def likelihood(self, batch: Windows) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Mean log likelihood of the windows and its gradient for (role, file, pair)."""
        by_word = np.add.reduceat(self.role[:, batch.flat], batch.starts, axis=1)  # roles x words x tags
        scores = sum(by_word[r][batch.at[r]] for r in range(len(ROLES)))
        scores = scores + np.add.reduceat(self.file[batch.file_flat], batch.file_starts, axis=0)[:, None, :]
        n, length, _ = scores.shape
        top = scores.max(2, keepdims=True)
        # places behind the end of a window can be outside only, and so change nothing
        local = np.exp(scores - top) * batch.allowed
        pair = np.exp(self.pair)
        ahead, behind, scale = np.empty_like(local), np.empty_like(local), np.empty((n, length))
        row = pair[O] * local[:, 0]
        for t in range(length):
            if t:
                row = (ahead[:, t - 1] @ pair) * local[:, t]
            scale[:, t] = row.sum(1)
            ahead[:, t] = row / scale[:, [t]]
        end = ahead[:, -1] @ pair[:, O]
        behind[:, -1] = pair[:, O] / end[:, None]
        for t in range(length - 2, -1, -1):
            behind[:, t] = (local[:, t + 1] * behind[:, t + 1]) @ pair.T / scale[:, [t + 1]]
        total = (np.log(scale).sum(1) + np.log(end)) + (top[..., 0]).sum(1)
        tags, one = batch.tags, np.eye(3)
        given = np.take_along_axis(scores, tags[..., None], 2)[..., 0].sum(1)
        given += self.pair[O, tags[:, 0]] + self.pair[tags[:, :-1], tags[:, 1:]].sum(1) + self.pair[tags[:, -1], O]
        slope = one[tags] - ahead * behind
        of_pair = np.zeros((3, 3))
        np.add.at(of_pair, (tags[:, :-1], tags[:, 1:]), 1)
        following = local[:, 1:] * behind[:, 1:] / scale[:, 1:, None]
        of_pair -= np.einsum("nti,ntj->ij", ahead[:, :-1], following) * pair
        of_pair[O] += slope[:, 0].sum(0)
        of_pair[:, O] += slope[:, -1].sum(0)
        size, words = self.role.shape[1], len(batch.starts)
        role = np.empty_like(self.role)
        for r in range(len(ROLES)):
            for s in range(3):
                of_word = np.bincount(batch.at[r].ravel(), slope[..., s].ravel(), words)
                role[r, :, s] = np.bincount(batch.flat, np.repeat(of_word, batch.sizes), size)
        per_file = slope.sum(1)
        file = np.stack([np.bincount(batch.file_flat, np.repeat(per_file[:, s], batch.file_sizes), size) for s in range(3)], 1)
        return float((given - total).mean()), (role / n, file / n, of_pair / n)

    def fit(self, windows: list[dict], rare: float = 0.0, steps: int = 60, rate: float = 0.15, l2: float = 1e-5) -> Field:
        """Adam over all windows at once; ``rare``: lead of "outside" where windows without a secret are a sample."""
        if not any(any(w["tags"]) for w in windows):
            return self
        # the words by name that secrets have around them; others have no feature of their own
        seen = Counter(name for w in windows if any(w["tags"]) for name in {n for n in w["names"] if n})
        self.names = sorted(name for name, n in seen.items() if n >= NAME_WINDOWS)
        own = {name: name_feature(name) for name in self.names}
        windows = [w | {"words": [[*f, own[n]] if n in own else f for f, n in zip(w["words"], w["names"], strict=True)]} for w in windows]
        for w in windows:
            for f in (*(x for word in w["words"] for x in word), *w["file"]):
                self.row.setdefault(f, len(self.row) + 1)
        size = len(self.row) + 1
        self.role, self.file = np.zeros((len(ROLES), size, 3)), np.zeros((size, 3))
        batch = Windows(windows, self.row)
        weights = [self.role, self.file, self.pair]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            for w, g, m, v in zip(weights, self.likelihood(batch)[1], first, second, strict=True):
                g = g - l2 * w
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.rare, self.learned = rare, True
        return self


class Windows:
    """Windows as arrays: words by number, filled up to one length."""

    def __init__(self, windows: list[dict], row: dict[int, int]):
        known: dict[tuple[int, ...], int] = {(): 0}
        length = max(len(w["tags"]) for w in windows)
        before, after = -min(ROLES), max(ROLES)
        words = np.zeros((len(windows), before + length + after), np.int64)
        self.tags = np.zeros((len(windows), length), np.int64)
        self.allowed = np.zeros((len(windows), length, 3))
        self.allowed[..., O] = 1
        for i, w in enumerate(windows):
            numbers = [known.setdefault(tuple(f), len(known)) for f in w["words"]]
            words[i, : len(numbers)] = numbers
            self.tags[i, : len(w["tags"])] = w["tags"]
            self.allowed[i, : len(w["tags"])] = 1
        self.at = [words[:, before + r : before + r + length] for r in ROLES]
        # a word without features has the row that stays zero
        listed = [[row.get(x, 0) for x in f] or [0] for f in known]
        self.sizes = np.array([len(f) for f in listed])
        self.flat = np.concatenate([np.array(f, np.int64) for f in listed])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.file_sizes = np.array([len(w["file"]) for w in windows])
        self.file_flat = np.concatenate([np.array([row.get(x, 0) for x in w["file"]], np.int64) for w in windows])
        self.file_starts = np.cumsum(self.file_sizes) - self.file_sizes


def tags_of(spans: list[Span], places: list[tuple[int, int]]) -> dict[int, int]:
    """Tags that spans give to words with these places; words of overlapping spans are one secret."""
    out: dict[int, int] = {}
    starts = [a for a, _ in places]
    for _, a, b in spans:
        i = max(bisect_left(starts, a + 1) - 1, 0)
        first = True
        while i < len(places) and places[i][0] < b:
            if places[i][1] > a:
                out.setdefault(i, B if first and out.get(i - 1, O) == O else I)
                first = False
            i += 1
    return out


def windows_of(body: bytes, seed: int) -> list[tuple[bool, dict]]:
    """(holds a secret, window) of a text: around each secret, around odd words that are none, and one anywhere."""
    words, kinds = body.split(), body.translate(_KIND).split()
    if not words:
        return []
    text = body.decode("utf-8", "replace")
    places = [m.span() for m in _WORD.finditer(text)]
    tags = tags_of(base_spans(body, text), places)
    file = list(file_features(body, len(words)))
    before, after = -min(ROLES), max(ROLES)

    def window(lo: int, hi: int, hide: bool) -> dict:
        features, names = [], []
        for i in range(lo - before, hi + after):
            inside = 0 <= i < len(words)
            f = kind_features(kinds[i]) if inside else _NOTHING
            shown = inside and not (hide and zlib.crc32(f"{seed}:{i}".encode()) % 3 == 0)
            name = words[i].strip(_EDGE_BYTES).lower() if shown and not made(kinds[i]) else b""
            features.append(list(f + make_features(words[i]) if shown and made(kinds[i]) else f))
            names.append(name)
        return {"words": features, "names": names, "tags": [tags.get(i, O) for i in range(lo, hi)], "file": file}

    out, done = [], 0
    for start in sorted(i for i, t in tags.items() if t == B):
        end = start + 1
        while tags.get(end, O) == I:
            end += 1
        # the words around are outside, as the field takes them to be
        lo, hi = start, end
        while lo > done and start - lo < AROUND and lo - 1 not in tags:
            lo -= 1
        while hi < len(words) and hi - end < AROUND and hi not in tags:
            hi += 1
        out.append((True, window(lo, hi, True)))
        done = hi
    odd = [i for i, k in enumerate(kinds) if (made(k) or b"=" in k) and i not in tags]
    odd = sorted(odd, key=lambda i: zlib.crc32(f"{seed}:{i}".encode()))[:ODD_WINDOWS]
    for at in (zlib.crc32(str(seed).encode()) % len(words), *odd):
        lo = hi = at
        while lo > 0 and at - lo < AROUND and lo - 1 not in tags:
            lo -= 1
        while hi < len(words) and hi - at < AROUND and hi not in tags:
            hi += 1
        if hi > at:
            out.append((False, window(lo, hi, False)))
    return out


_WINDOW = "secret boolean, pick bigint, size bigint, words array<array<bigint>>, names array<binary>, tags array<int>, file array<bigint>"
_ARROW = pa.schema([
    ("secret", pa.bool_()), ("pick", pa.int64()), ("size", pa.int64()), ("words", pa.list_(pa.list_(pa.int64()))),
    ("names", pa.list_(pa.binary())), ("tags", pa.list_(pa.int32())), ("file", pa.list_(pa.int64())),
])


def _windows(batches):
    claim("secrets", _TAGGERS.clear)
    for batch in in_pieces(batches):
        rows = []
        for body, pick in zip(batch.column("text").to_pylist(), batch.column("pick").to_pylist(), strict=True):
            size = len(body.split())
            for k, (secret, window) in enumerate(windows_of(body, pick)):
                rows.append({"secret": secret, "pick": zlib.crc32(f"{pick}:{k}".encode()), "size": size if k == 0 else 0, **window})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def learn_field(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Field:
    """A field fitted on windows of at most ``sample_docs`` documents."""
    rows = texts(docs).withColumn("pick", F.xxhash64("doc_id"))
    ids = rows.select("doc_id", "pick").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = store(ids.orderBy("pick", "doc_id").limit(sample_docs).select("doc_id"), "sampled")
    # of rows that share a doc_id, all are cut into windows; the number of windows is bounded below
    found = store(rows.join(F.broadcast(ids), "doc_id").select("text", "pick").mapInArrow(_windows, _WINDOW), "windows")
    order = ["pick", F.xxhash64("words"), F.xxhash64("tags")]
    with_one, without = (
        found.where(F.col("secret") == s).orderBy(*order).limit(n).toArrow().to_pylist()
        for s, n in ((True, sample_windows), (False, OUTSIDE_WINDOWS * sample_windows))
    )
    # secrets are far rarer in texts than in the windows
    sizes = found.groupBy("secret").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    words = sum(r["words"] for r in sizes)
    share = min(1.0, len(with_one) / max([r["n"] for r in sizes if r["secret"]], default=1))
    taken = sum(len(w["tags"]) for w in without)
    return Field().fit(with_one + without, rare=float(np.log(max(1.0, words * share / max(taken, 1)))))


class Tagger:
    """Finds secrets with a field. Scores of kinds and of words with digits are kept in tables of bounded size.

    Most words have no name that the field knows; they have a score by kind only.
    """

    def __init__(self, field: Field):
        self.field = field
        self._reset()

    def _reset(self) -> None:
        self.kinds: dict[bytes, int] = {}
        self.makes: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(ROLES), 3))
        self.made = np.zeros(1024, bool)
        self.used = 1
        self.names = {name: self._add([name_feature(name)]) for name in self.field.names}
        self.names[b""] = 0
        self.edge = self._add(_NOTHING)

    def _add(self, features: Sequence[int]) -> int:
        if self.used == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.made = np.concatenate([self.made, np.zeros_like(self.made)])
        self.scores[self.used] = self.field.role_scores(features)
        self.used += 1
        return self.used - 1

    def word_scores(self, body: bytes, words: list[bytes]) -> np.ndarray:
        """words x tags"""
        if self.used > _KNOWN:
            self._reset()
        kinds = body.translate(_KIND).split()
        by_kind, by_make = self.kinds, self.makes
        found = list(map(by_kind.get, kinds))
        long = []
        if None in found:
            for k in set(kinds).difference(by_kind):
                by_kind[k] = self._add(kind_features(k))
                self.made[by_kind[k]] = made(k)
                if len(k) > _LONG:
                    long.append(k)
            found = [by_kind[k] for k in kinds]
            for k in long:  # very long ones are not kept
                del by_kind[k]
        before, after, n = -min(ROLES), max(ROLES), len(words)
        of_kind, of_word = np.full((2, before + n + after), self.edge)
        of_kind[before : before + n] = found
        of_word[:] = 0
        name = self.names.get
        of_word[before : before + n] = [name(w.strip(b"\0"), 0) for w in body.translate(_LOW).split()]
        for i in np.flatnonzero(self.made[of_kind[before : before + n]]).tolist():
            row = by_make.get(words[i])
            if row is None:
                row = self._add(make_features(words[i]))
                if len(words[i]) <= _LONG:
                    by_make[words[i]] = row
            of_word[before + i] = row
        out = self.field.file_scores(file_features(body, n)) + np.zeros((n, 1))
        some = np.flatnonzero(of_word)
        for r, role in enumerate(ROLES):
            out += self.scores[of_kind[before + role : before + role + n], r]
            to = some - before - role
            inside = (to >= 0) & (to < n)
            out[to[inside]] += self.scores[of_word[some[inside]], r]
        return out

    def spans(self, body: bytes) -> tuple[list[Span], list[Span]]:
        """(spans of the patterns, spans that the field adds)."""
        base = base_spans(body)
        if not self.field.learned:
            return base, []
        words = body.split()
        if not words:
            return base, []
        tags = self.field.tags(self.word_scores(body, words))
        if not tags:
            return base, []
        text = body.decode("utf-8", "replace")
        places = [m.span() for m in _WORD.finditer(text)]
        more: list[Span] = []
        for i in sorted(tags):
            a, b = places[i]
            if tags[i] == I and i - 1 in tags:
                more[-1] = (LEARNED, more[-1][1], b)
            else:
                more.append((LEARNED, a, b))
        out = []
        for _, a, b in more:
            found = text[a:b]
            b = a + len(found.rstrip(_EDGE))
            a = a + len(found) - len(found.lstrip(_EDGE))
            if a < b and not any(x < b and a < y for _, x, y in base):
                out.append((LEARNED, a, b))
        return base, out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every secret replaced by its kind; overlapping spans are one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=_place):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_TAGGERS: dict[str, Tagger] = {}
_SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, field: Field, with_text: bool = False) -> DataFrame:
    """(doc_id, base, added[, text]) of every document: spans in code points, and the text without secrets."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, field))

    def run(batches):
        claim("secrets", _TAGGERS.clear)
        key, own = shared.value
        if key not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[key] = Tagger(own)
        tagger = _TAGGERS[key]
        as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        for batch in in_pieces(batches):
            bodies = batch.column("text").to_pylist()
            found = [tagger.spans(body) for body in bodies]
            columns = [batch.column("doc_id"), *(pa.array([as_rows(f[i]) for f in found], _SPANS) for i in (0, 1))]
            names = ["doc_id", "base", "added"]
            if with_text:
                clean = [redacted(body.decode("utf-8", "replace"), b + a) for body, (b, a) in zip(bodies, found, strict=True)]
                columns, names = [*columns, pa.array(clean, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, base {_SPAN}, added {_SPAN}" + ", text string" * with_text)


def scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Learn a field from the documents and find the secrets of all of them."""
    return find_secrets(docs, learn_field(docs), with_text)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    order = F.create_map(*[x for kind, i in _ORDER.items() for x in (F.lit(kind), F.lit(i))])

    def written(spans):
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], order[s["kind"]], s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(b[0]) for b in BASE], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
