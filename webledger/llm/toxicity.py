"""Toxicity: a learned lexicon, matched with spelling errors, and scores of the words around.

The lexicon (terms and word stems that occur almost only in toxic documents) is counted on a
bounded sample of labelled training documents. Its trie is intersected with the Levenshtein
automata of all its terms: one deterministic automaton, built as words ask for it, whose states are
sets of (trie node, errors so far). A word costs one table step per character and most words
die after a few. Around each hit, the words of a window tell quotation (quote marks) from abuse
(other hits nearby). A logistic model over these figures gives the score.

Defined cases: null texts are empty and get a score; null or repeated doc_ids are scored row by row;
without labels every score is 0.5, with one class only scores lean to it; an empty lexicon leaves
the model with the base rate; of terms of equal weight the first in code-point order stay; very long texts are scanned whole, a
few rows at a time; only doc_id, text and the labels are read, so other columns cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webledger.llm import learn
from webledger.llm.common import claim, fold, in_pieces, texts
from webledger.scale import store

# Terms and stems in the lexicon, at most: the heaviest stay.
LEXICON = 600
STEM_LENGTHS = (4, 5, 6, 7, 8)
# A term must be seen in so many toxic sample documents, in such a share of them, and be so many
# times likelier there; random words in a few copies of one text are none.
LEAST_SEEN, LEAST_SHARE, LEAST_LIFT = 3, 0.01, 15.0
WINDOW = 6
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”«»‘’"
_QUOTE = re.compile("[\"“”«»]")
_STATES, _WORDS = 50_000, 200_000


def core(word: str) -> str:
    return word.strip(_EDGE)


def _counts(batches):
    for batch in batches:
        terms: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for piece in in_pieces([batch]):
            for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist(), strict=True):
                words = {core(w) for w in text.decode("utf-8").lower().split()}
                stems = {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}
                terms[label > 0].update(words)
                terms[label > 0].update(stems)
        names = list(terms[True].keys() | terms[False].keys())
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(names, pa.string()),
            "bad": pa.array([terms[True][t] for t in names], pa.int64()),
            "good": pa.array([terms[False][t] for t in names], pa.int64()),
        })


def learn_lexicon(docs: DataFrame, picked: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Term → weight. Stems end in ``*``. Equal texts count once."""
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    chosen = chosen.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label").dropDuplicates(["text", "label"])
    totals = {r["label"] > 0: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = totals.get(True, 0), totals.get(False, 0)
    if not n_bad or not n_good:
        return {}
    counted = chosen.mapInArrow(_counts, "term string, bad bigint, good bigint").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    lift = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
    often = F.col("bad") >= max(LEAST_SEEN, LEAST_SHARE * n_bad)
    heavy = counted.where((F.length("term") >= 4) & often).withColumn("lift", lift)
    heavy = heavy.where(F.col("lift") >= LEAST_LIFT).withColumn("weight", F.log("lift") * F.sqrt(F.col("bad") / n_bad))
    best = heavy.orderBy(F.desc("weight"), "term").limit(size).collect()
    return {r["term"]: float(np.log(r["lift"])) for r in best}


def errors_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Matcher:
    """Levenshtein automata of all terms over their trie, made deterministic on demand."""

    def __init__(self, lexicon: dict[str, float]):
        self.terms = sorted(t for t in lexicon if not t.endswith("*"))
        self.stems = {t[:-1]: w for t, w in lexicon.items() if t.endswith("*")}
        self.weight = [lexicon[t] for t in self.terms]
        self.next: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.room = [0]
        for which, term in enumerate(self.terms):
            at, k = 0, errors_allowed(len(term))
            self.room[0] = max(self.room[0], k)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.room.append(0)
                at = self.next[at][c]
                self.room[at] = max(self.room[at], k)
            self.term_at[at] = which
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.words: dict[str, tuple | None] = {}
        self.start = self._number({(0, 0)})

    def _number(self, found: set[tuple[int, int]]) -> int:
        # letters of a term that the word lacks
        queue = list(found)
        while queue:
            node, e = queue.pop()
            for child in self.next[node].values():
                if e < self.room[child] and (child, e + 1) not in found:
                    found.add((child, e + 1))
                    queue.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in found:
            if e < least.get(node, 99):
                least[node] = e
        state = frozenset(least.items())
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
        return self.numbers[state]

    def _step(self, at: int, c: str) -> int:
        found: set[tuple[int, int]] = set()
        for node, e in self.sets[at]:
            if e < self.room[node]:
                found.add((node, e + 1))  # a letter too many
            for letter, child in self.next[node].items():
                if letter == c:
                    found.add((child, e))
                elif e < self.room[child]:
                    found.add((child, e + 1))
        to = self._number(found) if found else -1
        self.steps[at][c] = to
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """(0 exact, 1 misspelled, 2 stem; weight) of the best term, or None."""
        if word in self.words:
            return self.words[word]
        if len(self.sets) > _STATES or len(self.words) > _WORDS:
            self._reset()
        at = self.start
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                break
        best = None
        if at >= 0:
            for node, e in self.sets[at]:
                which = self.term_at.get(node)
                if which is not None and e <= errors_allowed(len(self.terms[which])):
                    kind = (0 if e == 0 else 1, self.weight[which])
                    if best is None or (kind[0], -kind[1]) < (best[0], -best[1]):
                        best = kind
        if best is None or best[0]:
            stem = max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) > n), default=0.0)
            if stem > 0:
                best = (2, stem)
        self.words[word] = best
        return best


WIDTH = 10


def figures(text: bytes, matcher: Matcher) -> list[float]:
    """Counts of hits by kind, weights, density, and the windows around hits."""
    raw = text.decode("utf-8").lower().split()
    found = {w: m for w in set(raw) if (m := matcher.match(core(w))) is not None}
    if not found:
        return [0.0] * WIDTH
    hits = [(i, *found[w]) for i, w in enumerate(raw) if w in found]
    kinds = Counter(kind for _, kind, _ in hits)
    quoted, near, top = 0, 0, 0.0
    strong = [(i, w if kind != 1 else w / 3) for i, kind, w in hits]
    low = high = 0
    inside = 0.0
    for i, _ in strong:
        while high < len(strong) and strong[high][0] <= i + WINDOW:
            inside += strong[high][1]
            high += 1
        while strong[low][0] < i - WINDOW:
            inside -= strong[low][1]
            low += 1
        near += high - low > 1
        top = max(top, inside)
        quoted += bool(_QUOTE.search(" ".join(raw[max(0, i - WINDOW) : i + WINDOW + 1])))
    sure = kinds[0] + kinds[2]
    return [
        float(np.log1p(kinds[0])),
        float(np.log1p(kinds[1])),
        float(np.log1p(kinds[2])),
        float(np.log1p(sum(w for _, w in strong))),
        float(sure > 0),
        float(np.log1p(100.0 * sure / len(raw))),
        float(np.log1p(100.0 * kinds[1] / len(raw))),
        float(np.log1p(len({core(w) for w, m in found.items() if m[0] != 1}))),
        top - (top / 2 if quoted == len(hits) else 0.0),
        near / len(hits) - quoted / len(hits),
    ]


_MATCHERS: dict[str, Matcher] = {}


def measure(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, features) of every document, stored."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    key = repr(sorted(lexicon.items()))

    def run(batches):
        claim("toxicity", _MATCHERS.clear)
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(lexicon)
        matcher = _MATCHERS[key]
        for batch in in_pieces(batches):
            found = [figures(t, matcher) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "features"]
            )

    return store(rows.mapInArrow(run, f"doc_id {kind}, features array<double>"), "toxicity")


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = learn.SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    picked = store(learn.labelled_ids(labels, "toxic", fold(5) != 0, sample_rows), "labelled")
    features = measure(docs, learn_lexicon(docs, picked))
    model = learn.Logistic().fit(*learn.training_matrix(features, picked))
    return learn.score_all(features, fold(5) == 0, model.predict)
