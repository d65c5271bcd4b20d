import math
import zlib
from collections import Counter

import numpy as np

from tests.llm.data import awkward, docs, prose
from webledger.llm import pitman_yor as py


def words(text):
    return (text or "").encode().translate(py._LOWER).split() + [b""]


def test_base_score_and_counts_against_brute_force(spark, monkeypatch):
    rows = [(i, prose(i, i % 70, 300).title()) for i in range(150)] + [(None, "null id"), (500, None), (501, ""), (3, "same id"), (3, "same id")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((
        str(i), held(i), len(words(t)), sum(seen[w] > 0 for w in words(t)), n,
        round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t)), 6),
    ) for i, t in rows)
    first = None
    for tokens in (py.BLOCK_TOKENS, 500):
        monkeypatch.setattr(py, "BLOCK_TOKENS", tokens)
        got = py.score_texts(docs(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
        first = first or got


def test_model_beats_the_base_on_held_out_text(spark):
    # two languages that share no word: endings tell which one
    rows = [(i, prose(i, 200, 500).replace(" ", ("aa ", "bb ")[i % 2])) for i in range(200)]
    got = [r for r in py.score_texts(docs(spark, rows)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 10 * len(got)


def one_part(seed=1, n_words=200):
    rng = np.random.default_rng(seed)
    word = np.repeat(np.arange(n_words), 4)
    context = np.tile(np.array([0, 3, 7, 100]), n_words)
    count = rng.geometric(0.2, len(word)) - 1
    count[:4] = (3000, 40, 0, 500)
    live = count > 0
    total = np.bincount(word, count, n_words)
    kinds = np.bincount(word, live, n_words)
    stats = [(total > 0).sum(), (kinds == 1).sum(), (kinds == 2).sum(), (count == 1).sum(), (count == 2).sum()]
    stats += [*np.bincount(context, count, py.CONTEXTS), *np.bincount(context, live, py.CONTEXTS)]
    return word, context, count, py.Totals(np.array(stats)), n_words


def test_seating_is_valid_and_repeatable():
    word, context, count, totals, n = one_part()
    runs = [list(py.Chain(5, word, context, count, n, totals).samples()) for _ in range(2)]
    assert len(runs[0]) == py.SAMPLES
    for (t, r, s), (t2, r2, s2) in zip(*runs, strict=True):
        assert (t == t2).all() and (r == r2).all() and (s == s2).all()
        live = count[count > 0]
        assert (t >= 1).all() and (t <= live).all() and (t[live == 1] == 1).all()
        assert (r == np.bincount(word[count > 0], t, n)).all()
        assert ((s >= 1) == (r > 0)).all() and (s <= np.maximum(r, 0)).all()
    assert any((a[0] != b[0]).any() for a, b in zip(runs[0], runs[0][1:], strict=False))


def test_probabilities_sum_to_one():
    word, context, count, totals, n = one_part()
    chain = py.Chain(5, word, context, count, n, totals)
    d = totals.discount
    for t, r, s in chain.samples():
        tables = np.bincount(chain.context, t, py.CONTEXTS)
        smooth = (py.STRENGTH + totals.root_discount * s.sum()) * totals.base
        parent = (r - totals.root_discount * s + smooth) / (py.STRENGTH + tables.sum())
        never = smooth / (py.STRENGTH + tables.sum())  # the unknown word
        known = total = np.bincount(word, count, n) > 0
        assert abs(parent[known].sum() + never - 1) < 1e-9 and total.sum() == totals.vocabulary
        for k in (0, 3, 7, 100, 50):
            own = np.zeros(n)
            here = chain.context == k
            own[chain.word[here]] = chain.count[here] - d * t[here]
            p = (own + (py.STRENGTH + d * tables[k]) * parent) / (py.STRENGTH + totals.customers[k])
            unknown = (py.STRENGTH + d * tables[k]) * never / (py.STRENGTH + totals.customers[k])
            assert abs(p[known].sum() + unknown - 1) < 1e-9


def test_table_sizes_add_up():
    rng = np.random.default_rng(3)
    c = rng.integers(1, 5000, 300)
    t = py._sequential(rng, c, np.full(300, 4.0), 0.6)
    cell, size = py._sizes(rng, c, t, 0.6)
    assert (size >= 1).all() and (np.bincount(cell, size) == c).all() and (np.bincount(cell) == t).all()
    cell, size = py.Chain._reseat(rng, cell, size, c, np.full(300, 4.0), 0.6, times=10)
    assert (size >= 1).all() and (np.bincount(cell, size) == c).all()


def test_awkward_rows(spark):
    got = py.score_texts(awkward(spark)).collect()
    assert len(got) == 11 and all(r.n_tokens >= 1 for r in got)
    assert py.score_texts(docs(spark, [])).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    alone = py.score_texts(docs(spark, [(i, "a b") for i in held])).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and abs(r.score) < 1e-9 for r in alone)


def exact_tables(c, new, d):
    """Chances of 1 to c tables, by the recursion of generalized Stirling numbers."""
    row = np.zeros(c + 1)
    row[1] = 1.0
    for m in range(1, c):
        row[1:] = row[:-1] * new + (m - d * np.arange(1, c + 1)).clip(0) * row[1:]
        row /= row.sum()
    return row[1:]


def test_tables_follow_the_exact_conditional():
    rng = np.random.default_rng(8)
    n = 20_000
    for c, new, d in ((2, 0.3, 0.5), (9, 0.01, 0.9), (40, 3.0, 0.7), (300, 25.0, 0.3), (2000, 0.5, 0.8), (2000, 60.0, 0.6)):
        want = exact_tables(c, new, d)
        got = np.bincount(py._tables(rng, np.full(n, c), np.full(n, new), d), minlength=c + 1)[1:] / n
        assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.016, (c, new, d)


def test_single_moves_come_to_the_same_tables():
    rng = np.random.default_rng(9)
    c, new, d = np.full(4000, 12), np.full(4000, 1.5), 0.6
    t = np.ones(len(c), np.int64)
    cell, size = py._sizes(rng, c, t, d)
    cell, size = py.Chain._reseat(rng, cell, size, c, new, d, times=150)
    got = np.bincount(np.bincount(cell), minlength=13)[1:] / len(c)
    assert np.abs(np.cumsum(got) - np.cumsum(exact_tables(12, 1.5, d))).max() < 0.035


def test_a_frequent_cell_is_seated_anew_in_every_sweep():
    # 200 words of 100,000 customers in a context; the parent's chances are about equal
    word, count = np.arange(200), np.full(200, 100_000)
    context = np.full(200, 3)
    stats = np.zeros(5 + 2 * py.CONTEXTS, np.int64)
    stats[:5] = (200, 50, 20, 60, 20)
    stats[5 + 3], stats[5 + py.CONTEXTS + 3] = count.sum(), 3000
    chain = py.Chain(1, word, context, count, 200, py.Totals(stats))
    t = np.array([a for a, _, _ in chain.samples()])
    assert np.abs(np.diff(t, axis=0)).max() > 4


def test_the_word_before_is_the_context(spark):
    # every word has its own successor, and all of them end alike
    rng = np.random.default_rng(4)
    names = [f"w{i}same" for i in range(60)]
    after = rng.permutation(60)
    rows = []
    for i in range(150):
        at, said = int(rng.integers(60)), []
        for _ in range(60):
            said.append(names[at])
            at = int(after[at])
        rows.append((i, " ".join(said)))
    got = [r for r in py.score_texts(docs(spark, rows)).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    # a word in itself is one of sixty; after the one before it is almost certain
    assert got and sum(r.base_score for r in got) / tokens < -1.7
    assert sum(r.score for r in got) / tokens > -0.3


def test_scores_against_brute_force_where_there_is_no_choice_of_tables(spark):
    # no training word comes twice, but for the end token, whose parent tables are bounded by its customers
    from pyspark.sql import functions as F

    rows = [(0, "a b c d e"), (10, "b c"), (11, "c a z"), (12, ""), (13, "z z")]
    got = {r.doc_id: r for r in py.score_texts(docs(spark, rows), F.col("doc_id") >= 10).collect()}
    # each word has one customer at one table in the restaurant of the word before, in that one's class, and in the parent
    v, d = 6, 0.95
    smooth = (py.STRENGTH + d * v) / (v + 1)
    known = (1 - d + smooth) / (py.STRENGTH + 6)
    never = smooth / (py.STRENGTH + 6)
    seen = {"": "a", "a": "b", "b": "c", "c": "d", "d": "e", "e": ""}
    kind = {k: py.context_of(k.encode()) for k in [*seen, "z"]}

    def p(before, word):
        size = sum(kind[k] == kind[before] for k in seen)
        inside = any(kind[k] == kind[before] and w == word for k, w in seen.items())
        top = ((1 - d) * inside + (py.STRENGTH + d * size) * (known if word in seen else never)) / (py.STRENGTH + size)
        if before not in seen:
            return top
        return ((1 - d) * (seen[before] == word) + (py.STRENGTH + d) * top) / (py.STRENGTH + 1)

    for i, text in rows:
        said = ["", *text.split(), ""]
        want = sum(math.log10(p(a, b)) for a, b in zip(said, said[1:], strict=False))
        assert abs(got[i].score - want) < 1e-9, (text, got[i].score, want)
    # of every context, the chances of all words and of an unknown one
    assert all(abs(sum(p(k, w) for w in seen) + p(k, "z") - 1) < 1e-9 for k in [*seen, "z"])


def test_totals_of_contexts_are_whole_over_parts_and_blocks(spark, monkeypatch):
    rows = [(i, prose(i, i % 40, 200)) for i in range(120)]
    seen = {}
    for tokens in (py.BLOCK_TOKENS, 300):
        monkeypatch.setattr(py, "BLOCK_TOKENS", tokens)
        seen[tokens] = sum(r.score for r in py.score_texts(docs(spark, rows)).collect())
    # blocks only cut the work: parts and their counts are the same, so is the chain but for the order of words
    a, b = seen.values()
    assert abs(a - b) < 0.01 * abs(a)


class Counting:
    """A generator of random numbers that counts what it is asked for."""

    def __init__(self, seed):
        self.rng, self.calls = np.random.default_rng(seed), 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.rng, name)


def test_a_cell_of_many_tables_takes_no_step_for_each():
    rng = Counting(3)
    got = [py._tables(rng, np.array([100_000]), np.array([3000.0]), 0.74)[0] for _ in range(20)]
    assert rng.calls < 1000
    # chances of single tables are even to some hundreds here
    about = py._expected(np.array([100_000.0]), np.array([3000.0]), 0.74)[0][0]
    assert about > 2000 and all(abs(t - about) < 8 * np.sqrt(about) for t in got) and len(set(got)) > 5


def test_chances_of_many_tables_are_exact():
    u = np.linspace(1e-4, 1 - 1e-4, 101)
    for c, new, d in ((3000, 60.0, 0.6), (3000, 500.0, 0.3), (3000, 5000.0, 0.9), (3000, 300.0, 0.74), (2000, 2000.0, 0.1), (2000, 40.0, 0.5)):
        upto = np.cumsum(exact_tables(c, new, d))
        want = np.searchsorted(upto, u * upto[-1]) + 1
        (about,), (saddle,) = py._expected(np.array([float(c)]), np.array([new]), d)
        assert [py._by_chances(x, float(c), new, d, about, saddle) for x in u] == want.tolist(), (c, new, d)


def test_few_customers_follow_the_exact_conditional_whatever_a_new_table_weighs():
    rng = np.random.default_rng(12)
    n = 20_000
    for c, new, d in ((2, 1e-9, 0.5), (3, 0.7, 0.95), (64, 1e4, 0.1), (64, 300.0, 0.74), (64, 1e5, 0.5)):
        few = 200 if new > py._HEAVY else n
        got = np.bincount(py._tables(rng, np.full(few, c), np.full(few, new), d), minlength=c + 1)[1:] / few
        assert np.abs(np.cumsum(got) - np.cumsum(exact_tables(c, new, d))).max() < 2.3 / np.sqrt(few), (c, new, d)


def test_words_are_those_between_white_space_of_any_bytes():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    said = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in rng.integers(0, 80, 400)]
    said += [b"", b" \t\n\x0b\x0c\r ", bytes(range(256)), "É\u00a0x\u2003Y \x1c\x85Z".encode(), b"\xff A\x00B"]
    for start, stop in ((0, len(said)), (7, 60), (0, 0)):
        sizes, found = py._split(pa.array(said, pa.binary()).slice(start, stop - start))
        want = [s.translate(py._LOWER).split() for s in said[start:stop]]
        assert sizes.tolist() == [len(w) for w in want] and found.to_pylist() == [w for ws in want for w in ws]


def test_words_numbered_in_portions_are_those_numbered_at_once(monkeypatch):
    import pyarrow as pa

    said = [[prose(i, i % 40, 200).encode() for i in range(k, k + 10)] + [b""] for k in range(0, 60, 10)]
    fields = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()),
        ("part", pa.int32()), ("words", pa.binary()), ("size", pa.int64()), ("counts", pa.binary()),
    ])
    seen = []
    for size in (py.WORD_BYTES, 0):
        monkeypatch.setattr(py, "WORD_BYTES", size)
        block = py._Block(1, 7)
        for k, texts in enumerate(said):
            sizes, found = py._split(pa.array(texts, pa.binary()))
            block.add([100 * k + i for i in range(len(texts))], [i % 3 == 0 for i in range(len(texts))], sizes, found)
        assert len(block.coded) == (0 if size else len(said))
        seen.append([b.to_pylist() for b in block.rows(fields.names, fields)])
    assert seen[0] == seen[1]
    # the numbers are those of the words in the block's parts, in order
    names = [w for r in seen[0][1] for w in pa.decompress(r["words"], r["size"], "zstd", asbytes=True).split(b" ")]
    got = [py._unpack(r["ids"]) for r in seen[0][0]]
    assert [len(g) for g in got] == [len(t.split()) + 1 for texts in said for t in texts]
    assert [[names[i] for i in g] for g in got] == [[*t.translate(py._LOWER).split(), b""] for texts in said for t in texts]
