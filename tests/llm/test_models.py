import zlib

import numpy as np

from tests.llm.data import awkward, docs, prose
from webledger.llm import learn, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, label string, score string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], LABELS)


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def test_trees_learn_and_match_their_own_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = learn.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert (learn.BoostedTrees().fit(np.empty((0, 5)), np.empty(0)).predict(x[:3]) == 0.5).all()
    assert (learn.BoostedTrees().fit(x, np.ones(3000)).predict(x[:3]) > 0.9).all()


def test_tree_traversal_is_the_plain_walk():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500).astype(float)
    trees = learn.BoostedTrees(n_trees=7, depth=3).fit(x, y)
    for row, got in zip(x[:50], trees.predict(x[:50]), strict=True):
        z = trees.base
        for t in range(7):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.threshold[t, node])
            z += trees.value[t, node - 7]
        assert abs(got - learn.sigmoid(np.array(z))) < 1e-12


def test_quality_on_held_out_documents(spark):
    rows, marks = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = prose(i, 80)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        marks.append((i, int(not bad), 0))
    got = quality.score_quality(docs(spark, [*rows, (None, "x"), (1000, None)]), labels(spark, [*marks, (5, None, None), (None, 1, 1)])).collect()
    assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 240]
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in known)
    assert all(r.predicted == (r.doc_id % 3 != 0) for r in known if r.held_out)
    kept = quality.keep_good(docs(spark, [*rows, (None, "x")]), labels(spark, marks))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(240) if i % 3]
    assert kept.where("doc_id IS NULL").count() == 1


def test_quality_awkward_rows(spark):
    df = awkward(spark)
    got = quality.score_quality(df, labels(spark, [])).collect()
    assert len(got) == 11 and {r.score for r in got} == {0.5}
    assert quality.score_quality(docs(spark, []), labels(spark, [(1, 1, 0)])).count() == 0
    kept = quality.keep_good(df, labels(spark, [(1, 1, 1), (2, 1, 1)]))
    assert kept.columns == df.columns and kept.count() == 11


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = np.random.default_rng(3)
    lexicon = {"".join(rng.choice(list("abcd"), n)): float(n) for n in (2, 4, 4, 5, 6, 7, 8, 9, 10, 12)}
    matcher = toxicity.Matcher(lexicon)
    for _ in range(4000):
        if rng.random() < 0.5:
            word = list(rng.choice(list(lexicon)))
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, len(word) + 1)
                word[at : at + rng.integers(0, 2)] = rng.choice(list("abcde"), rng.integers(0, 2))
            word = "".join(word)
        else:
            word = "".join(rng.choice(list("abcd"), rng.integers(0, 12)))
        near = {t: edits(word, t) for t in lexicon if edits(word, t) <= toxicity.errors_allowed(len(t))}
        got = matcher.match(word)
        if not near:
            assert got is None
        else:
            exact = word in near and near[word] == 0
            assert got == (0, lexicon[word]) if exact else got == (1, max(lexicon[t] for t in near))


def test_toxicity_on_held_out_and_misspelled(spark):
    rows, marks = [], []
    insults = ["vermin", "dimwitted", "scoundrel"]
    for i in range(300):
        words = prose(i, 60).split()
        if i % 4 == 0:
            for k in range(3):
                words[10 * k + 5] = insults[(i + k) % 3] if i < 240 else ["vermln", "dimwittd", "scoundrell"][k]
        rows.append((i, " ".join(words)))
        if i < 240:
            marks.append((i, 1, int(i % 4 == 0)))
    got = toxicity.score_toxicity(docs(spark, [*rows, (None, "x"), (1000, None)]), labels(spark, marks)).collect()
    assert len(got) == 302
    known = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in known)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in known if r.held_out and r.doc_id < 240)
    clean = [r.score for r in known if r.doc_id >= 240 and r.doc_id % 4]
    wrong = [r.score for r in known if r.doc_id >= 240 and r.doc_id % 4 == 0]
    assert min(wrong) > max(clean)


def test_quotation_weighs_less():
    matcher = toxicity.Matcher({"vermin": 4.0})
    plain = toxicity.figures(b"one two vermin three", matcher)
    quoted = toxicity.figures(b'he said "vermin" once', matcher)
    assert quoted[8] < plain[8] and quoted[9] < plain[9]


def test_toxicity_awkward_rows(spark):
    got = toxicity.score_toxicity(awkward(spark), labels(spark, [])).collect()
    assert len(got) == 11 and {r.score for r in got} == {0.5}
    one = toxicity.score_toxicity(awkward(spark), labels(spark, [(i, 1, 0) for i in range(9)])).collect()
    assert len(one) == 11 and not any(r.predicted for r in one)
    assert toxicity.score_toxicity(docs(spark, []), labels(spark, [(1, 1, 0)])).count() == 0


def test_the_sample_is_bounded_by_rows(spark):
    rows = [(i % 5, prose(i, 20)) for i in range(200)]
    features = quality.measure(docs(spark, rows))
    picked = learn.labelled_ids(labels(spark, [(i, i % 2, 0) for i in range(5)]), "quality", learn.F.lit(True), 2)
    x, y = learn.training_matrix(features, picked)
    assert x.shape[0] == y.shape[0] == 2
