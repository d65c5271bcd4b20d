import random
from itertools import combinations

import numpy as np
import pytest

from tests.llm.data import awkward, docs, prose
from webledger.llm import neardup


def plain_set(text, size):
    words = (text or "").encode().translate(neardup._LOWER).split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, size):
    """component of each row: links between non-empty sets, by full comparison."""
    sets = [plain_set(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None] if sets[i] else [doc_id]
        component = min(ids) if ids and ids[0] is not None else None
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def changed(rng, words, share):
    return [f"c{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed=7):
    rng = random.Random(seed)
    rows = [(i, prose(i, rng.randrange(1, 80))) for i in range(60)]
    base = prose(1000, 150).split()
    for i in range(100, 170):  # a star of near copies, some just out of reach of its centre
        rows.append((i, " ".join(changed(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05, 0.07]))).upper()))
    chain = prose(2000, 200).split()
    for i in range(200, 230):  # a chain: ends have little in common
        rows.append((i, " ".join(chain)))
        chain = chain[8:] + prose(i, 8).split()
    passage = prose(3000, 60)
    for i in range(300, 340):  # a shared passage, not enough to link
        rows.append((i, passage + " " + prose(i, 45, 5000)))
    rows += [(400 + i, t) for i, t in enumerate(["one", "ONE", "one two", "one two three", "", None, "\n", "one two one two"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "block"), [(2, 512), (5, 512), (2, 7)])
def test_components_against_brute_force(spark, size, block):
    rows = corpus()
    got = neardup.near_duplicates(docs(spark, rows), shingle_words=size, list_block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 1 and not by[7].kept and by[1].kept
    assert by[2].component_id == 2 and by[2].n_shingles == 0 and by[3].kept and by[6].kept
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 9
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    nameless = neardup.near_duplicates(docs(spark, [(None, prose(1, 50)), (None, prose(1, 50) + " more"), (9, prose(1, 50))])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in nameless) == [("9", 9, True), ("None", 9, False), ("None", 9, False)]


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)) + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {n: 0 for n in range(300)} | {1000: 1000, 1001: 1000}


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    words = prose(1, 2000, 10**6).split()
    a, b = neardup.shingle_set(" ".join(words).encode(), 2), neardup.shingle_set(" ".join(changed(rng, words, 0.04)).encode(), 2)
    alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = neardup.agreeing(neardup.signature(a).tobytes(), neardup.signature(b).tobytes()) / neardup.COORDINATES
    assert abs(got - alike) < 0.2
    assert neardup.linked(a, a, 80, 100) and not neardup.linked(a, a[: len(a) // 2], 80, 100)


def kept_by_brute_force(rows, size):
    """Of each component the row with the smallest (doc_id, hash of the text); rows without words all stay."""
    sets = [plain_set(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        key = (doc_id is None, doc_id or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    wordless = sorted((str(d), t) for (d, t), x in zip(rows, sets, strict=True) if not x)
    return wordless, sorted(least[r] for r in {find(i) for i in range(len(rows)) if sets[i]}), [find(i) for i in range(len(rows))]


def test_no_text_is_lost_and_no_copy_stays(spark):
    a, b = prose(1, 60), prose(2, 60)
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in neardup.drop_near_duplicates(docs(spark, rows)).collect())
    assert kept([(5, a), (5, b), (3, b), (7, a)]) == [("3", b), ("5", a)]
    assert kept([(5, a)] * 3) == [("5", a)]
    assert kept([(None, a), (None, a + " more"), (9, a)]) == [("9", a)]
    assert len(kept([(None, a), (None, a)])) == 1
    assert kept([(1, ""), (1, ""), (2, None)]) == [("1", ""), ("1", ""), ("2", None)]
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(90)]), text) for _, text in corpus(11) for _ in range(rng.choice([1, 1, 2]))]
    wordless, least, _ = kept_by_brute_force(rows, 5)
    left = neardup.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if not plain_set(r.text, 5)) == wordless
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left if plain_set(r.text, 5)) == least


def test_matches_follow_the_similarity(spark):
    assert neardup.matches_for(80, 100) == 34
    asked = [neardup.matches_for(n, 100) for n in (50, 60, 70, 80, 90, 99)]
    assert asked == sorted(asked) and asked[0] < 20 and neardup.matches_for(1, 1) == neardup.COORDINATES
    with pytest.raises(ValueError):
        neardup.matches_for(10, 100)
    rng = random.Random(8)
    base = prose(5, 120, 5000).split()
    rows = [(i, " ".join(changed(rng, base, 0.11))) for i in range(40)]
    sets = [plain_set(t, 2) for _, t in rows]
    got = neardup.near_duplicates(docs(spark, rows), shingle_words=2, num=55).collect()
    linked = [(i, j) for i, j in combinations(range(40), 2) if 100 * len(sets[i] & sets[j]) >= 55 * len(sets[i] | sets[j])]
    component = {r.doc_id: r.component_id for r in got}
    assert len(linked) > 20 and all(component[i] == component[j] for i, j in linked)


def test_signatures_alike_enough_share_keys():
    rng = np.random.default_rng(4)
    for matches in (20, 34, 45, 64):
        width = neardup.width_for(matches)
        least = neardup.COORDINATES // width - (neardup.COORDINATES - matches)
        a = rng.integers(0, 2**32, (50, neardup.COORDINATES), np.uint32)
        b = a.copy()
        for row in b:
            row[rng.permutation(neardup.COORDINATES)[matches:]] += np.uint32(1)
        shared = (neardup.keys_of(a, width) == neardup.keys_of(b, width)).sum(1)
        assert least > 0 and shared.min() >= least
    assert neardup.width_for(20) == 1 and neardup.width_for(34) == 2
    assert len(np.unique(neardup.keys_of(a[:1], 1))) == neardup.COORDINATES


def test_texts_of_nodes_without_a_partner_stay_where_they_are(spark, monkeypatch):
    """A passage in common gives nodes keys in common; their texts move only if signatures agree enough."""
    moved = []

    def store(df, name, put=neardup.store):
        out = put(df, name)
        moved.extend(r.doc for r in out.collect()) if name == "needed" else None
        return out

    monkeypatch.setattr(neardup, "store", store)
    passage, copy = prose(3000, 60), prose(9, 90)
    rows = [(i, passage + " " + prose(i, 60, 5000)) for i in range(40)] + [(50, copy), (51, copy + " more")]
    for block in (512, 7):
        moved.clear()
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), 2, list_block=block).collect()}
        assert got == {i: i for i in range(40)} | {50: 50, 51: 50}
        assert set(moved) == {50, 51}
