import hashlib

import numpy as np
import pytest

from webledger.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, codes string, error string, entry string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "clash", "clash", "clash", "clash") for i, v, l in rows], SCHEMA)


@pytest.mark.parametrize(("width", "low", "high"), [(8, -900, 900), (3, -3, 4), (1, 0, 3), (2, -(2**27), 2**27)])
def test_search_is_the_nearest_entry(width, low, high):
    rng = np.random.default_rng(width)
    books, rows = rng.integers(low, high, (8, 16, width)), rng.integers(low, high, (2000, 8, width)).astype("<i4")
    entry, square = orchard.Orchard(books).search(rows)
    every = ((rows[:, :, None].astype(np.int64) - books[None]) ** 2).sum(3)
    # argmin takes the lower of equal ones
    assert (entry == every.argmin(2)).all() and (square == every.min(2)).all()


def test_search_of_few_and_equal_entries():
    rows = np.arange(24, dtype="<i4").reshape(3, 8, 1)
    assert (orchard.Orchard(np.zeros((8, 1, 1), np.int64)).search(rows)[0] == 0).all()
    assert (orchard.Orchard(np.full((8, 16, 1), 5)).search(rows)[0] == 0).all()


def brute(rows):
    """The contract, one vector and one entry at a time."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 8
    cut = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        found = [[nearest(c[p], p)[1] for p in range(8)] for c in cut]
        for p in range(8):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    last = [[nearest(c[p], p) for p in range(8)] for c in cut]
    errors = [sum(d for d, _ in f) for f in last]
    sums = {}
    for (_, _, l), e in zip(kept, errors, strict=True):
        sums[l] = sums.get(l, 0) + e
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, sums[l], sha) for (i, _, l), f, e in zip(kept, last, errors, strict=True))


def digested(spark, rows):
    return sorted(tuple(r) for r in orchard.digests(*orchard.compress(vectors(spark, rows))).collect())


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(100 - i, rng.normal(size=24).round(2).tolist(), [None, 1, 2][i % 3]) for i in range(90)]
    rows += [(-1, None, 1), (-2, [None] * 24, 1), (-3, [float("nan")] * 24, 1), (-4, [float("-inf")] + [0.0] * 23, None)]
    assert digested(spark, rows) == brute(rows)
    few = rows[:5]
    assert digested(spark, few) == brute(few)


def test_awkward_vectors(spark):
    one = [0.5] * 16
    rows = [(None, one, 1), (1, one, 1), (1, one, 1), (2, [0.25] * 16, None), (3, [1.0] * 8, 1), (4, [], 1), (5, [3e38] * 16, 1)]
    got = orchard.digests(*orchard.compress(vectors(spark, rows))).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "2", "5", "None"]
    assert all(r.error == 0 for r in got) and len({r.code for r in got if r.vec_id != 2 and r.vec_id != 5}) == 1
    assert orchard.digests(*orchard.compress(vectors(spark, []))).count() == 0
    odd = orchard.digests(*orchard.compress(vectors(spark, [(i, [0.1 * i] * 11, 0) for i in range(20)]))).collect()
    assert len(odd) == 20 and all(len(r.code) == 16 for r in odd)
    coded, books = orchard.compress(vectors(spark, [(i, [float(i)] * 8, 0) for i in range(16)]))
    assert {r.vec_id: orchard.decode(r.codes, books).tolist() for r in coded.collect()} == {i: [4096 * i] * 8 for i in range(16)}
