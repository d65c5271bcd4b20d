import random

from tests.llm.data import awkward, docs
from webledger.llm import decontam

BENCH = "item_id long, text string, items string"


def bench(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], BENCH)


def brute(text, items, size):
    words = decontam.words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        for w in decontam.windows_of(decontam.words_of((body or "").encode()), size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_against_brute_force_in_one_scan_and_in_blocks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(9)))) for i in range(12)] + [(3, "A,b c! D e a"), (None, "d d d d")]
    texts = [(i, "".join(rng.choice("abcdeABC") + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randrange(50)))) for i in range(40)]
    texts += [(99, None), (98, "")]
    for limit in (1000, 3):
        got = decontam.find_contamination(docs(spark, texts), bench(spark, items), window=4, block_windows=limit).collect()
        assert len(got) == len(texts)
        body = dict(texts)
        for r in got:
            n, hit, found = brute(body[r.doc_id], items, 4)
            assert (r.n_words, r.n_hit, r.items) == (n, hit, found)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
            raw = (body[r.doc_id] or "").encode()
            spanned = [decontam.words_of(raw[s.start : s.end]) for s in r.spans]
            assert sum(map(len, spanned)) == hit


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = decontam.find_contamination(df, bench(spark, [])).collect()
    assert len(rows) == 11 and not any(r.contaminated for r in rows)
    found = decontam.find_contamination(df, bench(spark, [(1, df.where("doc_id = 7").first().text), (2, None), (3, "...")]))
    assert sorted(r.doc_id for r in found.where("contaminated").collect()) == [1, 1, 7]
    assert sorted(decontam.digests(found).columns) == ["contaminated", "doc_id", "items_sha256", "n_hit", "n_items", "n_words"]
    assert decontam.find_contamination(docs(spark, []), bench(spark, [(1, "a")])).count() == 0
    kept = decontam.drop_contaminated(df, bench(spark, [(1, df.where("doc_id = 7").first().text)]))
    assert kept.columns == df.columns and kept.count() == 8
