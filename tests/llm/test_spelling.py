import random
import re
import zlib
from collections import Counter

from tests.llm.data import awkward, docs
from webledger.llm import spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(found[w]), words.get(form[w], 0)) for w, n in words.items())


def got(spark, rows):
    found = spelling.group_spellings(docs(spark, rows))
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())


def test_words_of_a_text():
    text = "Zoo-keeper's Çà naïve×façade÷ xĀy 日本 café ok a\x00b ſtop KK"
    expected = [w.translate(str.maketrans(UPPER, LOWER)) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [r.decode() for r in spelling.runs(text.encode())] == expected
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abZ é×ÿā©̀😀.\n") for _ in range(40))
        expected = [w.translate(str.maketrans(UPPER, LOWER)) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
        assert [r.decode() for r in spelling.runs(text.encode())] == expected


def test_groups_against_brute_force(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(25)]

    def bent(word):
        at = rng.randrange(len(word) + 1)
        return word[:at] + rng.choice(["", "a", "ü", "o"]) + word[at + rng.randrange(2) :]

    rows = []
    for i in range(120):
        words = [rng.choice(stems[: rng.choice([2, 25])]) for _ in range(30)]
        rows.append((i, ", ".join(bent(w) if rng.random() < 0.2 else w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, None), (501, "")]
    expected = brute(rows)
    assert got(spark, rows) == expected
    assert sum(1 for r in expected if r[1]) > 20


def test_chains_and_ties(spark):
    # 1,000 > 100 > 10 in a chain of forms; two forms of equal frequency
    counts = {"aaaaaaaa": 1100, "aaaaaaab": 105, "aaaaaabb": 10, "zzzzzzzx": 50, "zzzzzzzy": 50, "zzzzzzzw": 2, "oooooooo": 40, "ooooooo": 3}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    # a doc_id under which no word is edited
    free = next(i for i in range(10**6) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in counts))
    rows = [(free, text)]
    expected = brute(rows)
    assert got(spark, rows) == expected
    by = {r[0]: r for r in expected}
    assert by["aaaaaabb"][1:3] == ("aaaaaaab", "aaaaaaaa") and by["zzzzzzzw"][1] == "zzzzzzzx" and by["ooooooo"][4] == 1


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = spelling.group_spellings(df)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect()) == brute(rows)
    assert spelling.group_spellings(docs(spark, [])).count() == 0
