import random
from collections import Counter

from tests.llm.data import awkward, docs
from webledger.llm import rules


def plain(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    dup, lines = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é ", "a b a ", "\n", "#", "|x ", " ", "\t", "zz\n"]) for _ in range(rng.randrange(60)))
        assert rules.measure(text.encode())[:5] == plain(text)


def test_awkward_rows(spark):
    rows = rules.verdicts(rules.ledger(awkward(spark))).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].n_words == by[3].n_words == by[6].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[1].kept and by[7].kept and sum(r.doc_id is None for r in rows) == 2
    assert rules.ledger(docs(spark, [])).count() == 0


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    loud = " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60))
    odd = " ".join(f"word{i}%%" for i in range(60))
    done = rules.verdicts(rules.ledger(docs(spark, [(1, good), (2, loud), (3, odd), (4, "few")])))
    got = {r.doc_id: (r.base_failed, r.kept) for r in done.collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False), 4: (True, False)}
    old = {r.doc_id: r.kept for r in rules.verdicts(rules.ledger(docs(spark, [(2, loud)])), "v1").collect()}
    assert old == {2: True}
    counted = {r.rule: (r.n_failed, r.n_alone) for r in rules.ablation(done).collect()}
    assert counted["capitals"] == (1, 1) and counted["symbols"] == (1, 1) and counted["few_words"] == (1, 1)
    assert counted["repetition"] == (0, 0)
