from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import awkward, docs
from webledger.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.001, 100), min_size=1), st.sampled_from([16, 64, 100]))
def test_every_source_keeps_within_one_block(weights, period):
    slots = mixing.quantised(weights, period)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    pattern = mixing.one_period(slots)
    assert sorted(np.concatenate(list(pattern.values()))) == list(range(period))
    for s, at in pattern.items():
        k = slots[s]
        for i, slot in enumerate(at):  # release and deadline
            assert i * period // k <= slot < -(-(i + 1) * period // k)
        given_out = np.cumsum(np.bincount(at, minlength=period))
        lag = given_out - np.arange(1, period + 1) * k / period
        assert np.abs(lag).max() < 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 300), min_size=1), st.data())
def test_all_blocks_get_slots_of_their_own(blocks, data):
    weights = {s: data.draw(st.floats(0, 5)) for s in blocks}
    plan = mixing.Schedule(blocks, weights, period=32)
    taken = np.concatenate([plan.slot(s, np.arange(n)) for s, n in blocks.items() if n] or [np.empty(0, int)])
    assert sorted(taken) == list(range(sum(blocks.values())))
    for s, n in blocks.items():
        if n:
            assert (np.diff(plan.slot(s, np.arange(n))) > 0).all()


def test_documents_against_a_serial_mix(spark):
    rows = [(i, "x" * (i * 37 % 90), "abca"[i % 4]) for i in range(400)] + [(1000, None, None), (1001, "y", None), (3, "dup", "a")]
    got = mixing.schedule(docs(spark, rows), {"a": 2.0, "b": 1.0, "c": 1.0}, block_chars=100, period=32).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    size = defaultdict(list)
    for r in rows:
        size[r[0], r[2]].append(len(r[1] or "") + 1)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.slot, r.start)):
        by[r.source].append(r)
    for source, own in by.items():
        assert [r.start for r in own] == sorted(r.start for r in own) and own[0].start == 0
        assert all(r.block == r.start // 100 for r in own)
        assert len({(r.slot, r.block) for r in own}) == len({r.slot for r in own})
        last = own[-1]
        assert last.start + max(size[last.doc_id, source]) >= sum(sum(v) for (i, s), v in size.items() if s == source) - 90
    # while all named sources last, a has half of the slots to within a block
    named = [r for r in got if r.source is not None]
    first_end = min(max(r.slot for r in named if r.source == s) for s in "abc")
    for t in range(1, first_end):
        assert abs(len({r.slot for r in named if r.source == "a" and r.slot < t}) - t / 2) < 2
    assert min(r.slot for r in got if r.source is None) > max(r.slot for r in named) - 1


def test_mix_keeps_rows_and_columns(spark):
    df = awkward(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(map(str, mixed.collect())) == Counter(map(str, df.collect()))
    assert mixing.schedule(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert mixing.schedule(df).count() == 11
