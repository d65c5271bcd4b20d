import io
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.data import awkward, docs, prose
from webledger.llm import tokens
from webledger.llm.common import open_folder
from webledger.llm.queries import tokenizer_file


@given(bits=st.integers(1, 32), data=st.data())
def test_pack_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=50)), np.uint32)
    assert (tokens.unpack(tokens.pack(ids, bits), bits, len(ids)) == ids).all()


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


TEXTS = ["End. The, a., b,, (c). É. É, x.y z.", "<|ENDOFTEXT|> A.", "İ, I\u0307. A\u030a. A\u030a, K. don't. I'LL.", "", "Hello, World! it's 12'33\tx y  z", "é ́a é Å ≮ ΑΣ ΣΑΣ. İI", "<|endoftext|>a<|startoftext|> b", "\x00   é😀",
         "x" * 3000, "\n\n#*$ || <> ﻿", "ＡＢ ﬁ ǅ ß"]


def test_pieces_are_whole_texts(direct):
    from pathlib import Path

    encoder = tokens.Encoder(Path(tokenizer_file()).read_text())
    bodies = [*TEXTS, *[prose(i, 50) for i in range(5)]]
    assert encoder.folds
    for size in (tokens.KNOWN, 3):
        tokens.KNOWN, old = size, tokens.KNOWN
        encoder.known.clear()
        try:
            for _ in range(2):
                got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in bodies])]
                assert got == [e.ids for e in direct.encode_batch(bodies, add_special_tokens=False)]
        finally:
            tokens.KNOWN = old


def test_capitals_with_combining_marks(direct):
    from pathlib import Path

    encoder = tokens.Encoder(Path(tokenizer_file()).read_text())
    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    marks = [chr(c) for c in range(0x300, 0x370)]
    every = " ".join(letter + mark for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for mark in marks)
    bodies = [*pairs, *[f"The END. {p}x, X{p}. The End." for p in pairs], every, every.lower()]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in bodies])]
    assert got == [e.ids for e in direct.encode_batch(bodies, add_special_tokens=False)]
    assert b"the" in encoder.known and b"The" not in encoder.known


def test_added_tokens_are_found_by_name():
    from pathlib import Path

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    model.add_special_tokens(["[Sep]"])
    encoder = tokens.Encoder(model.to_str())
    assert encoder.folds
    bodies = ["One [Sep] Two.", "One [SEP] Two, x.", "one [sep] x"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in bodies])]
    assert got == [e.ids for e in model.encode_batch(bodies, add_special_tokens=False)]
    model.add_special_tokens(["two words"])
    assert not tokens.Encoder(model.to_str()).drops_space


def test_a_tokenizer_that_keeps_spaces():
    from pathlib import Path

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.Encoder(Path(path).read_text())
    assert not encoder.drops_space
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in TEXTS])] == want


def test_files_read_back(spark, direct):
    rows = [(i * 7 % 50 - 10, TEXTS[i % len(TEXTS)] + prose(i, i * 40)) for i in range(50)] + [(None, "null id"), (500, None), (3, "again")]
    manifest = tokens.write_tokens(docs(spark, rows), tokenizer_file(), 2)
    got = sorted(tokens.read_tokens(manifest).collect(), key=lambda r: r.start)
    want = {}
    for i, t in rows:
        ids = np.array([*direct.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at, seen = 0, {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    # random access
    row = max(manifest.collect(), key=lambda r: r.n_ids)
    system, inside = open_folder(row.path)
    with system.open_input_file(inside) as source:
        file = tokens.TokenFile(source)
        whole = file.ids(0, file.n_ids)
        for a, b in ((0, 1), (5, 4100), (file.n_ids - 3, file.n_ids), (9, 9)):
            assert (file.ids(a, b) == whole[a:b]).all()
        assert file.document(0)[-1] == 2


def test_too_large_an_id():
    writer = tokens._Writer(io.BytesIO(), 4)
    writer.add(1, np.array([16], "<u4").tobytes())
    with pytest.raises(ValueError):
        writer.flush(last=True)


def test_awkward_rows(spark):
    got = tokens.read_tokens(tokens.write_tokens(awkward(spark), tokenizer_file(), 2)).collect()
    assert len(got) == 11 and min(r.n_tokens for r in got) == 1
    assert tokens.read_tokens(tokens.write_tokens(docs(spark, []), tokenizer_file(), 2)).count() == 0


def test_plain_words_go_to_the_model_alone(direct):
    from pathlib import Path

    from tokenizers import Tokenizer, normalizers

    encoder = tokens.Encoder(Path(tokenizer_file()).read_text())
    words = ["hander", "trechan", "dont", "s", "x" * 500, *prose(3, 40).replace("w", "qu").split(), "étude", "hander$$$", "B", "a1b"]

    class Counted:
        def encode(self, pieces, **kind):
            assert not any(p.isascii() and p.isalpha() and p.islower() for p in pieces)
            return direct.encode(pieces, **kind)

    encoder.tokenizer = Counted()
    got = encoder.pieces([w.encode() for w in words])
    assert {w.encode(): direct.encode(w, add_special_tokens=False).ids for w in words} == {
        p: np.frombuffer(ids, "<u4").tolist() for p, ids in got.items()
    }
    # a tokenizer that changes some pair of letters, or has a name of letters
    for change in ("normalizer", "name"):
        model = Tokenizer.from_file(tokenizer_file())
        if change == "normalizer":
            model.normalizer = normalizers.Sequence([model.normalizer, normalizers.Replace("qz", "k")])
        else:
            model.add_special_tokens(["sep"])
        other = tokens.Encoder(model.to_str())
        assert encoder.plain and not other.plain
        found = other.encode([b"a qzed onesep sep two"])
        assert np.frombuffer(found[0], "<u4").tolist() == model.encode("a qzed onesep sep two", add_special_tokens=False).ids


def test_pieces_are_looked_up_once_for_all_texts(direct):
    from pathlib import Path

    encoder = tokens.Encoder(Path(tokenizer_file()).read_text())
    looks = []

    class Counted(dict):
        def __contains__(self, piece):
            looks.append(piece)
            return super().__contains__(piece)

        def __getitem__(self, piece):
            looks.append(piece)
            return super().__getitem__(piece)

        def get(self, piece, other=None):
            looks.append(piece)
            return super().get(piece, other)

    encoder.known = Counted()
    bodies = ["The end, the\tend!", "", "the end? END"] * 100
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in bodies])]
    assert got == [e.ids for e in direct.encode_batch(bodies, add_special_tokens=False)]
    assert len(looks) <= 3 * len(set(looks))


def test_marks_after_words_are_pieces(direct):
    from pathlib import Path

    from tokenizers import Tokenizer, pre_tokenizers

    encoder = tokens.Encoder(Path(tokenizer_file()).read_text())
    bodies = ["Word$$$ word! (word) word's word' it's. é$$ $$ a$$é x2&& a&&̸ b≠ c=", "word,$$\nword.", "<|endoftext|> word%% <|endoftext|>&& ", "J̌&& The%% É.. "]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in bodies])]
    assert got == [e.ids for e in direct.encode_batch(bodies, add_special_tokens=False)]
    assert {b"word", b"$$$", b"!", b",$$"} <= set(encoder.known) and b"word$$$" not in encoder.known
    # a tokenizer that keeps some mark with the word before it
    model = Tokenizer.from_file(tokenizer_file())
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    other = tokens.Encoder(model.to_str())
    assert other.folds
    bodies = ["word_ word! word!_ word_! word$$ "]
    got = [np.frombuffer(x, "<u4").tolist() for x in other.encode([b.encode() for b in bodies])]
    assert got == [e.ids for e in model.encode_batch(bodies, add_special_tokens=False)]
    assert b"word_" in other.known and b"word$$" not in other.known


@given(st.lists(st.text(st.sampled_from("aZT.,&'1 \nÉé̌\x00 "), max_size=12), max_size=5))
def test_texts_cut_together_are_texts_alone(direct, bodies):
    encoder = tokens.Encoder.of("test", open(tokenizer_file(), encoding="utf-8").read())
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([b.encode() for b in bodies])]
    assert got == [e.ids for e in direct.encode_batch(bodies, add_special_tokens=False)]


def test_rows_are_grouped_by_bytes():
    import pyarrow as pa

    rows = [(None, b""), *[(i, b"x" * 1000) for i in range(9000)], (3, b"y" * tokens.AT_ONCE), (4, b"")]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})
    found = list(tokens.groups(iter([batch, batch.slice(0, 0), batch.slice(0, 10)])))
    assert [r for ids, texts in found for r in zip(ids, texts, strict=True)] == [*rows, *rows[:10]]
    assert max(len(ids) for ids, _ in found) > 256 and all(sum(map(len, t[:-1])) < tokens.AT_ONCE for _, t in found)
    assert list(tokens.groups(iter([]))) == []
