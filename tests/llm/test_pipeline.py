import random
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.data import docs, prose
from tests.llm.test_neardup import brute
from webledger.llm import decontam
from webledger.llm.queries import tokenizer_file


def tables(spark, folder):
    """Good and loud documents, near copies, passages of the benchmark; labels for most."""
    rng = random.Random(3)
    passage = prose(77, 40)
    rows, kind = [], {}
    for i in range(300):
        text = prose(i, 90)
        if i % 5 == 1:
            text, kind[i] = text.upper().replace(" ", "!! "), "bad"
        elif i % 5 == 2 and i > 20:
            text, kind[i] = rows[i - 2][1] + " tail", "copy"
        elif i % 25 == 3:
            text, kind[i] = text + " " + passage, "dirty"
        rows.append((i, text, f"src{rng.randrange(3)}"))
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(kind.get(i) != "bad"), 0) for i in range(300) if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "other words entirely")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, _ in rows}, kind


def test_stages_against_brute_force(spark, tmp_path):
    text, kind = tables(spark, tmp_path)
    kept, known = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        known.append({r.doc_id for r in kept.select("doc_id").collect()})
        if name != "token files":
            assert kept.columns == before.columns
    good, alone, clean, mixed, written = known
    assert good == {i for i in text if kind.get(i) != "bad"}
    assert alone == {i for i, _, c, k in brute([(i, text[i]) for i in sorted(good)], 5) if k}
    want = [decontam.words_of(prose(77, 40).encode())]
    dirty = {i for i in alone if kind.get(i) == "dirty"}
    assert dirty and clean == alone - dirty and len(want[0]) == 40
    assert mixed == clean == written

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    order = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/source-mixing").select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    at = 0
    for i, r in zip(order, sorted(kept.collect(), key=lambda r: r.start), strict=True):
        ids = np.array([*tokenizer.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_is_the_stages(spark, tmp_path):
    text, kind = tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i in text if kind.get(i) not in ("bad", "dirty")} and len(got) > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    empty = docs(spark, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_file_numbers_order_as_numbers(spark, tmp_path):
    from webledger.llm import tokens

    for number, doc_id in (("99999", 1), ("100000", 2), ("100001", 3)):
        docs(spark, [(doc_id, f"text {doc_id}")]).coalesce(1).write.parquet(str(tmp_path / number))
        (part,) = (tmp_path / number).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"part-{number}-x.parquet").write_bytes(part.read_bytes())
    read = spark.read.parquet(str(tmp_path / "all"))
    assert [r.doc_id for r in read.orderBy(*tokens.file_order(read)).select("doc_id").collect()] == [1, 2, 3]
    assert tokens.file_order(docs(spark, [(1, "x")])) is None
