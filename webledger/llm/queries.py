"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webledger.llm import (
    chat, decontam, mixing, neardup, orchard, pitman_yor, quality, rules, secret_scan, spelling, tokens, toxicity, warc,
)
from webledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_classifier(spark, sf):
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_source_mixing(spark, sf):
    return mixing.schedule(table(spark, sf, "documents"))


@query
def op3_pitman_yor(spark, sf):
    return pitman_yor.score_texts(table(spark, sf, "documents"))


@query
def op4_chat_formatting(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    probe = F.explode(F.array(*[
        F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"))
        for i, role in enumerate(("user", "assistant"))
    ]))
    extra = spark.range(1).select(probe.alias("p")).select("p.*", F.lit("</s>[INST] ok [/INST]").alias("text"))
    extra = extra.select(*[F.col(c).cast(kinds[c]).alias(c) for c in turns.columns])
    return chat.digests(chat.read_back(chat.format_chats(turns.unionByName(extra))))


@query
def op5_warc(spark, sf):
    return warc.with_referred(warc.assemble(warc.read_records(warc.write_archives(table(spark, sf, "pages")))))


@query
def op6_decontamination(spark, sf):
    found = decontam.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontam.digests(found)


@query
def op7_toxicity(spark, sf):
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_near_duplicates(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"), shingle_words=2)


@query
def op9_quality_rules(spark, sf):
    done = rules.verdicts(rules.ledger(table(spark, sf, "documents")))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "fail_bits",
    )


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_token_files(spark, sf):
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf, "documents"), tokenizer_file(), end_id=2))


@query
def op11_secret_scan(spark, sf):
    return secret_scan.digests(secret_scan.scan(table(spark, sf, "documents")))


@query
def op12_spelling_variants(spark, sf):
    return spelling.group_spellings(table(spark, sf, "documents"))


@query
def op13_vector_codes(spark, sf):
    return orchard.digests(*orchard.compress(table(spark, sf, "embeddings")))
