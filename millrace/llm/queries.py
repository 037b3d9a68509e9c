"""The thin queries over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import oracles
from millrace.llm._common import table

QUERIES = {}
ORACLES = {}


def _query(name, sql=None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


@_query("op7_quality_rules", oracles.QUALITY_RULES)
def op7(spark, sf_dir):
    from millrace.llm import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query("op5_line_runs", oracles.LINE_RUNS)
def op5(spark, sf_dir):
    from millrace.llm import line_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.drop_repeated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op6_url_rules")
def op6(spark, sf_dir):
    from millrace.llm import url_rules

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return url_rules.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")


@_query("op8_bpe_automaton")
def op8(spark, sf_dir):
    import public_tokenizers

    from millrace.llm import bpe_automaton

    docs = table(spark, sf_dir, "documents")
    return bpe_automaton.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


@_query("op2_hilbert_packing")
def op2(spark, sf_dir):
    import public_tokenizers

    from millrace.llm import hilbert_packing

    return hilbert_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op1_spotsigs")
def op1(spark, sf_dir):
    from millrace.llm import spotsigs

    return spotsigs.edit_likeness(table(spark, sf_dir, "documents"))


@_query("op10_toxicity_kn")
def op10(spark, sf_dir):
    from millrace.llm import toxicity_kn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity_kn.judge(docs, labels).select("doc_id", "held_out", "score", "predicted")


@_query("op9_pii_bootstrap")
def op9(spark, sf_dir):
    from millrace.llm import pii_bootstrap as pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [
        F.size(F.filter("base", pii.is_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.BASE_KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


@_query("op4_dart_minhash")
def op4(spark, sf_dir):
    from millrace.llm import dart_minhash

    return dart_minhash.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op3_compact_windows")
def op3(spark, sf_dir):
    from millrace.llm import compact_windows

    return compact_windows.memberships(table(spark, sf_dir, "documents").select("doc_id", "text"))
