"""The queries op1_ to op13_: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilis.llm import (
    alignment, decontaminate, factorization, langid, line_rules, packing, partenum, sharding, simhash, span_dedup, spelling, token_store, toxicity,
)
from vigilis.llm.common import crc32_text, fold_of, table
from vigilis.llm.sql import ORACLES


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by source over 32 shards go to 40 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    placed = sharding.reshard_files(docs, F.crc32(F.coalesce("source", F.lit(""))) % 32, 40)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__old").alias("old_shard"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every document; toxic: flagged by the last."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), chain)
    p = F.col("toxicity")
    # fewer categories may be found than are asked for
    earlier = [(p[f"category_{k}"] if f"category_{k}" in chain.names else F.lit(0.0)).alias(f"category_{k}") for k in range(1, toxicity.CATEGORIES + 1)]
    return scored.select("doc_id", *earlier, p["toxic"].alias("score"), p["flagged"].alias("toxic"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; learned from documents whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = factorization.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = factorization.score_quality(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids written to seekable files and read back."""
    index = token_store.tokens_of(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: 4-word shingles, fingerprints that differ in at most 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = langid.fit_languages(docs, ~held_out, _tokenizer("piece_bpe_32k.model"))
    found = langid.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line rules for all documents, with the frequency of lines by source."""
    return line_rules.line_frequency(table(spark, sf_dir, "documents"), host="source").drop("text")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4,096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts without the sentences of repeated spans."""
    done = span_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("removed").alias("n_removed"), (F.col("removed") > 0).alias("repeated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all documents the benchmark items that occur in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("edits"))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers' tokens over all documents, with corpus-wide counts of linked pairs."""
    return alignment.align_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles are alike to 90 in a hundred."""
    return partenum.similar_sets(table(spark, sf_dir, "documents"), words=3, percent=90)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OPERATORS = (
    op1_reshard, op2_toxicity, op3_quality, op4_token_files, op5_near_duplicates,
    op6_language, op7_line_frequency, op8_pack, op9_repeated_spans, op10_decontaminate,
    op11_align_tokens, op12_similar_sets, op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
