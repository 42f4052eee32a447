"""A training corpus from raw documents, in stages that each call one of the corpus operators.

Each stage takes the documents that the one before has kept and returns those that it keeps, with the columns of documents;
the last returns the packed pieces. Rows that a stage can't tell apart (same doc_id and text) share its verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilis.llm import decontaminate, factorization, packing, simhash, span_dedup
from vigilis.llm.common import as_rows, from_rows, new_path, ship, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the factorisation machine scores 0.7 or more; fitted on the labelled ones among them."""
    ship(spark)
    model = factorization.fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score = unused(docs, "score")
    return factorization.score_quality(docs, model, score).where(F.col(score) >= 0.7).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts that share 0.8 of their five-word shingles: that with the smallest doc_id.

    Documents without an id are their own.
    """
    ship(spark)
    own = F.struct("doc_id", "text_hash")
    found = simhash.similar_documents(docs, words=5, percent=80).where("doc_id is not null")
    found = found.groupBy("component").agg(F.min(own).alias("own")).select("own.*")
    rows = as_rows(docs)
    at = (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash"))
    kept = rows.join(found, at).dropDuplicates(["doc_id", "text_hash"])
    return from_rows(kept, docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated sentence spans out of the texts; documents of which nothing is left go."""
    ship(spark)
    n = unused(docs, "removed")
    done = span_dedup.remove_repeats(docs, removed=n).where((F.col(n) == 0) | F.col("text").isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[f"`{c}`" for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item occurs."""
    ship(spark)
    hits, flag = unused(docs, "hits"), unused(docs, "contaminated")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), hits=hits, flag=flag)
    return found.where(~F.col(flag)).drop(hits, flag)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4,096 tokens."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: SQL expresses neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
