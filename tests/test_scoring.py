"""Scores for several targets: held-out accuracy, calibration, saved versions, odd rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vigilis.operators import scoring

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.col("lang").alias("language"))
    marks = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("relevance"))
    return docs.join(marks, "doc_id").withColumn("test", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


@pytest.fixture(scope="module")
def found(rows):
    return scoring.fit_targets(rows.where("not test").drop("test"), ["relevance", "language"])


def test_held_out(rows, found):
    got = scoring.score_targets(rows.where("test"), found).join(rows.select("doc_id", F.col("relevance").alias("r"), F.col("language").alias("l")), "doc_id").toPandas()
    assert (got.relevance == got.r.astype(str)).mean() > 0.9
    assert (got.language == got.l).mean() > 0.93
    assert got.relevance_score.between(0.5, 1).all() and got.language_score.between(0.25, 1).all()
    # a calibrated score is about the share of right answers
    assert abs(got.language_score.mean() - (got.language == got.l).mean()) < 0.1


def test_a_saved_version_gives_the_same_rows(spark, rows, found, tmp_path):
    path = f"file://{tmp_path}/targets"
    scoring.save_targets(found, spark, path, "v1")
    again = scoring.load_targets(spark, path, "v1")
    one, two = (sorted(map(tuple, scoring.score_targets(rows, f).collect())) for f in (found, again))
    assert one == two and len(one) == rows.count()
    with pytest.raises(Exception, match="exist"):
        scoring.save_targets(found, spark, path, "v1")


def test_odd_rows(spark, found):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "... !"), (None, "the the"), (5, "a " * 50_000), (5, "a " * 50_000)], "doc_id long, text string")
    got = scoring.score_targets(odd, found).collect()
    assert len(got) == 6 and all(r.relevance in ("0", "1") and r.language for r in got)
    assert got[0][1:] == got[1][1:]  # null as empty; signs alone are no words, but part of a text's build
    assert scoring.score_targets(odd.limit(0), found).collect() == []


def test_rows_without_a_label_and_targets_of_one_class(spark):
    own = [(i, "good day" if i % 2 else "bad night", None if i % 7 == 0 else str(i % 2), "same") for i in range(80)]
    gold = spark.createDataFrame(own, "doc_id long, text string, side string, one string")
    got = scoring.score_targets(gold, scoring.fit_targets(gold, ["side"])).collect()
    assert all(r.side == str(r.doc_id % 2) for r in got)
    with pytest.raises(ValueError, match="one has 1 classes"):
        scoring.fit_targets(gold, ["one"])


def test_query_covers_all_documents(spark):
    got = entry.queries()["tx22_targets"](spark, DATA)
    assert got.columns == ["doc_id", "relevance", "relevance_score", "tone", "tone_score", "language", "language_score"]
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
