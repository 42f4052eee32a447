"""Texts scored for several targets: one shared featuriser, one-versus-rest models with calibrated scores, saved by version."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilis.functions.text import is_ascii
from vigilis.operators.textjobs import words

#: A target has at most this many classes: each is a model.
CLASSES = 100
#: Every CALIBRATED-th labelled row, by a hash of its id, calibrates the scores and isn't learned from.
CALIBRATED = 5
#: Numbers of a text's build.
SHAPE = 8


@dataclass
class Targets:
    """``model`` makes features and margins; ``scales`` has for each target its classes and (slope, intercept) of each margin."""

    model: PipelineModel
    scales: dict[str, dict]


def _words(text: Column) -> Column:
    return F.coalesce(words(text), F.array().cast("array<string>"))


def _featured(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs``, __words and __shape: words and lines are columns of a step before, as each is used several times."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    cut = docs.select(*columns, t.alias("__t"), _words(F.col("text")).alias("__words"), lines.alias("__lines"))
    return cut.select(*columns, "__words", _shape(F.col("__t"), F.col("__words"), F.col("__lines")).alias("__shape"))


def _shape(t: Column, ws: Column, lines: Column) -> Column:
    """A text's build as numbers: words and their square in logarithms, shares of distinct words, repeated lines, signs and letters, word length."""
    n, size = F.log1p(F.size(ws)), F.greatest(F.length(t), F.lit(1))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    signs = F.regexp_count(t, F.lit(r"[#*$%&|<>]"))
    # what is left without the runs between letters: no match for each letter
    letters = F.length(F.when(is_ascii(t), F.regexp_replace(t, "[^A-Za-z]+", "")).otherwise(F.regexp_replace(t, r"\P{L}+", "")))
    own = [n, n * n, share(F.size(F.array_distinct(ws)), F.size(ws)), share(F.size(F.array_distinct(lines)), F.size(lines)), F.log1p(signs), signs / size, letters / size, share(letters, F.size(ws))]
    return array_to_vector(F.array(*[x.cast("double") for x in own]))


def _margin(target: str, i: int) -> str:
    return f"__{target}_{i}"


def _line(rows: DataFrame, x: Column, label: Column) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one number; (1, 0) where one class alone is there."""
    own = rows.select(array_to_vector(F.array(x)).alias("x"), label.cast("double").alias("label"))
    if own.agg(F.count_distinct("label")).first()[0] < 2:
        return 1.0, 0.0
    fit = LogisticRegression(featuresCol="x", labelCol="label", maxIter=50, regParam=1e-3).fit(own)
    return float(fit.coefficients[0]), float(fit.intercept)


def fit_targets(gold: DataFrame, targets: Sequence[str], features: int = 1 << 14, penalty: float = 0.01) -> Targets:
    """Models learned from ``gold`` (doc_id, text and a column for each of ``targets``).

    A row without a label of a target isn't learned from for that target; null and empty texts have no words. The fit runs on
    Spark over all rows, once for each class; a target of two classes has one model. Fails for a target without two classes, or
    with more than CLASSES.
    """
    spark = gold.sparkSession
    hashing = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features)
    counted = hashing.transform(_featured(gold, "doc_id", *targets))
    weigh = IDF(inputCol="__tf", outputCol="__weighed").fit(counted)
    level = Normalizer(inputCol="__weighed", outputCol="__level")  # else margins grow with a text's length
    hint = VectorSizeHint(inputCol="__shape", size=SHAPE, handleInvalid="optimistic")  # else the first row is looked at, and empty tables fail
    join = VectorAssembler(inputCols=["__level", "__shape"], outputCol="__x")
    kept = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % CALIBRATED == 0
    rows = join.transform(hint.transform(level.transform(weigh.transform(counted)))).select("__x", kept.alias("__kept"), *targets).persist(StorageLevel.MEMORY_AND_DISK)
    steps, scales = [hashing, weigh, level, hint, join], {}
    try:
        for t in targets:
            classes = sorted(r[0] for r in rows.where(F.col(t).isNotNull()).select(F.col(t).cast("string")).distinct().limit(CLASSES + 1).collect())
            if not 2 <= len(classes) <= CLASSES:
                raise ValueError(f"{t} has {len(classes)} classes; from 2 to {CLASSES} are taken")
            own, lines = rows.where(F.col(t).isNotNull()), []
            for i, c in enumerate(classes[1:] if len(classes) == 2 else classes):
                is_class, raw = F.col(t).cast("string") == c, _margin(t, i)
                learn = own.where(~F.col("__kept")).select("__x", is_class.cast("double").alias("label"))
                regression = LogisticRegression(featuresCol="__x", labelCol="label", rawPredictionCol=raw, probabilityCol="", predictionCol="", maxIter=20, regParam=penalty, family="binomial")
                step = regression.fit(learn)
                lines.append(_line(step.transform(own.where("__kept")), vector_to_array(raw)[1], is_class))
                steps.append(step)
            scales[t] = {"classes": classes, "lines": lines}
    finally:
        rows.unpersist()
    return Targets(PipelineModel(steps), scales)


def score_targets(docs: DataFrame, found: Targets) -> DataFrame:
    """doc_id and, for each target, its likeliest class and that class's share of the calibrated probabilities (ties: the first class)."""
    made = found.model.transform(_featured(docs, "doc_id"))
    out = [F.col("doc_id")]
    for t, scale in found.scales.items():
        p = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(vector_to_array(_margin(t, i))[1] * a + b))) for i, (a, b) in enumerate(scale["lines"])]
        p = [F.lit(1.0) - p[0], p[0]] if len(p) == 1 else p
        all_p = F.array(*p)
        total = F.aggregate(all_p, F.lit(0.0), lambda x, y: x + y)
        best = F.array_position(all_p, F.array_max(all_p)).cast("int")
        out += [F.element_at(F.array(*[F.lit(c) for c in scale["classes"]]), best).alias(t), (F.array_max(all_p) / total).alias(f"{t}_score")]
    return made.select(*out)


def save_targets(found: Targets, spark: SparkSession, path: str, version: str) -> None:
    """Writes a version below ``path``; a version that is there already is never replaced."""
    found.model.save(f"{path}/{version}/model")
    spark.createDataFrame([(json.dumps(found.scales),)], "value string").coalesce(1).write.text(f"{path}/{version}/scales")


def load_targets(spark: SparkSession, path: str, version: str) -> Targets:
    return Targets(PipelineModel.load(f"{path}/{version}/model"), json.loads(spark.read.text(f"{path}/{version}/scales").first()[0]))
