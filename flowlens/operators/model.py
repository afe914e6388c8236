"""The flow classifier: a random forest trained on labelled feature rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES, LABELS

TREES, SEED = 10, 42


def baseline_rows(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """Cold-start training rows drawn from fixed ranges: 100 normal, 50 malicious, 50 suspicious."""
    rng = np.random.default_rng(seed)

    # Per class the ranges of the seven features.
    def draw(n: int, label: str, *ranges) -> list[tuple]:
        columns = [
            rng.choice(r, n) if isinstance(r, list) else np.full(n, r) if np.isscalar(r)
            else rng.integers(r[0], r[1], n) if isinstance(r[0], int) else rng.uniform(r[0], r[1], n)
            for r in ranges
        ]
        return [(*map(float, row), label) for row in zip(*columns)]

    rows = (
        draw(100, "Normal", (100, 1000), (100, 1000), (0.01, 0.1), (0.01, 0.1), [1.0, 2.0], (5, 20), (40.0, 100.0))
        + draw(50, "Malicious", (5000, 50000), (100, 1000), (0.001, 0.01), 0.0, 1.0, (100, 500), (500.0, 1500.0))
        + draw(50, "Suspicious", 64.0, 0.0, (0.0001, 0.002), 0.0, 1.0, 1.0, 64.0)
    )
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label string")


def train(rows: DataFrame, trees: int = TREES, seed: int = SEED) -> Model:
    """Fit on rows with the seven features and a ``label`` of the three names."""
    code = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")) - 1
    labelled = rows.withColumn("__y", code.cast("double")).where(F.col("__y") >= 0)
    forest = RandomForestClassifier(
        featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__k",
        numTrees=trees, seed=seed, maxDepth=8,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="__x"), forest]).fit(labelled)


def train_baseline(spark: SparkSession) -> Model:
    return train(baseline_rows(spark))


class FixedForest:
    """A forest written down by hand, used like a fitted model; its score is an expression, no model file is needed.

    A tree is ``(feature, bound, below, otherwise)`` or, as a leaf, the chances of the three labels. The trees' chances
    are averaged and the first label with the largest one wins.
    """

    def __init__(self, trees: list):
        self.trees = trees

    def chances(self, label: int) -> Column:
        def of(tree) -> Column:
            if len(tree) == len(LABELS):
                return F.lit(float(tree[label]))
            feature, bound, below, rest = tree
            return F.when(F.col(feature) < bound, of(below)).otherwise(of(rest))

        return sum((of(t) for t in self.trees[1:]), of(self.trees[0])) / F.lit(float(len(self.trees)))

    def transform(self, rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("__a", F.array(*[self.chances(i) for i in range(len(LABELS))]))
        best = F.array_position("__a", F.array_max("__a")) - 1
        return scored.select(*rows.columns, best.cast("double").alias("__k"), array_to_vector("__a").alias("__p"))


def classify(flows: DataFrame, model: Model | FixedForest) -> DataFrame:
    """Add ``prediction_label`` and ``confidence_score`` (largest class probability)."""
    names = F.array(*[F.lit(x) for x in LABELS])
    scored = model.transform(flows)
    return scored.select(
        *flows.columns,
        names[F.col("__k").cast("int")].alias("prediction_label"),
        F.array_max(vector_to_array("__p")).alias("confidence_score"),
    )


def label_rule(watch_hit: Column, eligible: Column, model_label: Column, model_confidence: Column) -> list[Column]:
    """Import labelling: the model if the flow has its inputs, else the watchlist, else normal."""
    return [
        F.when(eligible, model_label).when(watch_hit, "Suspicious").otherwise("Normal").alias("prediction_label"),
        F.when(eligible, model_confidence).when(watch_hit, 0.90).otherwise(0.85).alias("confidence_score"),
    ]


def knows_enough(rows: DataFrame, classes: int = 2) -> bool:
    """Whether a refit may replace the baseline: it must have seen more than one class."""
    return rows.select("label").distinct().limit(classes).count() >= classes
