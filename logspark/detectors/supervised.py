"""Linear and tree classifiers on count vectors, from Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model, classification
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.detectors.kept import keep_settings, kept_settings
from logspark.detectors.vectors import assemble, distinct_vectors
from logspark.sources.sinks import save_best_model

KINDS = {
    "logistic_regression": lambda: LogisticRegression(maxIter=100, regParam=1e-4, tol=1e-4),
    "linear_svm": lambda: LinearSVC(maxIter=30, regParam=1e-2, tol=1e-3),
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=10, seed=42),
}


@dataclass
class SupervisedDetector:
    columns: list[str]
    model: Model

    def transform(self, matrix: DataFrame) -> DataFrame:
        """Add ``score`` and ``pred``."""
        scored = self.model.transform(assemble(matrix, self.columns))
        return scored.select(
            *matrix.columns,
            F.element_at(vector_to_array("rawPrediction"), 2).alias("score"),
            F.col("prediction").cast("int").alias("pred"))

    def save(self, path: str) -> None:
        """Replace what is at ``path``."""
        save_best_model(self.model, f"{path}/model")
        keep_settings(path, {"columns": self.columns, "kind": type(self.model).__name__})

    @classmethod
    def load(cls, path: str) -> SupervisedDetector:
        kept = kept_settings(path)
        return cls(kept["columns"], getattr(classification, kept["kind"]).load(f"{path}/model"))


def fit_supervised(matrix: DataFrame, columns: list[str], label: str, kind: str, **params) -> SupervisedDetector:
    """Train on distinct (vector, label) rows weighted by their number."""
    rows = distinct_vectors(matrix, columns, [label]).withColumn(label, F.col(label).cast("double"))
    learner = KINDS[kind]().setFeaturesCol("features").setLabelCol(label).setWeightCol("weight")
    if params:
        learner = learner.copy({learner.getParam(name): value for name, value in params.items()})
    return SupervisedDetector(columns, learner.fit(assemble(rows, columns)))
