"""Cross-fitted estimators on MLlib (inventory 2.16)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepared(features: list[str]) -> list:
    """Median imputation, then standardised columns as one vector `x`."""
    filled = [f"_{c}" for c in features]
    return [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="x", withMean=True, withStd=True),
    ]


def cross_fitted(df: DataFrame, features: list[str], label: str, fold: str, folds: int, estimator) -> DataFrame:  # noqa: ANN001
    """Each row scored once, by the model fitted on all other folds: df with the column `oof`.

    estimator(rows) makes the estimator for a training set of that many rows.
    """
    parts = []
    for k in range(folds):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        out = Pipeline(stages=[*prepared(features), estimator(train.count())]).fit(train).transform(test)
        score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        parts.append(out.select(*df.columns, score.alias("oof")))
    return reduce(DataFrame.unionByName, parts)


def logistic(label: str, c: float):  # noqa: ANN201
    """The penalty of C in the other convention is 1 / (C n)."""
    return lambda n: LogisticRegression(featuresCol="x", labelCol=label, regParam=1.0 / (c * max(n, 1)), standardization=False)


def ridge(label: str, alpha: float, weight: str | None = None):  # noqa: ANN201
    """Squared error over n and the penalty over n."""

    def make(n: int):  # noqa: ANN202
        model = LinearRegression(featuresCol="x", labelCol=label, regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False)
        return model.setWeightCol(weight) if weight else model

    return make


def boosted(label: str):  # noqa: ANN201
    return lambda n: GBTClassifier(featuresCol="x", labelCol=label, maxIter=5, maxDepth=3, seed=1)


def perceptron(label: str, width: int, hidden: int = 8):  # noqa: ANN201
    return lambda n: MultilayerPerceptronClassifier(featuresCol="x", labelCol=label, layers=[width, hidden, 2], maxIter=30, seed=1)
