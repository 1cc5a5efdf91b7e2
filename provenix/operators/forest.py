"""Random forests on feature columns."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_and_rate(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """(name, value): the importance of each feature, and accuracy and auc on the fifth of the rows held out by a hash."""
    rows = df.select(F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features], F.pmod(F.xxhash64(*features, label), F.lit(5)).alias("_part"))
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(rows.dropna())
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ready.where("_part > 0"))
    out = model.transform(ready.where("_part = 0"))
    acc = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    auc = BinaryClassificationEvaluator().evaluate(out)
    named = [(f"importance of {f}", float(v)) for f, v in zip(features, model.featureImportances.toArray())] + [("accuracy", float(acc or 0)), ("auc", float(auc))]
    return df.sparkSession.createDataFrame(named, "name string, value double")
