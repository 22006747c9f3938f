"""Opponents from MLlib: boosted trees and factorisation machines, one-vs-rest for several classes.

They are other algorithms than the closed-form read-outs; their numbers are comparisons, not parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_opponent(train: DataFrame, test: DataFrame, features: list[str], sizes: list[int], y: str, classes: int, kind: str = "gbt", **options) -> DataFrame:
    """(bits, acc) on test of a 'gbt' (depth, rounds, rate) or 'fm' (dim, rounds, rate) opponent on one-hot features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import FMClassifier, GBTClassifier
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def estimator():
        if kind == "gbt":
            return GBTClassifier(featuresCol="features", labelCol="__y", maxDepth=options.get("depth", 2), maxIter=options.get("rounds", 20), stepSize=options.get("rate", 0.3), seed=1)
        return FMClassifier(featuresCol="features", labelCol="__y", factorSize=options.get("dim", 8), maxIter=options.get("rounds", 100), stepSize=options.get("rate", 0.05), seed=1)

    hot = [f"{f}__hot" for f in features]
    prepare = Pipeline(stages=[OneHotEncoder(inputCols=features, outputCols=hot, dropLast=False, handleInvalid="keep"), VectorAssembler(inputCols=hot, outputCol="features")]).fit(train)
    learn, held = prepare.transform(train).select("features", y).cache(), prepare.transform(test).select("features", F.col(y).alias("__t"))
    heads = [1] if classes == 2 else list(range(classes))
    for c in heads:
        model = estimator().fit(learn.withColumn("__y", (F.col(y) == c).cast("double")))
        held = model.transform(held).withColumn(f"__p{c}", F.element_at(vector_to_array("probability"), 2)).drop("rawPrediction", "probability", "prediction")
    learn.unpersist()
    shares = [1 - F.col("__p1"), F.col("__p1")] if classes == 2 else [F.col(f"__p{c}") for c in heads]
    total = sum(shares[1:], shares[0])
    p = F.transform(F.array(*shares), lambda x: x / F.greatest(total, F.lit(1e-12)))
    scored = held.select(p.alias("p"), F.col("__t").cast("int").alias("t"))
    return scored.agg(F.avg(-F.log2(F.greatest(F.element_at("p", F.col("t") + 1), F.lit(1e-12)))).alias("bits"), F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("t")).cast("int")).alias("acc"))
