"""Fitted models over feature frames: regressions, boosted trees and outcome classifiers, split by time.

Features are an allow-list of columns; rows without one of them are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gram

SEED = 42


def temporal_split(df: DataFrame, period: str, last_train: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including a period, and those after it."""
    return df.where(F.col(period) <= last_train), df.where(F.col(period) > last_train)


def collapsed(rows: DataFrame, columns: Sequence[str], weight: str = "weight") -> DataFrame:
    """A row for each different set of values, none of them missing, and how many rows have it: all that a fit of few different values has to go through."""
    return rows.na.drop(subset=list(columns)).groupBy(*columns).agg(F.count("*").cast("double").alias(weight))


def split_collapsed(rows: DataFrame, key: Sequence[str], period: str, last_train: int, columns: Sequence[str], weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """As `temporal_split`, but of the earlier rows one for each different set of values with how many rows have it, of the later ones all with their keys.

    Both come from one grouping, which is cached: rows are built once, and the earlier ones are never held one by one.
    """
    late = F.col(period) > last_train
    few = rows.where(F.col(period).isNotNull()).groupBy(late.alias("_late"), *(F.when(late, F.col(k)).alias(k) for k in key), *columns).agg(F.count("*").cast("double").alias(weight)).cache()
    repeats = F.explode(F.array_repeat(F.lit(True), F.col(weight).cast("int"))).alias("_late")  # a key that occurs twice stays two rows
    return few.where("NOT _late").select(*columns, weight), few.where("_late").select(*key, *columns, repeats).drop("_late")


def one_hot(column: str, categories: Sequence[str]) -> list[Column]:
    """A 0/1 column for each of a pinned list of categories."""
    return [(F.col(column) == c).cast("int").alias(f"{column}_{c}") for c in categories]


def _features(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def _linear(rows: DataFrame, features: Sequence[str], label: str, l1: float, l2: float, **options) -> PipelineModel:
    """Least squares over twice the rows, plus l1 times the absolute and l2 / 2 times the squared weights.

    Spark fits the label divided by its deviation, by which the squared part of its penalty shrinks;
    the parameters are set so that the penalty on the label as it is comes out as asked.
    """
    spread = rows.agg(F.stddev_pop(label)).first()[0] or 1.0
    strength = l1 + l2 * spread
    share = l1 / strength if strength else 0.0
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=strength, elasticNetParam=share, standardization=False, **options)
    return Pipeline(stages=[_features(features), model]).fit(rows)


def ridge(train: DataFrame, features: Sequence[str], label: str, alpha: float) -> PipelineModel:
    """Least squares with alpha times the squared weights added to the sum of squares; the constant is free."""
    rows = train.na.drop(subset=[*features, label])
    return _linear(rows, features, label, 0.0, alpha / max(rows.count(), 1), solver="normal")


def elastic_net(train: DataFrame, features: Sequence[str], label: str, alpha: float, l1_ratio: float) -> PipelineModel:
    """Mean square over two, plus alpha times (l1_ratio of the absolute and (1 - l1_ratio) / 2 of the squared weights)."""
    return _linear(train.na.drop(subset=[*features, label]), features, label, alpha * l1_ratio, alpha * (1 - l1_ratio), maxIter=200)


def boosted(train: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, leaf: int = 20, weight: str | None = None) -> PipelineModel:
    """Boosted trees whose leaves have at least `leaf` rows. `weight` is the column that says how many rows a row stands for."""
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED)
    if weight is None:
        model.setMinInstancesPerNode(leaf)
    else:
        n = train.na.drop(subset=[*features, label]).agg(F.sum(weight)).first()[0] or 0.0
        model.setWeightCol(weight)
        if n < 2 * leaf:
            model.setMaxDepth(0)  # no split leaves enough rows on both sides
        else:
            model.setMinWeightFractionPerNode((leaf - 0.5) / n)
    return Pipeline(stages=[_features(features), model]).fit(train.na.drop(subset=[*features, label]))


def alpha_sweep(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float]) -> DataFrame:
    """MAE on the later rows for each penalty, best first; the training rows are gone through once for all of them."""
    return gram.sweep(train, valid.na.drop(subset=[*features, label]), features, label, alphas)


OUTCOMES = ("H", "D", "A")


def _labelled(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")


def outcome_logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, rounds: int = 100, weight: str | None = None, repeats: str | None = None) -> PipelineModel:
    """Three-way logistic regression; the penalty is 1 / (c n) on unscaled features.

    `weight` is the column that says how many rows a row stands for. The fit then comes to the same place by other steps, as Spark scales features by
    a deviation that depends on the weights; one that ends before it gets there differs. With `repeats` in its stead a row is
    assembled once and laid down so many times, so each step is that of all rows.
    """
    rows = train.na.drop(subset=[*features, label])
    count = weight or repeats
    n = rows.agg(F.count("*") if count is None else F.sum(count)).first()[0] or 0
    model = LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=rounds)
    if weight is not None:
        model.setWeightCol(weight)
    before = Pipeline(stages=[_labelled(label), _features(features)]).fit(rows)
    ready = before.transform(rows)
    if repeats is not None:
        ready = ready.select("_label", "features", F.explode(F.array_repeat(F.lit(True), F.col(repeats).cast("int"))))
    return PipelineModel(stages=[*before.stages, model.fit(ready)])


def outcome_boosted(train: DataFrame, features: Sequence[str], label: str, rounds: int = 10, depth: int = 2, rate: float = 0.1) -> PipelineModel:
    """One boosted two-way classifier for each outcome."""
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED)
    model = OneVsRest(classifier=trees, featuresCol="features", labelCol="_label", predictionCol="prediction")
    return Pipeline(stages=[_labelled(label), _features(features), model]).fit(train.na.drop(subset=[*features, label]))


def outcome_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 50, depth: int = 5) -> PipelineModel:
    model = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[_labelled(label), _features(features), model]).fit(train.na.drop(subset=[*features, label]))


def outcome_chances(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with pred and, where the model gives them, p_home, p_draw, p_away."""
    labels = model.stages[0].labels
    scored = rows.na.drop(subset=list(features))
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    out = scored.withColumn("pred", F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int")))
    if "probability" in scored.columns:
        chances = vector_to_array("probability")
        out = out.withColumns({f"p_{n}": chances[labels.index(k)] for k, n in zip(OUTCOMES, ("home", "draw", "away")) if k in labels})
    return out.drop("features", "rawPrediction", "probability", "prediction", "_label")


def goal_models(train: DataFrame, features: Sequence[str], home: str, away: str) -> tuple[PipelineModel, PipelineModel]:
    """A regressor for the goals of each side. Rows of the same features and goals are one with a weight, so the trees grow over the different ones."""

    def model(goals: str) -> PipelineModel:
        rows = collapsed(train, [*features, goals]).persist()
        try:
            return boosted(rows, features, goals, weight="weight")
        finally:
            rows.unpersist()

    return model(home), model(away)
