"""Trainable next-activity models on the last few activities, learned by distributed gradient methods: a regression and a network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.config import Config
from casewise.operators.evaluate import case_perplexity, perplexity_stats
from casewise.operators.predict import prediction


@dataclass
class WindowClassifier:
    window: int
    model: PipelineModel
    validation_accuracy: float
    index: DataFrame

    def score(self, prefixes: DataFrame) -> DataFrame:
        """Prefix rows with the distribution over activities, the prediction and the likelihood of the actual one, 0 if it was never learned."""
        names = self.index.agg(
            F.map_from_entries(F.collect_list(F.struct("activity_idx", "activity"))).alias("m")
        ).scalar()
        rows = self.model.transform(_columns(prefixes, self.window)).withColumn("_names", names)
        probs = vector_to_array("probability")
        rows = rows.withColumn("_p", probs)
        dist = F.filter(
            F.transform(
                "_p",
                lambda p, i: F.struct(
                    F.try_element_at("_names", i.cast("bigint")).alias("activity"), p.alias("prob")
                ),
            ),
            lambda x: x["activity"].isNotNull(),
        )
        rows = rows.withColumn("dist", dist).withColumn("activity", F.try_element_at("_names", F.col("y")))
        rows = rows.withColumn("likelihood", F.when(F.col("y") > 0, F.get("_p", F.col("y").cast("int"))))
        rows = rows.withColumn("likelihood", F.coalesce("likelihood", F.lit(0.0)))
        return rows.withColumn("prediction", prediction(F.col("dist"), Config())).select(
            "case_id", "case_seq", "pos", "activity", "dist", "prediction", "likelihood"
        )


def _columns(prefixes: DataFrame, window: int) -> DataFrame:
    return prefixes.withColumns({f"_x{i}": F.get("x", i).cast("double") for i in range(window)}).withColumn(
        "label", F.col("y").cast("double")
    )


def _features(window: int) -> list:
    """Stages from the columns of :func:`_columns` to one-hot ``features``."""
    inputs, hot = [f"_x{i}" for i in range(window)], [f"_h{i}" for i in range(window)]
    return [OneHotEncoder(inputCols=inputs, outputCols=hot, dropLast=False, handleInvalid="keep"), VectorAssembler(inputCols=hot, outputCol="features")]


def window_classifier(
    train: DataFrame, validation: DataFrame, window: int, index: DataFrame, *, reg_params: tuple[float, ...] = (0.0, 0.01), max_iter: int = 20
) -> WindowClassifier:
    """Fit one-hot multinomial regressions on prefix windows and keep the best on the validation part."""
    train, validation = _columns(train, window).persist(), _columns(validation, window).persist()
    best, best_accuracy = None, -1.0
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    try:
        for reg in reg_params:
            stages = [*_features(window), LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter)]
            fitted = Pipeline(stages=stages).fit(train)
            accuracy = judge.evaluate(fitted.transform(validation))
            if accuracy > best_accuracy:
                best, best_accuracy = fitted, accuracy
    finally:
        train.unpersist()
        validation.unpersist()
    return WindowClassifier(window, best, best_accuracy, index)


def window_network(
    train: DataFrame, validation: DataFrame, window: int, index: DataFrame, *,
    hidden: tuple[int, ...] = (32,), steps: int = 20, rounds: int = 10, patience: int = 2, seed: int = 0,
) -> WindowClassifier:
    """Fit a multilayer perceptron on one-hot prefix windows, with early stopping.

    Training goes on in rounds of ``steps`` iterations, each from the weights of the one before, until ``patience`` rounds in a row haven't
    raised the accuracy on the validation part, at most ``rounds``; the best weights are kept. Gradients are sums over all partitions, so
    the driver holds weights only.
    """
    if not hidden or min(hidden) < 1 or min(steps, rounds, patience) < 1:
        raise ValueError("need hidden units, steps, rounds and patience of at least 1")
    encoder = Pipeline(stages=_features(window)).fit(_columns(train, window))
    parts = [encoder.transform(_columns(rows, window)).select("features", "label").persist() for rows in (train, validation)]
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    best, best_accuracy, weights, idle = None, -1.0, None, 0
    try:
        classes = (index.agg(F.max("activity_idx")).first()[0] or 0) + 1
        layers = [parts[0].first()["features"].size, *hidden, max(classes, 2)]
        for _ in range(rounds):
            network = MultilayerPerceptronClassifier(layers=layers, maxIter=steps, seed=seed)
            fitted = (network if weights is None else network.setInitialWeights(weights)).fit(parts[0])
            weights, accuracy = fitted.weights, judge.evaluate(fitted.transform(parts[1]))
            if accuracy > best_accuracy:
                best, best_accuracy, idle = fitted, accuracy, 0
            else:
                idle += 1
            if idle >= patience:
                break
    finally:
        for rows in parts:
            rows.unpersist()
    return WindowClassifier(window, PipelineModel(stages=[*encoder.stages, best]), best_accuracy, index)


def sequence_metrics(scored: DataFrame, top_k: int = 3) -> DataFrame:
    """:func:`top_k_nll` of all positions, and mean, harmonic mean and quartiles of the perplexities of whole cases."""
    return top_k_nll(scored, top_k).join(perplexity_stats(case_perplexity(scored)), F.lit(True))


def top_k_nll(scored: DataFrame, top_k: int = 3) -> DataFrame:
    """Accuracy, top-k accuracy, mean negative log-likelihood of a scored classifier."""
    hit = F.col("prediction.activity") == F.col("activity")
    rank = F.array_position("prediction.top_k", F.col("activity"))
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(hit.cast("int")).alias("accuracy"),
        *[F.avg(((rank >= 1) & (rank <= k)).cast("int")).alias(f"top{k}") for k in range(1, top_k + 1)],
        F.avg(-F.ln("likelihood")).alias("nll"),
    )
