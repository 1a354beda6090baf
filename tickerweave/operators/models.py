"""Scorers and regressors: a small interface, and what runs without external models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerweave.functions.columns import alnum_only, softmax, tokens

POSITIVE = "gain gains rise rises rose up growth profit profits strong beat beats record high surge rally upgrade bullish win boost".split()
NEGATIVE = "loss losses fall falls fell down decline weak miss misses low drop crash downgrade bearish fraud cut cuts risk fear worthless".split()


class SentimentScorer(Protocol):
    """Adds pos, neg and neu (in that order they are the model's outputs) to rows with a text column."""

    def score(self, df: DataFrame, text: str) -> DataFrame: ...


class LexiconScorer:
    """Counts of listed words as logits; built-in expressions only. A model plugs in by the same method, in Arrow batches."""

    def __init__(self, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE):
        self.positive, self.negative = positive, negative

    def score(self, df: DataFrame, text: str) -> DataFrame:
        words = tokens(alnum_only(F.lower(F.coalesce(F.col(text), F.lit("")))))
        # the words are split once: one fold over them counts both lists
        up, down = F.array(*map(F.lit, self.positive)), F.array(*map(F.lit, self.negative))
        step = lambda a, t: F.struct((a["p"] + F.array_contains(up, t).cast("double")).alias("p"), (a["n"] + F.array_contains(down, t).cast("double")).alias("n"))
        counted = df.withColumn("__c", F.aggregate(words, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n")), step))
        pos, neg, neu = softmax(F.col("__c.p"), F.col("__c.n"), F.lit(1.0))
        return counted.withColumns({"pos": pos, "neg": neg, "neu": neu}).drop("__c")


class BatchScorer:
    """A model behind ``load``: loaded once in each worker, then called on Arrow batches of texts; it returns rows of (pos, neg, neu)."""

    def __init__(self, load):
        self.load = load

    def score(self, df: DataFrame, text: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("pos double, neg double, neu double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in batches:
                yield pd.DataFrame(list(model(texts.fillna("").tolist())), columns=["pos", "neg", "neu"], dtype="float64")

        return df.withColumn("__s", scored(F.col(text).cast("string"))).select(*df.columns, "__s.pos", "__s.neg", "__s.neu")


class SequenceRegressor(Protocol):
    def fit(self, train: DataFrame) -> SequenceRegressor: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


class Persistence:
    """Tomorrow's close is today's."""

    def fit(self, train: DataFrame) -> Persistence:
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col("Close"))


class LinearTrend:
    """Least squares of the target on today's close and one more feature, solved from sums of one distributed aggregate."""

    def __init__(self, feature: str = "Close", target: str = "target_close"):
        self.feature, self.target = feature, target

    @staticmethod
    def lines(train: DataFrame, features: list[str], target: str) -> list[tuple[float, float]]:
        """Slope and intercept for each feature by itself, in one pass."""
        row = train.agg(*[f(target, c) for c in features for f in (F.regr_slope, F.regr_intercept)]).first()
        return [(row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i in range(len(features))]

    def fit(self, train: DataFrame) -> LinearTrend:
        ((self.slope, self.intercept),) = self.lines(train, [self.feature], self.target)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col(self.feature) * self.slope + self.intercept)


class LagRegression:
    """Ridge or lasso regression of the target on the lagged columns (a flattened sequence), by pyspark.ml; ``log`` has the loss by iteration."""

    def __init__(self, features: list[str], target: str = "target_close", ridge: float = 0.0, lasso_share: float = 0.0, rounds: int = 100, solver: str = "auto"):
        self.features, self.target, self.params = features, target, {"regParam": ridge, "elasticNetParam": lasso_share, "maxIter": rounds, "solver": solver}

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__x", handleInvalid="skip").transform(df)

    def fit(self, train: DataFrame) -> LagRegression:
        from pyspark.ml.regression import LinearRegression

        self.model = LinearRegression(featuresCol="__x", labelCol=self.target, predictionCol="prediction", **self.params).fit(self._vectors(train))
        losses = list(self.model.summary.objectiveHistory) if self.model.hasSummary else []
        self.log = train.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, val_mse double")
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._vectors(df)).drop("__x")

    def fit_or_load(self, train: DataFrame, path: str) -> LagRegression:
        """Training is skipped where a model was saved at ``path``."""
        from pyspark.ml.regression import LinearRegressionModel

        spark = train.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            self.model = LinearRegressionModel.load(path)
            return self
        self.fit(train)
        self.model.write().overwrite().save(path)
        return self


def ridge_search(train: DataFrame, validation: DataFrame, features: list[str], grid: dict[str, list], target: str = "target_close") -> DataFrame:
    """(trial_id, ridge, lasso_share, val_loss) of every combination: fitted on the training part, scored on the validation part."""
    trials = [(float(r), float(s)) for r in grid.get("ridge", [0.0]) for s in grid.get("lasso_share", [0.0])]
    # all trials' predictions stand side by side, so the validation part is read once
    p = LagRegression(features, target)._vectors(validation)
    for i, (ridge, share) in enumerate(trials):
        p = LagRegression(features, target, ridge, share).fit(train).model.setPredictionCol(f"__p{i}").transform(p)
    columns = {"ridge": [r for r, _ in trials], "lasso_share": [s for _, s in trials]}
    return _losses(p, [F.col(f"__p{i}") for i in range(len(trials))], target, columns)


def grid_search(train: DataFrame, validation: DataFrame, features: list[str], target: str = "target_close") -> DataFrame:
    """(trial_id, feature, val_loss): every candidate is fitted on the training part and scored on the validation part, never on the test part.

    One aggregate fits all candidates and one scores them.
    """
    lines = LinearTrend.lines(train, features, target)
    return _losses(validation, [F.col(f) * a + b for f, (a, b) in zip(features, lines)], target, {"feature": features})


def _losses(validation: DataFrame, predictions: list[Column], target: str, columns: dict[str, list]) -> DataFrame:
    """(trial_id, columns, val_loss) of every prediction: one pass over the rows for all of them."""
    sums = validation.agg(*[F.avg(F.pow(F.col(target) - p, 2)).alias(f"v{i}") for i, p in enumerate(predictions)])
    rows = [F.struct(F.lit(i).alias("trial_id"), *[F.lit(c[i]).alias(n) for n, c in columns.items()], F.col(f"v{i}").alias("val_loss")) for i in range(len(predictions))]
    return sums.select(F.inline(F.array(*rows)))


def loss_plateau(log: DataFrame, patience: int) -> DataFrame:
    """The training log up to where ``patience`` epochs have passed without a better val_mse; lr is halved after each 7 such epochs."""
    w = Window.orderBy("epoch")
    best = log.withColumn("best", F.min("val_mse").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = best.withColumn("at", F.max(F.when(F.col("val_mse") == F.col("best"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    waited = at.withColumn("waited", F.col("epoch") - F.col("at"))
    over = waited.withColumn("over", F.max("waited").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    live = over.filter(F.coalesce("over", F.lit(0)) < patience)
    return live.select("epoch", "val_mse", "best", "waited", F.pow(F.lit(0.5), F.floor(F.col("waited") / 7)).alias("lr_factor"))
