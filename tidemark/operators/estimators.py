"""Estimators of pyspark.ml: typed parameters, copies with other parameters, a place in a Pipeline or a cross-validator, models that are saved and loaded."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ewm_mean
from . import jump_model

_TO = TypeConverters


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _Stored(MLWriter):
    """Parameters as pyspark.ml writes them, and what the model keeps beside them (see _keep)."""

    def __init__(self, model: _Kept):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=self.model._facts())
        self.model._keep(path)


class _Read(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind._found(self.sparkSession, path, metadata)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Kept(Model, MLWritable, MLReadable):
    """A model that is saved with its parameters. _facts: plain values; _keep: writes tables or models below path; _found: makes one of what is there."""

    def _facts(self) -> dict:
        return {}

    def write(self) -> MLWriter:
        return _Stored(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Read(cls)


class _JumpParams(Params):
    features = _param("features", "feature columns", _TO.toListString)
    states = _param("states", "number of states", _TO.toInt)
    penalty = _param("penalty", "cost of a change of state", _TO.toFloat)
    maxIter = _param("maxIter", "most rounds of a fit", _TO.toInt)
    tol = _param("tol", "a fit ends when its objective moves by less", _TO.toFloat)
    seed = _param("seed", "of the first centres", _TO.toInt)
    key = _param("key", "column of the series' names", _TO.toString)
    order = _param("order", "column that orders a series", _TO.toString)
    value = _param("value", "column whose mean tells the bull state", _TO.toString)


class JumpModel(_JumpParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Regimes of every key by the jump model; fit() runs one task a key. Rows with a null feature or value teach nothing."""

    def __init__(self, features: list[str] | None = None, states: int = 2, penalty: float = 50.0, max_iter: int = 300, tol: float = 1e-6, seed: int = 0, key: str = "asset", order: str = "t", value: str = "er"):
        super().__init__()
        self._set(features=features, states=states, penalty=penalty, maxIter=max_iter, tol=tol, seed=seed, key=key, order=order, value=value)

    def _fit(self, dataset: DataFrame) -> JumpModelModel:
        key, order, value, features = (self.getOrDefault(p) for p in ("key", "order", "value", "features"))
        states, penalty, max_iter, tol, seed = (self.getOrDefault(p) for p in ("states", "penalty", "maxIter", "tol", "seed"))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            labels, centres = jump_model.fit(pdf[features].to_numpy(float), states, penalty, max_iter, tol, seed)
            r = pdf[value].to_numpy(float)
            mean = [float(r[labels == k].mean()) if (labels == k).any() else -np.inf for k in range(states)]
            return pd.DataFrame({key: [pdf[key].iloc[0]], "centres": [centres.tolist()], "bull": [int(np.argmax(mean))], "labels": [labels.tolist()], "days": [pdf[order].tolist()]})

        kinds = {c: dataset.schema[c].dataType.simpleString() for c in (key, order)}
        rows = dataset.select(key, order, *dict.fromkeys([value, *features])).dropna()
        fitted = rows.groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, centres array<array<double>>, bull int, labels array<int>, days array<{kinds[order]}>")
        return self._copyValues(JumpModelModel(fitted))


class JumpModelModel(_JumpParams, _Kept):
    """centres: (key, centres, bull); labels: (key, order, state, regime) of the training rows; transform() names the nearest centre, without a penalty."""

    def __init__(self, fitted: DataFrame | None = None):
        super().__init__()
        self.fitted = fitted

    def _keep(self, path: str) -> None:
        self.fitted.write.parquet(f"{path}/fitted")

    @classmethod
    def _found(cls, spark, path: str, metadata: dict) -> JumpModelModel:
        return cls(spark.read.parquet(f"{path}/fitted"))

    @property
    def centres(self) -> DataFrame:
        return self.fitted.select(self.getOrDefault("key"), "centres", "bull")

    @property
    def labels(self) -> DataFrame:
        key, order = self.getOrDefault("key"), self.getOrDefault("order")
        e = self.fitted.select(key, "bull", F.explode(F.arrays_zip("days", "labels")).alias("e"))
        return e.select(key, F.col("e.days").alias(order), F.col("e.labels").alias("state"), F.when(F.col("e.labels") == F.col("bull"), 0).otherwise(1).alias("regime"))

    def stats(self, dataset: DataFrame) -> DataFrame:
        """(key, state, mean_daily, cum_return, volatility, n) of the training rows of each state."""
        key, order, v = self.getOrDefault("key"), self.getOrDefault("order"), F.col(self.getOrDefault("value"))
        x = dataset.join(self.labels, [key, order])
        return x.groupBy(key, "state").agg(F.avg(v).alias("mean_daily"), (F.product(1 + v) - 1).alias("cum_return"), (F.stddev_pop(v) * F.sqrt(F.lit(252.0))).alias("volatility"), F.count(v).alias("n"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.array(*[F.col(f).cast("double") for f in self.getOrDefault("features")])
        far = F.transform("centres", lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d) / 2)
        known = ~F.exists(x, lambda v: v.isNull())
        d = dataset.join(self.centres, self.getOrDefault("key"), "left")
        state = F.when(known & F.col("centres").isNotNull(), F.array_position(far, F.array_min(far)) - 1)
        return d.withColumn("state", state.cast("int")).withColumn("regime", F.when(F.col("state").isNotNull(), F.when(F.col("state") == F.col("bull"), 0).otherwise(1))).drop("centres", "bull")


class TimingEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean over keys of the Sharpe ratio that holding a key the day after a bullish row earns, less `cost` a change; for cross-validation over a penalty. Keys without a ratio don't count."""

    key = _param("key", "column of the series' names", _TO.toString)
    order = _param("order", "column that orders a series", _TO.toString)
    value = _param("value", "column of the returns", _TO.toString)
    label = _param("label", "column of the regimes: 0 bull, 1 bear", _TO.toString)
    cost = _param("cost", "of a change of position", _TO.toFloat)

    def __init__(self, key: str = "asset", order: str = "t", value: str = "er", label: str = "regime", cost: float = 5e-4):
        super().__init__()
        self._set(key=key, order=order, value=value, label=label, cost=cost)

    def _evaluate(self, dataset: DataFrame) -> float:
        key, order, value, label, cost = (self.getOrDefault(p) for p in ("key", "order", "value", "label", "cost"))
        w = Window.partitionBy(key).orderBy(order)
        held = F.coalesce(1 - F.lag(label).over(w), F.lit(0)).cast("double")
        d = dataset.withColumn("_held", held).withColumn("_net", F.col("_held") * F.col(value) - F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0.0))) * cost)
        ratio = F.when(F.stddev_samp("_net") > 1e-10, F.avg("_net") / F.stddev_samp("_net") * F.sqrt(F.lit(252.0)))
        mean = d.groupBy(key).agg(ratio.alias("_s")).agg(F.avg("_s")).first()[0]
        return 0.0 if mean is None else float(mean)

    def isLargerBetter(self) -> bool:
        return True


class _ForecastParams(Params):
    features = _param("features", "feature columns", _TO.toListString)
    label = _param("label", "column of the next row's state", _TO.toString)
    smooth = _param("smooth", "half-life that probabilities are smoothed by, in rows; 0 for none", _TO.toFloat)
    threshold = _param("threshold", "probability from which on a row is bearish", _TO.toFloat)
    trees = _param("trees", "rounds of boosting", _TO.toInt)
    depth = _param("depth", "of a tree", _TO.toInt)
    rate = _param("rate", "step of a round", _TO.toFloat)
    seed = _param("seed", "of the trees", _TO.toInt)
    order = _param("order", "column that counts rows", _TO.toString)
    key = _param("key", "column of the series' names, for smoothing; empty: all rows are one series", _TO.toString)


class RegimeForecaster(_ForecastParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The probability of a bear state on the next row, by pyspark.ml's gradient-boosted trees; labels of one kind only give a constant.

    Rows are (features, label: the next row's state). transform() adds prob, smoothed over a key's rows where smooth > 0 (order counts them), and regime (prob of the threshold or more).
    """

    def __init__(self, features: list[str] | None = None, label: str = "target", smooth: float = 0.0, threshold: float = 0.5, trees: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42, order: str = "t", key: str = ""):
        super().__init__()
        self._set(features=features, label=label, smooth=smooth, threshold=threshold, trees=trees, depth=depth, rate=rate, seed=seed, order=order, key=key)

    def _fit(self, dataset: DataFrame) -> RegimeForecasterModel:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        get = self.getOrDefault
        rows = dataset.select(*get("features"), F.col(get("label")).cast("double").alias("label")).dropna()
        low, high = rows.agg(F.min("label"), F.max("label")).first()
        if low is None:
            raise ValueError("no training rows")
        if low == high:
            return self._copyValues(RegimeForecasterModel(None, low))
        ready = VectorAssembler(inputCols=get("features"), outputCol="_features").transform(rows)
        trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=get("trees"), maxDepth=get("depth"), stepSize=get("rate"), seed=get("seed"))
        return self._copyValues(RegimeForecasterModel(trees.fit(ready), None))


class RegimeForecasterModel(_ForecastParams, _Kept):
    def __init__(self, fitted=None, constant: float | None = None):
        super().__init__()
        self.fitted, self.constant = fitted, constant

    def _facts(self) -> dict:
        return {"constant": json.dumps(self.constant)}

    def _keep(self, path: str) -> None:
        if self.fitted is not None:
            self.fitted.write().save(f"{path}/trees")

    @classmethod
    def _found(cls, spark, path: str, metadata: dict) -> RegimeForecasterModel:
        from pyspark.ml.classification import GBTClassificationModel

        constant = json.loads(metadata["constant"])
        return cls(GBTClassificationModel.load(f"{path}/trees") if constant is None else None, constant)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        get, columns = self.getOrDefault, dataset.columns
        if self.fitted is None:
            out = dataset.withColumn("prob", F.lit(float(self.constant)))
        else:
            ready = VectorAssembler(inputCols=get("features"), outputCol="_features", handleInvalid="skip").transform(dataset)
            out = self.fitted.transform(ready).select(*columns, vector_to_array("probability")[1].alias("prob"))
        if get("smooth") > 0:
            key = get("key") or "_one"
            out = out.withColumn("_one", F.lit(0))
            out = out.withColumn("prob", ewm_mean(F.col("prob"), get("smooth"), key, get("order"))).drop("_one")
        return out.withColumn("regime", (F.col("prob") >= get("threshold")).cast("int"))
