"""Pair classifier: roles and folds by hash, boosted trees with out-of-fold scores, isotonic calibration, routed blending."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Model, Split


def uniform(c: Column, salt: str = "") -> Column:
    """A number in [0, 1) from an id's MD5: the same everywhere, at any size, in any order."""
    return F.conv(F.substring(F.md5(F.concat(c, F.lit(salt))), 1, 8), 16, 10).cast("bigint") % 10000 / 10000


def role(c: Column, cfg: Split = Split()) -> Column:
    if cfg.valid + cfg.train + cfg.test > 1:
        raise ValueError("roles overlap")
    u = uniform(c)
    return F.when(u < cfg.valid, "VALID").when(u < cfg.valid + cfg.train, "TRAIN").when(u >= 1 - cfg.test, "TEST").otherwise("UNUSED")


def fold(c: Column, folds: int, salt: str = "fold") -> Column:
    return (F.floor(uniform(c, salt) * folds)).cast("int")


def hash_sample(d: DataFrame, column: str, n: int, salt: str = "") -> DataFrame:
    """The ``n`` rows of the smallest hashes."""
    return d.orderBy(F.md5(F.concat(F.col(column), F.lit(salt))), column).limit(n)


def assembled(d: DataFrame, features: list[str]) -> DataFrame:
    """A vector of the features; NULL becomes -1 beside an indicator, as trees cannot take it."""
    if missing := set(features) - set(d.columns):
        raise KeyError(f"features are missing: {sorted(missing)}")
    cols = [c for f in features for c in (F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f"_{f}"), F.col(f).isNull().cast("double").alias(f"_{f}_none"))]
    names = [n for f in features for n in (f"_{f}", f"_{f}_none")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(d.select("*", *cols)).drop(*names)


def learner(kind: str, cfg: Model, seed: int):
    if kind == "gbt":
        return GBTClassifier(labelCol="y", maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=cfg.step, subsamplingRate=0.7, featureSubsetStrategy="0.8", seed=seed)
    if kind == "forest":
        return RandomForestClassifier(labelCol="y", numTrees=cfg.trees, maxDepth=cfg.depth, seed=seed)
    return LogisticRegression(labelCol="y", standardization=True)


def fit(d: DataFrame, features: list[str], cfg: Model = Model(), kind: str = "gbt", seed: int | None = None):
    kept = [f for f in features if f not in cfg.exclude]
    return Pipeline(stages=[learner(kind, cfg, cfg.seed if seed is None else seed)]).fit(assembled(d.withColumn("y", F.col("y").cast("double")), kept)), kept


def predict(model, d: DataFrame, out: str = "p") -> DataFrame:
    fitted, kept = model
    return fitted.transform(assembled(d, kept)).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save_model(model, path: str) -> None:
    """The fitted pipeline and the names and order of its features, on any file system that Spark writes to."""
    fitted, kept = model
    fitted.write().overwrite().save(f"{path}/pipeline")
    _session().createDataFrame([(json.dumps(kept),)], "features string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def load_model(path: str):
    """What ``save_model`` wrote; ``predict`` refuses data that lacks one of its features."""
    return PipelineModel.load(f"{path}/pipeline"), json.loads(_session().read.text(f"{path}/features").first()[0])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def importance(model) -> dict[str, float]:
    fitted, kept = model
    values = fitted.stages[-1].featureImportances.toArray()
    return {f: float(values[2 * i] + values[2 * i + 1]) for i, f in enumerate(kept)}


def out_of_fold(d: DataFrame, features: list[str], cfg: Model = Model(), kind: str = "gbt") -> DataFrame:
    """``p``: every row is scored by a model that saw no pair of its entity's fold."""
    d, out = d.withColumn("_fold", fold(F.col("s1_id"), cfg.folds)), None
    for k in range(cfg.folds):
        part = predict(fit(d.filter(F.col("_fold") != k), features, cfg, kind, cfg.seed + k), d.filter(F.col("_fold") == k))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def calibrate(d: DataFrame, p: str = "p"):
    """Isotonic regression of the label on the score; ``apply_calibration`` uses it."""
    return IsotonicRegression(featuresCol="_v", labelCol="y", weightCol="_w").fit(VectorAssembler(inputCols=[p], outputCol="_v").transform(d.withColumn("y", F.col("y").cast("double")).withColumn("_w", F.lit(1.0))))


def apply_calibration(model, d: DataFrame, p: str = "p") -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=[p], outputCol="_v").transform(d))
    return out.withColumn(p, F.col("prediction")).drop("_v", "prediction")


def compare(d: DataFrame, features: list[str], valid: DataFrame, cfg: Model = Model(), kinds=("logistic", "forest", "gbt")) -> DataFrame:
    """(kind, auc, ap, log_loss, f1) of learners fitted on ``d`` and scored on ``valid``."""
    from .metrics import auc, average_precision, best_f1

    out = None
    for kind in kinds:
        p = predict(fit(d, features, cfg, kind), valid).select("p", "y")
        q = F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
        loss = p.agg(F.round(F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))), 9).alias("log_loss"))
        row = auc(p).crossJoin(average_precision(p)).crossJoin(loss).crossJoin(best_f1(p).select("f1")).select(F.lit(kind).alias("kind"), "auc", "ap", "log_loss", "f1")
        out = row if out is None else out.union(row)
    return out


def blend(d: DataFrame, labelled: list[str], base: str, unlabelled: str, weight: float = 1.0) -> DataFrame:
    """``p``: the base score where the country has labels, else the weighted mixture."""
    mixed = F.lit(weight) * F.col(unlabelled) + F.lit(1 - weight) * F.col(base)
    return d.withColumn("p", F.when(F.col("country").isin(*labelled), F.col(base)).otherwise(mixed))
