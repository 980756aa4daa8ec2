"""Entity-level F0.5 and its slices, pair-level reports, ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import grown


def per_entity(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, tp, n_pred, n_gt, f, precision, recall) for every entity; an empty list for no truth scores 1."""
    n = lambda d, name: grown(d.groupBy("s1_id").agg(F.count("*").alias(name)))
    pred, gt = (d.select("s1_id", "c_id").distinct() for d in (predicted, truth))
    d = entities.select("s1_id").join(n(pred.join(grown(gt), ["s1_id", "c_id"], "left_semi"), "tp"), "s1_id", "left").join(n(pred, "n_pred"), "s1_id", "left").join(n(gt, "n_gt"), "s1_id", "left").na.fill(0)
    both = (F.col("n_pred") == 0) & (F.col("n_gt") == 0)
    f = F.when(both, 1.0).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_gt")))
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).when(both, 1.0)
    return d.select("s1_id", "tp", "n_pred", "n_gt", F.round(f, 9).alias("f"), F.round(precision, 9).alias("precision"), F.when(F.col("n_gt") > 0, F.round(F.col("tp") / F.col("n_gt"), 9)).alias("recall"))


def _summary():
    return [F.count("*").alias("entities"), F.round(F.avg("f"), 9).alias("f"), F.round(F.avg("precision"), 9).alias("precision"), F.round(F.avg("recall"), 9).alias("recall"),
            F.round(F.avg(F.when(F.col("n_gt") == 0, (F.col("n_pred") > 0).cast("int"))), 9).alias("singleton_fp"), F.round(F.avg((F.col("n_pred") > 0).cast("int")), 9).alias("coverage"),
            F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt")]


def summary(d: DataFrame) -> DataFrame:
    return d.agg(*_summary())


def slices(d: DataFrame, columns: list[str]) -> DataFrame:
    """A summary of all entities and of each value of each column, in one pass; of booleans only the true side."""
    parts = [F.struct(F.lit("ALL").alias("slice"), F.lit("").alias("value"))]
    for c in columns:
        yes = F.col(c) if dict(d.dtypes)[c] == "boolean" else F.lit(True)
        parts.append(F.when(yes, F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value"))))
    return d.withColumn("s", F.explode(F.array(*parts))).filter("s is not null").groupBy("s.slice", "s.value").agg(*_summary())


def _by_score(d: DataFrame, p: str, y: str) -> DataFrame:
    """Counts of both labels at each distinct score: global windows then run over these alone."""
    return d.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))


def auc(d: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve; ties count half. NULL without both labels."""
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    c = _by_score(d, p, y).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    return c.agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0)), 9).alias("auc"))


def average_precision(d: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Step-wise: precision at each score (all pairs of the score at once), weighted by the positives there."""
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    c = _by_score(d, p, y).withColumn("tp", F.sum("pos").over(w)).withColumn("all", F.sum(F.col("pos") + F.col("neg")).over(w))
    return c.agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.nullif(F.sum("pos"), F.lit(0.0)), 9).alias("ap"))


def _scores(tp, fp, fn) -> list:
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 9)
    return [share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(1.25 * tp, 1.25 * tp + fp + 0.25 * fn).alias("f05")]


def pair_report(d: DataFrame, missed: DataFrame) -> DataFrame:
    """``d`` (selected, y) over candidate pairs and ``missed`` (n) true pairs that blocking lost."""
    n = lambda c: F.sum(c.cast("long"))
    yes, sel = F.col("y") == 1, F.col("selected")
    c = d.agg(n(sel & yes).alias("tp"), n(sel & ~yes).alias("fp"), n(~sel & yes).alias("fn_candidates"), n(~sel & ~yes).alias("tn")).crossJoin(missed.select(F.col("n").alias("fn_blocking")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn_candidates") + F.col("fn_blocking")
    return c.select("*", F.round((tp + F.col("tn")) / (tp + F.col("tn") + fp + fn), 9).alias("accuracy"), *_scores(tp, fp, fn))


def threshold_table(d: DataFrame, total: DataFrame, grid=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), p: str = "p") -> DataFrame:
    """Pair scores at each threshold, in one pass; ``total`` (n) counts the true pairs."""
    at = d.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid]))).filter(F.col(p) >= F.col("threshold"))
    c = at.groupBy("threshold").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp")).crossJoin(total)
    return c.select("threshold", "tp", "fp", *_scores(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp")))


def best_f1(d: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """The threshold of the highest F1 (the highest threshold on ties)."""
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    c = _by_score(d, p, y).withColumn("tp", F.sum("pos").over(w)).withColumn("all", F.sum(F.col("pos") + F.col("neg")).over(w)).crossJoin(d.agg(F.sum(y).alias("total")))
    return c.agg(F.max(F.struct(F.round(2 * F.col("tp") / (F.col("all") + F.col("total")), 9).alias("f1"), F.col("p").alias("threshold"))).alias("b")).select("b.threshold", "b.f1")
