"""From probabilities to lists: one owner a record, the prefix of the best expected F0.5, the missing source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import grown, save


def owner(d: DataFrame, p: str = "p") -> DataFrame:
    """The best claim of each record: highest p, then blocking rank, then s1_id."""
    order = [F.desc(p), *(["rank"] if "rank" in d.columns else []), "s1_id"]
    return d.withColumn("_k", F.row_number().over(Window.partitionBy("c_id").orderBy(*order))).filter("_k = 1").drop("_k")


def select(d: DataFrame, p: str = "p", min_prob: float = 0.0) -> DataFrame:
    """``selected``: the entity's prefix (by p, ties by c_id) of the highest expected F0.5, if that beats an empty list."""
    e = Window.partitionBy("s1_id")
    run = e.orderBy(F.desc(p), "c_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_k", F.row_number().over(e.orderBy(F.desc(p), "c_id"))).withColumn("_top", F.sum(p).over(run))
    d = d.withColumn("_sum", F.sum(p).over(e)).withColumn("_empty", F.exp(F.sum(F.log1p(-F.least(F.col(p), F.lit(1 - 1e-7)))).over(e)))
    d = d.withColumn("_ef", F.round(1.25 * F.col("_top") / (F.col("_k") + 0.25 * F.col("_sum")), 12))
    best = F.max(F.struct("_ef", (-F.col("_k")).alias("k"))).over(e)
    d = d.withColumn("_best", best)
    chosen = (F.col("_best._ef") > F.col("_empty")) & (F.col("_k") <= -F.col("_best.k")) & (F.col(p) >= min_prob)
    return d.withColumn("selected", chosen).drop("_k", "_top", "_sum", "_empty", "_ef", "_best")


def threshold(d: DataFrame, least: float, p: str = "p") -> DataFrame:
    return d.withColumn("selected", F.col(p) >= least)


def fill(d: DataFrame, p: str = "p", least: float = 0.5) -> DataFrame:
    """Entities whose list has one source only get their best free record (p >= ``least``) of the other one.

    ``d`` (s1_id, c_id, p, selected, any further columns); a record goes to its best entity, an entity takes one record."""
    s3 = F.col("c_id").startswith("S3").cast("int")
    lists = d.filter("selected").groupBy("s1_id").agg(F.min(s3).alias("lo"), F.max(s3).alias("hi")).filter("lo = hi").select("s1_id", F.col("lo").alias("has"))
    free = d.join(grown(d.filter("selected").select("c_id").distinct()), "c_id", "left_anti").filter(F.col(p) >= least).join(grown(lists), "s1_id").filter(s3 != F.col("has"))
    per_record = free.withColumn("_k", F.row_number().over(Window.partitionBy("c_id").orderBy(F.desc(p), "s1_id"))).filter("_k = 1")
    per_entity = per_record.withColumn("_k", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(p), "c_id"))).filter("_k = 1")
    added = per_entity.select("s1_id", "c_id", F.lit(True).alias("_add"))
    return d.join(grown(added), ["s1_id", "c_id"], "left").withColumn("selected", F.col("selected") | F.coalesce("_add", F.lit(False))).drop("_add")


def decide(d: DataFrame, p: str = "p", min_prob: float = 0.0, fill_min_prob: float = 0.5) -> DataFrame:
    """All pairs with ``selected``: owner, then prefix, then (unless 0) the missing source."""
    d = save(d, "claims")  # read by several branches below
    chosen = select(owner(d, p), p, min_prob).select("s1_id", "c_id", "selected")
    out = d.join(grown(chosen), ["s1_id", "c_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return fill(save(out, "lists"), p, fill_min_prob) if fill_min_prob else out
