"""Command line: python -m kindredge COMMAND --data ROOT --work DIR [--config FILE].

  prepare   normalise both splits, learn the lexicon from pairs of TRAIN entities
  block     candidate pairs of both splits, recall and cost of the blocking
  train     pair features, stages of the model on TRAIN entities
  validate  the decision floor of the VALID entities, systems and slices on them
  test      the same systems on TEST entities, with the floor that validation chose
  predict   lists of matched and candidate records of the test split
  all       these in turn

Every step writes its tables under DIR and reads those of the steps before; DIR/timings has the seconds of each.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import blocking, decide, features, lexicon, metrics, model, normalize
from .plans import linkage
from .sources import records


class Steps:
    def __init__(self, spark: SparkSession, data: str, work: str, cfg: config.Config):
        self.spark, self.data, self.work, self.cfg = spark, data, work, cfg

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.work}/{name}")

    def put(self, d: DataFrame, name: str) -> DataFrame:
        records.write_table(d, f"{self.work}/{name}")
        return self.table(name)

    def truth(self) -> DataFrame:
        return records.read_truth(self.spark, f"{self.data}/train/train_ground_truth.tsv")

    def prepare(self) -> None:
        base = {}
        for split in ("train", "test"):
            base[split] = [self.put(normalize.base(d, self.cfg.normalise.max_numbers), f"base/{split}{n}") for n, d in enumerate(records.load_split(self.spark, self.data, split))]
        learn = self.truth().filter(model.role(F.col("s1_id"), self.cfg.split) == "TRAIN")
        lex = lexicon.fit(*base["train"], learn, self.cfg.normalise)
        self.spark.createDataFrame([(lex.text(),)], "lexicon string").coalesce(1).write.mode("overwrite").text(f"{self.work}/lexicon")
        for split, parts in base.items():
            for n, d in enumerate(parts):
                self.put(normalize.finalize(d, lex, self.cfg.normalise.pseudo_min_len), f"final/{split}{n}")

    def final(self, split: str) -> tuple[DataFrame, DataFrame]:
        return self.table(f"final/{split}0"), self.table(f"final/{split}1")

    def block(self) -> None:
        for split in ("train", "test"):
            self.put(blocking.generate(*self.final(split), self.cfg.blocking), f"pairs/{split}")
        pairs, truth = self.table("pairs/train"), self.truth()
        records.write_report(blocking.recall_curve(pairs, truth), f"{self.work}/reports/recall")
        records.write_report(blocking.reduction(pairs, *self.final("train")), f"{self.work}/reports/reduction", "json")

    def train(self) -> None:
        for split in ("train", "test"):
            self.put(features.pair_features(self.table(f"pairs/{split}"), *self.final(split)), f"features/{split}")
        d = linkage.labelled(self.table("features/train"), self.truth())
        self.put(linkage.three_stages(d, self.final("train")[1], self.cfg, self.put, path=f"{self.work}/models"), "scores/train")

    def _systems(self, role: str, floor: float) -> None:
        s1, cand = self.final("train")
        d = linkage.systems(self.table("scores/train"), self.truth(), s1, cand, self.cfg, role, floor)
        records.write_report(d, f"{self.work}/reports/systems_{role.lower()}")

    def validate(self) -> None:
        s1, scored = self.final("train")[0], self.table("scores/train")
        best = linkage.tuned_floor(scored, self.truth(), s1, self.cfg.split)
        records.write_report(best, f"{self.work}/decision", "json")
        self._systems("VALID", self.floor())
        total = self.truth().agg(F.count("*").alias("n"))
        records.write_report(metrics.threshold_table(scored, total), f"{self.work}/reports/thresholds")

    def floor(self) -> float:
        return self.spark.read.json(f"{self.work}/decision").first().floor

    def test(self) -> None:
        self._systems("TEST", self.floor())

    def predict(self) -> None:
        s1, cand = self.final("test")
        d = self.table("features/test")
        for stage in range(1, self.cfg.model.stages + 1):
            out = f"p{stage}"
            d = self.put(model.predict(model.load_model(f"{self.work}/models/stage{stage}"), d, out), f"scores/test{stage}")
            if stage < self.cfg.model.stages:
                d = linkage.rivalry(d.drop("sib"), cand, out, "" if stage == 1 else "s3_")
        decided = self.put(decide.decide(d.withColumn("p", F.col(out)), "p", self.floor(), self.cfg.decide.fill_min_prob), "decided")
        records.write_lists(records.match_lists(s1, decided.filter("selected")), f"{self.work}/output/matched")
        records.write_lists(records.match_lists(s1, decided, "candidate_entity_ids"), f"{self.work}/output/candidates")


ALL = ["prepare", "block", "train", "validate", "test", "predict"]


def run(spark: SparkSession, command: str, data: str, work: str, cfg: config.Config = config.Config()) -> dict[str, float]:
    """Run one step or all; returns and writes the seconds of each."""
    steps, took = Steps(spark, data, work, cfg), {}
    for name in ALL if command == "all" else [command]:
        began = time.perf_counter()
        getattr(steps, name)()
        took[name] = round(time.perf_counter() - began, 1)
    records.write_report(spark.createDataFrame(list(took.items()), "step string, seconds double"), f"{work}/timings/{command}")
    return took


def main() -> None:
    ap = argparse.ArgumentParser(prog="kindredge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("command", choices=[*ALL, "all"])
    ap.add_argument("--data", required=True)
    ap.add_argument("--work", required=True)
    ap.add_argument("--config")
    a = ap.parse_args()
    spark = SparkSession.builder.appName("kindredge").getOrCreate()
    print(run(spark, a.command, a.data, a.work, config.load(a.config) if a.config else config.Config()))


if __name__ == "__main__":
    main()
