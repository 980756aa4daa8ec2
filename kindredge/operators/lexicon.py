"""Lexicon learning by co-occurrence: canonical components, transliteration, localities, vocabulary."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Normalise
from ..functions import text as T
from ..plans.store import grown
from .normalize import core_tokens


@dataclass
class Lexicon:
    """Learned maps that travel with a plan. Transliteration, components and localities hold what passed a support threshold;
    the vocabulary, used for closed-up names alone, the ``VOCABULARY`` most frequent name words."""

    translit: dict[str, str] = field(default_factory=dict)
    components: dict[str, str] = field(default_factory=dict)
    localities: list[str] = field(default_factory=list)
    vocab: list[str] = field(default_factory=list)

    def vocab_set(self) -> frozenset[str]:
        return frozenset(w for w in self.vocab if len(w) >= 2) | frozenset(T.LEGAL) if self.vocab else frozenset()

    def text(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.text())

    @classmethod
    def load(cls, path: str) -> "Lexicon":
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))


def keyed_components(d: DataFrame, key: str = "entity_id") -> DataFrame:
    """Distinct (key, 'country|component')."""
    return d.select(key, F.explode(F.transform("addr_comps", lambda x: F.concat_ws("|", "country", x))).alias("comp")).distinct()


def component_pairs(s1: DataFrame, cand: DataFrame, pairs: DataFrame) -> DataFrame:
    """(comp2, comp1, n, f1, f2): how many true pairs have comp2 on the candidate's and comp1 on the entity's side."""
    one = pairs.join(grown(keyed_components(s1).withColumnsRenamed({"entity_id": "s1_id", "comp": "comp1"})), "s1_id").select("s1_id", "c_id", "comp1")
    two = pairs.join(grown(keyed_components(cand).withColumnsRenamed({"entity_id": "c_id", "comp": "comp2"})), "c_id").select("s1_id", "c_id", "comp2")
    n = one.join(grown(two), ["s1_id", "c_id"]).groupBy("comp2", "comp1").agg(F.count("*").alias("n"))
    f1 = one.groupBy("comp1").agg(F.count("*").alias("f1"))
    f2 = two.groupBy("comp2").agg(F.count("*").alias("f2"))
    return n.join(grown(f1), "comp1").join(grown(f2), "comp2")


def learn_components(s1: DataFrame, cand: DataFrame, pairs: DataFrame, cfg: Normalise = Normalise()) -> DataFrame:
    """(comp2, comp1, n, share, cosine): a candidate-side variant and its canonical component.

    Per variant the component of the highest cosine (then the smallest name); accepted by share, support, and where the
    variant is rare among source-1 records next to the candidates."""
    c = component_pairs(s1, cand, pairs).filter("comp1 <> comp2").filter(~F.col("comp2").rlike("[0-9]"))
    c = c.withColumn("share", F.col("n") / F.col("f2")).withColumn("cosine", F.col("n") * F.col("n") / (F.col("f1") * F.col("f2")))
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("comp2").orderBy(F.desc("cosine"), "comp1"))).filter("k = 1")
    rate = lambda d, name: keyed_components(d).groupBy(F.col("comp").alias("comp2")).agg(F.count("*").alias(name))
    n1, n2 = (d.agg(F.count("*").alias(x)) for d, x in ((s1, "n1"), (cand, "n2")))
    best = best.join(rate(s1, "r1"), "comp2", "left").join(rate(cand, "r2"), "comp2", "left").crossJoin(n1).crossJoin(n2)
    foreign = F.coalesce("r1", F.lit(0)) / F.col("n1") / (F.col("r2") / F.col("n2"))
    return best.filter((F.col("share") >= cfg.component_min_share) & (F.col("f2") >= cfg.component_min_count) & (foreign <= cfg.foreign_max_ratio)).select("comp2", "comp1", "n", "share", "cosine")


def learn_translit(s1: DataFrame, cand: DataFrame, pairs: DataFrame, cfg: Normalise = Normalise()) -> DataFrame:
    """(native, latin, n, share): native-script tokens aligned by place with the entity's tokens, the most frequent kept."""
    two = cand.filter("f_script").select(F.col("entity_id").alias("c_id"), F.col("name_tokens").alias("t2"))
    one = s1.select(F.col("entity_id").alias("s1_id"), F.col("name_tokens").alias("t1"))
    z = pairs.join(grown(two), "c_id").join(grown(one), "s1_id").filter(F.size("t1") == F.size("t2")).select(F.explode(F.arrays_zip("t1", "t2")).alias("z"))
    z = z.select(F.col("z.t2").alias("native"), F.col("z.t1").alias("latin")).filter(F.col("native").rlike(T.SCRIPT) & F.col("latin").rlike("^[a-z]+$"))
    n = z.groupBy("native", "latin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("native")
    n = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "latin")))
    return n.filter((F.col("k") == 1) & (F.col("n") >= cfg.translit_min_count) & (F.col("share") >= cfg.translit_min_share)).drop("k")


def pseudo_pairs(s1: DataFrame, cand: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs without labels: same country and core name, and the entity's first number among the candidate's first three.

    The entity's (country, name, number) must be unique. With ``limit``, those of the smallest hashes."""
    name = F.array_join(core_tokens(F.col("name_tokens")), " ")
    one = s1.select(F.col("entity_id").alias("s1_id"), "country", name.alias("core"), F.get("nums", F.lit(0)).alias("num")).filter("num is not null")
    once = one.groupBy("country", "core", "num").agg(F.min("s1_id").alias("s1_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    two = cand.select(F.col("entity_id").alias("c_id"), "country", name.alias("core"), F.explode(F.slice("nums", 1, 3)).alias("num"))
    out = once.join(grown(two), ["country", "core", "num"]).select("s1_id", "c_id").distinct()
    return out if limit is None else out.orderBy(F.md5(F.concat_ws("|", "s1_id", "c_id")), "s1_id", "c_id").limit(limit)


def localities(s1: DataFrame, min_share: float = Normalise.locality_min_share) -> DataFrame:
    """(comp, n, share): components found in at least a share of their country's records."""
    comps = keyed_components(s1).groupBy("comp").agg(F.count("*").alias("n")).withColumn("country", F.substring_index("comp", "|", 1))
    return comps.join(s1.groupBy("country").agg(F.count("*").alias("total")), "country").withColumn("share", F.col("n") / F.col("total")).filter(
        (F.col("share") >= min_share) & ~F.col("comp").rlike("[0-9]")).select("comp", "n", "share")


def vocabulary(*tables: DataFrame) -> DataFrame:
    """Distinct name tokens of several base tables."""
    out = None
    for d in tables:
        part = d.select(F.explode("name_tokens").alias("token"))
        out = part if out is None else out.union(part)
    return out.distinct()


def _frequent_words(d: DataFrame, most: int) -> DataFrame:
    counts = d.select(F.explode("name_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(most).select("token")


#: Words of source-1 names that closed-up names are cut into, the most frequent ones: what bounds the part that is collected.
VOCABULARY = 200_000


def fit(s1: DataFrame, cand: DataFrame, pairs: DataFrame, cfg: Normalise = Normalise(), words: int = VOCABULARY) -> Lexicon:
    """Learn everything from base tables and known pairs; what is collected has passed its support threshold, or is bounded
    by ``words``."""
    take = lambda d, a, b: {r[a]: r[b] for r in d.select(a, b).collect()}
    comps = {k: v for k, v in take(learn_components(s1, cand, pairs, cfg), "comp2", "comp1").items()}
    return Lexicon(take(learn_translit(s1, cand, pairs, cfg), "native", "latin"), comps, sorted(r.comp for r in localities(s1, cfg.locality_min_share).collect()), sorted(r.token for r in _frequent_words(s1, words).collect()))
