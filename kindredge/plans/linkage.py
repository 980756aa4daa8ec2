"""The linkage run: normalise, block, compare, score, decide, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import blocking, decide, features, metrics, model, normalize
from .store import grown


def prepared(records: DataFrame, lexicon=None, cfg: Config = Config()) -> DataFrame:
    return normalize.finalize(normalize.base(records, cfg.normalise.max_numbers), lexicon, cfg.normalise.pseudo_min_len)


def rule_score(d: DataFrame) -> DataFrame:
    """A deterministic score where no model is trained: votes, house number and exact name."""
    p = 0.45 * F.col("rel") + 0.35 * F.coalesce("num_p_in", F.lit(0.3)) + 0.2 * F.col("nm_exact")
    return d.withColumn("p", F.round(F.least(p, F.lit(0.99)), 9))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(grown(truth.select("s1_id", "c_id", F.lit(1).alias("y"))), ["s1_id", "c_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


STAGE1 = ["num_p_in", "num_p_first", "num_frac1", "num_frac2", "num_logdiff", "num_drop", "num_del_any", "num_long", "n_nums1", "n_nums2", "nm_idf_cov1", "nm_idf_cov2", "nm_idf_rare", "ad_idf_cov1", "ad_idf_cov2", "ad_idf_rare", "loc_overlap",
          "c_f_alias", "c_f_url", "c_f_junk", "c_f_script", "c_f_empty_addr", "c_f_pseudo", "tok_diff", "n_tok1", "c_s3", "votes", "nm_exact", "s1_name_n", "c_name_n", "nm_tset", "nm_tsort", "nm_ratio_ns", "nm_partial_ns", "nm_jw", "ad_tset", "ad_tsort"]
RIVALS = ["p1", "e_rank", "e_n", "e_sum", "e_sib", "e_max", "e_rel", "e_margin", "c_rank", "c_n", "c_max", "c_margin", "coh_p", "coh_num", "coh_nm", "coh_ad"]


def rivalry(d: DataFrame, cand: DataFrame, p: str, prefix: str = "") -> DataFrame:
    """``d`` with competition and coherence features of the scores ``p``, their names led by ``prefix``."""
    made = [c for c in RIVALS if c != "p1"]
    had = [c for c in made if c in d.columns]  # an earlier stage's, put aside
    out = d.withColumnsRenamed({c: f"_{c}" for c in had})
    out = features.coherence(features.competition(features.look_alike(out), p), cand, p).drop("anchor_id")
    return out.withColumnsRenamed({c: prefix + c for c in made}).withColumnsRenamed({f"_{c}": c for c in had})


def three_stages(pairs: DataFrame, cand: DataFrame, cfg: Config = Config(), save=lambda d, name: d, extra: DataFrame | None = None, extra_cand: DataFrame | None = None,
                 roles: tuple[str, ...] = ("TRAIN",), path: str | None = None) -> DataFrame:
    """Scores p1, p2, p of all ``pairs`` (labelled, with all features): pairwise evidence, then rivals read from p1, then rivals
    read again from p2 (``cfg.model.stages`` of them).

    Pairs of entities of ``roles`` train; they are scored out of fold, all others by the model of all of them. ``extra`` is
    a further block of labelled pairs (synthetic, pseudo-labelled) with its records ``extra_cand``; it trains only. With
    ``path``, every stage's model is written there. ``save`` (DataFrame, name) -> DataFrame cuts the lineage by a table."""
    learn = model.role(F.col("s1_id"), cfg.split).isin(*roles)
    d = pairs.withColumn("_real", F.lit(True)).withColumn("_learn", learn)
    everyone = cand
    if extra is not None:
        d = d.unionByName(extra.withColumn("_real", F.lit(False)).withColumn("_learn", F.lit(True)), allowMissingColumns=True)
        everyone = cand.unionByName(extra_cand, allowMissingColumns=True)
    names, had = list(STAGE1), None
    for stage in range(1, cfg.model.stages + 1):
        fitted = model.fit(d.filter("_learn"), names, cfg.model, seed=cfg.model.seed + 100 * stage)
        if path:
            model.save_model(fitted, f"{path}/stage{stage}")
        seen = model.out_of_fold(d.filter("_learn"), names, cfg.model)
        out = f"p{stage}"
        d = save(seen.unionByName(model.predict(fitted, d.filter("not _learn"))).withColumnRenamed("p", out), f"stage{stage}")
        if stage < cfg.model.stages:
            prefix = "" if stage == 1 else "s3_"
            d = save(rivalry(d.drop("sib"), everyone, out, prefix), f"rivals{stage}")
            names = names + ([out] if stage == 1 else []) + [prefix + x for x in RIVALS if x != "p1"]
        had = out
    return d.filter("_real").withColumn("p", F.col(had)).drop("_real", "_learn")


def routed(base: DataFrame, other: DataFrame | None, labelled: list[str], weight: float) -> DataFrame:
    """Scores of two model sets over the same pairs, by country: labelled ones have the first's, the rest the mixture."""
    if other is None or weight == 0:
        return base
    both = base.withColumnRenamed("p", "p_base").join(grown(other.select("s1_id", "c_id", F.col("p").alias("p_other"))), ["s1_id", "c_id"])
    return model.blend(both, labelled, "p_base", "p_other", weight).drop("p_base", "p_other")


def two_stages(pairs: DataFrame, cand: DataFrame, cfg: Config = Config(), save=lambda d, name: d) -> DataFrame:
    """Out-of-fold scores, rival features from them, a second out-of-fold model on both, isotonic calibration.

    ``save`` (DataFrame, name) -> DataFrame writes a stage and reads it back, so that each starts from a table."""
    d = save(features.look_alike(model.out_of_fold(pairs, STAGE1, cfg.model)), "stage1").withColumnRenamed("p", "p1")
    d = features.coherence(features.competition(d, "p1"), cand, "p1").drop("anchor_id")
    d = save(model.out_of_fold(save(d, "rivals"), STAGE1 + RIVALS, cfg.model), "stage2")
    return model.apply_calibration(model.calibrate(d), d)


def rule_based(s1: DataFrame, cand: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Decided candidate pairs of the run without a trained model."""
    one, two = prepared(s1, cfg=cfg), prepared(cand, cfg=cfg)
    pairs = blocking.generate(one, two, cfg.blocking)
    scored = rule_score(features.pair_features(pairs, one, two, scores=False))
    return decide.decide(scored, "p", cfg.decide.min_prob, cfg.decide.fill_min_prob)


def evaluate(decided: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    return metrics.per_entity(decided.filter("selected"), truth, s1.select(F.col("entity_id").alias("s1_id")))


def tuned_floor(scored: DataFrame, truth: DataFrame, s1: DataFrame, split=None, grid=(0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)) -> DataFrame:
    """(floor, f): the floor of the highest macro F0.5 over the VALID entities, the lowest on ties. Keep it for the decision.

    Records find their owner among all entities, as in the decision; only what is measured is confined to VALID ones."""
    only = s1.filter(model.role(F.col("entity_id"), split or Config().split) == "VALID")
    return grid_floor(scored, truth, only, grid).orderBy(F.desc("f"), "floor").limit(1)


def described(per: DataFrame, s1: DataFrame, pairs: DataFrame, truth: DataFrame, cand: DataFrame) -> DataFrame:
    """``per`` (an entity a row) with what its slices are: country, singleton, look-alike among the candidates (``pairs``: s1_id,
    y, alike), unusual name or empty address among the true records (flags of ``cand``), number of candidates."""
    flags = cand.select(F.col("entity_id").alias("c_id"), (F.col("f_pseudo") | F.col("f_alias") | F.col("f_url") | F.col("f_script")).alias("odd"), F.col("f_empty_addr").alias("bare"))
    own = truth.join(grown(flags), "c_id").groupBy("s1_id").agg(F.max("odd").alias("unusual_name"), F.max("bare").alias("empty_address"))
    near = pairs.groupBy("s1_id").agg(F.max((F.col("y") == 0) & (F.col("alike") == 1)).alias("look_alike"), F.count("*").alias("n"))
    d = per.join(grown(s1.select(F.col("entity_id").alias("s1_id"), "country")), "s1_id").join(grown(own), "s1_id", "left").join(grown(near), "s1_id", "left")
    n = F.coalesce("n", F.lit(0))
    some = F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 10, "7-10").when(n <= 20, "11-20").otherwise(">20")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return d.select(*per.columns, "country", (F.col("n_gt") == 0).alias("singleton"), no("look_alike"), no("unusual_name"), no("empty_address"), some.alias("candidates"))


SLICES = ["country", "singleton", "look_alike", "unusual_name", "empty_address", "candidates"]


def best_cut(d: DataFrame, cuts: dict[str, object], truth: DataFrame, entities: DataFrame) -> str:
    """The name of the cut (name -> condition on ``d``) with the highest macro F0.5 over ``entities``, the first on ties."""
    best, top = "", -1.0
    for name, cut in cuts.items():
        f = metrics.summary(metrics.per_entity(d.filter(cut), truth, entities)).first().f or 0.0
        if f > top:
            best, top = name, f
    return best


def systems(d: DataFrame, truth: DataFrame, s1: DataFrame, cand: DataFrame, cfg: Config = Config(), role: str = "VALID", floor: float = 0.0) -> DataFrame:
    """(system, slice, value, entities, f, …): a fuzzy rule, the first stage by threshold and by lists, the second by threshold, and
    the last stage with lists and fill, over the entities of ``role``. Cuts are chosen on TRAIN entities alone.

    ``d``: pairs with p1, p2, p, y, rank and features."""
    who = s1.select(F.col("entity_id").alias("s1_id"), model.role(F.col("entity_id"), cfg.split).alias("role"))
    train, held = (who.filter(F.col("role") == x).select("s1_id") for x in ("TRAIN", role))
    known = lambda x: truth.join(grown(x), "s1_id", "left_semi")
    own = d.join(grown(train), "s1_id", "left_semi")
    rules = {f"name>={a} address>={b}": (F.col("nm_tset") >= a) & (F.col("ad_tset") >= b) for a in (70, 80, 90) for b in (60, 80)}
    cuts = {f"p1>={t}": F.col("p1") >= t for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)}
    b0, b1 = best_cut(own, rules, known(train), train), best_cut(own, cuts, known(train), train)
    here = d.join(grown(held), "s1_id", "left_semi")
    chosen = {f"B0 rule {b0}": here.filter(rules[b0]), f"B1 first stage {b1}": here.filter(cuts[b1]), "B2 first stage, lists": decide.decide(here, "p1", 0.0, 0.0).filter("selected"),
              "B3 second stage p2>=0.5": here.filter("p2 >= 0.5"), "FINAL last stage, lists and fill": decide.decide(here, "p", floor, cfg.decide.fill_min_prob).filter("selected")}
    alike = here.select("s1_id", "y", (F.col("nm_tset") >= 90).cast("int").alias("alike"))
    out = None
    for name, picked in chosen.items():
        per = described(metrics.per_entity(picked, known(held), held), s1, alike, truth, cand)
        row = metrics.slices(per, SLICES).select(F.lit(name).alias("system"), "*")
        out = row if out is None else out.union(row)
    return out


def grid_floor(scored: DataFrame, truth: DataFrame, s1: DataFrame, grid=(0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """(floor, f): macro F0.5 over ``s1`` of the owner-and-prefix decision over all of ``scored``, for each floor; the prefix is found
    once for all floors."""
    kept = decide.select(decide.owner(scored)).filter("selected").select("s1_id", "c_id", "p")
    hit = labelled(kept, truth).withColumn("floor", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).filter(F.col("p") >= F.col("floor"))
    got = hit.groupBy("floor", "s1_id").agg(F.sum("y").alias("tp"), F.count("*").alias("n_pred"))
    gt = s1.select(F.col("entity_id").alias("s1_id")).join(grown(truth.groupBy("s1_id").agg(F.count("*").alias("n_gt"))), "s1_id", "left").na.fill(0)
    every = gt.withColumn("floor", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    d = every.join(grown(got), ["floor", "s1_id"], "left").na.fill(0)
    f = F.when((F.col("n_pred") == 0) & (F.col("n_gt") == 0), 1.0).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_gt")))
    return d.groupBy("floor").agg(F.round(F.avg(f), 9).alias("f"))
