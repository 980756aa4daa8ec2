"""Queries of the library's own operators on records derived from the star schema, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from . import oracle
from .config import Config, Model, Normalise
from .functions import similarity as S
from .functions import text as T
from .operators import blocking, decide, evidence, features, lexicon, metrics, model, normalize, synth
from .plans import linkage
from .plans.store import grown, save
from .sources import records

CFG = Config()


class Run:
    """One linkage run over derived records. Steps that several others read are written once and shared."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def records(self):
        return records.derived(self.spark, self.sf)

    @cached_property
    def base(self):
        s1, cand = self.records
        return normalize.base(s1.drop("num")), normalize.base(cand.drop("origin_id", "is_decoy", "noise_op"))

    @cached_property
    def final(self):
        return tuple(save(normalize.finalize(d), "final") for d in self.base)

    @cached_property
    def truth(self):
        return self.records[1].filter("not is_decoy").select(F.col("origin_id").alias("s1_id"), F.col("entity_id").alias("c_id"))

    @cached_property
    def entities(self):
        return self.records[0].select(F.col("entity_id").alias("s1_id"))

    @cached_property
    def keys(self):
        one, two = self.final
        return blocking.keys(one, CFG.blocking, True), blocking.keys(two, CFG.blocking)

    @cached_property
    def votes(self):
        return blocking.votes(*self.keys, CFG.blocking.key_cap)

    @cached_property
    def pairs(self):
        return save(blocking.generate(*self.final, CFG.blocking), "pairs")

    def features(self, scores=False):
        return features.pair_features(self.pairs, *self.final, scores)

    @cached_property
    def scored(self):
        d = linkage.rule_score(self.features())
        d = d.withColumn("sib", ((F.col("nm_exact") == 1) & (F.col("num_p_in") == 0)).cast("int"))
        return save(linkage.labelled(d, self.truth).select("s1_id", "c_id", "country", "rank", "p", F.coalesce("sib", F.lit(0)).alias("sib"), "nm_exact", "y"), "scored")

    @cached_property
    def decided(self):
        return save(decide.decide(self.scored, "p", 0.0, 0.5), "decided")

    @cached_property
    def selected(self):
        return self.decided.filter("selected")

    @cached_property
    def per_entity(self):
        return metrics.per_entity(self.selected, self.truth, self.entities)

    @cached_property
    def missed(self):
        return self.truth.join(grown(self.pairs), ["s1_id", "c_id"], "left_anti").agg(F.count("*").alias("n"))

    @cached_property
    def train(self):
        """True pairs of training entities only."""
        return self.truth.filter(model.role(F.col("s1_id"), CFG.split) == "TRAIN")

    @cached_property
    def evidence(self):
        return evidence.evidence(self.decided.drop("y"), *self.records, self.truth)

    def trained(self, cfg):
        """All pairs with string scores, labels and the scores of the trained stages."""
        d = save(linkage.labelled(self.features(True), self.truth), "features")
        return save(linkage.three_stages(d, self.final[1], cfg, save), "trained")


def _records(spark, sf):
    return Run(spark, sf).records


def _base(spark, sf):
    return Run(spark, sf).base


def _final(spark, sf):
    return Run(spark, sf).final


def _truth(spark, sf):
    return Run(spark, sf).truth


def _pairs(spark, sf):
    return Run(spark, sf).pairs


def _scored(spark, sf):
    return Run(spark, sf).scored


def _decided(spark, sf):
    return Run(spark, sf).decided


def er_source1(spark, sf):
    return _records(spark, sf)[0].drop("num")


def er_candidates(spark, sf):
    return _records(spark, sf)[1]


def er_norm(spark, sf):
    one, two = _base(spark, sf)
    return one.union(two).select("entity_id", "country", F.array_join("name_tokens", " ").alias("name"), F.array_join("addr_comps", "|").alias("comps"), "f_alias", "f_url", "f_junk", "f_empty_addr")


def er_house_numbers(spark, sf):
    one, two = _base(spark, sf)
    return one.union(two).select("entity_id", F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("nums"), "n_nums")


def er_final(spark, sf):
    one, two = _final(spark, sf)
    return one.union(two).select("entity_id", "name_full", "name_core", "name_nospace", "n_name_tok", "addr_norm", "addr_alpha", "f_pseudo")


def er_digit_deletions(spark, sf):
    one, _ = _base(spark, sf)
    return one.select("entity_id", F.array_join(F.transform(T.digit_deletions(F.get("nums", F.lit(0))), lambda x: x.cast("string")), ",").alias("gone")).filter("gone <> ''")


def er_fold_documents(spark, sf):
    """Accents off on real prose: letters kept, marks gone."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


def er_url_hosts(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    host = F.regexp_extract(F.lower("url"), "^https?://([^/?#:]+)", 1)
    return d.select("page_id", host.alias("host"), host.rlike(T.URL).alias("f_url"))


def er_url_segments(spark, sf):
    """Closed-up names cut into vocabulary words (no SQL form: dynamic programming)."""
    one, two = _base(spark, sf)
    lex = lexicon.Lexicon(vocab=sorted(r.token for r in lexicon.vocabulary(one).collect()))
    return normalize.finalize(two.filter("f_url"), lex).select("entity_id", F.array_join("name_tokens", " ").alias("words"), "name_nospace")


def er_vocabulary(spark, sf):
    return lexicon.vocabulary(*_base(spark, sf))


def er_component_pairs(spark, sf):
    r = Run(spark, sf)
    return lexicon.component_pairs(*r.base, r.train)



def er_localities(spark, sf):
    return lexicon.localities(_base(spark, sf)[0]).select("comp", "n", F.round("share", 9).alias("share"))


def er_pseudo_pairs(spark, sf):
    return lexicon.pseudo_pairs(*_base(spark, sf))


def er_block_keys(spark, sf):
    one, two = Run(spark, sf).keys
    return one.union(two)



def er_postings(spark, sf):
    return blocking.postings(Run(spark, sf).keys[0], CFG.blocking.key_cap)



def er_votes(spark, sf):
    return Run(spark, sf).votes



def er_top_candidates(spark, sf):
    return _pairs(spark, sf).select("c_id", "s1_id", "country", "votes", "rank", F.round("rel", 9).alias("rel"))


def er_recall_curve(spark, sf):
    r = Run(spark, sf)
    return blocking.recall_curve(r.pairs, r.truth).withColumn("recall", F.round("recall", 9))



def er_reduction(spark, sf):
    r = Run(spark, sf)
    return blocking.reduction(r.pairs, *r.records).withColumn("reduction", F.round("reduction", 9))



def er_number_features(spark, sf):
    return Run(spark, sf).features().select("s1_id", "c_id", "num_p_in", "num_p_first", F.round("num_frac1", 9).alias("num_frac1"), F.round("num_frac2", 9).alias("num_frac2"), "num_logdiff", "num_drop", "num_del_any", "num_long", "n_nums1", "n_nums2")


def er_rarity(spark, sf):
    return Run(spark, sf).features().select("s1_id", "c_id", *[f"{x}_idf_{y}" for x in ("nm", "ad") for y in ("cov1", "cov2", "rare")])


def er_flag_features(spark, sf):
    return Run(spark, sf).features().select("s1_id", "c_id", "c_f_alias", "c_f_url", "c_f_junk", "c_f_empty_addr", "c_f_pseudo", "tok_diff", "n_tok1", "c_s3", "nm_exact", "s1_name_n", "c_name_n")


def er_jaro_winkler(spark, sf):
    r = Run(spark, sf)
    one, two = r.final
    j = r.pairs.join(grown(one.select(F.col("entity_id").alias("s1_id"), F.col("name_core").alias("a"))), "s1_id").join(grown(two.select(F.col("entity_id").alias("c_id"), F.col("name_core").alias("b"))), "c_id")
    return j.select("s1_id", "c_id", F.round(S.jaro_winkler_of("a", "b"), 6).alias("nm_jw"))



def er_string_scores(spark, sf):
    """The Indel-based scorers (tested against a table-filling version)."""
    return Run(spark, sf).features(True).select("s1_id", "c_id", *[F.round(c, 6).alias(c) for c in ("nm_tset", "nm_tsort", "nm_ratio_ns", "nm_partial_ns", "ad_tset", "ad_tsort")])


def er_competition(spark, sf):
    # shares near a half of the ninth place differ in the last bit between the two engines: six places are compared
    return features.competition(_scored(spark, sf)).drop("country", "rank", "y", "nm_exact").withColumn("e_rel", F.round("e_rel", 6))



def er_coherence(spark, sf):
    r = Run(spark, sf)
    return features.coherence(r.scored, r.final[1], "p", scores=False).select("s1_id", "c_id", "coh_p", "anchor_id", "coh_num")



def er_owner(spark, sf):
    return decide.owner(_scored(spark, sf)).select("s1_id", "c_id", "p")


def er_select(spark, sf):
    return decide.select(decide.owner(_scored(spark, sf))).filter("selected").select("s1_id", "c_id", "p")


def er_decide(spark, sf):
    return _decided(spark, sf).filter("selected").select("s1_id", "c_id", "p")


def er_threshold(spark, sf):
    return decide.threshold(_scored(spark, sf), 0.7).filter("selected").select("s1_id", "c_id", "p")


def er_per_entity(spark, sf):
    return Run(spark, sf).per_entity



def er_slices(spark, sf):
    r = Run(spark, sf)
    alike = r.scored.select("s1_id", "y", F.col("nm_exact").alias("alike"))
    return metrics.slices(linkage.described(r.per_entity, r.records[0], alike, r.truth, r.final[1]), linkage.SLICES)



def er_end_to_end(spark, sf):
    return metrics.summary(Run(spark, sf).per_entity)



def er_oracle_ceiling(spark, sf):
    r = Run(spark, sf)
    return metrics.summary(metrics.per_entity(r.pairs.join(grown(r.truth), ["s1_id", "c_id"], "left_semi"), r.truth, r.entities))



def er_pair_report(spark, sf):
    r = Run(spark, sf)
    return metrics.pair_report(r.decided, r.missed)



def er_threshold_table(spark, sf):
    r = Run(spark, sf)
    return metrics.threshold_table(r.scored, r.truth.agg(F.count("*").alias("n")))



def er_auc(spark, sf):
    d = _scored(spark, sf)
    return metrics.auc(d).crossJoin(metrics.average_precision(d)).crossJoin(metrics.best_f1(d))


def er_grid_floor(spark, sf):
    r = Run(spark, sf)
    return linkage.grid_floor(r.scored, r.truth, r.records[0])


def er_tuned_floor(spark, sf):
    """The floor that the validation entities choose."""
    r = Run(spark, sf)
    return linkage.tuned_floor(r.scored, r.truth, r.records[0], CFG.split)



def er_label_metrics(spark, sf):
    """Ranking quality on the real labels: does length tell quality?"""
    d = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    d = d.select(F.col("n_chars").cast("double").alias("p"), F.col("quality").alias("y"))
    return metrics.auc(d).crossJoin(metrics.average_precision(d))


def er_roles(spark, sf):
    d = _records(spark, sf)[0]
    return d.select("entity_id", model.role(F.col("entity_id"), CFG.split).alias("role"), model.fold(F.col("entity_id"), 2).alias("fold"))


def er_hash_sample(spark, sf):
    """A sampling operator: the limit is the feature."""
    return model.hash_sample(_records(spark, sf)[0].select("entity_id"), "entity_id", 100, "s")


def er_match_lists(spark, sf):
    r = Run(spark, sf)
    return records.match_lists(r.records[0], r.selected)



def er_truth_lists(spark, sf):
    """Comma-joined lists back to pairs."""
    r = Run(spark, sf)
    return records.truth_pairs(records.match_lists(r.records[0], r.truth))



def er_orphans(spark, sf):
    r = Run(spark, sf)
    return r.entities.join(grown(r.pairs), "s1_id", "left_anti")


def er_lonely(spark, sf):
    """Entities without a candidate above the middle of the votes: a left anti join that finds some."""
    r = Run(spark, sf)
    return r.entities.join(grown(r.scored.filter("p >= 0.9")), "s1_id", "left_anti")



def er_evidence(spark, sf):
    d = Run(spark, sf).evidence
    return d.select("s1_id", "s1_name", "c_id", "c_name", "p", "rival_id", "label", evidence.verdict(d).alias("verdict"))


def er_number_diff(spark, sf):
    """Which numbers of an address the record lacks, and the other way round."""
    lost, other = evidence.number_diff(F.col("s1_addr"), F.col("c_addr"))
    return Run(spark, sf).evidence.filter("c_id is not null").select("s1_id", "c_id", F.array_join(lost, ",").alias("lost"), F.array_join(other, ",").alias("other"))


def er_entity(spark, sf):
    """The lookup of one entity: its candidates, the decided ones first."""
    return evidence.entity(Run(spark, sf).evidence, "S1-7").select("s1_id", "s1_addr", "c_id", "c_addr", "p", "selected")



def er_search(spark, sf):
    """Twenty hits at most: the limit is the feature."""
    return evidence.search(Run(spark, sf).evidence, "RED")



def er_density(spark, sf):
    s1, cand = _records(spark, sf)
    return synth.density(cand, s1)


def er_thinned(spark, sf):
    """Decoys kept so that density would rise by a fifth of a record an entity."""
    s1, cand = _records(spark, sf)
    decoys, train = cand.filter("is_decoy"), synth.density(cand.filter("not is_decoy"), s1)
    return synth.thin(decoys, train, train.withColumn("per_entity", F.col("per_entity") + 0.2), synth.density(decoys, s1)).select("entity_id", "country")


def er_surplus(spark, sf):
    """By how many records an entity the whole is denser than its true records."""
    s1, cand = _records(spark, sf)
    return synth.surplus(synth.density(cand.filter("not is_decoy"), s1), synth.density(cand, s1))



def er_pseudo_labels(spark, sf):
    return synth.pseudo_labels(_decided(spark, sf).drop("y"), 0.75, 0.55).select("s1_id", "c_id", "y")


def er_blend(spark, sf):
    d = _scored(spark, sf).withColumn("q", F.col("p") * F.col("p"))
    return model.blend(d.withColumnRenamed("p", "base"), ["ASIA", "EUROPE"], "base", "q", 0.7).select("s1_id", "c_id", F.round("p", 9).alias("p"))


def er_noise_rates(spark, sf):
    s1, cand = _records(spark, sf)
    one = s1.select(F.col("entity_id").alias("origin_id"), F.col("business_name").alias("name1"), F.col("business_address").alias("addr1"))
    return synth.rates(cand.filter("not is_decoy").join(grown(one), "origin_id").select("name1", "addr1", F.col("business_name").alias("name2"), F.col("business_address").alias("addr2")))


def er_synthetic(spark, sf):
    """Seeded noisy records (a generator: no SQL form)."""
    rates = {"reorder": 0.2, "typo": 0.3, "upper_name": 0.1, "url": 0.1, "alias": 0.1, "empty_addr": 0.1, "num_inject": 0.1, "addr_typo": 0.2}
    return synth.generate(_records(spark, sf)[0], synth.Profile(rates=rates))


def er_best_components(spark, sf):
    """Of each variant component the most alike canonical one, all of them accepted."""
    r, every = Run(spark, sf), Normalise(component_min_count=1, component_min_share=0.0, foreign_max_ratio=1e9)
    d = lexicon.learn_components(*r.base, r.train, every)
    return d.select("comp2", "comp1", "n", F.round("share", 9).alias("share"), F.round("cosine", 9).alias("cosine"))


def er_learned_components(spark, sf):
    """Those that are accepted with a support of two pairs and a tenth of them."""
    r = Run(spark, sf)
    return lexicon.learn_components(*r.base, r.train, Normalise(component_min_count=2, component_min_share=0.1, foreign_max_ratio=1e9)).select("comp2", "comp1", "n")


def er_translit(spark, sf):
    """Learned from records whose names are written in Greek letters."""
    r = Run(spark, sf)
    one, two = r.base
    native = two.withColumn("name_tokens", F.transform("name_tokens", lambda x: F.translate(x, *oracle.GREEK))).withColumn("f_script", F.lit(True))
    return lexicon.learn_translit(one, native, r.train).select("native", "latin", "n", F.round("share", 9).alias("share"))


def er_places(spark, sf):
    """Places in common, by the learned localities (a lexicon applied)."""
    r = Run(spark, sf)
    lex = lexicon.Lexicon(localities=sorted(x.comp for x in lexicon.localities(r.base[0]).collect()))
    one, two = (normalize.finalize(d, lex).select("entity_id", "localities") for d in r.base)
    d = r.pairs.join(grown(one.withColumnsRenamed({"entity_id": "s1_id", "localities": "l1"})), "s1_id").join(grown(two.withColumnsRenamed({"entity_id": "c_id", "localities": "l2"})), "c_id")
    return d.select("s1_id", "c_id", F.when((F.size("l1") > 0) & (F.size("l2") > 0), F.size(F.array_intersect("l1", "l2"))).alias("loc_overlap"))


def er_applied_lexicon(spark, sf):
    """Transliteration and canonical components applied."""
    lex = lexicon.Lexicon(translit={"red": "rouge", "blue": "bleu", "green": "vert"}, components={f"{c}|small street": f"{c}|petite rue" for c in ("ASIA", "EUROPE", "AFRICA")})
    one, two = (normalize.finalize(d.withColumn("addr_comps", F.transform("addr_comps", lambda x: F.regexp_replace(x, "^[0-9]+ ", ""))), lex) for d in _base(spark, sf))
    return one.union(two).select("entity_id", "name_core", "addr_norm", "f_pseudo")


def er_trained(spark, sf):
    """Trained stages, tuned floor, all systems and slices on the test entities (models: no SQL form)."""
    r, cfg = Run(spark, sf), Config(model=Model(trees=8, depth=4))
    d = r.trained(cfg)
    floor = linkage.tuned_floor(d, r.truth, r.records[0], cfg.split).first().floor
    return linkage.systems(d, r.truth, r.records[0], r.final[1], cfg, "TEST", floor)



def queries():
    return {n: f for n, f in globals().items() if n.startswith("er_")}


def oracle_sql():
    return oracle.statements()
