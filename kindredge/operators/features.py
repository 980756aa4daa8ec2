"""Pair features: geometry of numbers, rarity of tokens, flags, names, string scores; windows over entities and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..plans.store import grown

NONE = lambda kind="double": F.lit(None).cast(kind)


def numbers(n1: Column, n2: Column) -> dict[str, Column]:
    """Number features of an entity's and a record's number arrays; NULL where a side has none."""
    p, both = F.get(n1, F.lit(0)), (F.size(n1) > 0) & (F.size(n2) > 0)
    inside = F.array_contains(n2, p)
    share = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)
    digits = lambda x: F.length(x.cast("string"))
    part = F.exists(n2, lambda x: (digits(x) < digits(p)) & ((F.right(p.cast("string"), digits(x)) == x.cast("string")) | (F.left(p.cast("string"), digits(x)) == x.cast("string"))))
    long = lambda a: F.filter(a, lambda x: x >= 10000)
    when = lambda c: F.when(both, c.cast("double"))
    return {
        "num_p_in": when(inside), "num_p_first": when(F.get(n2, F.lit(0)) == p), "num_frac1": when(share(n1, n2)), "num_frac2": when(share(n2, n1)),
        "num_logdiff": when(F.round(F.log1p(F.least(F.array_min(F.transform(n2, lambda x: F.abs(x - p))), F.lit(1000000000))), 9)),
        "num_drop": when((p >= 10) & ~inside & part), "num_del_any": when(~inside & F.arrays_overlap(n2, T.digit_deletions(p, 9))),
        "num_long": F.when((F.size(long(n1)) > 0) & (F.size(long(n2)) > 0), F.arrays_overlap(long(n1), long(n2)).cast("double")),
        "n_nums1": F.size(n1), "n_nums2": F.size(n2)}


def idf(s1: DataFrame, column: str) -> DataFrame:
    """(token, idf): ln(records / occurrences) over source 1, all countries together."""
    n = s1.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return n.crossJoin(s1.agg(F.count("*").alias("total"))).select("token", F.log(F.col("total") / F.col("n")).alias("idf"))


def with_idf(d: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """Attach array<struct<token, idf>> of all of a record's tokens: one join a record, not a pair; unknown tokens weigh most."""
    worst = table.agg(F.max("idf").alias("worst"))
    t = d.select("entity_id", F.posexplode(column).alias("at", "token")).join(table, "token", "left").crossJoin(F.broadcast(worst))
    t = t.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("at", "token", F.coalesce("idf", "worst", F.lit(0.0)).alias("idf")))).alias(name))
    return d.join(grown(t), "entity_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<at:int,token:string,idf:double>>")))


def rarity(a: Column, b: Column, name: str) -> dict[str, Column]:
    """Shares of each side's rarity found on the other, and the rarest common token; NULL shares where a side weighs nothing."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, t: acc + t["idf"])
    # the other side's tokens are taken out once a pair; lists are of any length
    common = lambda x, y: F.get(F.transform(F.array(y["token"]), lambda w: F.filter(x, lambda t: F.array_contains(w, t["token"]))), F.lit(0))
    share = lambda x, y: F.when(total(x) > 0, F.round(total(common(x, y)) / total(x), 9))
    rare = F.round(F.coalesce(F.array_max(F.transform(common(a, b), lambda t: t["idf"])), F.lit(0.0)), 9)
    return {f"{name}_cov1": share(a, b), f"{name}_cov2": share(b, a), f"{name}_rare": rare}


def name_counts(s1: DataFrame) -> DataFrame:
    return s1.groupBy("country", "name_core").agg(F.count("*").alias("name_n"))


def strings(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {"nm_tset": S.token_set_of(a["name_core"], b["name_core"]), "nm_tsort": S.token_sort_of(a["name_full"], b["name_full"]),
            "nm_ratio_ns": S.ratio_of(a["name_nospace"], b["name_nospace"]), "nm_partial_ns": S.partial_of(a["name_nospace"], b["name_nospace"]),
            "nm_jw": S.jaro_winkler_of(a["name_core"], b["name_core"]), "ad_tset": S.token_set_of(a["addr_alpha"], b["addr_alpha"]), "ad_tsort": S.token_sort_of(a["addr_norm"], b["addr_norm"])}


def pair_features(pairs: DataFrame, s1: DataFrame, cand: DataFrame, scores: bool = True) -> DataFrame:
    """``pairs`` (s1_id, c_id, votes, rank, …) with all pair features; ``scores`` adds the string scorers (Python)."""
    for column, name in (("name_tokens", "nm_idf"), ("addr_tokens", "ad_idf")):
        table = idf(s1, column)
        s1, cand = with_idf(s1, table, column, name), with_idf(cand, table, column, name)
    counts = name_counts(s1)
    s1, cand = (d.join(grown(counts), ["country", "name_core"], "left") for d in (s1, cand))
    keep = ["entity_id", "name_core", "name_full", "name_nospace", "addr_alpha", "addr_norm", "nums", "n_name_tok", "localities", "nm_idf", "ad_idf", "name_n"]
    side = lambda d, p, more=(): d.select(*[F.col(c).alias(f"{p}_{c}") for c in [*keep, *more]])
    flags = ["f_alias", "f_url", "f_junk", "f_script", "f_empty_addr", "f_pseudo"]
    j = pairs.join(grown(side(s1, "a")), F.col("s1_id") == F.col("a_entity_id")).join(grown(side(cand, "b", flags)), F.col("c_id") == F.col("b_entity_id"))
    a, b = ({c: F.col(f"{p}_{c}") for c in keep} for p in "ab")
    out = {**numbers(a["nums"], b["nums"]), **rarity(a["nm_idf"], b["nm_idf"], "nm_idf"), **rarity(a["ad_idf"], b["ad_idf"], "ad_idf")}
    out["loc_overlap"] = F.when((F.size(a["localities"]) > 0) & (F.size(b["localities"]) > 0), F.size(F.array_intersect(a["localities"], b["localities"])).cast("double"))
    out |= {f"c_{f}": F.col(f"b_{f}").cast("int") for f in flags}
    out |= {"tok_diff": b["n_name_tok"] - a["n_name_tok"], "n_tok1": a["n_name_tok"], "c_s3": F.col("c_id").startswith("S3").cast("int"), "nm_exact": (a["name_core"] == b["name_core"]).cast("int"),
            "s1_name_n": F.round(F.log1p(F.coalesce(a["name_n"], F.lit(0))), 9), "c_name_n": F.round(F.log1p(F.coalesce(b["name_n"], F.lit(0))), 9)}
    if scores:
        out |= strings(a, b)
    return j.select(*pairs.columns, *[c.alias(n) for n, c in out.items()])


def look_alike(d: DataFrame, least: float = 90.0) -> DataFrame:
    """``sib``: the names agree and the entity's number is absent."""
    return d.withColumn("sib", F.when((F.col("nm_tset") >= least) & (F.col("num_p_in") == 0), 1).otherwise(0))


def _margin(p: Column, w) -> Column:
    """A value minus the best other one of its window; minus 0 where it is alone."""
    top, n = F.max(p).over(w), F.count("*").over(w)
    ordered = w.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value(p, 2).over(ordered)
    return p - F.when(n == 1, 0.0).otherwise(F.when(p >= top, second).otherwise(top))


def competition(d: DataFrame, p: str = "p", sib: str = "sib") -> DataFrame:
    """Rival features over entities (e_) and records (c_): ranks, counts, sums, best, share of the best, margins."""
    e, c, x = Window.partitionBy("s1_id"), Window.partitionBy("c_id"), F.col(p)
    d = d.withColumns({"e_rank": F.rank().over(e.orderBy(F.desc(p))), "e_n": F.count("*").over(e), "e_sum": F.round(F.sum(p).over(e), 9), "e_sib": F.sum(sib).over(e), "e_max": F.max(p).over(e), "e_margin": F.round(_margin(x, e), 9)})
    d = d.withColumns({"c_rank": F.rank().over(c.orderBy(F.desc(p))), "c_n": F.count("*").over(c), "c_max": F.max(p).over(c), "c_margin": F.round(_margin(x, c), 9)})
    return d.withColumn("e_rel", F.round(x / F.greatest(F.col("e_max"), F.lit(1e-6)), 9))


def coherence(d: DataFrame, cand: DataFrame, p: str = "p", scores: bool = True) -> DataFrame:
    """Each pair against its anchor, the entity's best *other* record (ties by c_id): coh_p, coh_num, coh_nm, coh_ad."""
    w = Window.partitionBy("s1_id").orderBy(F.desc(p), "c_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first(F.struct(F.col(p).alias("p"), F.col("c_id").alias("id"))).over(whole), F.nth_value(F.struct(F.col(p).alias("p"), F.col("c_id").alias("id")), 2).over(whole)
    d = d.withColumn("anchor", F.when(F.row_number().over(w) == 1, second).otherwise(best))
    d = d.select("*", F.col("anchor.p").alias("coh_p"), F.col("anchor.id").alias("anchor_id")).drop("anchor")
    side = lambda n: cand.select(F.col("entity_id").alias(n), *[F.col(x).alias(f"{n}_{x}") for x in ("name_core", "addr_alpha", "nums")])
    d = d.join(grown(side("own")), F.col("c_id") == F.col("own")).join(grown(side("other")), F.col("anchor_id") == F.col("other"), "left")
    one, two = F.slice("own_nums", 1, 3), F.slice("other_nums", 1, 3)
    d = d.withColumn("coh_num", F.when((F.size(one) > 0) & (F.size(two) > 0), F.arrays_overlap(one, two).cast("double")))
    if scores:
        has = F.col("anchor_id").isNotNull()
        d = d.withColumn("coh_nm", F.when(has, S.token_set_of("own_name_core", "other_name_core"))).withColumn("coh_ad", F.when(has, S.token_set_of("own_addr_alpha", "other_addr_alpha")))
    return d.drop("own", "other", *[f"{n}_{x}" for n in ("own", "other") for x in ("name_core", "addr_alpha", "nums")])
