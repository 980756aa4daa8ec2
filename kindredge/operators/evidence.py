"""Evidence of each decision, its reasons in words, and the lookups of a reader of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import grown
from .decide import owner


def evidence(pairs: DataFrame, s1: DataFrame, cand: DataFrame, truth: DataFrame, p: str = "p") -> DataFrame:
    """Every decided pair with raw strings, its rival (the record's owner, if another entity) and label; entities without
    candidates have one row without a record."""
    raw = lambda d, x: d.select(F.col("entity_id").alias(f"{x}_id"), F.col("business_name").alias(f"{x}_name"), F.col("business_address").alias(f"{x}_addr"))
    best = owner(pairs, p).select("c_id", F.col("s1_id").alias("rival_id"))
    d = pairs.drop("country").join(grown(best), "c_id", "left").withColumn("rival_id", F.when(F.col("rival_id") != F.col("s1_id"), F.col("rival_id")))
    d = d.join(grown(truth.select("s1_id", "c_id", F.lit(1).alias("label"))), ["s1_id", "c_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    d = d.join(grown(raw(cand, "c")), "c_id")
    return raw(s1, "s1").join(grown(s1.select(F.col("entity_id").alias("s1_id"), "country")), "s1_id").join(grown(d), "s1_id", "left")


def verdict(d: DataFrame) -> Column:
    return F.when(F.col("c_id").isNull(), "no candidate").when(F.col("selected"), "matched").when(F.col("rival_id").isNotNull(), "claimed by another entity").otherwise("rejected")


def number_diff(one: Column, two: Column) -> tuple[Column, Column]:
    """(numbers of the entity's address that the record's lacks, the record's that the entity's lacks), without leading
    zeros, each once, in order."""
    numbers = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))
    return F.array_except(numbers(one), numbers(two)), F.array_except(numbers(two), numbers(one))


def reasons() -> Column:
    """Array of sentences, each led by + (for), - (against) or · (context), of a row with raw addresses (s1_addr, c_addr), pair
    features, decision and rival."""
    name, sel, rival = F.col("nm_tset"), F.col("selected"), F.col("rival_id").isNotNull()
    inside, shift, part = F.col("num_p_in"), F.round(F.expm1("num_logdiff")).cast("long"), F.col("num_frac1")
    lost, other = number_diff(F.col("s1_addr"), F.col("c_addr"))
    both = (F.coalesce("c_addr", F.lit("")) != "") & (F.size(lost) > 0) & (F.size(other) > 0)
    said = lambda pattern, *c: F.format_string(pattern, *c)
    some = lambda a, n: F.array_join(F.slice(a, 1, n), ", ")
    swapped = ~sel & both & (name >= 85) & ~rival
    apart = ~swapped & (inside == 0) & F.col("num_logdiff").isNotNull()
    lines = [
        F.when(swapped, said("- number %s is absent, the record has %s instead: the sign of a look-alike", some(lost, 2), some(other, 3))),
        F.when(~swapped & (inside == 1), F.lit("+ the record has the house number")),
        F.when(~swapped & (inside == 1) & (part < 1), said("- only %d%% of the address's numbers are there", F.round(part * 100).cast("int"))),
        F.when(apart, F.when((F.col("num_drop") == 1) & sel, F.lit("+ house number without one digit (noise)"))
               .when((shift > 0) & (shift <= 60) & (name >= 85) & ~sel, said("- house number shifted by %d: the sign of a look-alike", shift))
               .when(part >= 0.5, said("· house number differs by %d, but most other numbers agree", shift)).otherwise(said("- house number differs by %d", shift))),
        F.when(~swapped & inside.isNull(), F.lit("· no house number to compare")),
        F.when((F.col("tok_diff") > 0) & (name >= 85) & ~sel, F.lit("- a further word in the name, as decoys have")),
        F.when(F.col("c_f_pseudo") == 1, F.lit("· invented name: only the address tells")), F.when(F.col("c_f_alias") == 1, F.lit("+ the real name follows an alias marker")),
        F.when(F.col("c_f_url") == 1, F.lit("· the name is written as a web address")), F.when(F.col("c_f_script") == 1, F.lit("· the name is in another script")), F.when(F.col("c_f_empty_addr") == 1, F.lit("· no address: only the name tells")),
        F.when(name >= 95, F.lit("+ same name")).when((name < 60) & (F.col("c_f_pseudo") + F.col("c_f_url") + F.col("c_f_script") == 0), said("- names differ (word overlap %d of 100)", F.round(name).cast("int"))),
        F.when(F.col("loc_overlap") == 0, F.lit("- another city or region")), F.when(rival, said("- claimed more strongly by %s", F.col("rival_id"))),
        F.when(sel & (F.col("e_sib") >= 1) & (inside == 1), said("+ beats %d look-alikes of this entity by the house number", F.col("e_sib").cast("int")))]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def explained(d: DataFrame, p: str = "p") -> DataFrame:
    return d.withColumn("verdict", verdict(d)).withColumn("reasons", reasons()).withColumn("fooled", (F.col(p) >= 0.5) & ~F.col("selected"))


def search(d: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities with this id, or whose name has the text in it (any case); at most ``limit``."""
    hit = (F.col("s1_id") == text) | F.contains(F.lower("s1_name"), F.lit(text.lower()))
    return d.filter(hit).select("s1_id", "s1_name", "s1_addr", "country").distinct().orderBy("s1_id").limit(limit)


def entity(d: DataFrame, s1_id: str) -> DataFrame:
    return d.filter(F.col("s1_id") == s1_id).orderBy(F.desc("selected"), F.desc("p"), "c_id")


def demo(d: DataFrame, kind: str, country: str | None = None) -> DataFrame:
    """(s1_id, n): entities worth showing, those of three to eight candidates first. ``kind``: lookalike, lowsim, empty,
    branch, or country (with ``country``: its matched entities)."""
    sel, true = F.coalesce("selected", F.lit(False)), F.col("label") == 1
    rows = {"lookalike": ~sel & ~true & (F.col("nm_tset") >= 90) & (F.col("num_p_in") == 0) & (F.col("p") >= 0.5), "lowsim": sel & true & (F.col("nm_tset") < 50),
            "empty": sel & true & (F.col("c_f_empty_addr") == 1), "branch": ~true & F.col("rival_id").isNotNull() & (F.col("nm_tset") >= 95), "country": sel & (F.col("country") == F.lit(country))}[kind]
    found = F.lit(True) if kind == "country" else F.max((sel & true).cast("int")) == 1
    g = d.groupBy("s1_id").agg(F.max(F.coalesce(rows, F.lit(False)).cast("int")).alias("hit"), found.alias("found"), F.count("c_id").alias("n")).filter("hit = 1 and found")
    return g.select("s1_id", "n").orderBy(~F.col("n").between(3, 8), "s1_id")
