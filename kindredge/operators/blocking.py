"""Candidate generation: exploded country-scoped keys, a frequency cap, a hash join, rarity-weighted votes, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Blocking
from ..functions import text as T
from ..plans import store

#: Candidate records whose lists one task opens, about: its sums and ranks then fit in memory, at any size of the input.
RECORDS = 8192


def _cross(a: Column, b: Column, family: str) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", F.lit(family), x, y.cast("string")))))


def _pairs(a: Column, family: str) -> Column:
    both = F.flatten(F.transform(a, lambda x: F.transform(a, lambda y: F.when(x < y, F.concat_ws("|", F.lit(family), x, y)))))
    return F.filter(both, lambda k: k.isNotNull())


def keys(d: DataFrame, cfg: Blocking = Blocking(), source1: bool = False) -> DataFrame:
    """(country, key, entity_id), each key once a record; ``source1`` adds keys of first numbers without one digit."""
    name, addr = F.slice("name_tokens", 1, cfg.name_tokens), F.slice("addr_tokens", 1, cfg.addr_tokens)
    nums = F.slice("nums", 1, cfg.number_keys)
    parts = [_cross(name, nums, "nu"), _cross(addr, nums, "au"), _pairs(name, "nn"), _cross(F.slice(name, 1, cfg.pair_tokens), addr, "na"),
             F.when(F.col("name_nospace") != "", F.array(F.concat(F.lit("ns|"), F.col("name_nospace")))).otherwise(F.array().cast("array<string>"))]
    if cfg.name1_key:
        parts.append(F.transform(name, lambda x: F.concat(F.lit("n1|"), x)))
    if cfg.addr_pair_key:
        parts.append(_pairs(addr, "aa"))
    if cfg.num_del_key and source1:
        gone = F.coalesce(T.digit_deletions(F.get("nums", F.lit(0))), F.array().cast("array<int>"))
        parts.append(_cross(F.slice(addr, 1, cfg.pair_tokens), gone, "au"))
    return d.select("country", F.explode(F.array_distinct(F.concat(*parts))).alias("key"), "entity_id")


def postings(s1_keys: DataFrame, cap: int) -> DataFrame:
    """(country, key, n): keys of at most ``cap`` source-1 records. Bounds what any key can add to the join."""
    return s1_keys.groupBy("country", "key").agg(F.count("*").alias("n")).filter(F.col("n") <= cap)


def index(s1_keys: DataFrame, cap: int) -> DataFrame:
    """(h, weight, ids): each hashed key of at most ``cap`` entities, its rarity and its entities. Keys are counted first
    (map-side), so that no list grows beyond the cap; the lists then form where the counted keys already lie."""
    hashed = s1_keys.select(F.xxhash64("country", "key").alias("h"), "entity_id")
    counted = hashed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") <= cap)
    return hashed.join(store.grown(counted), "h").groupBy("h").agg((1.0 / F.log2(1.0 + F.first("n"))).alias("weight"), F.collect_list("entity_id").alias("ids"))


def met(s1_keys: DataFrame, cand_keys: DataFrame, cap: int) -> DataFrame:
    """(c_id, country, weight, ids): a candidate's keys met with the index, as whole lists."""
    probe = cand_keys.select(F.xxhash64("country", "key").alias("h"), "country", F.col("entity_id").alias("c_id"))
    return probe.join(store.grown(index(s1_keys, cap)), "h").select("c_id", "country", "weight", "ids")


def summed(lists: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and votes of lists that lie by c_id: the entities are opened here, after the last exchange."""
    return lists.withColumn("s1_id", F.explode("ids")).groupBy(*by).agg(F.round(F.sum("weight"), 9).alias("votes"))


def votes(s1_keys: DataFrame, cand_keys: DataFrame, cap: int) -> DataFrame:
    """(c_id, s1_id, country, votes): the sum of 1 / log2(1 + n) over shared keys.

    Lists travel to the candidate's partition, where they are opened and summed: pairs are formed after the last exchange,
    and what follows by record (top-k) needs none."""
    return summed(met(s1_keys, cand_keys, cap).repartition("c_id"), ["c_id", "s1_id", "country"])


def top_candidates(v: DataFrame, cfg: Blocking = Blocking()) -> DataFrame:
    """Per record its best entities: rank (from 0, ties by s1_id) below ``top``, votes of a share of the best's."""
    w = Window.partitionBy("c_id")
    # compared as it is, so that Spark drops lower rows before it ranks
    ranked = v.withColumn("_n", F.row_number().over(w.orderBy(F.desc("votes"), "s1_id"))).filter(F.col("_n") <= cfg.top).withColumn("rank", F.col("_n") - 1).drop("_n")
    return ranked.withColumn("best", F.max("votes").over(w)).filter(F.col("votes") >= cfg.min_rel_votes * F.col("best")).withColumn("rel", F.col("votes") / F.col("best")).drop("best")


def numbered(s1: DataFrame, save=store.save) -> DataFrame:
    """(entity_id, country, no): each once with a long in the ids' order, written, so that it stays what it is."""
    ids = s1.select("entity_id", "country").distinct().repartitionByRange("entity_id", "country").sortWithinPartitions("entity_id", "country")
    return save(ids.withColumn("no", F.monotonically_increasing_id()), "numbered")


def generate(s1: DataFrame, cand: DataFrame, cfg: Blocking = Blocking(), save=store.save) -> DataFrame:
    """The candidate pairs of two sides. Lists, votes and ranks hold entities by number, 8 bytes each and ordered as their ids;
    only the pairs that are left get their ids and country back (both sides of a key share it). The lists go to as many
    tasks as the records need, whatever the session's number of partitions."""
    numbers = numbered(s1, save)
    names = numbers.withColumnsRenamed({"entity_id": "s1_id", "country": "land"})
    one = s1.join(store.grown(names), (F.col("entity_id") == F.col("s1_id")) & F.col("country").eqNullSafe(F.col("land"))).drop("entity_id", "s1_id", "land").withColumnRenamed("no", "entity_id")
    lists = met(keys(one, cfg, True), keys(cand, cfg), cfg.key_cap).drop("country").repartition(1 + cand.count() // RECORDS, "c_id")
    top = top_candidates(summed(lists, ["c_id", "s1_id"]), cfg).withColumnRenamed("s1_id", "no")
    return top.join(store.grown(names), "no").select("c_id", "s1_id", F.col("land").alias("country"), "votes", "rank", "rel")


def recall_curve(pairs: DataFrame, truth: DataFrame, ranks=(1, 2, 3, 4, 6, 8), rels=(0.2, 0.35, 0.5)) -> DataFrame:
    """(cut, pairs, found, recall) for rank and relative-vote cuts: one pass over the pairs."""
    hit = pairs.join(store.grown(truth.select("s1_id", "c_id", F.lit(1).alias("y"))), ["s1_id", "c_id"], "left")
    cuts = [(f"rank<{k}", F.col("rank") < k) for k in ranks] + [(f"rel>={r}", F.col("rel") >= r) for r in rels]
    sums = hit.agg(*[F.sum(c.cast("long")).alias(f"p{i}") for i, (_, c) in enumerate(cuts)], *[F.sum((c & F.col("y").isNotNull()).cast("long")).alias(f"f{i}") for i, (_, c) in enumerate(cuts)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), F.coalesce(f"p{i}", F.lit(0)).alias("pairs"), F.coalesce(f"f{i}", F.lit(0)).alias("found")) for i, (n, _) in enumerate(cuts)])).alias("r")
    return sums.crossJoin(truth.agg(F.count("*").alias("total"))).select(rows, "total").select("r.cut", "r.pairs", "r.found", (F.col("r.found") / F.col("total")).alias("recall"))


def reduction(pairs: DataFrame, s1: DataFrame, cand: DataFrame) -> DataFrame:
    """1 - pairs / (entities * records)."""
    n = pairs.agg(F.count("*").alias("pairs")).crossJoin(s1.agg(F.count("*").alias("entities"))).crossJoin(cand.agg(F.count("*").alias("records")))
    return n.withColumn("reduction", 1 - F.col("pairs") / (F.col("entities") * F.col("records")))
