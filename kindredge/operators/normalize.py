"""Base and final normalisation of raw records: one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FLAGS = ["f_alias", "f_url", "f_junk", "f_script", "f_empty_addr", "f_pseudo"]


def base(records: DataFrame, max_numbers: int = 6, exact_fold: bool = False) -> DataFrame:
    """entity_id, country, further columns, name_tokens, addr_comps, nums (at most ``max_numbers``), n_nums, noise flags."""
    fold = T.fold_all if exact_fold else T.fold
    flag, real = T.alias_of(F.col("business_name"))
    extra = [c for c in records.columns if c not in ("business_name", "business_address")]
    d = records.select(*extra, flag.alias("f_alias"), F.regexp_replace(fold(real), T.NOISE, " ").alias("name"), fold(F.col("business_address")).alias("addr"))
    d = d.withColumn("f_junk", F.col("name").rlike(T.JUNK)).withColumn("name", F.regexp_replace("name", T.JUNK, ""))
    d = d.withColumn("f_url", F.col("name").rlike(T.URL)).withColumn("name", F.regexp_replace("name", T.URL_PARTS, " "))
    dotted = F.regexp_replace("name", r"(?<![a-z0-9_])([a-z0-9_])\.", "$1")
    d = d.withColumn("name", T.squeeze(F.regexp_replace(F.regexp_replace(dotted, "&", " and "), T.SYMBOLS, " ")))
    d = d.withColumn("addr", F.regexp_replace("addr", T.PLACEHOLDER, " "))
    comps = F.filter(F.transform(T.tokens(F.col("addr"), ","), lambda x: T.squeeze(F.regexp_replace(x, T.SYMBOLS, " "))), lambda x: x != "")
    nums = T.house_numbers(F.col("addr"))
    d = d.withColumn("addr_comps", comps).withColumn("all_nums", nums)
    return d.select(*extra, T.tokens(F.col("name")).alias("name_tokens"), "addr_comps", F.slice("all_nums", 1, max_numbers).alias("nums"), F.size("all_nums").alias("n_nums"),
                    "f_alias", "f_url", "f_junk", F.col("name").rlike(T.SCRIPT).alias("f_script"), (F.size("addr_comps") == 0).alias("f_empty_addr"))


def core_tokens(tokens: Column) -> Column:
    """Without legal words, unless nothing would be left."""
    core = T.without(tokens, T.LEGAL)
    return F.when(F.size(core) > 0, core).otherwise(tokens)


def finalize(d: DataFrame, lexicon=None, pseudo_min_len: int = 5) -> DataFrame:
    """Apply the lexicon (``None``: nothing learned) and derive names without legal words, closed-up names, address tokens."""
    translit = lexicon.translit if lexicon else {}
    components = lexicon.components if lexicon else {}
    places = lexicon.localities if lexicon else []
    vocab = lexicon.vocab_set() if lexicon else frozenset()
    d = d.withColumn("name_tokens", F.transform("name_tokens", lambda x: T.homoglyphs(T.map_values(x, translit))))
    d = d.withColumn("core", core_tokens(F.col("name_tokens"))).withColumn("name_nospace", F.array_join("core", ""))
    if vocab:
        # Python is kept to the rows that need it: the others never reach the UDF
        hit = d.filter("f_url and length(name_nospace) >= 4").withColumn("core", core_tokens(T.segmenter(vocab)("name_nospace")))
        d = d.filter("not coalesce(f_url and length(name_nospace) >= 4, false)").unionByName(hit)
    one = F.get("core", F.lit(0))
    pseudo = (F.size("core") == 1) & ~F.col("f_url") & (F.length(one) >= pseudo_min_len) & one.rlike("^[a-z]+$")
    if vocab:
        pseudo = pseudo & ~one.isin(*sorted(vocab))
    keyed = F.transform("addr_comps", lambda x: T.map_values(F.concat_ws("|", "country", x), components))
    comps = F.transform(keyed, lambda x: F.element_at(F.split(x, "\\|"), -1))
    words = F.filter(F.split(F.array_join(comps, " "), " "), lambda x: x != "")
    surface = {w: short for short, forms in T.SHORT_FORMS.items() for w in forms.split()}
    addr = T.without(F.transform(words, lambda x: T.map_values(x, surface)), T.ADDR_STOP)
    alpha = F.filter(addr, lambda x: ~x.rlike("[0-9]"))
    full = F.transform(comps, lambda x: F.concat_ws("|", "country", x))
    out = d.withColumn("f_pseudo", F.coalesce(pseudo, F.lit(False))).withColumn("name_full", F.array_join("name_tokens", " ")).withColumn("name_core", F.array_join("core", " "))
    out = out.withColumn("addr_norm", F.array_join(addr, " ")).withColumn("addr_tokens", alpha).withColumn("addr_alpha", F.array_join(alpha, " "))
    out = out.withColumn("localities", F.filter(full, lambda x: x.isin(*places)) if places else F.array().cast("array<string>"))
    return out.withColumn("name_tokens", F.col("core")).withColumn("n_name_tok", F.size("core")).drop("core", "addr_comps")
