"""Language identification of web pages: text likelihoods, declared markup language, address suffix and host priors.

Text likelihoods come from hashed byte-trigram counts of labelled documents (a table of a fixed size), tempered because
trigrams overlap. The languages that the text alone suggests are then counted by host, by address suffix, and against the
declared language; each page's own vote is left out of its counts. Suffix priors are smoothed towards the overall prior
and host priors towards their suffix's. The log terms add up to the posterior.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Work, bounded_batches, chunks

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
#: Weight of the text's log likelihood, by its share of independent evidence, and its greatest total.
TEMPER, MOST = 0.3, 40.0
ALPHA = 2.0
_TAGS = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;")
_DECLARED = re.compile(rb"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})")


def buckets(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, blanks squeezed."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    return ((data[:-2] * 0x9E3779B1 + data[1:-1] * 0x85EBCA6B + data[2:] * 0xC2B2AE35) >> np.uint32(7)) & np.uint32(BUCKETS - 1) if len(data) > 2 else np.zeros(0, np.uint32)


def _counter(languages):
    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                for t, lang in zip(texts[a:b], langs[a:b], strict=True):
                    if t:
                        counts[languages.index(lang)] += np.bincount(buckets(t), minlength=BUCKETS)
        for i in range(len(languages)):
            at = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[i][at])], names=["lang", "bucket", "n"])

    return run


def train(docs: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """languages x BUCKETS log probabilities, from all documents of a known language."""
    labelled = docs.filter(F.col("lang").isin(*languages)).select(F.col("text").cast("string"), "lang")
    sums = labelled.mapInArrow(_counter(list(languages)), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in sums.toPandas().itertuples(index=False):  # at most languages x BUCKETS rows
        table[r.lang, r.bucket] += r.n
    return np.log(table / table.sum(1, keepdims=True))


def _reader(model: np.ndarray, languages):
    def run(batches):
        for batch in batches:
            likes, declared = [], []
            for html in batch.column(2).cast(pa.binary()).to_pylist():
                html = html or b""
                m = _DECLARED.search(html[: html.find(b">", max(0, html.lower().find(b"<html"))) + 1] or html)
                lang = m[1].lower().decode() if m else ""
                declared.append(lang if lang in languages else "")
                found = buckets(_TAGS.sub(b" ", html))
                total = model[:, found].sum(1) * TEMPER
                likes.append(np.maximum(total - total.max(), -MOST).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared), pa.array(likes, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "likes"])

    return run


def identify(pages: DataFrame, docs: DataFrame, languages=LANGUAGES) -> DataFrame:
    """``pages`` (page_id, url, html), ``docs`` (text, lang) -> (page_id, host, suffix, declared, text_lang, lang, confidence).

    A row for each page row. Null html is an empty page and null or odd urls have the host ''; such pages rest on what
    evidence they have, in the end on the overall prior; ties go to the first language by name. Without labelled documents
    the text says nothing. Repeated rows are judged each; an empty table gives an empty table."""
    spark, k, langs = pages.sparkSession, len(languages), F.array(*[F.lit(x) for x in languages])
    bounded_batches(spark)
    work = Work(spark, "language")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    read = pages.mapInArrow(_reader(train(docs, languages), list(languages)), "page_id long, url string, declared string, likes array<double>")
    host = F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    read = read.withColumn("host", host).withColumn("suffix", F.regexp_extract("host", "([^.]*)$", 1))
    read = read.withColumn("vote", F.array_position("likes", F.array_max("likes")).cast("int") - 1).drop("url")
    read = work.save(read, "read")
    votes = [F.sum((F.col("vote") == i).cast("long")).alias(f"n{i}") for i in range(k)]
    row = F.array(*[F.col(f"n{i}") for i in range(k)])
    count = lambda key, name: work.save(read.groupBy(key).agg(*votes).select(key, row.alias(name)), name)
    overall = read.agg(*votes).select(F.transform(row, lambda x: F.coalesce(x, F.lit(0))).alias("all_n"))
    d = read
    for key, name in (("host", "host_n"), ("suffix", "suffix_n"), ("declared", "declared_n")):
        d = d.join(count(key, name), key)
    d = d.crossJoin(F.broadcast(overall))  # one row
    # left out: the page's own vote
    own = lambda c: F.transform(F.col(c), lambda x, i: x - (i == F.col("vote")).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda x, y: x + y)

    def smooth(counts, parent):
        return F.transform(F.arrays_zip(counts.alias("n"), parent.alias("q")), lambda z: (z["n"] + ALPHA * z["q"]) / (total(counts) + ALPHA))

    d = d.withColumns({x: own(x) for x in ("host_n", "suffix_n", "declared_n", "all_n")})
    d = d.withColumn("prior", F.transform("all_n", lambda x: (x + 1.0) / (total(F.col("all_n")) + k)))
    d = d.withColumn("by_suffix", smooth(F.col("suffix_n"), F.col("prior"))).withColumn("by_host", smooth(F.col("host_n"), F.col("by_suffix")))
    # P(declared | language) up to a factor that all languages share: P(language | declared) / P(language)
    d = d.withColumn("by_declared", F.when(F.col("declared") == "", F.col("prior")).otherwise(smooth(F.col("declared_n"), F.col("prior"))))
    score = F.transform(F.arrays_zip("likes", "by_host", "by_declared", "prior"), lambda z: z["likes"] + F.log(z["by_host"]) + F.log(z["by_declared"]) - F.log(z["prior"]))
    d = d.withColumn("score", score).withColumn("top", F.array_max("score"))
    weight = total(F.transform("score", lambda s: F.exp(s - F.col("top"))))
    return d.select("page_id", "host", "suffix", F.nullif(F.col("declared"), F.lit("")).alias("declared"), F.element_at(langs, F.col("vote") + 1).alias("text_lang"),
                    F.element_at(langs, F.array_position("score", F.col("top")).cast("int")).alias("lang"), F.round(1 / weight, 6).alias("confidence"))
