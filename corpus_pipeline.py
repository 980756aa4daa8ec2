"""From raw documents to packed training sequences: five stages, each an operator of kindredge.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kindredge.llm.common import Work, maybe_broadcast, table
from kindredge.llm.decontaminate import contaminated
from kindredge.llm.line_dedup import drop_lines
from kindredge.llm.near_dedup import near_duplicates
from kindredge.llm.packing import pack
from kindredge.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Work tables of this pipeline's stages: a stage's are removed when a later stage begins, as its result is then written.
_HELD: list[Work] = []


def _fresh():
    """Collects the work tables of the stage that begins, and removes those of the stages before it."""
    while _HELD:
        _HELD.pop().drop()
    return Work.collected(_HELD)


def _without(docs, ids, name):
    """``docs`` without the documents whose doc_id is among ``ids``. Rows without a doc_id stay: no decision names them."""
    gone = Work(docs.sparkSession, name).save(ids.select("doc_id").filter("doc_id is not null").distinct(), "gone")
    return docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go, row by row."""
    with _fresh():
        return classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).filter("predicted = 1").select("kept.*")


def lines(spark, docs, sf_dir):
    """Of each class of near-equal lines the first stays; n_chars follows the text. Documents that lose all of their lines go
    (an exact copy loses them to its original); texts that were empty before stay."""
    with _fresh():
        left = drop_lines(docs.select(*COLUMNS)).filter("not emptied")
        return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    with _fresh():
        return _without(docs, near_duplicates(docs).filter("not kept"), "copies")


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    with _fresh():
        return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")), "leaks")


def packing(spark, docs, sf_dir):
    """Pieces of the documents that are left, packed into sequences."""
    with _fresh():
        return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]
#: Learned filters, edit joins and packing have no SQL form: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        work = Work(spark, f"stage-{name}")
        docs = work.save(stage(spark, docs, sf_dir), "docs")
        if kept:
            kept.drop()
        kept = work
    return docs
