"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers

from .common import table
from .decontaminate import contaminated
from .jpeg import media_columns
from .language import identify
from .licenses import license_scan
from .licenses import oracle as license_sql
from .line_dedup import GROWING, near_lines
from .near_dedup import near_duplicates
from .packing import pack
from .quality import classify
from .scoring import lm_scores
from .warc import archive_round_trip


def op1_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark, sf_dir):
    return near_lines(table(spark, sf_dir, "documents"), GROWING)


def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_media(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") or name == "pipeline"}


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (d, n)"""


def oracle_sql():
    return {"op1_license_scan": license_sql(), "op2_warc": WARC_SQL}
