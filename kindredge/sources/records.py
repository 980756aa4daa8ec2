"""Business records: text and parquet sources, ground truth, list sinks, and records derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import grown

RAW = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def raw_path(root: str, split: str, source: int) -> str:
    return f"{root}/{split}/{split}_source{source}.tsv"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text without quoting; all columns are strings and empty ones stay empty strings."""
    return spark.read.schema(RAW).option("sep", "\t").option("quote", "").option("header", True).csv(path).na.fill("")


def load_split(spark: SparkSession, root: str, split: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(source 1, sources 2 and 3 together); ids, not row places, are the keys."""
    one, two, three = (read_raw(spark, raw_path(root, split, n)) for n in (1, 2, 3))
    keep = columns or one.columns
    return one.select(*keep), two.unionByName(three).select(*keep)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(TRUTH).option("sep", "\t").option("quote", "").option("header", True).csv(path).na.fill("")
    return truth_pairs(raw)


def truth_pairs(lists: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids comma-joined) -> (s1_id, c_id)."""
    parts = lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("c_id"))
    return parts.filter("c_id <> ''")


def unknown_ids(truth: DataFrame, s1: DataFrame, cand: DataFrame) -> DataFrame:
    """Pairs of the ground truth that name a record that does not exist; must be empty."""
    left = truth.join(grown(s1.select(F.col("entity_id").alias("s1_id"))), "s1_id", "left_anti")
    return left.union(truth.join(grown(cand.select(F.col("entity_id").alias("c_id"))), "c_id", "left_anti").select("s1_id", "c_id"))


def match_lists(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Every entity of ``s1`` once, with its records' ids in order, comma-joined; '' where there are none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("c_id")), ",").alias(column))
    out = s1.select(F.col("entity_id").alias("s1_id")).join(grown(lists), "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated parts in order of the entities, by ranges: no single task writes them all."""
    lists.repartitionByRange("source1_entity_id").sortWithinPartitions("source1_entity_id").write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet through the commit protocol; ``mode`` "ignore" keeps what an earlier run wrote."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(d: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table (a summary) as one CSV file with a header, or as JSON lines."""
    writer = d.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


# Records derived from the star schema. The same text runs in Spark and in DuckDB: {name} stands for a table.
S1_SQL = """
SELECT concat('S1-', c_custkey) AS entity_id,
  concat(p_name, ' ', lower(c_mktsegment), CASE c_custkey % 3 WHEN 0 THEN ' llc' WHEN 1 THEN ' inc' ELSE '' END) AS business_name,
  concat(10 + (c_custkey * 37) % 9000, ' ', lower(split_part(p_type, ' ', 1)), ' street, ', translate(lower(n_name), '_0123456789', 'xabcdefghij')) AS business_address,
  r_name AS country, c_custkey AS num
FROM {customer} JOIN {part} ON p_partkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey"""

CAND_SQL = """
SELECT concat(CASE WHEN (num + v) % 2 = 0 THEN 'S2-' ELSE 'S3-' END, num * 10 + v) AS entity_id,
  CASE op WHEN 1 THEN upper(business_name)
    WHEN 2 THEN concat(split_part(business_name, ' ', 2), ' ', split_part(business_name, ' ', 1), ' ', split_part(business_name, ' ', 3))
    WHEN 3 THEN concat(split_part(business_name, ' ', 1), split_part(business_name, ' ', 2), '.com')
    WHEN 4 THEN concat('zorvexa formerly known as ', business_name)
    WHEN 8 THEN concat(business_name, ' holdings') ELSE business_name END AS business_name,
  CASE op WHEN 5 THEN '' WHEN 6 THEN substr(business_address, 2) WHEN 7 THEN concat('no 7, ', business_address)
    WHEN 8 THEN concat(CAST(split_part(business_address, ' ', 1) AS INT) + 7, substr(business_address, length(split_part(business_address, ' ', 1)) + 1))
    WHEN 9 THEN upper(business_address) ELSE business_address END AS business_address,
  country, entity_id AS origin_id, op = 8 AS is_decoy, op AS noise_op
FROM (SELECT s.*, v.v, (num * 7 + v.v * 3) % 10 AS op FROM s1_business s JOIN (VALUES (0), (1), (2), (3)) AS v(v) ON v.v <= num % 4) x"""

TABLES = ("customer", "part", "nation", "region")


def derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source-1 records, candidate records with origin_id, is_decoy and noise_op)."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    s1 = spark.sql(S1_SQL, **read | {t: grown(read[t]) for t in ("customer", "part")})
    s1.createOrReplaceTempView("s1_business")
    return s1, spark.sql(CAND_SQL)
