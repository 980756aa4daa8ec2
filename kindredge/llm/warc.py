"""WARC archives: write records, and read them back by boundary-chain verification.

Writing: a record is one row of Spark's text writer whose line separator is the record separator, so archives go to any
file system that Spark writes. Equal payloads of at least ``least`` bytes are stored once (a ``response``); the others are
``revisit`` records without a payload.

Reading: Spark's text reader splits the archives at the magic ``WARC/1.``, so every task sees *candidate* records, among
them magic inside payloads. A candidate's header names its length and so the offset of its successor. Candidates whose
successor is the next candidate form runs; runs are few (one a file split, and two for each embedded magic). Pointer
jumping over the runs, from the start of each file, keeps the reachable ones; all other candidates are payload bytes and
go back to the record that contains them. Offsets are running sums within file splits, then over the splits of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, maybe_broadcast

MAGIC = "WARC/1."
END = "\r\n\r\n"
LEAST = 1000


def revisits(pages: DataFrame, work: Work, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, digest, bytes) -> (digest, bytes, keeper) of payloads that several pages share."""
    groups = pages.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return work.save(groups.filter("n > 1").drop("n"), "shared")


def records(pages: DataFrame) -> Column:
    """The record of a row (page_id, url, html, digest, bytes, refers_to) without its closing separator."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    length = F.octet_length(http) + F.octet_length(body)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Target-URI", url),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), length.cast("string"), F.lit(END))
    return F.concat(head, http, body)


def write(pages: DataFrame, path: str, work: Work, least: int = LEAST) -> None:
    """``pages`` (page_id, url, html) to archives under ``path``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    shared = revisits(pages, work, least)
    marked = pages.join(maybe_broadcast(shared, shared.count()), ["digest", "bytes"], "left")
    marked = marked.withColumn("refers_to", F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    marked.select(records(marked).alias("value")).write.option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, f"(?i)(?:^|\\n){name}:[ \\t]*([^\\r\\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Everything between two magics: file, split, n (order within the split), size, raw and what its header says.

    ``next`` is the successor's distance from the candidate's magic; null where there is no header."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value"))
    size = F.octet_length("value").cast("long") + len(MAGIC)
    head = F.substring_index("value", END, 1)
    inner = F.octet_length(head).cast("long") + len(END)
    length = F.expr("try_cast(clen as bigint)")
    rows = raw.withColumn("size", size).withColumn("head", head).withColumn("inner", inner)
    # a split's first piece starts after a magic, except the one at the start of a file, which is empty or damage
    valid = F.col("head").rlike("^\\d[ \\t]*\\r\\n") & (F.col("size") >= F.col("inner"))
    rows = rows.withColumn("clen", F.when(valid, _field(F.col("head"), "Content-Length"))).withColumn("length", length)
    return rows.withColumn("next", F.when(F.col("length") >= 0, F.lit(len(MAGIC)) + F.col("inner") + F.col("length") + len(END)))


def _parsed(value: Column, head: Column, inner: Column, length: Column) -> list[Column]:
    """Columns of a record from its bytes after the magic."""
    block = F.substring(value.cast("binary"), (inner + 1).cast("int"), length.cast("int"))
    http = F.substring_index(block.cast("string"), END, 1)
    is_http = _field(head, "Content-Type").startswith("application/http")
    payload = F.when(is_http, F.substring(block, (F.octet_length(http) + len(END) + 1).cast("int"), length.cast("int"))).otherwise(block)
    return [
        F.lower(_field(head, "WARC-Type")).alias("record_type"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Target-URI").alias("uri"),
        F.nullif(_field(head, "WARC-Refers-To"), F.lit("")).alias("refers_to"), _field(head, "WARC-Payload-Digest").alias("declared_digest"),
        F.when(is_http, _field(http, "Content-Length").try_cast("long")).alias("declared_bytes"),
        F.octet_length(payload).cast("long").alias("stored_bytes"), F.sha1(payload).alias("stored_digest"), payload.alias("payload")]


def read(spark: SparkSession, path: str, work: Work, payloads: bool = False) -> DataFrame:
    """The records of all archives under ``path``: file, start, record_type, record_id, uri, refers_to, declared_digest,
    declared_bytes, stored_bytes, stored_digest and, if asked for, payload."""
    found = candidates(spark, path)
    columns = _parsed(F.col("value"), F.col("head"), F.col("inner"), F.col("length"))
    names = ["record_type", "record_id", "uri", "refers_to", "declared_digest", "declared_bytes", "stored_bytes", "stored_digest"] + ["payload"] * payloads
    whole = F.col("size") >= F.col("next")
    parsed = found.select("file", "split", "n", "size", "next", whole.alias("whole"), F.when(whole, F.struct(*columns)).alias("r")).select(
        "file", "split", "n", "size", "next", "whole", *[F.col(f"r.{x}").alias(x) for x in names])
    slim = work.save(parsed, "candidates")

    # offsets: the first piece of a file has no magic before it, so it starts at -len(MAGIC)
    within = Window.partitionBy("file", "split").orderBy("n")
    splits = slim.groupBy("file", "split").agg(F.sum("size").alias("total"))
    splits = splits.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC))
    placed = slim.join(splits.select("file", "split", "base"), ["file", "split"])
    placed = placed.withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size")).drop("base").withColumn("to", F.col("start") + F.col("next"))
    follows = F.lag("to").over(within).eqNullSafe(F.col("start"))
    placed = placed.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(within))
    placed = work.save(placed, "placed")

    runs = placed.groupBy("file", "split", "run").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.max_by("to", "start").alias("to"))
    runs = work.save(runs, "runs")
    reached = _reachable(runs, placed, work)
    kept = placed.join(reached, ["file", "split", "run"]).filter(F.col("start") >= F.col("entry")).drop("entry", "run")
    kept = work.save(kept, "kept")
    good = kept.filter("whole").select("file", "start", *names)
    if not kept.filter("not whole").head(1):
        return good
    return good.union(_rejoined(found, kept, placed, names))


def _reachable(runs: DataFrame, placed: DataFrame, work: Work) -> DataFrame:
    """(file, split, run, entry): runs on the chain from the start of their file, and where the chain enters them."""
    goal = placed.select("file", F.col("start").alias("to"), F.col("split").alias("s2"), F.col("run").alias("r2"))
    node = F.struct("split", "run")
    edges = runs.join(goal, ["file", "to"]).select("file", node.alias("a"), F.struct(F.col("s2").alias("split"), F.col("r2").alias("run")).alias("b"), F.col("to").alias("entry"))
    jump = work.save(edges, "jump0")
    reach = work.save(runs.filter("first <= 0 and last >= 0").select("file", node.alias("a"), F.lit(0).cast("long").alias("entry")), "reach0")
    for k in range(1, 64):
        more = reach.select("file", "a").join(jump, ["file", "a"]).select("file", F.col("b").alias("a"), "entry")
        after = work.save(reach.union(more).groupBy("file", "a").agg(F.min("entry").alias("entry")), f"reach{k}")
        if after.count() == reach.count():
            break
        reach = after
        left = jump.select("file", "a", F.col("b").alias("m"))
        jump = work.save(left.join(jump.select("file", F.col("a").alias("m"), "b", "entry"), ["file", "m"]).select("file", "a", "b", "entry"), f"jump{k}")
    return reach.select("file", "a.split", "a.run", "entry")


def _rejoined(found: DataFrame, kept: DataFrame, placed: DataFrame, names: list[str]) -> DataFrame:
    """Records whose payload holds magic: their pieces, read once more, are put together again, record by record."""
    parts = kept.filter("not whole").select("file", F.col("start").alias("record"), F.col("to").alias("stop"))
    where = placed.select("file", "split", "n", "start")
    # candidate pieces belong to the last broken record that starts at or before them
    marks = parts.select("file", F.col("record").alias("start"), F.lit(None).cast("long").alias("split"), F.lit(None).cast("long").alias("n"), "record", "stop")
    rows = where.join(parts.select("file").distinct(), "file", "left_semi").select("file", "start", "split", "n", F.lit(None).cast("long").alias("record"), F.lit(None).cast("long").alias("stop"))
    order = Window.partitionBy("file").orderBy("start", F.col("record").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.union(rows).select("file", "start", "split", "n", F.last("record", True).over(order).alias("record"), F.last("stop", True).over(order).alias("stop"))
    owned = owned.filter("n is not null and record is not null and start < stop").select("file", "split", "n", "start", "record", "stop")
    pieces = owned.join(found.select("file", "split", "n", F.col("value").cast("binary").alias("value")), ["file", "split", "n"])
    joined = pieces.groupBy("file", "record", "stop").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("p"))
    magic = F.lit(MAGIC).cast("binary")
    value = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))), F.element_at("p", 1)["value"], lambda acc, x: F.concat(acc, magic, x["value"]))
    joined = joined.select("file", F.col("record").alias("start"), F.col("stop"), value.cast("string").alias("value"))
    joined = joined.withColumn("head", F.substring_index("value", END, 1)).withColumn("inner", F.octet_length("head").cast("long") + len(END))
    joined = joined.withColumn("length", F.col("stop") - F.col("start") - len(MAGIC) - F.col("inner") - len(END))
    whole = joined.filter(F.octet_length("value") + len(MAGIC) >= F.col("stop") - F.col("start"))  # else the file ends within it
    return whole.select("file", "start", *_parsed(F.col("value"), F.col("head"), F.col("inner"), F.col("length"))).select("file", "start", *names)


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) -> (page_id, payload_bytes, payload_digest, record_type, refers_to), read back.

    A row for each page row. Null html is an empty payload; a null page_id is kept (and never referred to while a page
    with an id has the payload); rows that share the largest page_id of a payload are all responses. Stored payloads are
    checked against their declared digests: damage raises. An empty table gives an empty table."""
    spark = pages.sparkSession
    work = Work(spark, "warc")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    write(pages, work.path("archives"), work, least)
    if not pages.head(1):
        return spark.createDataFrame([], schema)
    rows = read(spark, work.path("archives"), work)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?\\d+)>", 1).try_cast("long")
    declared = F.substring_index("declared_digest", ":", -1)
    revisit = F.col("record_type") == "revisit"
    checked = F.when(revisit | (declared == F.col("stored_digest")), declared).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    return rows.select(number(F.col("record_id")).alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.col("stored_bytes")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))
