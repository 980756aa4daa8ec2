import hashlib
import random

from kindredge.llm import warc
from kindredge.llm.common import Work


def expected(rows, least=1000):
    keeper = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and page is not None:
            keeper[raw] = max(keeper.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = keeper.get(raw)
        to = None if to == page else to
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def fake(r, inner=""):
    return f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(inner)}\r\n\r\n{inner}\r\n\r\n"


def test_round_trip_with_magic_inside(spark):
    r = random.Random(1)
    filler = lambda n: "".join(r.choice("abc é\r\n") for _ in range(n))
    rows = [(i, f"http://h{i}/", filler(r.choice([0, 10, 999, 1000, 3000]))) for i in range(60)]
    rows += [(100, "u", filler(50) + fake(r, "xyz") + "tail"), (101, "u", fake(r)), (102, "u", fake(r, fake(r, "q") * 3) + "WARC/1."), (103, "u\r\nWARC-Type: revisit", "WARC/1.1\r\n"), (104, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (105, "u", "WARC/1." * 400), (106, "u", "WARC/1." * 400)]
    rows += [(200 + i, None, "same " * 300) for i in range(5)] + [(204, None, "same " * 300), (None, None, "same " * 300), (None, "n", None), (300, "e", ""), (301, "e", None), (302, "long", "word " * 100000)]
    frame = spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, html string, digest string")
    for split in ("128m", "700"):  # records that cross splits, and splits within payloads
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = warc.archive_round_trip(frame.repartition(2)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((tuple(x) for x in got), key=str) == expected(rows)


def test_payloads_come_back(spark):
    work = Work(spark, "t")
    frame = spark.createDataFrame([(1, "http://a/", "x" + fake(None, "in") + "y"), (2, "http://b/", "plain")], "page_id long, url string, html string")
    warc.write(frame.coalesce(1), work.path("a"), work)
    got = {x.uri: bytes(x.payload).decode() for x in warc.read(spark, work.path("a"), work, payloads=True).collect()}
    assert got == {"http://a/": "x" + fake(None, "in") + "y", "http://b/": "plain"}


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
