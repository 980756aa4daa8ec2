"""The stages against brute force: every decision takes effect, and clean documents stay."""

import random
import zlib
from functools import partial

import pytest

import corpus_pipeline as P
from kindredge.llm.quality import classify
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as line_classes
from tests.llm.test_near_dedup import brute as components


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, root = random.Random(12), tmp_path_factory.mktemp("sf")
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.choice([2, 4, 6])))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    shared = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for d in range(240):
        good = r.random() < 0.75
        lines = [" ".join(word() for _ in range(r.randint(8, 25))) for _ in range(r.randint(3, 7))]
        if d % 10 == 3:
            lines.insert(1, shared)
        if d % 12 == 5:
            lines.append(r.choice(items)[1])
        text = "\n".join(lines)
        rows.append((d, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((d, int(good), 0))
    for d in range(240, 260):
        words = rows[d - 240][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((d, " ".join(words)))
        labels.append((d, labels[d - 240][1], 0))
    rows += [(300, ""), (301, "short and clean words here"), (302, "long " * 3000), (303, rows[0][1]), (304, rows[1][1])]
    labels += [(303, labels[0][1], 0), (304, labels[1][1], 0)]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    write([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    return str(root), rows, items


def test_stages_in_turn(spark, corpus):
    root, rows, items = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = lambda d: {x.doc_id: x.text for x in d.collect()}

    def written(d):
        path = f"{root}/{zlib.crc32(repr(d.columns).encode())}-{random.random()}"
        d.write.parquet(path)
        return spark.read.parquet(path)

    kept = written(P.quality(spark, docs, root))
    assert kept.columns == P.COLUMNS
    want = {x.doc_id for x in classify(docs, spark.read.parquet(f"{root}/labels.parquet")).filter("predicted = 1").collect()}
    assert set(texts(kept)) == want and 0.5 < len(want) / len(rows) < 0.95

    before, lined = texts(kept), written(P.lines(spark, kept, root))
    gone = {p[1:] for p, _, first, _ in line_classes(list(before.items())) if p != first}
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in before.items()}
    assert texts(lined) == {d: t for d, t in left.items() if t.strip() or not before[d].strip()} and len(texts(lined)) < len(before)
    assert all(x.n_chars == len(x.text) for x in lined.collect())

    before, single = texts(lined), written(P.near(spark, lined, root))
    assert set(texts(single)) == {d for d, _, _, own in components(list(before.items())) if own}

    before, clean = texts(single), written(P.decontaminate(spark, single, root))
    assert set(texts(clean)) == set(before) - {d for d, _ in leaks(list(before.items()), items)}

    packed = P.packing(spark, clean, root).collect()
    assert {x.doc_id for x in packed} == set(texts(clean))
    assert all(sum(x.length for x in packed if x.doc_id == d) == next(x.doc_tokens for x in packed if x.doc_id == d) for d in texts(clean))


def test_run_chains_the_stages(spark, corpus):
    out = P.run(spark, corpus[0])
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, gone string, row int, kept int, emptied int, score double, predicted int"


def test_stages_with_nulls_repeats_and_clashing_names(spark, corpus, monkeypatch):
    """No stage crashes, and rows that share a doc_id, or have none, are not mistaken for each other."""
    from kindredge.llm import quality

    monkeypatch.setattr(quality, "fit", partial(quality.fit, steps=60))
    root, rows, items = corpus
    more = ("en", "s", 1, "g", 1, 1, 1, 0.5, 1)
    good = [t for _, t in rows[:40] if not t.isupper() and "!!" not in t][:4]
    data = [(None, None, *more), (None, "", *more), (None, good[0], *more), (None, "another text without an id, quite its own", *more), (7, good[1], *more), (7, f"own line of the second row with this id\n{good[0]}", *more), (7, good[1], *more), (8, items[0][1], *more)]
    data += [(i, None, None, None, None, None, None, None, None, None, None) for i in (20, 20, 21)]
    docs = spark.createDataFrame(data, AWKWARD)
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, root)
        assert out.columns == P.COLUMNS and 0 < out.count() <= len(data)
    none = spark.createDataFrame([], AWKWARD)
    assert P.lines(spark, none, root).count() == 0 and P.decontaminate(spark, none, root).count() == 0 and P.packing(spark, none, root).count() == 0
    lined = [x.text for x in P.lines(spark, docs, root).collect()]
    assert any(t and t.startswith("own line of the second row") for t in lined) and "another text without an id, quite its own" in lined
    assert {x.doc_id for x in P.decontaminate(spark, docs, root).collect()} == {None, 7, 20, 21}
    assert P.packing(spark, docs, root).count() >= len(data)


def test_release_leaves_other_results_alone(spark, corpus):
    """A lazy result that a caller holds outlives the stages of the pipeline."""
    from kindredge.llm.near_dedup import near_duplicates

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    held = near_duplicates(docs)
    P.lines(spark, docs.selectExpr("*", "'en' lang", "'s' source", "1L n_chars"), corpus[0]).count()
    P.decontaminate(spark, docs.selectExpr("*", "'en' lang", "'s' source", "1L n_chars"), corpus[0]).count()
    assert held.filter("kept").count() == 2


def test_workers_give_back_what_a_task_took(monkeypatch):
    import pathlib
    import re

    from kindredge.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert list(common.lean(lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3] and seen == ["back"]
    stopped = common.lean(lambda batches: (x for x in batches))([1, 2])
    next(stopped)
    stopped.close()
    assert seen == ["back"] * 2
    for name in ("quality", "near_dedup", "decontaminate", "packing"):  # the stages of the pipeline that have Python workers
        text = (pathlib.Path(common.__file__).parent / f"{name}.py").read_text()
        assert re.findall(r"\.mapInArrow\((.{5})", text) and set(re.findall(r"\.mapInArrow\((.{5})", text)) == {"lean("}
