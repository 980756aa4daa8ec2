import importlib.util
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindredge import catalog, config, oracle
from kindredge.operators import blocking, evidence, features, model, normalize, synth
from kindredge.plans import linkage
from kindredge.plans.store import save
from kindredge.sources import records

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", ["er_norm", "er_final", "er_block_keys", "er_top_candidates", "er_number_features", "er_competition", "er_decide", "er_slices", "er_pair_report", "er_evidence", "er_oracle_ceiling"])
def test_same_rows_as_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    cur = duck.execute(oracle.statements()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_rarity_of_long_texts_same_rows_as_sql(spark, sf, tmp_path):
    """Names and addresses of more than six words that differ after the sixth only: code and SQL read them to their end."""
    con = duckdb.connect()
    long = {"customer": "SELECT * FROM {} WHERE c_custkey <= 40", "part": "SELECT * REPLACE (concat('amber birch cedar dune ember flint grove ', p_partkey % 9, 'x ', p_name) AS p_name, 'PROMO' AS p_type) FROM {} WHERE p_partkey <= 40",
            "nation": "SELECT * REPLACE (concat('great old north river hill lake bay ', n_name) AS n_name) FROM {}", "region": "SELECT * FROM {}"}
    for t, q in long.items():
        con.execute(f"COPY ({q.format(f"'{sf}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    got = catalog.queries()["er_rarity"](spark, str(tmp_path))
    cur = con.execute(oracle.statements()["er_rarity"])
    had = got.collect()
    assert rows(got.columns, [tuple(r) for r in had]) == rows([c[0] for c in cur.description], cur.fetchall())
    # the first six words are those of every record: alone they weigh nothing and have no share
    assert len(had) > 40 and all(any(x is not None and x < 1 for x in (r[f"{n}_idf_cov1"] for r in had)) for n in ("nm", "ad"))


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in entry.queries() if n.startswith("er_")} - set(entry.oracle_sql()) == {"er_url_segments", "er_string_scores", "er_noise_rates", "er_synthetic", "er_trained"}


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_text_round_trip(spark, tmp_path):
    d = tmp_path / "train"
    d.mkdir()
    for n in (1, 2, 3):
        (d / f"train_source{n}.tsv").write_text(f'entity_id\tbusiness_name\tbusiness_address\tcountry\nS{n}-1\t"Q" Inc\t\tUS\n', encoding="utf-8")
    s1, cand = records.load_split(spark, str(tmp_path), "train")
    assert [tuple(r) for r in s1.collect()] == [("S1-1", '"Q" Inc', "", "US")] and cand.count() == 2
    lists = records.match_lists(s1.union(spark.createDataFrame([("S1-2", "x", "", "US")], s1.schema)), spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1")], "s1_id string, c_id string"))
    records.write_lists(lists, str(tmp_path / "out"))
    back = spark.read.schema(records.TRUTH).option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).na.fill("")
    assert {tuple(r) for r in back.collect()} == {("S1-1", "S2-1,S3-1"), ("S1-2", "")}
    assert records.unknown_ids(records.truth_pairs(back), s1, cand).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[blocking]\ntop = 3\n[model]\nexclude = ['votes']\n")
    c = config.load(str(tmp_path / "c.toml"))
    assert c.blocking.top == 3 and c.blocking.key_cap == 150 and c.model.exclude == ("votes",)
    with pytest.raises(ValueError):
        model.role(F.lit("a"), config.Split(0.5, 0.5, 0.5))


def test_floor_is_tuned_on_the_decision_over_all_entities(spark):
    """A record that an entity outside VALID owns counts for no VALID entity, whatever the floor."""
    role = {r.id: r.role for r in spark.range(200).select(F.concat(F.lit("S1-"), "id").alias("id")).select("id", model.role(F.col("id"), config.Split()).alias("role")).collect()}
    held, other = (min(k for k, v in role.items() if (v == "VALID") == valid) for valid in (True, False))
    s1 = spark.createDataFrame([(held,), (other,)], "entity_id string")
    scored = spark.createDataFrame([(held, "S2-1", 0.6, 0), (other, "S2-1", 0.9, 0), (held, "S3-2", 0.7, 0)], "s1_id string, c_id string, p double, rank int")
    truth = spark.createDataFrame([(other, "S2-1"), (held, "S3-2")], "s1_id string, c_id string")
    assert tuple(linkage.tuned_floor(scored, truth, s1).first()) == (0.0, 1.0)


def test_three_stage_model(spark, sf, tmp_path):
    """Stages, tuned floor, systems by slices, models written and read."""
    r, cfg = catalog.Run(spark, sf), config.Config(model=config.Model(trees=3, depth=3))
    d = save(linkage.labelled(r.features(True), r.truth), "features")
    scored = save(linkage.three_stages(d, r.final[1], cfg, save, path=str(tmp_path / "models")), "scored")
    assert scored.count() == d.count() and {"p1", "p2", "p3", "p", "coh_nm", "s3_e_max"} <= set(scored.columns)
    x = scored.agg(F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("a"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("b"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert x.a > 0.8 > 0.4 > x.b and 0 <= x.lo <= x.hi <= 1
    floor = linkage.tuned_floor(scored, r.truth, r.records[0], cfg.split).first()
    assert 0 <= floor.floor <= 0.5 and 0.5 < floor.f <= 1
    got = {(v.system.split()[0], v.slice, v.value): v for v in linkage.systems(scored, r.truth, r.records[0], r.final[1], cfg, "TEST", floor.floor).collect()}
    assert {k[0] for k in got} == {"B0", "B1", "B2", "B3", "FINAL"} and {k[1] for k in got} >= {"ALL", "country", "candidates", "look_alike"}
    assert got["FINAL", "ALL", ""].f >= got["B0", "ALL", ""].f and got["FINAL", "ALL", ""].entities == sum(v.entities for k, v in got.items() if k[:2] == ("FINAL", "country"))
    fitted = model.load_model(str(tmp_path / "models" / "stage1"))
    again = model.predict(fitted, d, "q").agg(F.avg("q")).first()[0]
    assert 0 < again < 1 and sum(model.importance(fitted).values()) == pytest.approx(1)
    with pytest.raises(KeyError):
        model.predict(fitted, d.drop("votes"))


def test_extra_blocks_train_only(spark, sf):
    """A synthetic and a pseudo-labelled block train beside the real pairs; routed scores use them by country."""
    r, cfg = catalog.Run(spark, sf), config.Config(model=config.Model(trees=2, depth=3, stages=2))
    real = r.records[0].drop("num")
    made = synth.generate(real, synth.Profile(rates={"typo": 0.3, "reorder": 0.3}), max_entities=60)
    two = save(normalize.finalize(normalize.base(made.drop("origin_id", "is_decoy"))), "made")
    pairs = features.pair_features(blocking.generate(r.final[0], two), r.final[0], two)
    truth = made.filter("not is_decoy").select(F.col("origin_id").alias("s1_id"), F.col("entity_id").alias("c_id"))
    extra = save(linkage.labelled(pairs, truth), "extra")
    assert extra.filter("y = 1").count() > 30
    d = save(linkage.labelled(r.features(True), r.truth), "features")
    base, other = (save(linkage.three_stages(d, r.final[1], cfg, save, extra=e, extra_cand=None if e is None else two), "scored") for e in (None, extra))
    assert base.count() == other.count() == d.count() and other.filter("c_id like '%SYN%'").count() == 0
    mixed = linkage.routed(base, other, ["ASIA"], 0.5)
    j = mixed.select("s1_id", "c_id", "country", "p").join(base.select("s1_id", "c_id", F.col("p").alias("b")), ["s1_id", "c_id"]).join(other.select("s1_id", "c_id", F.col("p").alias("o")), ["s1_id", "c_id"])
    assert all(abs(x.p - (x.b if x.country == "ASIA" else (x.b + x.o) / 2)) < 1e-9 for x in j.collect())
    table = model.compare(d.filter("y is not null"), linkage.STAGE1, d, cfg.model, ("logistic", "gbt")).collect()
    assert [x.kind for x in table] == ["logistic", "gbt"] and all(x.auc > 0.8 and x.log_loss < 0.7 for x in table)


def test_command_line_runs_all_steps(spark, sf, tmp_path):
    from kindredge.__main__ import run

    s1, cand = records.derived(spark, sf)
    raw = ["entity_id", "business_name", "business_address", "country"]
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        for n, d in ((1, s1), (2, cand.filter("entity_id like 'S2%'")), (3, cand.filter("entity_id like 'S3%'"))):
            rows = [tuple(x) for x in d.select(*raw).collect()]
            (tmp_path / split / f"{split}_source{n}.tsv").write_text("\t".join(raw) + "\n" + "".join("\t".join(x) + "\n" for x in rows), encoding="utf-8")
    lists = records.match_lists(s1, cand.filter("not is_decoy").select(F.col("origin_id").alias("s1_id"), F.col("entity_id").alias("c_id"))).collect()
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{a}\t{b}\n" for a, b in lists), encoding="utf-8")
    cfg = config.Config(model=config.Model(trees=2, depth=3, stages=2), normalise=config.Normalise(component_min_count=5))
    took = run(spark, "all", str(tmp_path), str(tmp_path / "work"), cfg)
    assert list(took) == ["prepare", "block", "train", "validate", "test", "predict"]
    out = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "work" / "output" / "matched"))
    assert out.count() == s1.count() and out.filter("matched_entity_ids is not null").count() > 100


def test_without_training_data_operators(tmp_path):
    """The entry imports without the subpackage; an error inside it is not hidden."""
    for name in ("kindredge", "__spark_entry__.py"):
        src = os.path.join(os.path.dirname(entry.__file__), name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op')]))"]
    (tmp_path / "kindredge" / "llm" / "registry.py").write_text("import no_such_module\n") if (tmp_path / "kindredge" / "llm").is_dir() else None
    if (tmp_path / "kindredge" / "llm").is_dir():
        assert subprocess.run(ask, cwd=tmp_path, capture_output=True).returncode != 0
        shutil.rmtree(tmp_path / "kindredge" / "llm")
    assert subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True).stdout.strip() == "0"


def test_generator_and_reasons(spark, sf):
    s1, _ = records.derived(spark, sf)
    rates = catalog.er_noise_rates(spark, sf).first().asDict()
    assert len(rates) == 17 and rates["alias"] > 0 and rates["upper_name"] > 0 and rates["empty_addr"] > 0
    row = dict(nm_tset=90.0, selected=False, rival_id=None, num_p_in=0.0, num_logdiff=2.0, num_frac1=0.0, num_frac2=0.0, num_drop=0.0, tok_diff=1, c_f_pseudo=0, c_f_url=0, c_f_script=0, c_f_empty_addr=0, c_f_alias=0, loc_overlap=None, e_sib=1, s1_addr="12 Willow Road", c_addr="19 Willow Road")
    schema = ", ".join(f"{k} {'boolean' if k == 'selected' else 'string' if k in ('rival_id', 's1_addr', 'c_addr') else 'double' if isinstance(v, float) or v is None else 'int'}" for k, v in row.items())
    got = spark.createDataFrame([tuple(row.values())], schema).select(evidence.reasons().alias("r")).first().r
    assert got[0] == "- number 12 is absent, the record has 19 instead: the sign of a look-alike" and any("further word" in x for x in got)
    row |= dict(selected=True, num_p_in=1.0, num_frac1=0.5, nm_tset=96.0, tok_diff=0, c_addr="12 Willow Road")
    got = spark.createDataFrame([tuple(row.values())], schema).select(evidence.reasons().alias("r")).first().r
    assert got == ["+ the record has the house number", "- only 50% of the address's numbers are there", "+ same name", "+ beats 1 look-alikes of this entity by the house number"]


@pytest.mark.skipif(importlib.util.find_spec("kindredge.llm") is None, reason="the subpackage is optional")
def test_library_does_not_import_the_subpackage():
    root = os.path.dirname(catalog.__file__)
    for folder, _, names in os.walk(root):
        if "llm" not in os.path.relpath(folder, root).split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n), encoding="utf-8").read()
                    assert ".llm" not in text and "import llm" not in text


def test_blocking_by_numbers_keeps_ids_and_ties(spark):
    """Lists of blocking hold longs, in the order of the ids ("S1-10" before "S1-9"), so ties fall as among the ids."""
    ids = [f"S1-{i}" for i in range(1, 40)]
    s1 = spark.createDataFrame([(i, "red bolt", "12 small street, france", "EUROPE") for i in ids], records.RAW).repartition(7)
    cand = spark.createDataFrame([(f"S2-{i}", "red bolt", "12 small street, france", "EUROPE") for i in range(5)], records.RAW)
    one, two = (save(linkage.prepared(d), "sides") for d in (s1, cand))
    numbers = blocking.numbered(one)
    assert [r.entity_id for r in numbers.orderBy("no").collect()] == sorted(ids) and dict(numbers.dtypes)["no"] == "bigint"
    got = {(r.c_id, r["rank"], r.s1_id, r.votes) for r in blocking.generate(one, two).collect()}
    slow = blocking.top_candidates(blocking.votes(blocking.keys(one, source1=True), blocking.keys(two), 150))
    assert got == {(r.c_id, r["rank"], r.s1_id, r.votes) for r in slow.collect()} and {x[2] for x in got if x[1] == 0} == {"S1-1"} and {x[2] for x in got if x[1] == 1} == {"S1-10"}


def test_lists_go_to_as_many_tasks_as_records_need(spark, monkeypatch):
    s1 = spark.createDataFrame([(f"S1-{i}", "red bolt", f"{i} small street, france", c) for i in range(30) for c in ("EUROPE", None)], records.RAW)
    cand = spark.createDataFrame([(f"S2-{i}", "red bolt", f"{i} small street, france", c) for i, c in zip(range(25), ["EUROPE", None] * 13)], records.RAW)
    one, two = (save(linkage.prepared(d), "sides") for d in (s1, cand))
    monkeypatch.setattr(blocking, "RECORDS", 4)
    d = blocking.generate(one, two)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(c_id#\d+, 7\), REPARTITION_BY_NUM", plan) and "WindowGroupLimit" in plan
    slow = blocking.top_candidates(blocking.votes(blocking.keys(one, source1=True), blocking.keys(two), 150)).select(d.columns)
    assert d.count() > 25 and not d.exceptAll(slow).head(1) and not slow.exceptAll(d).head(1)


def test_no_table_that_grows_is_broadcast(spark, sf):
    """Spark's estimate of compressed bytes may fall under its threshold at any size: every join of two growing tables is by
    sorting. Only nations, regions, four literals and the vocabulary are left to the estimate."""
    r = catalog.Run(spark, sf)
    plans = [*r.records, blocking.generate(*r.final), r.features(), r.decided, r.per_entity, r.evidence, r.missed, features.coherence(r.scored, r.final[1], scores=False),
             records.match_lists(r.records[0], r.selected), linkage.grid_floor(r.scored, r.truth, r.records[0])]
    joins = [line for d in plans for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"\bJoin \w+, .*=", line)]
    free = [x for x in joins if "strategy=" not in x and not re.search(r"n_nationkey|r_regionkey|token#|\bv#", x)]
    assert len(joins) > 30 and not free, free
