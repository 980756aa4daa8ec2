"""Column functions and operators against slow Python versions, on generated records."""

import random
import re
from itertools import combinations, product
from math import expm1, log

import pytest
from pyspark.sql import functions as F

from kindredge.functions import similarity as S
from kindredge.functions import text as T
from kindredge.operators import blocking, decide, features, lexicon, metrics, normalize, synth
from kindredge.operators.evidence import demo, number_diff

RAW = "entity_id string, business_name string, business_address string, country string"
WORDS = "harbor lantern quartz willow cobalt meadow copper falcon ember juniper".split()


def collected(spark, rows, lex=None):
    return {r.entity_id: r for r in normalize.finalize(normalize.base(spark.createDataFrame(rows, RAW)), lex).collect()}


@pytest.mark.parametrize("marker", ["formerly known as", "fka", "d/b/a", "DBA:", "trading as", "aka"])
def test_every_alias_marker_leaves_the_real_name(spark, marker):
    d = collected(spark, [("a", f"Lantern {marker} Quartz Harbor", "", "X"), ("b", "Lantern Quartz Harbor", "", "X")])
    assert d["a"].name_core == "quartz harbor" and d["a"].f_alias and not d["b"].f_alias


def test_legal_words_go_unless_nothing_is_left(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((str(i), " ".join(r.sample(WORDS, r.randint(0, 2)) + r.sample(T.LEGAL, r.randint(1, 2))).title(), "", "X"))
    for i, row in collected(spark, rows).items():
        words = rows[int(i)][1].lower().split()
        kept = [w for w in words if w not in T.LEGAL] or words
        assert row.name_core.split() == kept and row.name_nospace == "".join(kept) and row.f_empty_addr


def test_noise_in_names(spark):
    d = collected(spark, [("junk", "*** Willow Cobalt", "", "X"), ("url", "www.willowcobalt.net", "", "X"), ("id", "Willow (ID: 77) Cobalt | page 3", "", "X"), ("dots", "W.C. Willow & Cobalt", "", "X"), ("marks", "Wíllôw Çobalt", "", "X"), ("none", None, None, "X")])
    assert d["junk"].f_junk and d["junk"].name_core == "willow cobalt" and d["url"].f_url and d["url"].name_nospace == "willowcobalt"
    assert d["id"].name_core == "willow cobalt" and d["dots"].name_full == "wc willow and cobalt" and d["marks"].name_full == "willow cobalt" and d["none"].name_full == ""


def test_native_tokens_are_looked_up(spark):
    native = {"κοβαλτ": "cobalt", "φαλκον": "falcon"}
    d = collected(spark, [("a", "Κοβαλτ φαλκον ουιλλου", "", "X")], lexicon.Lexicon(translit=native))["a"]
    assert d.f_script and d.name_full == "cobalt falcon ουιλλου"
    many = {f"w{i}": f"v{i}" for i in range(500)}
    got = spark.createDataFrame([(f"w{i}",) for i in range(0, 700, 7)], "w string").select("w", T.map_values(F.col("w"), many).alias("v")).collect()
    assert all(x.v == many.get(x.w, x.w) for x in got)


def test_numbers_of_addresses(spark):
    r = random.Random(4)
    rows = [(str(i), "x", "".join(r.choice(["0", "12", "400", " ", ",", "-", "b", "98765432101"]) for _ in range(r.randint(0, 14))), "X") for i in range(80)]
    for i, d in collected(spark, rows).items():
        runs = [int(x.lstrip("0")[-9:] or 0) for x in re.findall("[0-9]+", rows[int(i)][2])]
        assert d.nums == runs[:6] and d.n_nums == len(runs)


def test_places_and_short_forms(spark):
    lex = lexicon.Lexicon(components={"X|old name": "new name", "Y|old name": "elsewhere"}, localities=["X|new name"])
    d = collected(spark, [("1", "x", "9 Willow Avenue, Old Name", "X"), ("2", "x", "9 Willow Av, New-Name", "X"), ("3", "x", "9 Willow Ave, Old Name", "Y")], lex)
    assert d["1"].addr_norm == d["2"].addr_norm == "9 willow ave new name" and d["1"].localities == ["X|new name"] and d["3"].addr_norm == "9 willow ave elsewhere" and not d["3"].localities
    for short, forms in T.SHORT_FORMS.items():
        for form in forms.split():
            assert short in {*forms.split(), short} and form
    every = [(f, "x", f"{f} willow", "X") for forms in T.SHORT_FORMS.values() for f in forms.split()]
    want = {f: short for short, forms in T.SHORT_FORMS.items() for f in forms.split()}
    assert all(d.addr_norm == " ".join(w for w in (want[f], "willow") if w not in T.ADDR_STOP) for f, d in collected(spark, every).items())


def test_components_are_learned_from_pairs(spark):
    r = random.Random(6)
    place = {f"town {w}": f"{w}ville" for w in WORDS[:4]}
    rows = [(i, r.choice(list(place))) for i in range(240)]
    one = normalize.base(spark.createDataFrame([(f"S1-{i}", "x", f"{i} Road, {t}", "X") for i, t in rows], RAW))
    two = normalize.base(spark.createDataFrame([(f"S2-{i}", "x", f"{i} Road, {place[t] if r.random() < 0.9 else t}", "X") for i, t in rows], RAW))
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i, _ in rows], "s1_id string, c_id string")
    assert {(x.comp2, x.comp1) for x in lexicon.learn_components(one, two, pairs).collect()} == {(f"X|{v}", f"X|{k}") for k, v in place.items()}
    lex = lexicon.fit(one, two, pairs)
    assert set(lex.components) == {f"X|{v}" for v in place.values()} and set(lex.localities) == {f"X|{t}" for t in place}


def test_votes_against_all_pairs(spark):
    """Shared keys, counted by hand, with a cap that bites."""
    r = random.Random(8)
    rows = lambda p, n: [(f"{p}{i}", " ".join(r.sample(WORDS[:6], 2)), f"{r.randint(1, 9)} {r.choice(WORDS)} road", r.choice("XY")) for i in range(n)]
    final = lambda x: normalize.finalize(normalize.base(spark.createDataFrame(x, RAW)))
    one, two = blocking.keys(final(rows("A", 40)), source1=True), blocking.keys(final(rows("B", 30)))
    by: dict = {}
    for x in one.collect():
        by.setdefault((x.country, x.key), set()).add(x.entity_id)
    for cap in (3, 1000):
        want: dict = {}
        for x in two.collect():
            ids = by.get((x.country, x.key), ())
            if 0 < len(ids) <= cap:
                for s in ids:
                    want[x.entity_id, s] = want.get((x.entity_id, s), 0) + log(2) / log(1 + len(ids))
        got = {(x.c_id, x.s1_id): x.votes for x in blocking.votes(one, two, cap).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    assert max(len(v) for v in by.values()) > 3


def test_number_geometry(spark):
    r = random.Random(10)
    some = lambda: [r.choice([3, 17, 71, 171, 1710, 12345, 99999]) for _ in range(r.randint(0, 3))]
    rows = [(i, some(), some()) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    for x in d.select("i", *[c.alias(n) for n, c in features.numbers(F.col("a"), F.col("b")).items()]).collect():
        _, a, b = rows[x.i]
        if not a or not b:
            assert x.num_p_in is None and x.num_logdiff is None and x.num_drop is None
            continue
        p = a[0]
        cut = lambda n: {str(p)[:n], str(p)[-n:]}
        assert x.num_p_in == (p in b) and x.num_p_first == (b[0] == p) and x.num_frac1 == sum(v in b for v in a) / len(a)
        assert round(expm1(x.num_logdiff)) == min(abs(v - p) for v in b)
        assert x.num_drop == (p >= 10 and p not in b and any(len(str(v)) < len(str(p)) and str(v) in cut(len(str(v))) for v in b))
        gone = {int(str(p)[:k] + str(p)[k + 1:]) for k in range(len(str(p)))} if p >= 10 else set()
        assert x.num_del_any == (p not in b and bool(gone & set(b)))
        big = [[v for v in z if v >= 10000] for z in (a, b)]
        assert x.num_long == (None if not all(big) else float(bool(set(big[0]) & set(big[1]))))


def test_deletions_and_homoglyphs(spark):
    ns = [0, 9, 10, 305, 99887, 123456789]
    got = spark.createDataFrame([(n,) for n in ns], "n int").select("n", T.digit_deletions(F.col("n")).alias("d")).collect()
    assert all(x.d == ([int(str(x.n)[:i] + str(x.n)[i + 1:]) for i in range(min(6, len(str(x.n))))] if x.n >= 10 else []) for x in got)
    words = ["".join(p) for p in product("a0185", repeat=3)]
    swap = str.maketrans(*T.HOMOGLYPHS)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.homoglyphs(F.col("w")).alias("x")).collect()
    assert all(x.x == (x.w.translate(swap) if "a" in x.w and set(x.w) != {"a"} else x.w) for x in got)


def test_segmentation_is_cheapest():
    """Against all ways to cut short words."""
    r, vocab = random.Random(3), {"ab", "abc", "bca", "cab", "caa", "bb"}
    for _ in range(300):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        best = None
        for cuts in (c for k in range(len(word)) for c in combinations(range(1, len(word)), k)):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]
            if all(len(p) == 1 or p in vocab for p in parts):
                cost = sum(1.5 if len(p) == 1 else 1 for p in parts)
                best = cost if best is None else min(best, cost)
        pieces, covered = T.segment_word(word, vocab)
        assert all(p in vocab for p in pieces) and covered == sum(map(len, pieces))
        assert len(pieces) + 1.5 * (len(word) - covered) == best


def test_closed_up_names_are_cut(spark):
    lex = lexicon.Lexicon(vocab=WORDS)
    d = collected(spark, [("1", "quartzlantern.com", "", "X"), ("2", "xxyyzzquux.com", "", "X"), ("3", "ember.net", "", "X")], lex)
    assert d["1"].name_tokens == ["quartz", "lantern"] and d["2"].name_tokens == ["xxyyzzquux"] and d["3"].name_tokens == ["ember"]


def test_rivals(spark):
    r = random.Random(12)
    rows = [(f"s{r.randint(0, 6)}", f"c{i % 15}", r.randint(1, 99) / 100, r.randint(0, 1)) for i in range(40)]
    rows = list({x[:2]: x for x in rows}.values())
    for x in features.competition(spark.createDataFrame(rows, "s1_id string, c_id string, p double, sib int")).collect():
        for side, at in (("e", 0), ("c", 1)):
            group = [y for y in rows if y[at] == (x.s1_id, x.c_id)[at]]
            ps = sorted((y[2] for y in group), reverse=True)
            others = sorted((y[2] for y in group if y[:2] != (x.s1_id, x.c_id)), reverse=True)
            assert x[f"{side}_rank"] == ps.index(x.p) + 1 and x[f"{side}_n"] == len(group) and x[f"{side}_max"] == ps[0]
            assert abs(x[f"{side}_margin"] - (x.p - (others[0] if others else 0))) < 1e-8
        assert x.e_sib == sum(y[3] for y in rows if y[0] == x.s1_id)


def test_anchors(spark):
    cand = spark.createDataFrame([(f"c{i}", WORDS[i % 3], WORDS[i % 2] + " road", [i % 4] if i % 5 else []) for i in range(12)], "entity_id string, name_core string, addr_alpha string, nums array<int>")
    rows = [(f"s{i % 4}", f"c{i}", ((i * 37) % 50) / 50) for i in range(12)]
    got = {x.c_id: x for x in features.coherence(spark.createDataFrame(rows, "s1_id string, c_id string, p double"), cand).collect()}
    for s, c, _ in rows:
        others = sorted(((-p, x) for t, x, p in rows if t == s and x != c))
        assert got[c].coh_p == -others[0][0] and got[c].anchor_id == others[0][1]
        i, j = int(c[1:]), int(others[0][1][1:])
        assert (got[c].coh_nm == 100) == (i % 3 == j % 3) and got[c].coh_num == (float(i % 4 == j % 4) if i % 5 and j % 5 else None)


def test_lists_maximise_the_expected_score(spark):
    r = random.Random(5)
    rows = [(f"s{i % 9}", f"c{i:02}", r.randint(1, 99) / 100) for i in range(40)]
    got = {(x.s1_id, x.c_id) for x in decide.select(spark.createDataFrame(rows, "s1_id string, c_id string, p double")).filter("selected").collect()}
    for s in {x[0] for x in rows}:
        own = sorted((-p, c) for t, c, p in rows if t == s)
        total, none = -sum(p for p, _ in own), 1.0
        for p, _ in own:
            none *= 1 + p
        value = [1.25 * -sum(p for p, _ in own[:k]) / (k + 0.25 * total) for k in range(1, len(own) + 1)]
        best = max(range(len(own)), key=lambda k: (round(value[k], 12), -k))
        want = {(s, c) for _, c in own[: best + 1]} if value[best] > none else set()
        assert {x for x in got if x[0] == s} == want


def test_owner_and_fill(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "s1_id string, c_id string, p double")
    r = random.Random(2)
    rows = [(f"s{a}", f"c{b}", r.randint(1, 9) / 10) for a in range(5) for b in range(7)]
    got = {x.c_id: x.s1_id for x in decide.owner(pairs(rows)).collect()}
    assert got == {c: min((-p, s) for s, x, p in rows if x == c)[1] for c in {x[1] for x in rows}}
    d = spark.createDataFrame([("x", "S3-9", 0.8, True), ("x", "S2-4", 0.7, False), ("x", "S2-5", 0.65, False), ("y", "S2-4", 0.75, False), ("y", "S3-1", 0.9, True), ("z", "S2-6", 0.9, True), ("z", "S3-8", 0.3, False)], "s1_id string, c_id string, p double, selected boolean")
    assert {(x.s1_id, x.c_id) for x in decide.fill(d, least=0.5).filter("selected").collect()} == {("x", "S3-9"), ("x", "S2-5"), ("y", "S3-1"), ("y", "S2-4"), ("z", "S2-6")}


def test_entity_scores(spark):
    r = random.Random(7)
    two = lambda rows: spark.createDataFrame(rows, "s1_id string, c_id string")
    truth, said = ([(f"s{i}", f"c{j}") for i in range(12) for j in range(4) if r.random() < q and i] for q in (0.4, 0.5))
    got = metrics.per_entity(two(said), two(truth), spark.createDataFrame([(f"s{i}",) for i in range(12)], "s1_id string")).collect()
    for x in got:
        a, b = ({c for s, c in z if s == x.s1_id} for z in (said, truth))
        p, q = (len(a & b) / len(a) if a else 0), (len(a & b) / len(b) if b else 0)
        want = 1.0 if not a and not b else 1.25 * p * q / (0.25 * p + q) if p and q else 0.0
        assert abs(x.f - want) < 1e-8
    assert len(got) == 12


def test_rarity_shares(spark):
    r = random.Random(9)
    bags = [[r.choice(WORDS[:7]) for _ in range(r.randint(0, 4))] for _ in range(30)]
    s1 = spark.createDataFrame([(str(i), b) for i, b in enumerate(bags[:20])], "entity_id string, name_tokens array<string>")
    two = spark.createDataFrame([(str(i), b) for i, b in enumerate(bags[20:])], "entity_id string, name_tokens array<string>")
    table = features.idf(s1, "name_tokens")
    idf = {w: log(20 / sum(b.count(w) for b in bags[:20])) for w in {w for b in bags[:20] for w in b}}
    weight = lambda w: idf.get(w, max(idf.values()))
    a = features.with_idf(s1, table, "name_tokens", "x").select(F.col("entity_id").alias("i"), F.col("x").alias("a"))
    b = features.with_idf(two, table, "name_tokens", "y").select(F.col("entity_id").alias("j"), F.col("y").alias("b"))
    for x in a.crossJoin(b).select("i", "j", *[c.alias(n) for n, c in features.rarity(F.col("a"), F.col("b"), "nm").items()]).collect():
        one, other = bags[int(x.i)], bags[20 + int(x.j)]
        total, common = sum(map(weight, one)), [weight(w) for w in one if w in other]
        assert x.nm_cov1 is None if total <= 0 else abs(x.nm_cov1 - sum(common) / total) < 1e-8
        assert abs(x.nm_rare - max(common, default=0)) < 1e-8


def test_rarity_reads_lists_to_their_end(spark):
    """Lists longer than six tokens, with repeats and words that source 1 lacks, against plain loops."""
    r = random.Random(4)
    bags = [[f"w{r.randint(0, 29 if i < 12 else 34)}" for _ in range(r.randint(7, 40))] for i in range(20)]
    kind = "entity_id string, name_tokens array<string>"
    s1, two = (spark.createDataFrame([(str(i), bags[i]) for i in part], kind) for part in (range(12), range(12, 20)))
    table = features.idf(s1, "name_tokens")
    idf = {w: log(12 / sum(b.count(w) for b in bags[:12])) for w in {w for b in bags[:12] for w in b}}
    weight = lambda w: idf.get(w, max(idf.values()))
    a, b = (features.with_idf(d, table, "name_tokens", n).select(F.col("entity_id").alias(k), n) for d, n, k in ((s1, "x", "i"), (two, "y", "j")))
    got = a.crossJoin(b).select("i", "j", *[c.alias(n) for n, c in features.rarity(F.col("x"), F.col("y"), "nm").items()]).collect()
    assert len(got) == 12 * 8 and any(w not in idf for b in bags[12:] for w in b)
    for x in got:
        one, other = bags[int(x.i)], bags[int(x.j)]
        for share, left, right in ((x.nm_cov1, one, other), (x.nm_cov2, other, one)):
            total = sum(map(weight, left))
            assert share is None if total <= 0 else abs(share - sum(weight(w) for w in left if w in right) / total) < 1e-8
        assert abs(x.nm_rare - max((weight(w) for w in one if w in other), default=0)) < 1e-8


def test_scorers_against_slow_versions():
    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    slow = lambda a, b: 200 * table(a, b) / (len(a) + len(b)) if a or b else 100.0
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(15))) for _ in range(2))
        assert S.lcs(a, b) == table(a, b) and S.ratio(a, b) == pytest.approx(slow(a, b))
        assert S.token_sort(a, b) == pytest.approx(slow(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
        assert S.token_set(a, b) == pytest.approx(S.token_set(b, a)) and 0 <= S.token_set(a, b) <= 100
        short, long = sorted((a, b), key=len)
        if short:
            windows = {long[max(0, e - len(short)): e] for e in range(1, len(long) + len(short))}
            assert S.partial(a, b) == pytest.approx(max(slow(short, w) for w in windows))
        assert 0 <= S.jaro_winkler(a, b) <= 1 and S.jaro_winkler(a, a) == 1


def test_rates_count_what_they_say(spark):
    """Each kind of noise on pairs that have it and nothing else."""
    name, addr = "Harbor Lantern Quartz", "12 Willow Road, Meadow"
    kinds = {"pseudo": ("Zorvex", addr), "alias": (f"Onyx dba {name}", addr), "url": ("harborlantern.com", addr), "junk": (f"-- {name}", addr), "upper_name": (name.upper(), addr), "reorder": ("Lantern Harbor Quartz", addr), "drop": ("Harbor Quartz", addr),
             "add": (f"{name} Group", addr), "typo": ("Harbor Lanern Quartz", addr), "accent": ("Hàrbor Lantern Quartz", addr), "empty_addr": (name, ""), "upper_addr": (name, addr.upper()), "comp_reorder": (name, "Meadow, 12 Willow Road"), "comp_drop": (name, "12 Willow Road"),
             "num_missing": (name, "Willow Road, Meadow"), "num_inject": (name, "No 7, 12 Willow Road, Meadow"), "addr_typo": (name, "12 Wilow Road, Meadow")}
    for kind, (n, a) in kinds.items():
        got = synth.rates(spark.createDataFrame([(name, addr, n, a)], "name1 string, addr1 string, name2 string, addr2 string")).first().asDict()
        on = {k for k, v in got.items() if v}
        assert kind in on, (kind, on)
        assert on <= {kind, *({"typo"} if kind == "accent" else ()), *({"comp_drop"} if kind == "num_inject" else ())}, (kind, on)
    assert set(got) == set(synth.RATES)


def test_steps_make_the_noise_that_is_measured(spark):
    """A generator with one rate at one: that noise, seen by the measurement, and no other kind of record."""
    r = random.Random(3)
    rows = [(f"S1-{i}", " ".join(w.title() for w in r.sample(WORDS, 3)), f"{r.randint(10, 99)} {r.choice(WORDS).title()} Road, {r.choice(WORDS).title()}, Land", "X") for i in range(40)]
    s1 = spark.createDataFrame(rows, RAW)
    for kind in synth.RATES:
        p = synth.Profile(rates={kind: 1.0}, n_variants=[2], decoys_per_entity=0.0, num_prefix=["No"], pseudo=["Zorvex"], markers=["dba"])
        d = synth.generate(s1, p).join(s1.select(F.col("entity_id").alias("origin_id"), F.col("business_name").alias("name1"), F.col("business_address").alias("addr1")), "origin_id")
        got = synth.rates(d.select("name1", "addr1", F.col("business_name").alias("name2"), F.col("business_address").alias("addr2"))).first().asDict()
        assert d.count() == 80 and got[kind] > (0.2 if kind in ("typo", "addr_typo", "accent", "comp_reorder") else 0.9), (kind, got)


def test_generator(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "Harbor Lantern", f"{i + 50} Willow Road, Meadow", "X") for i in range(200)], RAW)
    p = synth.Profile(rates={"typo": 0.5, "alias": 0.2}, n_variants=[1, 2], decoys_per_entity=0.7, decoy_delta=[4])
    a, b = (sorted(tuple(x) for x in synth.generate(s1.repartition(n), p).collect()) for n in (1, 5))
    assert a == b and {x[0][:2] for x in a} == {"S2", "S3"} and len({x[0] for x in a}) == len(a)
    decoys = [x for x in a if x[5]]
    assert 0.5 < len(decoys) / 200 < 0.9 and 200 < len(a) - len(decoys) < 400
    for x in decoys:
        assert abs(int(x[2].split()[0]) - int(x[4][3:]) - 50) == 4
    assert len({x[4] for x in synth.generate(s1, p, max_entities=17).collect()}) <= 17


def test_misspelt_words(spark):
    d = spark.createDataFrame([("lantern", i) for i in range(300)] + [("ab", 1)], "w string, variant int").withColumn("origin_id", F.lit("x"))
    for x in d.select("w", synth.misspelt(F.col("w"), synth.Draw(1), "t").alias("m")).collect():
        if x.w == "ab":
            assert x.m == "ab"
        else:
            assert x.m[0] == "l" and len(x.m) in (6, 7, 8) and S.lcs(x.w, x.m) >= 6


def test_profile_round_trip(spark, tmp_path):
    s1 = spark.createDataFrame([(f"S1-{i}", f"{WORDS[i % 4].title()} Harbor LLC", f"{i} Willow Avenue, Meadow", "X") for i in range(80)], RAW)
    cand = s1.withColumn("business_address", F.concat(F.lit("No "), "business_address")).withColumn("f_pseudo", F.lit(False)).withColumn("entity_id", F.regexp_replace("entity_id", "S1", "S2"))
    per = s1.select(F.col("entity_id").alias("s1_id"), F.lit(1).alias("n"))
    shifts = spark.createDataFrame([("a", "b", 7.0), ("a", "c", 9000.0)], "s1_id string, c_id string, delta double")
    p = synth.build_profile({"typo": 0.1}, per, shifts, s1, cand, "X")
    p.save(f"{tmp_path}/p.json")
    assert synth.Profile.load(f"{tmp_path}/p.json") == p
    assert p.legal == ["llc"] and "harbor" in p.descriptors and p.num_prefix[0] == "No" and p.decoy_delta == [7] and p.n_variants == [1] * 80 and "Avenue" in p.abbrev["ave"] and p.decoys_per_entity == 0.2


def test_number_diff(spark):
    r = random.Random(4)
    rows = [("".join(r.choice(["7", "07", "12", " ", ",", "x"]) for _ in range(8)), "".join(r.choice(["7", "31", " ", ","]) for _ in range(6))) for _ in range(80)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[c.alias(n) for n, c in zip("xy", number_diff(F.col("a"), F.col("b")), strict=True)]).collect()
    for x in got:
        a, b = (list(dict.fromkeys(str(int(n)) for n in re.findall("[0-9]+", t))) for t in (x.a, x.b))
        assert x.x == [n for n in a if n not in b] and x.y == [n for n in b if n not in a]


def test_demo_selectors(spark):
    schema = "s1_id string, c_id string, selected boolean, label int, nm_tset double, num_p_in double, p double, c_f_empty_addr int, rival_id string, country string"
    rows = [("a", "1", True, 1, 95.0, 1.0, 0.9, 0, None, "X"), ("a", "2", False, 0, 95.0, 0.0, 0.6, 0, "b", "X"), ("b", "3", True, 1, 40.0, 1.0, 0.9, 1, None, "Y")]
    d = spark.createDataFrame(rows, schema)
    pick = lambda *k: [x.s1_id for x in demo(d, *k).collect()]
    assert pick("lookalike") == ["a"] and pick("branch") == ["a"] and pick("lowsim") == ["b"] and pick("empty") == ["b"] and pick("country", "X") == ["a"]


def test_calibrated_thinning(spark):
    own = spark.createDataFrame([(f"S2-syn{i}", "X") for i in range(2000)], "entity_id string, country string")
    dens = lambda v: spark.createDataFrame([("X", v)], "country string, per_entity double")
    assert 0.25 < synth.thin(own, dens(1.0), dens(1.6), dens(2.0)).count() / 2000 < 0.35
    assert synth.thin(own, dens(1.0), dens(0.5), dens(2.0)).count() == 0
