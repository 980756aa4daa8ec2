import random
import re
from itertools import combinations
from math import comb

import numpy as np

from kindredge.llm import near_dedup
from kindredge.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n string, rep string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, num=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {(i, len(s), find(i), find(i) == i) for i in sets for s in sets[i]}


def test_matches_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for group in range(12):
        base = r.choices(words, k=r.choice([3, 8, 60, 200]))
        for _ in range(r.choice([1, 2, 3, 80]) if group else 150):  # one group is larger than a leaf
            text = [w if r.random() > 0.003 else r.choice(words) for w in base]
            rows.append((n, " ".join(text).upper() if r.random() < 0.3 else "\n".join(text)))
            n += 1
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)).collect()
    assert {tuple(x) for x in got} == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (7, "x " * 200000), (8, "X " * 100000), (9, "a b"), (9, "a b"), (10, "é è ü ß ñ"), (11, "É è ü ß ñ")]
    got = near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 4, False), (9, 1, 4, False), (10, 1, 10, True), (11, 1, 11, True)])
    out = [tuple(x) for x in got.collect()]
    assert sorted(x for x in out if x[0] is not None) == want
    assert [x for x in out if x[0] is None] == [(None, 1, None, True)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def edited_copies(r, words, base, n, most):
    rows = []
    for _ in range(n):
        text = list(base)
        for at in r.sample(range(len(base)), r.randint(0, most)):
            text[at] = r.choice(words)
        rows.append(" ".join(text))
    return rows


def test_borderline_copies_keep_every_link(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    rows = list(enumerate(edited_copies(r, words, r.choices(words, k=100), 300, 3)))
    want = brute(rows)
    assert 50 < sum(x[3] for x in want) < 290
    assert {tuple(x) for x in near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)).collect()} == want


def test_large_nodes_branch(spark):
    """A group far over the leaf, whose members are only partly connected, by pivots and branching."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = edited_copies(r, words, r.choices(words, k=100), 150, 4) + edited_copies(r, words, r.choices(words, k=60), 60, 1)
    texts += [" ".join(r.choices(words, k=r.randint(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)
    want = brute(rows)
    assert {tuple(x) for x in near_duplicates(frame, leaf=24).collect()} == want


def test_rows_that_share_an_id_are_one_node(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    one, two = r.choices(words, k=120), r.choices(words, k=120)
    near = lambda x: " ".join([*x[:60], "changed", *x[61:]])
    rows = [(1, " ".join(one)), (5, near(one)), (5, " ".join(two)), (9, near(two)), (11, "a b c")]
    got = near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (5, 1), (9, 1), (11, 11)}


def test_overlaps_and_forests():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 90))) for _ in range(40)]
    got = near_dedup.overlaps(np.concatenate(sets), np.repeat(np.arange(40), [len(x) for x in sets]), 40, width=17)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (got - np.diag(np.diag(got)) == want - np.diag(np.diag(want))).all()
    linked = want > 12
    x, y = near_dedup.spanning(linked)
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        assert linked[i, j] and find(i) != find(j)
        root[find(i)] = find(j)
    assert all(find(int(i)) == find(int(j)) for i, j in zip(*np.nonzero(linked), strict=True))


def test_estimate_has_four_standard_errors():
    m = near_dedup.COORDINATES + near_dedup.EXTRA
    same = 0.85 + 0.15 / 16
    assert near_dedup.MARGIN >= 4 * (same * (1 - same) / m) ** 0.5 * 16 / 15
    lost = sum(comb(m, x) * same ** x * (1 - same) ** (m - x) for x in range(m) if (x / m - 1 / 16) * 16 / 15 < 0.85 - near_dedup.MARGIN)
    assert lost < 2e-4


def test_recall_of_the_trees():
    coordinates, q = near_dedup.COORDINATES, 1 / (0.85 * near_dedup.COORDINATES)

    def met(depth):
        total = 0
        for m in range(coordinates + 1):
            below = 1.0
            for _ in range(depth - 1):
                below = 1 - (1 - q * below) ** m
            one = 1 - (1 - q * (1 - (1 - below) ** near_dedup.COPIES)) ** m
            total += comb(coordinates, m) * 0.85 ** m * 0.15 ** (coordinates - m) * (1 - (1 - one) ** near_dedup.TREES)
        return total

    assert met(7) > 0.999 and met(15) > 0.99
