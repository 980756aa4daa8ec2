import random
from collections import Counter

import numpy as np

from kindredge.llm import decontaminate as D
from kindredge.llm.common import word_hashes
from kindredge.llm.decontaminate import Index, clean_run, contaminated, fingerprints, running_bits
from tests.llm.test_near_dedup import WORD, lower


def similarity(a, b):
    x, y = (Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(docs, items, least=0.8):
    """(doc, item) -> the best similarity of any window of the item's length."""
    out = {}
    for d, text in docs:
        w = WORD.findall(lower(text))
        for i, item in items:
            v = WORD.findall(lower(item))
            if len(v) >= 5:
                s = max((similarity(w[a:a + len(v)], v) for a in range(max(1, len(w) - len(v) + 1))), default=0)
                if s >= least:
                    out[d, i] = s
            elif v and any(w[a:a + len(v)] == v for a in range(len(w) - len(v) + 1)):
                out[d, i] = 1.0
    return out


def test_fingerprints_are_majorities():
    words, _ = word_hashes([b" ".join(b"w%d" % (i * i % 50) for i in range(120))])
    lanes = running_bits(words)
    for size in (2, 7, 40, 64):
        got = fingerprints(lanes, size)
        assert len(got) == len(words) - size + 1
        sums = np.diff(lanes[:, [3, 3 + size - 1]].astype(object), axis=1)
        want = 0
        for j in range(8):
            for lane in range(8):
                count = (int(sums[j, 0]) % (1 << 64) >> (8 * lane)) & 255
                want |= (2 * count > size - 1) << (8 * lane + j)
        assert int(got[3]) == want


def test_multi_index_misses_nothing_within_the_radius():
    r = np.random.default_rng(5)
    items = [(i, " ".join(f"t{x}" for x in r.integers(0, 900, 40))) for i in range(200)]
    index = Index(items, 5)
    text = " ".join(f"t{x}" for x in r.integers(0, 900, 3000)) + " " + " ".join(items[7][1].split()[:30]) + " x"
    words, _ = word_hashes([text.encode()])
    for size, c in index.classes.items():
        lanes = running_bits(words)
        fp = fingerprints(lanes, size)
        fp[:500] = c["fp"][r.integers(0, len(c["fp"]), 500)] ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 10), replace=False)) for _ in range(500)], np.uint64)
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ c["fp"][None, :]) <= 7), strict=True)}
        original = D.fingerprints
        D.fingerprints = lambda lanes, n, fp=fp: fp
        got = set(zip(*(x.tolist() for x in index.candidates(lanes, size)), strict=True))
        D.fingerprints = original
        assert got == want and len(want) > 300


def test_guards_leave_a_window_untouched():
    """Over lengths and edits: a passage within the similarity keeps a clean run as long as promised."""
    r = random.Random(2)
    for n in [5, 9, 13, 20, 30, 49, 60, 90, 150, 400]:
        item = [f"a{i}" for i in range(n)]
        for _ in range(300):
            text = list(item)
            for _ in range(r.randint(0, max(1, n // 25))):
                text[r.randrange(n)] = "edited"
            if similarity(text, item) >= 0.8:
                longest = max(len(x) for x in " ".join("|" if t == "edited" else "x" for t in text).replace(" ", "").split("|"))
                assert longest >= clean_run(n, 5, 0.8), (n, text)


def test_many_items_few_candidates():
    """Postings: what is compared grows with the matches, not with windows times items."""
    r = np.random.default_rng(4)
    items = [(i, " ".join(f"q{x}" for x in r.integers(0, 20_000, 40))) for i in range(5000)]
    index = Index(items, 5)
    text = " ".join(f"q{x}" for x in r.integers(0, 20_000, 4000)) + " " + items[4321][1]
    words, bounds = word_hashes([text.encode()])
    assert [(index.items[i][0], first, s) for _, i, first, s in index.places(words, bounds)] == [(4321, 4000, 1.0)]
    assert sum(len(index.candidates(running_bits(words), size)[0]) for size in index.classes) < 500


def test_against_brute_force(spark):
    r = random.Random(6)
    word = lambda: "the of and to in".split()[r.randrange(5)] if r.random() < 0.4 else f"w{r.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(r.randint(12, 60)))) for i in range(30)] + [(90, "Short one here"), (91, None), (92, "")]
    docs = []
    for d in range(120):
        text = [word() for _ in range(r.choice([10, 60, 200]))]
        if d % 2:
            passage = r.choice(items[:30])[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                passage[r.randrange(len(passage))] = "edited"
            at = r.randrange(len(text))
            text[at:at] = [x.upper() for x in passage]
        docs.append((d, "\n".join(text)))
    docs += [(500, "a short ONE here."), (501, "a short ONE\there"), (502, None), (503, ""), (None, items[0][1]), (504, items[1][1]), (504, items[1][1]), (505, "x " * 50000 + items[2][1])]
    frame = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, item_id string, similarity int")
    got = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id): x.similarity for x in got}
    want = brute(docs[:-1], items) | {(505, 2): 1.0}
    assert (501, 90) in found and (500, 90) not in found and (None, 0) in found and sum(x.doc_id == 504 for x in got) == 2
    for key, s in found.items():
        assert abs(want[key] - s) < 1e-9
    assert found.keys() == want.keys() and any(s < 0.9 for s in want.values())


def test_blocks_of_items(spark):
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randint(0, 999)}" for _ in range(20))) for i in range(23)]
    docs = [(i, f"before {t} after") for i, t in items]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=5).collect()
    assert sorted((x.doc_id, x.item_id, x.start_word) for x in got) == [(i, i, 1) for i in range(23)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(none, items).count() == 0
    assert contaminated(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items).count() == 0
