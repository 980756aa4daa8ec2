import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kindredge.llm.line_dedup import BANDS, WHOLE, Band, drop_lines, near_lines, within
from kindredge.llm.registry import op3_line_dedup

ONE = (Band("chars", 8, WHOLE, 1),)
SETS = [ONE, (Band("chars", 8, 20, 1), Band("chars", 20, WHOLE, 2)), (Band("chars", 8, 24, 1), Band("words", 4, 7, 1), Band("words", 7, WHOLE, 2))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = r.randrange(len(text) + 1), r.randrange(3)
        if kind == 0:
            text.insert(at, r.choice("ab c\u00e9"))
        elif text and kind == 1:
            text[min(at, len(text) - 1)] = r.choice("ab c\u00e9")
        elif text:
            del text[min(at, len(text) - 1)]
    return "".join(text)


def linked(a, b, bands):
    for unit, least, below, tau in bands:
        x, y = (sorted((t if unit == "chars" else t.split(" ") for t in (a, b)), key=len))
        if least <= len(x) < below and len(y) - len(x) <= tau and distance(x, y) <= tau:
            return True
    return False


def brute(rows, bands=BANDS):
    """(place, length, place of the class's first line, links) of every line; rows of one doc_id must have one text."""
    place = lambda d, i: (d is None, d or 0, i)
    lines = [(place(d, i), line) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))]
    texts = sorted({x for _, x in lines if x.strip(" \t\n\x0b\x0c\r")})
    root, links = {x: x for x in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(texts, 2):
        if linked(a, b, bands):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    first = {}
    for p, x in lines:
        if x in root:
            first[find(x)] = min(first.get(find(x), p), p)
    return sorted((p, len(x), first[find(x)] if x in root else p, links.get(x, 0)) for p, x in lines)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_edit_distance(spark, tau):
    r = random.Random(tau)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("ab \u00e9") for _ in range(r.randint(1, 90)))
        a, b = sorted((a, edited(r, a, r.randint(0, 5))), key=len)
        if a and len(b) - len(a) <= tau:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within(F.split("a", ""), F.split("b", ""), tau).alias("x")).collect()
    assert all(x.x == (distance(x.a, x.b) <= tau) for x in got)


@pytest.mark.parametrize("bands", SETS)
def test_against_brute_force(spark, bands):
    r = random.Random(len(bands))
    pool = ["".join(r.choice("abcdefgh  \u00e9") for _ in range(r.randint(6, 40))) for _ in range(25)]
    rows = [(d, "\n".join(edited(r, r.choice(pool), r.choice([0, 0, 1, 2, 4])) for _ in range(r.randint(1, 6)))) for d in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, rows[0][1]), (3, rows[3][1]), (73, "x" * 1500), (74, "x" * 1501), (75, "  \n \t"), (76, "y " * 700 + "z"), (77, "y " * 700 + "w v")]
    docs = spark.createDataFrame([(*x, "a", 1, 2, "c") for x in rows], "doc_id long, text string, line string, n int, row int, words string")
    got = near_lines(docs, bands).collect()
    place = lambda d, i: (d is None, d or 0, i)
    assert sorted((place(x.doc_id, x.line_no), x.n_chars, place(x.class_doc_id, x.class_line_no), x.n_links) for x in got) == brute(rows, bands)
    assert all(x.kept == ((x.doc_id, x.line_no) == (x.class_doc_id, x.class_line_no)) for x in got)


def test_a_changed_word_in_a_long_line(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 9)))
    rows = []
    for n in (12, 25, 60):
        line = [word() for _ in range(n)]
        for changes in (0, 1, 2, 3):
            text = list(line)
            for at in r.sample(range(n), changes):
                text[at] = "different"
            rows.append((len(rows), " ".join(text)))
    got = near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    place = lambda d, i: (False, d, i)
    assert sorted((place(x.doc_id, x.line_no), x.n_chars, place(x.class_doc_id, x.class_line_no), x.n_links) for x in got) == brute(rows)
    assert [x.kept for x in sorted(got, key=lambda x: x.doc_id)] == [True, True, True, True, True, False, True, True, True, False, True, True]


SAME = "a line that is long enough to count here"


def dropped(spark, rows, schema="doc_id long, text string, lang string", extra=("en",)):
    return [tuple(x) for x in drop_lines(spark.createDataFrame([(*x, *extra) for x in rows], schema)).collect()]


def test_dropping(spark):
    rows = [(1, f"{SAME}\nshort\n\n{SAME}x"), (2, f"short\n{SAME}"), (3, f"{SAME}\n"), (4, None), (6, ""), (None, f"own line of a document without an id\n{SAME}")]
    assert set(dropped(spark, rows)) == {(1, f"{SAME}\nshort\n", "en", False), (2, "", "en", True), (3, "", "en", True), (4, None, "en", False), (6, "", "en", False),
                                         (None, "own line of a document without an id", "en", False)}


@pytest.mark.parametrize("key", [None, 7])
def test_unique_lines_of_rows_that_share_an_id_stay(spark, key):
    rows = [(1, SAME), (key, f"{SAME}\nfirst row's own line"), (key, "a unique line that no other document has at all\nmore"), (key, "a unique line that no other document has at all\nmore")]
    got = sorted(dropped(spark, rows), key=str)
    assert sorted(x[1] for x in got if x[0] == key) == ["a unique line that no other document has at all\nmore"] * 2 + ["first row's own line"]


def test_names_that_clash(spark):
    schema = "doc_id long, text string, gone string, row int, whole int, `line no` int, lost int, emptied int"
    got = drop_lines(spark.createDataFrame([(1, SAME, "g", 1, 2, 3, 4, 5), (2, SAME, "h", 1, 2, 3, 4, 5)], schema))
    assert got.columns == ["doc_id", "text", "gone", "row", "whole", "line no", "lost", "emptied"]
    assert {tuple(x) for x in got.collect()} == {(1, SAME, "g", 1, 2, 3, 4, False), (2, "", "h", 1, 2, 3, 4, True)}


def test_many_lines_that_go(spark):
    lines = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(20000)]
    got = dict(x[:2] for x in dropped(spark, [(1, "\n".join(lines[::3])), (2, "\n".join(lines))]))
    assert got[2] == "\n".join(x for i, x in enumerate(lines) if i % 3)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_lines(none).count() == 0 and drop_lines(none).count() == 0


def test_short_repeats_are_one_class(spark, tmp_path):
    rows = [(1, "Les.\nown"), (2, "Les."), (3, "Les\nown")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.line_no): (x.class_doc_id, x.class_line_no, x.kept) for x in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 1): (1, 1, True), (2, 0): (1, 0, False), (3, 0): (3, 0, True), (3, 1): (1, 1, False)}


def test_one_character_parts_no_line_by_its_length(spark):
    """One edit links lines of 32 characters at any length: few long words, or a blank put into a word of many."""
    few, many = " ".join(f"{i}{'abcdefghijklm' * 2}" for i in range(6)), " ".join(f"word{i}" for i in range(30))
    rows = [(1, few), (2, few[:70] + "X" + few[71:]), (3, many), (4, many.replace("word17", "wo rd17"))]
    assert min(len(x) for _, x in rows) > 128
    got = {r.doc_id: (r.class_doc_id, r.n_links) for r in near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}


def test_own_segments_are_hashed_and_exchanged_once(spark):
    """Lines of one length meet through the index alone: no probe repeats its keys, and its exchange serves all its joins."""
    from kindredge.llm.line_dedup import index_keys, probe_keys

    lines = spark.createDataFrame([("some words " * 30 + str(i) * 3,) for i in range(3)], "line string")
    rows = lines.select("line", F.length("line").alias("chars"), F.size(F.split("line", " ")).alias("n_words"))
    for bands in (BANDS, (Band("chars", 8, WHOLE, 2), Band("words", 3, WHOLE, 2))):
        for row in rows.select(F.array(*[k.key for k in index_keys(bands)]), F.array(*[k.key for k in probe_keys(bands)])).collect():
            assert len(set(row[0])) == len(row[0]) and not set(row[0]) & set(row[1])


def test_edits_grow_with_the_line(spark, tmp_path):
    """A word in twenty, whichever words; a character or a blank more in long lines, whose keys are those of words alone."""
    from kindredge.llm.line_dedup import GROWING, most_words

    assert most_words(GROWING) == (40, *[WHOLE] * 3) and most_words(BANDS) == (WHOLE, WHOLE)
    r, rows, want = random.Random(11), [], {}
    for k, (words, edits) in enumerate([(39, 1), (40, 2), (59, 2), (60, 3), (79, 3), (200, 3), (39, 2), (59, 3), (60, 4)]):
        line = [f"w{k}x{r.randrange(10 ** 6)}" for _ in range(words)]
        other = list(line)
        for at in r.sample(range(words), edits):
            other[at] = "changed" + str(at)
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
        want[2 * k + 1] = 2 * k if k < 6 else 2 * k + 1
    for k, words in enumerate((38, 39, 40, 41, 80), 50):  # a blank parts a word, or goes
        line = [f"w{k}x{r.randrange(10 ** 6)}" for _ in range(words)]
        rows += [(3 * k, " ".join(line)), (3 * k + 1, " ".join(line).replace("x", " x", 1)), (3 * k + 2, " ".join(line).replace(" ", "", 1))]
        want |= {3 * k + 1: 3 * k, 3 * k + 2: 3 * k}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.class_doc_id for x in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert {d: got[d] for d in want} == want
