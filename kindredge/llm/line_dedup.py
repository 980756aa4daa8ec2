"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

Equal lines are one class at any length. Beyond that, lines are joined within an edit distance, by bands: a ``Band`` says
in which units (characters, or words between single blanks) lines are compared, how long the shorter of two lines is, and
how many edits ``tau`` may part them. By default lines of 32 characters or more
may differ by a character, and lines of 20 words or more by a whole word; with ``GROWING``
by a word in twenty, up to three.

Two lines within ``tau`` edits share at least one of tau + 1 segments of the shorter, unchanged and shifted by little
(pigeonhole principle). Every line is cut into its segments, which are hashed with its length and their number (the
index, which also meets itself), and into the other substrings of the right lengths around the places where segments of lines up to tau shorter can lie
(the probes; only starts that can be the first or the last of several matches are kept). Equal keys give candidates,
unless their signatures differ too much: a signature holds the parity of the line's words in 56 hashed bits, and an edit
changes at most three words. A banded bit-parallel edit distance over one long verifies the candidates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, maybe_broadcast
from .components import components


class Band(NamedTuple):
    """Pairs whose shorter line has ``least`` to under ``below`` units, within ``tau`` edits of units."""

    unit: str
    least: int
    below: int
    tau: int


WHOLE = (1 << 31) - 1
BANDS = (Band("chars", 32, WHOLE, 1), Band("words", 20, WHOLE, 1))
#: Edits grow with the line: a character, and a word in twenty, up to three: op3_line_dedup's bands.
GROWING = (Band("chars", 32, WHOLE, 1), Band("words", 20, 40, 1), Band("words", 40, 60, 2), Band("words", 60, WHOLE, 3))
BITS = 56


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` parts different texts of one doc_id (or of none)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("row"), "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no from 0, line) of ``rows_of``."""
    # "outer", else Spark would split every text a second time to see that there are lines
    return docs.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")).filter("line_no is not null")


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i: as equal as can be, the longer ones last."""
    base = F.floor(length / (tau + 1)).cast("int")
    longer = length - base * (tau + 1)
    return i * base + F.greatest(F.lit(0), F.lit(i - tau - 1) + longer), base + (F.lit(tau - i) < longer).cast("int")


def _hashed(number: int, band: Band, length: Column, i: int, at: Column, size: Column, first: bool, last: bool) -> Column:
    """Of a segment that is known to begin with the line (``first``), to end with it (``last``), or neither."""
    if band.unit == "chars":
        part = F.substring(F.col("line"), at + 1, size)
    else:
        part = F.col("line") if last else F.call_function("substring_index", F.col("line"), F.lit(" "), at + size)
        part = part if first else F.call_function("substring_index", part, F.lit(" "), -size)
    return F.xxhash64(F.lit(number), length, F.lit(i), part)


def most_words(bands: tuple[Band, ...]) -> tuple[int, ...]:
    """Words of the longest lines that each of ``bands`` needs keys of. An edited character edits two words at most (a blank
    that comes or goes), so where word bands allow twice the edits at any length on, they link all that characters would."""
    def most(band: Band) -> int:
        least = WHOLE
        for other in sorted((b for b in bands if b.unit == "words"), key=lambda b: b.least, reverse=True):
            if other.tau < 2 * band.tau or other.below < least:
                break
            least = other.least
        return WHOLE if band.unit == "words" or least == WHOLE else least - 1 + band.tau

    return tuple(most(b) for b in bands)


class Key(NamedTuple):
    """A hash (null where the row has none), its band, and by how much the lines that it seeks are shorter."""

    key: Column
    band: int
    gap: int


def index_keys(bands: tuple[Band, ...], most: tuple[int, ...] | None = None) -> list[Key]:
    """Of a row (line, chars, n_words): its segments, in the bands that its length belongs to, ``most`` words at most."""
    out = []
    for number, band in enumerate(bands):
        n = F.col("chars" if band.unit == "chars" else "n_words")
        inside = (n >= band.least) & (n < band.below) & (F.col("n_words") <= (most[number] if most else WHOLE))
        for i in range(band.tau + 1):
            at, size = _segment(n, i, band.tau)
            out.append(Key(F.when(inside, _hashed(number, band, n, i, at, size, i == 0, i == band.tau)), number, 0))
    return out


def probe_keys(bands: tuple[Band, ...], most: tuple[int, ...] | None = None) -> list[Key]:
    """Of a row (line, chars, n_words): where segments of lines by ``gap`` shorter can lie in it, but for its own segments in
    their places, which the index holds."""
    out = []
    for number, band in enumerate(bands):
        for gap in range(band.tau + 1):
            n, tau = F.col("chars" if band.unit == "chars" else "n_words"), band.tau
            length = n - gap
            inside = (length >= band.least) & (length < band.below) & (F.col("n_words") <= (most[number] if most else WHOLE))
            for i in range(tau + 1):
                start, size = _segment(length, i, tau)
                for shift in range(max(-i, gap - (tau - i)), min(i, gap + tau - i) + 1):
                    if gap == shift == 0:
                        continue
                    at = start + shift
                    key = _hashed(number, band, length, i, at, size, i == 0 and shift == 0, i == tau and shift == gap)
                    out.append(Key(F.when(inside & (at >= 0) & (at + size <= n), key), number, gap))
    return out


def word_parity() -> Column:
    """Of a row (words): ``BITS`` bits, bit b set when an odd number of words hash to b."""
    return F.expr(f"aggregate(words, 0L, (x, w) -> x ^ shiftleft(1L, cast(pmod(xxhash64(w), {BITS}) as int)))")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether two arrays (the first no longer than the second) are within ``tau`` edits: banded bit-parallel columns.

    Bit k of column j stands for row j - tau + k. Vertical steps of +1 and -1 are two vectors of 2 tau + 1 bits, which
    move down by a row with each column. The distance is followed along the lowest diagonal of the band, then along the
    last row."""
    width = 2 * tau + 1
    mask = (1 << width) - 1
    bit = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(1).cast("long"))
    flip = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(mask).cast("long"))

    def over(chars: Column) -> Column:
        ca, cb = chars["a"], chars["b"]
        m = F.size(ca)

        def equal(c: Column, j: Column) -> Column:
            hits = [F.when(F.get(ca, j + (k - tau)).eqNullSafe(c), 1 << k).otherwise(0) for k in range(width)]
            total = hits[0]
            for h in hits[1:]:
                total = total + h
            return total.cast("long")

        def column(state: Column, eq: Column) -> Column:
            vp, vn, j = state["vp"], state["vn"], state["j"] + 1
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask).cast("long"))

            def steps(d: Column) -> Column:
                hp = vn.bitwiseOR(flip(d.bitwiseOR(vp)))

                def close(h: Column) -> Column:
                    hn, low = d.bitwiseAND(vp), F.shiftright(d, 1)
                    row = m - j + tau  # the last row's bit, once the band has reached it
                    cost = F.when(row >= 2 * tau, F.lit(1) - bit(d, 2 * tau)).otherwise(
                        F.call_function("shiftright", h, row).bitwiseAND(F.lit(1).cast("long")) - F.call_function("shiftright", hn, row).bitwiseAND(F.lit(1).cast("long")))
                    return F.struct(hn.bitwiseOR(flip(low.bitwiseOR(h))).alias("vp"), low.bitwiseAND(h).alias("vn"), j.alias("j"), (state["score"] + cost).alias("score"))

                return _let(hp, close)

            return _let(d0, steps)

        eqs = F.transform(cb, equal)
        first = F.struct(F.lit(mask & (-1 << tau)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).alias("j"), F.least(F.lit(tau), m).cast("long").alias("score"))
        return F.aggregate(eqs, first, column, lambda s: s["score"])

    return _let(F.struct(a.alias("a"), b.alias("b")), over) <= tau


def _parts(line: str, unit: str) -> Column:
    return F.split(F.col(line), "" if unit == "chars" else " ", -1)


def edit_links(lines: DataFrame, work: Work, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """``lines`` (line), repeated or not -> (a, b), MD5s of different lines linked in any band, each pair once."""
    most = most_words(bands)
    distinct = lines.select("line").distinct().select("line", F.length("line").alias("chars"), F.split("line", " ", -1).alias("words"))

    def keyed(keys: list[Key]) -> DataFrame:
        """A row a key. The hashes are columns of a projection, which Spark compiles; within a higher-order function it would
        not. (Without "outer", it would make the arrays twice, to see that they are not empty.)"""
        d = distinct.select("line", "chars", F.size("words").alias("n_words"), word_parity().alias("parity"))
        d = d.select(F.xxhash64("line").alias("h"), "parity", F.array(*[k.key for k in keys]).alias("keys"))
        d = d.select("h", "parity", F.posexplode_outer("keys").alias("at", "key")).filter("key is not null")
        of = lambda values: F.element_at(F.array(*[F.lit(x).cast("tinyint") for x in values]), F.col("at") + 1)
        return d.select("key", "h", "parity", of(k.band for k in keys).alias("band"), of(k.gap for k in keys).alias("gap"))

    # made anew for each side, not joined with itself: only so does Spark see equal exchanges and run each once
    side = lambda keys, h, parity, *more: keyed(keys).select("key", "band", F.col("h").alias(h), F.col("parity").alias(parity), *more)
    held = lambda: side(index_keys(bands, most), "a", "wa")
    edits = F.element_at(F.array(*[F.lit(3 * x.tau) for x in bands]), F.col("band") + 1)
    alike = F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= edits
    # the index meets itself, then the probes
    pairs = held().join(side(index_keys(bands, most), "b", "wb"), ["key", "band"]).filter((F.col("a") < F.col("b")) & alike).select("a", "b", "band")
    if probes := probe_keys(bands, most):
        once = (F.col("a") != F.col("b")) & ((F.col("gap") > 0) | (F.col("a") < F.col("b")))
        pairs = pairs.union(held().join(side(probes, "b", "wb", "gap"), ["key", "band"]).filter(once & alike).select("a", "b", "band"))
    pairs = pairs.distinct()
    pairs = work.save(pairs, "pairs")
    needed = work.save(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "needed")
    texts = lines.select(F.xxhash64("line").alias("h"), "line").join(maybe_broadcast(needed, needed.count()), "h", "left_semi")
    texts = work.save(texts.distinct(), "texts")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a")
    both = both.join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b").filter("la <> lb")
    near = F.lit(False)
    for number, band in enumerate(bands):
        a, b = _parts("la", band.unit), _parts("lb", band.unit)
        gap = F.size(b) - F.size(a)
        ok = F.when((gap >= 0) & (gap <= band.tau) & (F.size(a) >= band.least) & (F.size(a) < band.below), within(a, b, band.tau)).otherwise(False)
        near = F.when(F.col("band") == number, ok).otherwise(near)
    found = both.filter(near).select(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
    return work.save(found.select(_id("la").alias("a"), _id("lb").alias("b")).distinct(), "links")


def _id(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("binary")))


def _solid(text: str) -> Column:
    """Whether there is anything but blanks."""
    return F.col(text).rlike("[^ \\t-\\r]")


def _classed(docs: DataFrame, work: Work, bands: tuple[Band, ...]) -> DataFrame:
    """(doc_id, row, line_no, chars, n_links, place, first): every line's place, and the place of its class's first line."""
    lines = lines_of(rows_of(docs))
    least = min(b.least - (b.unit == "words") for b in bands)  # words have as many blanks between them, less one
    links = edit_links(lines.filter(F.length("line") >= least).select("line"), work, bands)
    slim = lines.select("doc_id", "row", "line_no", F.length("line").alias("chars"), F.when(_solid("line"), _id("line")).alias("id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = work.save(components(links, work).withColumnRenamed("node", "id").join(degree, "id"), "classes")
    slim = slim.join(maybe_broadcast(classes, classes.count()), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component", "id")
    slim = work.save(slim, "slim")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    first = work.save(slim.filter("class is not null").groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last"), "first")
    out = slim.join(first, "class", "left").withColumn("place", place)
    return out.withColumn("first", F.coalesce("first", "place")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def near_lines(docs: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """``docs`` (doc_id, text) -> a row a line: doc_id, line_no, n_chars, class_doc_id, class_line_no, n_links, kept.

    Lines that are equal or linked (directly or through others) in one of ``bands`` are one class, named by its first line
    (smallest doc_id, then a hash of the text where rows share a doc_id, then line number; null doc_ids come last); only
    that is kept. Lines of blanks alone are classes of their own. ``n_links`` counts the different lines that a line is linked with. Null texts have no lines, an empty
    text has one empty line. Rows of equal doc_id and text share their lines' places, so a repeated row is kept or dropped
    as the row that it repeats; other rows of one doc_id, or of none, are told apart. Lines end at a line feed. Further
    columns are ignored, whatever their names. An empty table gives an empty table."""
    out = _classed(docs, Work(docs.sparkSession, "lines"), bands)
    return out.select("doc_id", "line_no", F.col("chars").alias("n_chars"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"),
                      "n_links", F.col("first").eqNullSafe(F.col("place")).alias("kept"))


def drop_lines(docs: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """``docs`` without the lines that ``near_lines`` does not keep, all columns as they were.

    ``emptied`` (boolean, the last column; a column of that name gives way) says that a document lost lines and has nothing
    but blanks left. Null texts stay null. Nulls, repeated ids and clashing names as in ``near_lines``."""
    work = Work(docs.sparkSession, "gone")
    gone = _classed(docs, work, bands).filter(~F.col("first").eqNullSafe(F.col("place")))
    gone = work.save(gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "gone")
    names = [c for c in docs.columns if c != "emptied"]
    whole = docs.select(F.struct(*names).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"))
    gone = gone.select(F.col("doc_id").alias("other"), F.col("row").alias("other_row"), "gone")
    joined = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("row") == F.col("other_row")), "left")

    def left(lines: Column) -> Column:
        """The runs between lines that go: one pass, however many go."""
        cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(lines)))
        return _let(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.slice(lines, F.get(c, k - 1) + 2, F.get(c, k) - F.get(c, k - 1) - 1))))

    text = F.when(F.col("gone").isNull(), F.col("whole.text")).otherwise(F.array_join(_let(F.split("whole.text", "\n", -1), left), "\n"))
    joined = joined.select("whole", text.alias("text"), F.col("gone").isNotNull().alias("lost"))
    return joined.select(*[F.col("text") if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in names], (F.col("lost") & ~_solid("text")).alias("emptied"))
