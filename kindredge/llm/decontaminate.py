"""Benchmark decontamination: SimHash windows, a multi-index on their Hamming blocks, exact confirmation.

A fingerprint has 64 bits: each bit is the majority over the hashed 2-word shingles of a window of words. Benchmark items
are dealt to length classes (each ``RATIO`` times the one before, rounded down); the first and the last window of the
class's length of each item are fingerprinted. Edits may move these beyond any radius, so an item also has short guard
windows, placed so that a passage of at least the wanted similarity leaves one of them untouched (see ``clean_run``), and
that one is found at distance 0. Every window of every document, at every word, is fingerprinted for every class.

The 64 bits are cut into four blocks of 16; for each block the fingerprints are sorted into postings by the block's value.
Two fingerprints within ``RADIUS`` = 7 bits have a block that differs in one bit at most (pigeonhole), so the postings of a
window's 17 neighbouring values in each block hold all of its fingerprints within the radius, and only those postings are
compared. What is within the radius is confirmed by the weighted Jaccard similarity of 5-word shingles (weight: how often
a shingle occurs) between the item and the document's window of the item's own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, bounded_batches, chunks, lean, mix64, word_hashes

RADIUS = 7
RATIO = 1.15
#: Words of a guard window: the longest of these that fits.
GUARDS = (5, 6, 8, 11, 16)
#: Items that a pass over the documents looks for at once; more items take more passes.
BLOCK = 20_000
_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9FB21C651E98DF25)
        h += words[j: n + j]
    return mix64(h)


def running_bits(words: np.ndarray) -> np.ndarray:
    """Running sums of the bits of the 2-word shingle hashes, eight 8-bit lanes to a word: row i sums those before i.

    Lanes may run over; the difference of two rows is still exact for windows of under 256 words."""
    h = _shingles(words, 2)
    out = np.zeros((8, len(h) + 1), np.uint64)
    for j in range(8):
        np.cumsum((h >> np.uint64(j)) & _ONES, out=out[j, 1:])
    return out


def fingerprints(lanes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` words (size - 1 shingles)."""
    n = size - 1
    need = np.uint64(128 - (n // 2 + 1)) * _ONES  # a lane's top bit is set from n // 2 + 1 on
    out = np.zeros(max(0, lanes.shape[1] - n), np.uint64)
    if len(out):
        for j in range(8):
            out |= (((lanes[j, n:] - lanes[j, :-n]) + need) & _TOPS) >> np.uint64(7 - j)
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    keys, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(keys)), np.bincount(at[len(a):], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


def length_classes(lengths: list[int], ratio: float = RATIO) -> dict[int, int]:
    """Item length -> window length of its class, never more than the item's own."""
    out, size = {}, 0
    for n in sorted(set(lengths)):
        if not size or n > size * ratio:
            size = n
        out[n] = size
    return out


def clean_run(n: int, k: int, least: float) -> int:
    """Words in a row that an item of ``n`` words surely shares with a window of at least the similarity ``least``.

    Of its s = n - k + 1 shingles at most d are missing: common / (2 s - common) >= least. An edited word amid the item
    takes k of them, so at most d // k gaps part the rest, and the longest part has the mean length at least."""
    s = n - k + 1
    d = s - int(np.ceil(2 * s * least / (1 + least) - 1e-9))
    return -(-(s - d) // (d // k + 1)) + k - 1


def edits(n: int, k: int, least: float) -> int:
    """Words by which edits can shift an alignment within a passage of at least the similarity ``least``."""
    s = n - k + 1
    return (s - int(np.ceil(2 * s * least / (1 + least) - 1e-9))) // k + 1


class Index:
    """The fingerprints of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], k: int, least: float = 0.8):
        self.k, self.least, self.items, self.exact = k, least, [], {}
        raw = [(i, (t or "").encode()) for i, t in items]
        words, bounds = word_hashes([t for _, t in raw]) if raw else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        for (i, _), a, b in zip(raw, bounds[:-1], bounds[1:], strict=True):
            w = words[a:b]
            if 0 < len(w) < max(k, 3):
                self.exact.setdefault(len(w), {}).setdefault(w.tobytes(), []).append(i)
            elif len(w):
                self.items.append((i, w, _shingles(w, k)))
        # lanes hold counts under 128: longer items have windows of 128 words
        classes = length_classes([min(128, len(w)) for _, w, _ in self.items])
        self.classes: dict[int, dict] = {}
        for at, (_, w, _) in enumerate(self.items):
            own, run = classes[min(128, len(w))], clean_run(len(w), k, least)
            guard = max((g for g in GUARDS if g <= run), default=run)
            shifts = {(own, 0), (own, len(w) - own)}
            shifts |= {(guard, min(x, len(w) - guard)) for x in range(0, len(w) - guard + run - guard + 1, run - guard + 1)}
            lanes = running_bits(w)
            for size, shift in sorted(shifts):
                c = self.classes.setdefault(size, {"fp": [], "item": [], "shift": []})
                c["fp"].append(fingerprints(lanes[:, shift: shift + size], size)[0])
                c["item"].append(at)
                c["shift"].append(shift)
        near = np.array([0] + [1 << b for b in range(16)], np.uint16)
        for c in self.classes.values():
            c["fp"], c["item"], c["shift"] = np.array(c["fp"], np.uint64), np.array(c["item"]), np.array(c["shift"])
            c["marks"], c["order"], c["starts"] = np.zeros((4, 1 << 16), bool), [], []
            for block, values in enumerate(c["fp"].view(np.uint16).reshape(-1, 4).T):
                c["marks"][block, (values[:, None] ^ near).ravel()] = True
                c["order"].append(np.argsort(values, kind="stable"))
                c["starts"].append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << 16)))))
        self.near = near

    def exact_places(self, words: np.ndarray):
        """(item, first word) of items of fewer than k words in one document."""
        for n, known in self.exact.items():
            met = set()
            for at in range(len(words) - n + 1):
                for i in known.get(words[at: at + n].tobytes(), ()):
                    if i not in met:
                        met.add(i)
                        yield i, at

    def candidates(self, lanes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window starts, entries of the class) within the radius; a pair can come once for each of the four blocks."""
        c = self.classes[size]
        fp = fingerprints(lanes, size)
        parts = fp.view(np.uint16).reshape(-1, 4)
        starts, entries = [np.zeros(0, np.intp)], [np.zeros(0, np.intp)]
        for block in range(4):
            hit = np.flatnonzero(c["marks"][block].take(parts[:, block]))
            for a in range(0, len(hit), 4096):
                at = hit[a: a + 4096]
                values = (parts[at, block][:, None] ^ self.near).ravel()
                first = c["starts"][block].take(values)
                count = c["starts"][block].take(values.astype(np.intp) + 1) - first
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                entry = c["order"][block][np.repeat(first, count) + place]
                window = np.repeat(np.repeat(at, 17), count)
                near = np.bitwise_count(fp[window] ^ c["fp"][entry]) <= RADIUS
                starts.append(window[near])
                entries.append(entry[near])
        return np.concatenate(starts), np.concatenate(entries)

    def places(self, words: np.ndarray, bounds: np.ndarray):
        """(document, item position, first word from the document's start, similarity) of the best window of each pair."""
        lanes = running_bits(words)
        tried: dict[tuple[int, int], set] = {}
        for size, c in self.classes.items():
            start, entry = self.candidates(lanes, size)
            doc = np.searchsorted(bounds, start, "right") - 1
            inside = start + size <= bounds[doc + 1]
            start, entry, doc = start[inside], entry[inside], doc[inside]
            for d, item, first in set(zip(doc.tolist(), c["item"][entry].tolist(), (start - c["shift"][entry]).tolist(), strict=True)):
                tried.setdefault((d, item), set()).add(first)
        for (d, item), firsts in sorted(tried.items()):
            _, w, shingles = self.items[item]
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            slack = edits(len(w), self.k, self.least)
            last = max(lo, hi - len(w))
            best = (0.0, 0)
            for first in sorted({min(max(lo, f + x), last) for f in firsts for x in range(-slack, slack + 1)}):
                s = weighted_jaccard(shingles, _shingles(words[first: min(hi, first + len(w))], self.k))
                best = max(best, (s, -first))
            if best[0] >= self.least:
                yield d, item, -best[1] - lo, best[0]


def _scanner(items: list[tuple[int, str]], k: int, least: float):
    def run(batches):
        index = Index(items, k, least)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            out: list[tuple] = []
            for a, b in chunks(texts):
                words, bounds = word_hashes(texts[a:b])
                out += [(ids[a + d], index.items[item][0], first, s) for d, item, first, s in index.places(words, bounds)]
                if index.exact:
                    for d in range(b - a):
                        out += [(ids[a + d], item, at, 1.0) for item, at in index.exact_places(words[bounds[d]: bounds[d + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                             names=["doc_id", "item_id", "start_word", "similarity"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` (item_id, text) -> (doc_id, item_id, start_word, similarity).

    A row for each document row and item of which it has a passage: the best window's first word and similarity, at
    least ``least`` (the first window on ties). The benchmark is a stated query set: it is taken in blocks of ``block`` items, each
    of which passes over all documents. Items of fewer than ``k`` words are looked for as exact word sequences. Null or
    wordless texts and items have no rows; null ids are carried as they are; repeated rows give repeated rows; empty
    tables give no rows."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    schema = "doc_id long, item_id long, start_word long, similarity double"
    work, held, parts = Work(docs.sparkSession, "leaks"), [], 0
    for row in items.toLocalIterator():
        if len(held) == block:  # a further block follows: this one's rows are written, so that the driver holds one at a time
            work.save(docs.mapInArrow(lean(_scanner(held, k, least)), schema), f"part{parts}")
            held, parts = [], parts + 1
        held.append((row.item_id, row.text))
    out = docs.mapInArrow(lean(_scanner(held, k, least)), schema)
    for i in range(parts):
        out = out.union(work.load(f"part{i}", schema))
    return out
