"""Pack token sequences with the minimum-bin-slack rule.

A document becomes its token ids and one end id. Full windows of ``capacity`` tokens are cut off its front and are
sequences of their own; what is left is one piece. Pieces are dealt to groups of a bounded size by a hash, and each group
fills one window after another: the longest piece left opens the window, and a bitset subset-sum programme over the
multiset of the other lengths left finds the sum closest to what the window still holds; back-tracking gives how many
pieces of each length to take. A short text is never cut.
"""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, bounded_batches, lean

CAPACITY = 2048
END_ID = 1
#: Pieces a group holds on average.
GROUP = 4096
#: Pieces whose ids a worker remembers, and the characters of the longest that it does.
MEMO, KEPT = 600_000, 64
#: Characters of texts whose new pieces are learned at once.
TOGETHER = 1 << 19


# In Latin-1 text the pre-tokenizer's pieces can be found by one pattern on the lower-cased text; other texts go through
# the tokenizer word by word. Letters, then digits (each a piece of its own to the tokenizer), then anything else.
_LETTER, _DIGIT = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_DIGIT}]+|[^ \\t-\\r{_LETTER}{_DIGIT}]+")
_PLAIN = re.compile("[\\t-\\r -;=?-~\u00a1-\u00ff]*")  # without < and >, which may start a special token, and without controls

_WORD = re.compile("[^ \\t-\\r]+")
_LETTERS = re.compile(f"[{_LETTER}]+")
#: Ids of pieces and words that a worker has met, by tokenizer: later tasks of the same Python worker find them again.
_MET: dict[str, dict[str, bytes]] = {}


def _group_encoder(tokenizer: str, end_id: int):
    """Texts -> their ids as little-endian 32-bit bytes. Pieces and words already met are looked up, new ones are learned together."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    closing = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
    for piece, i in tok.get_vocab().items():
        closing[i] = piece.endswith("</w>")
    end, memo = end_id.to_bytes(4, "little"), _MET.setdefault(tokenizer, {})

    def alone(pieces: list[str]):
        return (np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(pieces, add_special_tokens=False)) if pieces else ()

    def learn(pieces: list[str]) -> dict[str, bytes]:
        """Ids of the pieces that the memo does not hold; the short ones are remembered."""
        new = [p for p in dict.fromkeys(pieces) if p not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(dict.fromkeys(pieces))
        ids: dict[str, bytes] = {}
        letters = [p for p in new if _LETTERS.fullmatch(p)]  # lower-case Latin-1 letters: one piece each, closed by its last token
        parts = [letters[a: a + 200] for a in range(0, len(letters), 200)]
        for part, e in zip(parts, tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False) if parts else (), strict=True):
            found = np.array(e.ids, "<u4")
            ends = np.flatnonzero(closing[found]) + 1
            if len(ends) != len(part):  # a vocabulary whose pieces do not close words
                ids.update(zip(part, alone(part), strict=True))
                continue
            raw, ends = found.tobytes(), (ends * 4).tolist()
            ids.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        rest = [p for p in new if p not in ids]
        ids.update(zip(rest, alone(rest), strict=True))
        memo.update((p, x) for p, x in ids.items() if len(p) <= KEPT)
        return ids

    def encode(texts: list[str]) -> list[bytes]:
        out, left = [], {}
        for i, text in enumerate(texts):
            pieces = _PIECE.findall(text.lower()) if _PLAIN.fullmatch(text) else _WORD.findall(text)
            try:
                out.append(b"".join([*map(memo.__getitem__, pieces), end]))
            except KeyError:
                out.append(b"")
                left[i] = pieces
        new = learn([p for pieces in left.values() for p in pieces])  # of all texts at once
        for i, pieces in left.items():
            out[i] = b"".join([*(new[p] if p in new else memo[p] for p in pieces), end])
        return out

    return encode


def _encoder(tokenizer: str, end_id: int):
    """The same of a single text."""
    encode = _group_encoder(tokenizer, end_id)
    return lambda text: encode([text])[0]


def _runs(texts: list[str]):
    """(first, last) of consecutive texts of about TOGETHER characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def _piece_cutter(tokenizer: str, capacity: int, end_id: int):
    def run(batches):
        encode = _group_encoder(tokenizer, end_id)
        for batch in batches:
            out = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in _runs(texts):
                for doc, ids in zip(docs[first:last], encode(texts[first:last]), strict=True):
                    n = len(ids) // 4
                    for a in range(0, n, capacity):
                        b = min(n, a + capacity)
                        for k, v in zip(out, (doc, a, b - a, zlib.crc32(ids[4 * a: 4 * b]), n), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def fill(lengths: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset ``lengths`` whose sum is as close to ``room`` as possible without passing it.

    reach[i] has bit s set when the first i lengths can sum to s; counts are dealt in powers of two, so a length with
    many pieces costs a few shifts. Longer lengths come first, and the programme ends once ``room`` itself is reached."""
    mask, reach, steps = (1 << (room + 1)) - 1, [1], []
    for length in sorted((x for x in lengths if x <= room), reverse=True):
        left, take = min(lengths[length], room // length), 1
        while left > 0:
            take = min(take, left)
            reach.append((reach[-1] | reach[-1] << (take * length)) & mask)
            steps.append((length, take))
            left -= take
            take *= 2
            if reach[-1] >> room & 1:
                break
        if reach[-1] >> room & 1:
            break
    total, used = reach[-1].bit_length() - 1, {}
    for i in range(len(steps) - 1, -1, -1):
        if not reach[i] >> total & 1:
            length, take = steps[i]
            used[length] = used.get(length, 0) + take
            total -= take * length
    return list(used.items())


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of positions in ``lengths``; each position is in exactly one window."""
    at: OrderedDict[int, list[int]] = OrderedDict()
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], -i)):
        at.setdefault(lengths[i], []).append(i)
    counts, windows = {k: len(v) for k, v in at.items()}, []
    while counts:
        first = next(iter(counts))  # the longest: keys are in falling order
        window = [at[first].pop()]
        counts[first] -= 1
        if not counts[first]:
            del counts[first]
        for length, n in fill(counts, capacity - first) if first < capacity else []:
            for _ in range(n):
                window.append(at[length].pop())
            counts[length] -= n
            if not counts[length]:
                del counts[length]
        windows.append(window)
    return windows


def _packer(capacity: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "start", "length", "ids_crc32"], na_position="first", ignore_index=True)
        windows = pack_lengths(pdf["length"].tolist(), capacity)
        order = [i for w in windows for i in w]
        sequence, offset = [], []
        for s, w in enumerate(windows):
            filled = 0
            for i in w:
                sequence.append((int(key[0]) << 32) + s)
                offset.append(filled)
                filled += int(pdf["length"].iat[i])
        out = pdf.iloc[order].reset_index(drop=True)
        out["sequence_id"], out["offset"] = sequence, offset
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """``docs`` (doc_id, text, further columns ignored) -> a row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Null texts count as empty and give the end id alone; null or repeated doc_ids keep a piece set for each row. An empty
    table gives an empty table. Texts of any length are taken whole: long ones give many full windows. Groups are dealt by
    a hash of all of a piece's columns plus the row's own number, so neither copies nor one long document crowd a group."""
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Work(spark, "pack")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = work.save(docs.mapInArrow(lean(_piece_cutter(tokenizer, capacity, end_id)), schema).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups))).drop("row")
    grouped = dealt.groupBy("group").applyInPandas(_packer(capacity), schema + ", sequence_id long, offset long")
    return grouped
