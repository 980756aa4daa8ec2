import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from kindredge.llm.packing import END_ID, _encoder, fill, pack, pack_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fill_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(0, 5))}
        room = r.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + i * length for s in sums for i in range(n + 1)}
        used = fill(counts, room)
        assert all(n <= counts[x] for x, n in used)
        assert sum(x * n for x, n in used) == max(s for s in sums if s <= room)


def test_every_length_once():
    r = random.Random(4)
    lengths = [r.randint(1, 2048) for _ in range(3000)] + [2048, 1, 1]
    windows = pack_lengths(lengths)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 2048 for w in windows)
    assert len(windows) <= 1.01 * sum(lengths) / 2048
    assert pack_lengths([]) == []


def test_round_trip(spark):
    texts = ["Hello  world!\tIt's 2,048 ÉCOLE x", "", None, "a " * 5000, "word " * 3, "<|endoftext|> don't", "\x0b\x0c", "ΑΣ é é ́x", "a b" * 700]
    rows = [(i, t, "en", 5) for i, t in enumerate(texts)] + [(0, texts[0], "en", 5), (None, "null id", "en", 5)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string, start int"), PATH).collect()
    tok, want = Tokenizer.from_file(PATH), defaultdict(int)
    for i, t, *_ in rows:
        want[i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    ids = {i: x for i, x in want}
    by_seq, tokens = defaultdict(list), defaultdict(int)
    for p in got:
        piece = ids[p.doc_id][p.start: p.start + p.length]
        assert len(piece) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == p.ids_crc32
        by_seq[p.sequence_id].append((p.offset, p.length))
        tokens[p.doc_id] += p.length
    assert tokens == {i: sum(n * len(x) for (j, x), n in want.items() if j == i) for i in tokens} and len(tokens) == 10
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_of_any_script():
    """Against the tokenizer itself: mixed scripts, capitals that lower to two characters, marks, long words, special tokens."""
    tok, encode, r = Tokenizer.from_file(PATH), _encoder(PATH, END_ID), random.Random(9)
    ranges = [(32, 127), (160, 256), (256, 592), (768, 880), (880, 1024), (1024, 1280), (1424, 1536), (1536, 1792), (2304, 2432), (3585, 3676), (4352, 4608), (7680, 8192), (8192, 8304), (12352, 12544), (19968, 20200), (44032, 44300), (64256, 64280), (65281, 65400), (120120, 120200), (127744, 128000), (0, 32)]
    texts = ["D\u0130YARBAKIR", "\u0130", "STRASSE \u1e9e \u03a3\u0391\u03a3", "x" * 5000, "\u01c5 \u01c4\u0301", "<|endoftext|>a<|startoftext|>\u0130", "it's I'LL o'\u0130", "\ufb03 \u2126 \u212b", "a\u00a0b\u2028c\x1cd\x85e"]
    for _ in range(1500):
        used = r.sample(ranges, r.choice([1, 2, 3]))
        texts.append("".join(" " if r.random() < 0.15 else chr(r.randrange(*r.choice(used))) for _ in range(r.randint(1, 60))))
    for t in texts:
        want = b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t, add_special_tokens=False).ids, END_ID])
        assert encode(t) == want, ascii(t)


def test_turkish_capitals_pack(spark):
    got = pack(spark.createDataFrame([(1, "D\u0130YARBAKIR \u0130"), (2, "plain")], "doc_id long, text string"), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    assert {x.doc_id: x.doc_tokens for x in got} == {1: len(tok.encode("D\u0130YARBAKIR \u0130", add_special_tokens=False).ids) + 1, 2: 2}


def test_new_pieces_of_many_texts_are_learned_together(monkeypatch):
    import numpy as np

    from kindredge.llm import packing

    monkeypatch.setattr(packing, "_MET", {})
    monkeypatch.setattr(packing, "MEMO", 40)  # cleared in between
    tok, r = Tokenizer.from_file(PATH), random.Random(3)
    texts = [" ".join("".join(r.choices("abcde'.,1\u00e9\u4e2d", k=r.randint(1, 6))) for _ in range(r.randint(0, 30))) for _ in range(60)]
    encode = packing._group_encoder(PATH, END_ID)
    for a, b in ((0, 1), (1, 40), (40, 60), (0, 60)):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts[a:b])]
        assert got == [[*tok.encode(t, add_special_tokens=False).ids, END_ID] for t in texts[a:b]]
    monkeypatch.setattr(packing, "TOGETHER", 10)
    assert [i for a, b in packing._runs(texts) for i in range(a, b)] == list(range(60)) and not list(packing._runs([]))
