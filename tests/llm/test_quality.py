import random
import zlib

import numpy as np

from kindredge.llm import quality as Q


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(i % 251 for i in range(n))
        starts = Q.chunk_starts(n)
        seen = np.zeros(n + Q.CHUNK, bool)
        for s, c in zip(starts, Q.cut(text, starts), strict=True):
            seen[s: s + Q.CHUNK] = True
            part = text[s: s + Q.CHUNK]
            assert c[: len(part)].tolist() == list(part) and (c[len(part):] == Q.PAD).all()
        assert seen[:n].all()


def test_logits_match_a_naive_network():
    r = np.random.default_rng(1)
    chunks = r.integers(0, 256, (4, Q.CHUNK)).astype(np.uint16)
    model = Q.initial()
    naive = []
    for c in chunks:
        x = model["embed"][c]
        response = np.array([x[a:a + Q.WIDTH].ravel() @ model["conv"] for a in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE)])
        pooled = np.concatenate((np.maximum(response.max(0) + model["conv_b"], 0), Q._fill(c[None])[0]))
        naive.append(np.maximum(pooled @ model["dense"] + model["dense_b"], 0) @ model["out"] + model["out_b"][0])
    assert np.allclose(Q.logits(model, chunks), naive, atol=1e-3)


def test_gradients_match_differences():
    r = np.random.default_rng(3)
    chunks = r.integers(0, 256, (3, Q.CHUNK)).astype(np.uint16)
    chunks[2, 100:] = Q.PAD
    y = np.array([1.0, 0.0, 1.0])
    model = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.05 for k, v in Q.initial().items()}
    model["embed"][Q.PAD] = 0

    def loss(m):
        frames = Q._frames(m, chunks)
        pooled = (frames @ m["conv"]).reshape(3, Q.FRAMES, Q.FILTERS).max(1) + m["conv_b"]
        hidden = np.maximum(np.hstack((np.maximum(pooled, 0), Q._fill(chunks))) @ m["dense"] + m["dense_b"], 0)
        z = hidden @ m["out"] + m["out_b"]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    grad = Q.gradients(model, chunks, y)
    for name, g in grad.items():
        flat = np.flatnonzero(np.abs(g).ravel() > np.abs(g).max() * 0.05)
        for at in r.choice(flat, min(6, len(flat)), replace=False):
            moved = []
            for step in (1e-6, -1e-6):
                m = {k: v.copy() for k, v in model.items()}
                m[name].reshape(-1)[at] += step
                moved.append(loss(m))
            assert abs((moved[0] - moved[1]) / 2e-6 - g.reshape(-1)[at]) < 1e-4 + 0.02 * abs(g.reshape(-1)[at]), name


def test_sample_counts_repeated_rows_once(spark):
    rows = [(i, "some good words " * (1 + i % 5)) for i in range(50)] + [(3, "some good words " * 4)] * 200 + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = Q._sample(docs, learn, 30, 1 << 20).collect()
    assert len(got) == 51 and sum(x.text == "" for x in got) == 1
    assert sum(len(x.text) for x in Q._sample(docs, learn, 30, 300).collect()) <= 600


def test_learns_from_training_rows_only(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(r.choice([5, 50, 300]))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "x"))
        # held-out rows are labelled wrongly: a model that looked at them would do worse
        labels.append((i, int(good) if zlib.crc32(str(i).encode()) % 5 else int(not good), 0))
    extra = [(None, "hello there", "x"), (1000, None, "x"), (1001, "", "x"), (1002, "word " * 60000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    got = Q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, predicted int")).collect()
    assert len(got) == len(rows) + len(extra)
    by = {x.doc_id: x for x in got}
    truth = {i: not t[1].isupper() for i, t, _ in rows}
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert np.mean([bool(by[i].predicted) == truth[i] for i in truth if by[i].held_out]) > 0.95 and len(held) > 80
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert by[1000].score == by[1001].score and not by[None].held_out


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(docs, labels).count() == 0
    assert Q.classify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), labels).count() == 1
