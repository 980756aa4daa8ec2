"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters slide
over a chunk, each filter's greatest response is kept (max-pooling), and a small dense layer on these and on how full the chunk is gives
the chunk's logit. The
document's logit is the mean over its chunks, shifted to the share of label 1 in the training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 4
DIM, FILTERS, HIDDEN = 8, 48, 16
FRAMES = (CHUNK - WIDTH) // STRIDE + 1
#: Bounds of the training sample: labelled rows of each class, and the bytes of their texts. Sampled texts are used whole.
ROWS, BYTES = 2000, 8 << 20
PAD = 256


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; an empty text has one chunk of padding."""
    return np.arange(0, max(1, n - CHUNK + STEP), STEP)


def cut(text: bytes, starts: np.ndarray) -> np.ndarray:
    padded = np.full(int(starts[-1]) + CHUNK, PAD, np.uint16)
    data = np.frombuffer(text, np.uint8)[: len(padded)]
    padded[: len(data)] = data
    return padded[starts[:, None] + np.arange(CHUNK)]


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    embed = (r.standard_normal((257, DIM)) * 0.5).astype(np.float32)
    embed[PAD] = 0
    zero = lambda n: np.zeros(n, np.float32)
    return {"embed": embed, "conv": draw(WIDTH * DIM, FILTERS), "conv_b": zero(FILTERS), "dense": draw(FILTERS + 2, HIDDEN), "dense_b": zero(HIDDEN), "out": draw(HIDDEN, 1)[:, 0], "out_b": zero(1)}


def _fill(chunks: np.ndarray) -> np.ndarray:
    """How full each chunk is, plainly and by powers of two."""
    n = (chunks != PAD).sum(1).astype(np.float32)
    return np.stack((n / CHUNK, np.log2(n + 1) / 9), 1)


def _frames(model: dict, chunks: np.ndarray) -> np.ndarray:
    x = model["embed"][chunks]
    a, b, c = x.strides
    view = np.lib.stride_tricks.as_strided(x, (len(chunks), FRAMES, WIDTH * DIM), (a, b * STRIDE, c))
    return np.ascontiguousarray(view).reshape(-1, WIDTH * DIM)


def logits(model: dict, chunks: np.ndarray) -> np.ndarray:
    out = np.empty(len(chunks), np.float32)
    for a in range(0, len(chunks), 64):
        part = chunks[a: a + 64]
        pooled = (_frames(model, part) @ model["conv"]).reshape(len(part), FRAMES, FILTERS).max(1) + model["conv_b"]
        hidden = np.maximum(np.hstack((np.maximum(pooled, 0), _fill(part))) @ model["dense"] + model["dense_b"], 0)
        out[a: a + 64] = hidden @ model["out"] + model["out_b"]
    return out


def gradients(model: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log-loss of chunks ``x`` with labels ``y``, by each of the model's arrays."""
    n = len(x)
    frames = _frames(model, x)
    response = (frames @ model["conv"]).reshape(n, FRAMES, FILTERS)
    top = response.argmax(1)
    pooled = np.take_along_axis(response, top[:, None, :], 1)[:, 0] + model["conv_b"]
    act = np.hstack((np.maximum(pooled, 0), _fill(x)))
    pre = act @ model["dense"] + model["dense_b"]
    hidden = np.maximum(pre, 0)
    z = hidden @ model["out"] + model["out_b"]
    d = (1 / (1 + np.exp(-z)) - y) / n
    dh = d[:, None] * model["out"] * (pre > 0)
    da = (dh @ model["dense"][:FILTERS].T) * (pooled > 0)
    rows = (np.arange(n)[:, None] * FRAMES + top).ravel()
    picked = frames[rows].reshape(n, FILTERS, -1)
    back = (da[:, :, None] * model["conv"].T[None]).reshape(n * FILTERS, WIDTH, DIM)
    where = x[np.repeat(np.arange(n), FILTERS)[:, None], top.ravel()[:, None] * STRIDE + np.arange(WIDTH)]
    embed = np.zeros_like(model["embed"])
    np.add.at(embed, where, back)
    embed[PAD] = 0
    return {"out": hidden.T @ d, "out_b": d.sum(keepdims=True), "dense": act.T @ dh, "dense_b": dh.sum(0), "conv_b": da.sum(0), "conv": np.einsum("bf,bfw->wf", da, picked), "embed": embed}


def fit(chunks: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 2000, batch: int = 64, rate: float = 0.004, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the weighted log-loss of chunks; one thread, a fixed seed."""
    model, r = initial(seed), np.random.default_rng(seed)
    if not len(chunks):
        return model
    p = weights / weights.sum()
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = r.choice(len(chunks), batch, p=p)
        for k, g in gradients(model, chunks[at], labels[at]).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model[k] -= (rate * (1 - 0.9 * step / steps) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def _sampler(batches):
    for batch in batches:
        out, label, share = [], [], []
        for text, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            starts = chunk_starts(len(text or b""))
            for c in cut(text or b"", starts):
                out.append(c.tobytes())
                label.append(y)
                share.append(1 / len(starts))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(label, pa.int32()), pa.array(share, pa.float64())], names=["chunk", "label", "share"])


def _sample(docs: DataFrame, learn: DataFrame, rows: int, size: int) -> DataFrame:
    """(text, quality) of at most ``rows`` labelled documents of each class, those with the smallest hashes of their ids, as
    long as their texts have ``size`` bytes together. Of equal rows one counts."""
    parts = [learn.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text")).join(chosen, "doc_id")
    slim = known.select("doc_id", "row", "quality", F.octet_length("text").cast("long").alias("n")).dropDuplicates(["doc_id", "row", "quality"])
    left, taken = {0: [rows, size], 1: [rows, size]}, []
    for r in slim.orderBy(F.xxhash64("doc_id"), "doc_id", "row", "quality").limit(4 * rows).collect():
        if left[r.quality][0] and r.n <= left[r.quality][1]:
            left[r.quality][0] -= 1
            left[r.quality][1] -= r.n
            taken.append((r.doc_id, r.row, r.quality))
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, row long, quality int")
    return known.join(F.broadcast(taken), ["doc_id", "row", "quality"], "left_semi").dropDuplicates(["doc_id", "row", "quality"]).select("text", "quality")


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = BYTES) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of labelled documents (``_sample``), never on rows whose crc32(doc_id as text) mod 5 is 0.
    The share of label 1 is counted over all training rows."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    learn = labels.filter((fold != 0) & F.col("quality").isin(0, 1)).dropDuplicates()
    counts = {r.quality: r["count"] for r in learn.groupBy("quality").count().collect()}
    found = _sample(docs, learn, rows, size).mapInArrow(lean(_sampler), "chunk binary, label int, share double").toPandas()
    chunks = np.frombuffer(b"".join(found["chunk"]), np.uint16).reshape(-1, CHUNK)
    order = np.lexsort((found["share"], found["chunk"]))  # the arrival order of rows must not matter
    y, w = found["label"].to_numpy(np.float32)[order], found["share"].to_numpy()[order]
    balance = np.where(y == 1, w / max(w[y == 1].sum(), 1e-9), w / max(w[y == 0].sum(), 1e-9))
    model = fit(chunks[order], y, balance)
    model["prior"] = np.float32(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    return model


def _scorer(model: dict):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            scores, held, owner = np.zeros(len(texts)), [], []

            def flush():
                if held:
                    z = logits(model, np.concatenate(held))
                    np.add.at(scores, np.concatenate(owner), z)
                    held.clear()
                    owner.clear()

            sizes, pending = np.ones(len(texts)), 0
            for i, t in enumerate(texts):
                starts = chunk_starts(len(t or b""))
                sizes[i] = len(starts)
                for a in range(0, len(starts), 1024):
                    part = starts[a: a + 1024]
                    held.append(cut((t or b"")[part[0]:], part - part[0]))
                    owner.append(np.full(len(part), i))
                    pending += len(part)
                    if pending > 1024:
                        flush()
                        pending = 0
            flush()
            z = np.clip(scores / sizes + model["prior"], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z))), *batch.columns[2:]], names=["doc_id", "score", "kept"][: batch.num_columns])

    return run


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, score), the probability of label 1; with ``keep``, those columns in a struct ``kept``."""
    bounded_batches(docs.sparkSession)
    kept = [F.struct(*keep).alias("kept")] if keep else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    return docs.mapInArrow(lean(_scorer(model)), "doc_id long, score double" + (f", kept {docs.schema['kept'].dataType.simpleString()}" if keep else ""))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text), ``labels`` (doc_id, quality) -> (doc_id, held_out, score, predicted), a row a document row; with
    ``keep``, those columns of the row in a struct ``kept``.

    Only the bytes of the text are an input of the score. Null and empty texts get a chunk of padding; null doc_ids are
    carried and are not held out; repeated rows are scored each; without any labels the untrained network scores; an empty
    table gives an empty table. Texts of any length are taken whole."""
    out = score(docs, train(docs, labels), keep)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *(["kept"] if keep else []))
