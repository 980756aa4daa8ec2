"""Near-duplicate documents by chosen-path set similarity join.

Every document becomes the set of its distinct 5-word shingles; equal sets are one *representative*. Of each
representative a minwise signature is kept. In ``trees`` independent trees (each with a root for every class of set
sizes, classes overlapping so that no pair within the threshold is parted), a node picks a few signature coordinates at
random (each with probability 1 / (threshold * coordinates): less similar sets meet ever more rarely) and sends a representative
to the child named by the coordinate and its minwise value.

A node of at most ``leaf`` members and ``shingles`` shingles is a leaf and is compared exhaustively, in two steps. First
by signature estimates: a member goes on if it may be linked with one that is not yet in its component and that it does
not meet in a leaf of a smaller number (so a pair is compared once, however many leaves it shares). Then the whole shingle sets of those members are
brought to the leaf, all sizes of intersections are counted by matrix products, and a spanning forest of the true links
leaves the task: rows out never exceed members in. Larger nodes are only counted, compared with a few random pivots (the
members that may be linked with a pivot are dealt to leaves of their own) and branch again, row by row, as long as they
hold members that are not yet connected.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, bounded_batches, chunks, lean, maybe_broadcast, mix64, shingle_sets
from .components import components

#: Signature coordinates that name children, 32 bits each.
COORDINATES = 64
#: Further coordinates. The estimate takes four bits of every coordinate.
EXTRA = 192
TREES = 12
#: A root's large children each branch this many times independently: with 12 trees a pair at the threshold meets with
#: 0.9998 in 7 levels, 0.998 in 11 and 0.99 in 15 (branching formula, over the coordinates that agree by chance).
COPIES = 6
#: Members and shingles that a leaf may hold: what bounds the memory of a task.
LEAF = 4096
SHINGLES = 8_000_000
PIVOTS = 2
#: Candidates are taken this far below the threshold: four standard errors of the estimate at 0.85 (0.0232 each).
MARGIN = 0.093
#: Levels that the second round and those after it go down at once.
STEPS = (2, 4)
#: Roots are split by set size: a class spans this many threshold ratios, and sets near its upper end join the next too.
SPAN = 3
#: Leaves of up to so many members are compared side by side.
SMALL = 64
EST = (COORDINATES + EXTRA) // 2


def _u64(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _sketcher(k: int):
    mult = _u64(11, COORDINATES + EXTRA) | np.uint64(1)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                hashes, bounds = shingle_sets(texts[a:b], k)
                n = np.diff(bounds)
                some = n > 0
                path = np.zeros((b - a, COORDINATES), np.uint32)
                est = np.zeros((b - a, COORDINATES + EXTRA), np.uint8)
                key = np.zeros((b - a, 2), np.uint64)
                if len(hashes):
                    at = bounds[:-1][some]
                    for j, m in enumerate(mult):
                        low = np.minimum.reduceat(hashes * m, at)
                        est[some, j] = (low >> np.uint64(24)).astype(np.uint8) & 15
                        if j < COORDINATES:
                            path[some, j] = (low >> np.uint64(24)).astype(np.uint32)
                    key[some, 0] = np.add.reduceat(mix64(hashes + np.uint64(5)), at)
                    key[some, 1] = np.bitwise_xor.reduceat(mix64(hashes + np.uint64(7)), at)
                est = est[:, 0::2] | est[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([
                    ids[a:b], pa.array(n, pa.int32()), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)),
                    pa.array([x.tobytes() for x in path], pa.binary()), pa.array([x.tobytes() for x in est], pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "path", "est"])

    return run


def _wide(column, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width // np.dtype(dtype).itemsize)


def _roots(n: np.ndarray, trees: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the roots that each set size belongs to."""
    width = -SPAN * np.log(threshold)
    own = np.floor(np.log(n) / width).astype(np.int64)
    above = np.floor((np.log(n) - np.log(threshold)) / width + 1e-9).astype(np.int64)
    rows = np.concatenate((np.arange(len(n)), np.flatnonzero(above > own)))
    size = np.concatenate((own, above[above > own]))
    return np.repeat(rows, trees), (np.repeat(size, trees) * 1000 + np.tile(np.arange(1, trees + 1), len(rows))).astype(np.uint64)


def _brancher(trees: int, steps: int, threshold: float, copies: int = 1):
    """(node, rep, k1, n, path) -> (node, rep, k1, n) of the descendants ``steps`` below; with ``trees``, of the roots.

    Each node branches ``copies`` times independently."""
    coords = _u64(23, COORDINATES)
    limit = np.uint64(int((1 << 64) / (threshold * COORDINATES)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, paths = batch.column(3), _wide(batch.column(4), 4 * COORDINATES, "<u4")
            for a in range(0, batch.num_rows, 2048):
                node = batch.column(0).slice(a, 2048).to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.arange(a, a + len(node))
                if trees:
                    rows, node = _roots(sizes.slice(a, 2048).to_numpy(zero_copy_only=False), trees, threshold)
                    at = at[rows]
                if copies > 1:
                    at = np.repeat(at, copies)
                    node = mix64(np.repeat(node, copies) + np.tile(_u64(31, copies), len(node)))
                for _ in range(steps):
                    rows, cols = np.nonzero(mix64(node[:, None] ^ coords[None, :]) < limit)
                    node = mix64(mix64(node[rows] * np.uint64(31) + coords[cols]) ^ paths[at[rows], cols])
                    at = at[rows]
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(batch.column(i).take(pick) for i in (1, 2, 3))], names=["node", "rep", "k1", "n"])

    return run


# ---------------------------------------------------------------- comparing

def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of signatures (64-bit words of 4-bit coordinates)."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    same = 1 - np.bitwise_count(x).sum(-1, dtype=np.int64) / (COORDINATES + EXTRA)
    return (same - 1 / 16) * (16 / 15)  # one value in sixteen agrees by chance


def _sized(na, nb, num: int, den: int):
    """Whether the set sizes allow the threshold, in whole numbers."""
    return den * np.minimum(na, nb) >= num * np.maximum(na, nb)


def overlaps(values: np.ndarray, owner: np.ndarray, m: int, width: int = 4096) -> np.ndarray:
    """m x m: how many values any two of m owners share. Each owner has a value once at most."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    out = np.zeros((m, m), np.float32)
    if not len(v):
        return out
    new = np.concatenate(([True], v[1:] != v[:-1]))
    ident = np.cumsum(new) - 1
    shared = np.bincount(ident) > 1
    keep = shared[ident]
    column, row = (np.cumsum(shared) - 1)[ident[keep]], o[keep]
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        one = np.zeros((m, min(width, int(column[hi - 1]) - a + 1)), np.float32)
        one[row[lo:hi], column[lo:hi] - a] = 1
        out += one @ one.T
    return out


def _leaves(batches):
    """Batches sorted by their first column -> tables that hold whole runs of equal values, with the runs' bounds."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(node, node[-1]))
        if last:
            yield _bounded([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(0)[0].as_py() != int(node[0]):
            yield _bounded(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _bounded(held)


def _bounded(held: list) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    node = t.column(0).to_numpy()
    return t, np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))


def _small_pairs(node: np.ndarray, most: int):
    """Pairs of rows of one node, of nodes of at most ``most`` members: row and row + 1, row and row + 2, ..."""
    at = np.arange(len(node))
    for d in range(1, most):
        at = at[at + d < len(node)]
        at = at[node[at] == node[at + d]]
        if not len(at):
            return
        yield at, at + d


def _contested(num: int, den: int):
    """Rows (node, rep, comp, n, est, nodes) sorted by node -> (node, rep) of the members that may have a link in this leaf
    with a member of another component that they do not meet in a leaf of a smaller number; ``nodes`` are a member's leaves."""
    least = num / den - MARGIN

    def large(node, rep, comp, n, est, values, owner):
        m = len(rep)
        met = overlaps(values, owner, m) > 0
        some = np.zeros(m, bool)
        for a in range(0, m - 1, 64):
            i, j = np.triu_indices(min(64, m - a), 1, m - a)
            i, j = i + a, j + a
            ok = (comp[i] != comp[j]) & _sized(n[i], n[j], num, den) & ~met[i, j]
            i, j = i[ok], j[ok]
            for c in range(0, len(i), 65536):
                x, y = i[c: c + 65536], j[c: c + 65536]
                ok = _alike(est[x], est[y]) >= least
                some[x[ok]] = some[y[ok]] = True
        return some

    def run(batches):
        for t, cuts in _leaves(batches):
            node, rep, comp, n = (t.column(i).to_numpy() for i in range(4))
            est = _wide(t.column(4).combine_chunks(), EST, "<u8")
            lists = t.column(5).combine_chunks()
            values, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            some, size = np.zeros(len(node), bool), np.diff(cuts)
            small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
            for x, y in _small_pairs(node[small], SMALL):
                x, y = small[x], small[y]
                ok = (comp[x] != comp[y]) & _sized(n[x], n[y], num, den)
                x, y = x[ok], y[ok]
                ok = _alike(est[x], est[y]) >= least
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    if not (some[i] and some[j]):
                        both = np.intersect1d(values[bounds[i]: bounds[i + 1]], values[bounds[j]: bounds[j + 1]], assume_unique=True)
                        if not (both < node[i]).any():
                            some[i] = some[j] = True
            for a, b in zip(cuts[:-1][size > SMALL].tolist(), cuts[1:][size > SMALL].tolist(), strict=True):
                v = values[bounds[a]: bounds[b]]
                owner = np.repeat(np.arange(b - a), np.diff(bounds[a: b + 1]))
                less = v < node[a]
                some[a:b] = large(node[a], rep[a:b], comp[a:b], n[a:b], est[a:b], v[less], owner[less])
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(rep[some])], names=["node", "rep"])

    return run


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix."""
    left = linked.any(1)
    tails, heads = [], []
    for s in np.flatnonzero(left).tolist():
        if not left[s]:
            continue
        left[s], edge = False, np.array([s])
        while len(edge):
            reach = linked[edge] & left
            new = np.flatnonzero(reach.any(0))
            tails.append(edge[reach[:, new].argmax(0)] if len(new) else new)
            heads.append(new)
            left[new], edge = False, new
    return (np.concatenate(tails), np.concatenate(heads)) if tails else (np.zeros(0, np.intp),) * 2


def _set_maker(k: int):
    """(rep, text, nodes) -> (node, rep, s): the sorted shingle set, for each node. Empty sets are left out."""
    def run(batches):
        for batch in batches:
            ids, texts, nodes = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            for a, b in chunks(texts):
                hashes, bounds = shingle_sets(texts[a:b], k)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                part = nodes.slice(a, b - a)
                rows = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
                flat, kept = part.flatten(), np.diff(bounds)[rows] > 0
                rows, flat = rows[kept], flat.filter(pa.array(kept))
                for c in range(0, len(rows), 256):
                    pick = pa.array(rows[c: c + 256])
                    yield pa.RecordBatch.from_arrays([flat.slice(c, 256), ids.slice(a, b - a).take(pick), sets.take(pick)], names=["node", "rep", "s"])

    return run


def _linker(num: int, den: int):
    """Rows (node, rep, s) sorted by node -> (a, b): a spanning forest of the links within each node, on whole sets."""
    def run(batches):
        for t, cuts in _leaves(batches):
            rep, lists = t.column(1).to_numpy(), t.column(2).combine_chunks()
            values, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(n)))
            tails, heads = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a == 2:
                    x, y = values[bounds[a]: bounds[a + 1]], values[bounds[a + 1]: bounds[b]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        tails.append(rep[a: a + 1])
                        heads.append(rep[a + 1: b])
                elif b - a > 2:
                    size = n[a:b]
                    both = overlaps(values[bounds[a]: bounds[b]], np.repeat(np.arange(b - a), size), b - a)
                    linked = np.empty(both.shape, bool)
                    for c in range(0, b - a, 256):
                        linked[c: c + 256] = (den + num) * both[c: c + 256].astype(np.int64) >= num * (size[c: c + 256, None] + size)
                    x, y = spanning(linked)
                    tails.append(rep[a:b][x])
                    heads.append(rep[a:b][y])
            if tails:
                x, y = np.concatenate(tails), np.concatenate(heads)
                other = x != y
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[other]), pa.array(np.maximum(x, y)[other])], names=["a", "b"])

    return run


def _estimated(num: int, den: int):
    """Rows (rep, p, ...) with both sides' n and est -> the rows whose estimate is at most ``MARGIN`` below the threshold."""
    least = num / den - MARGIN

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, pn = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                ok = pa.array((_alike(_wide(batch.column(4), EST, "<u8"), _wide(batch.column(5), EST, "<u8")) >= least) & _sized(n, pn, num, den))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1, 2)], names=["rep", "p", "n"])

    return run


# ---------------------------------------------------------------- the join

def near_duplicates(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100, trees: int = TREES, leaf: int = LEAF, shingles: int = SHINGLES) -> DataFrame:
    """``docs`` (doc_id long, text string, further columns ignored) -> (doc_id, n_shingles, component_id, kept), a row a document.

    Two documents are linked when den * |A and B| >= num * |A or B| on their sets of distinct ``k``-word shingles (A-Z
    lower-cased, words ``[^\\x20\\x09-\\x0D]+``). ``component_id`` is the smallest doc_id reachable; ``kept`` says that it is
    the document's own. Null or wordless texts have an empty set and no links. A null doc_id is never linked: its
    component is null and it is kept. Rows that share a doc_id are one node of the graph. An empty table gives an empty
    table. Texts of any length are taken whole."""
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Work(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = work.save(docs.mapInArrow(lean(_sketcher(k)), "doc_id long, n int, k1 long, k2 long, path binary, est binary"), "sketch")
    base = work.save(sketch.select("doc_id", "n", "k1", "k2"), "base")
    keyed = sketch.filter("n > 0 and doc_id is not null")
    reps = work.save(keyed.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "path", "est")).alias("r")).select(F.col("r.doc_id").alias("rep"), "n", "k1", "k2", "r.path", "r.est"), "reps")
    work.drop("sketch")
    join = Join(work, docs, reps.select("rep", "k1", "n", "est"), k, num, den, leaf, shingles)

    paths = reps.select("rep", "k1", "n", "path")
    order, schema = ["node", "rep", "k1", "n", "path"], "node long, rep long, k1 long, n int"
    member = paths.withColumn("node", F.lit(0).cast("long")).select(*order).mapInArrow(lean(_brancher(trees, 1, num / den)), schema)
    for depth in itertools.count():
        big = join.level(depth, member)
        if big is None:
            break
        member = big.join(paths, ["rep", "k1", "n"]).select(*order).mapInArrow(lean(_brancher(0, STEPS[depth > 0], num / den, 1 if depth else COPIES)), schema)

    classes = reps.select("rep", "n", "k1", "k2")
    if join.comps is not None:
        classes = join.label(classes, "rep", "component").withColumn("rep", F.col("component")).drop("component")
    classes = work.save(classes, "classes")
    out = base.join(classes, ["n", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


class Join:
    """The links found so far, and the components that they make."""

    def __init__(self, work: Work, docs: DataFrame, sigs: DataFrame, k: int, num: int, den: int, leaf: int, shingles: int):
        self.work, self.docs, self.sigs, self.k, self.num, self.den, self.leaf, self.shingles = work, docs, sigs, k, num, den, leaf, shingles
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def label(self, d: DataFrame, rep: str, out: str) -> DataFrame:
        """``d`` with the component ``out`` of each ``rep``."""
        if self.comps is None:
            return d.withColumn(out, F.col(rep))
        return d.join(self.comps.select(F.col("node").alias(rep), F.col("component").alias(out)), rep, "left").withColumn(out, F.coalesce(out, rep))

    def level(self, depth: int, member: DataFrame) -> DataFrame | None:
        """Compare the nodes of one depth; the members of large nodes that go on branching, or None if there are none."""
        work = self.work
        member = work.save(member, f"member{depth}")
        sizes = work.save(member.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1"), f"sizes{depth}")
        large = (F.col("size") > 2) & ((F.col("size") > self.leaf) | (F.col("shingles") > self.shingles))  # two sets always fit
        member = work.save(member.join(sizes, "node").select("node", "rep", "k1", "n", large.alias("large")), f"shared{depth}")
        work.drop(f"member{depth}", f"sizes{depth}")
        if not member.head(1):
            return None
        small, big = member.filter("not large").drop("large"), member.filter("large").drop("large")
        own = small.groupBy("rep", "k1").agg(F.collect_list("node").alias("nodes"))  # as many as the trees give a set
        own = self.label(own.join(self.sigs, ["rep", "k1"]), "rep", "comp")
        rows = own.select(F.explode("nodes").alias("node"), "rep", "comp", F.col("n").cast("long").alias("n"), "est", "nodes")
        found = rows.repartition("node").sortWithinPartitions("node").mapInArrow(lean(_contested(self.num, self.den)), "node long, rep long")
        has_big = bool(big.head(1))
        if has_big:
            found = found.union(self.stars(depth, big))
        contested = work.save(found.groupBy("rep").agg(F.collect_set("node").alias("nodes")), f"contested{depth}")
        longs = contested.agg(F.sum(F.size("nodes") + 1)).first()[0]
        if longs:
            texts = self.docs.withColumnRenamed("doc_id", "rep").join(maybe_broadcast(contested, longs), "rep")
            sets = texts.select("rep", "text", "nodes").mapInArrow(lean(_set_maker(self.k)), "node long, rep long, s array<long>")
            links = sets.repartition("node").sortWithinPartitions("node").mapInArrow(lean(_linker(self.num, self.den)), "a long, b long")
            self.add(depth, work.save(links, f"links{depth}"))
        if not has_big:
            return None
        big = self.label(big, "rep", "comp")
        open_nodes = big.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        big = work.save(big.join(open_nodes.select("node"), "node", "left_semi").select("node", "rep", "k1", "n"), f"open{depth}")
        return big if big.head(1) else None

    def add(self, depth: int, links: DataFrame) -> None:
        if links.head(1):
            self.links = links if self.links is None else self.links.union(links)
            self.comps = self.work.save(components(self.links, self.work, f"cc{depth}"), f"comps{depth}")

    def stars(self, depth: int, big: DataFrame) -> DataFrame:
        """(node, rep) of leaves made of a large node's pivot and members that may be linked with it, dealt by salt."""
        # the hash does not depend on the node: nodes of one group of similar sets elect the same few pivots
        pick = [F.min(F.struct(F.xxhash64(F.lit(PIVOTS * depth + j), "rep"), "rep", "k1")).alias(f"p{j}") for j in range(PIVOTS)]
        pivots = self.work.save(big.groupBy("node").agg(*pick), f"pivots{depth}")
        stars = big.join(pivots, "node").select("rep", "k1", F.explode(F.array_distinct(F.array(*[F.struct(f"p{j}.rep", f"p{j}.k1") for j in range(PIVOTS)]))).alias("x"))
        stars = stars.select("rep", "k1", F.col("x.rep").alias("p"), F.col("x.k1").alias("pk")).filter("rep <> p").distinct()
        stars = self.label(self.label(stars, "rep", "ca"), "p", "cb").filter("ca <> cb").drop("ca", "cb")
        other = self.sigs.select(F.col("rep").alias("p"), F.col("k1").alias("pk"), F.col("n").alias("pn"), F.col("est").alias("pest"))
        stars = stars.join(self.sigs, ["rep", "k1"]).join(other, ["p", "pk"]).select("rep", "p", "n", "pn", "est", "pest")
        stars = self.work.save(stars.mapInArrow(lean(_estimated(self.num, self.den)), "rep long, p long, n int"), f"stars{depth}")
        dealt = stars.groupBy("p").agg(F.greatest(F.ceil(F.count("*") * (2 / self.leaf)), F.ceil(F.sum("n") * (2 / self.shingles))).cast("int").alias("salts"))
        node = lambda salt: F.xxhash64(F.lit(depth), "p", salt).alias("node")
        rows = stars.join(dealt, "p").select(node(F.pmod(F.xxhash64("rep"), "salts").cast("int")), "rep")
        return rows.union(dealt.select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(node(F.col("salt")), F.col("p").alias("rep")))
