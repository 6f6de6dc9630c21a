"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data share the upper levels of one cover tree.  Its points come from a bounded sample in farthest-first order,
so that those picked at gaps above a level's radius are separated by more than that radius, cover the sample within it, and
stay points of all finer levels; the finest points are the nodes, and every vector belongs to its nearest node.  For each
node the covering radius of its queries and of its data and the worst k-th score of its queries are aggregated, and are
carried up the tree; pairs of subtrees whose bound
    <q, c> + |q| r + |c| s + r s      (points q and c, covering radii s and r)
is below that score are never joined.  The first round joins each query node with its most promising data nodes.  Its k-th
scores prune the pairs of the second round, which returns only rows that reach them.  Node pairs are searched in blocks of
bounded size, each by two small cover trees with the same bound; a large node's rows are dealt to its blocks one by one, so
a vector or an id that many rows share cannot make a large block.  Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .spark_util import partitions, written

NODES, SAMPLE = 256, 2048
DATA_BLOCK, QUERY_BLOCK = 2048, 1024
#: Data blocks that one task searches in turn for one query block, keeping the running k-th scores.
RUN = 64
LEAF = 128
EXACT = 2.0**52


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as float64 rows (exact while norms stay below 2^52, else Python integers), padded with zeros."""
    out = np.zeros((len(col), dim))
    counts = np.diff(np.asarray(col.offsets))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), counts)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T)


def farthest_first(x: np.ndarray, n: int, until: float = 0.0, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of up to n spread rows, their gaps): each next row is the farthest from those before it, as long as it is
    farther than ``until``; the gap of the first is infinite."""
    picked, gaps = [start], [np.inf]
    far = ((x - x[start]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)) and far.max() > until**2:
        picked.append(int(far.argmax()))
        gaps.append(float(np.sqrt(far.max())))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked), np.array(gaps)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, distance to it); ties to the first centre."""
    square = (x**2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(axis=1)[None, :]
    at = square.argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


class CoverTree:
    """A cover tree over rows of x; node = (point, covering radius, rows, children).

    A node's children are points of its rows, its own point first; they are more than half the node's radius apart, and
    every row belongs to its nearest child, within half the radius.  Rows that are too few to divide, or so spread that
    half the radius takes a point for every few rows, stay together as a leaf."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(np.arange(len(x)), 0)

    def _node(self, rows: np.ndarray, at: int):
        own = self.x[rows]
        radius = float(np.sqrt(((own - own[at]) ** 2).sum(axis=1)).max())
        if len(rows) <= LEAF or radius == 0:
            return own[at], radius, rows, ()
        most = max(2, len(rows) // 16)
        picked, _ = farthest_first(own, most + 1, radius / 2, at)
        if len(picked) > most:
            return own[at], radius, rows, ()
        child, _ = nearest(own, own[picked])
        return own[at], radius, rows, tuple(self._node(rows[child == k], int(np.flatnonzero(np.flatnonzero(child == k) == p)[0])) for k, p in enumerate(picked))


class NodeTree:
    """The shared upper levels over at most NODES points in farthest-first order, with what queries and data lie below."""

    def __init__(self, points: np.ndarray, gaps: np.ndarray):
        self.points = points
        levels, radius = [np.array([0])], float(gaps[1]) if len(gaps) > 1 else 0.0
        while len(levels[-1]) < len(points):
            radius /= 2
            levels.append(np.flatnonzero(gaps > radius) if radius > gaps[-1] / 4 else np.arange(len(points)))
        #: children[l][p]: points of level l + 1 below point p of level l (a point is its own child).
        self.children = []
        for upper, lower in zip(levels, levels[1:]):
            to, _ = nearest(points[lower], points[upper])
            to = np.where(np.isin(lower, upper), np.searchsorted(upper, lower), to)
            self.children.append({int(p): lower[to == i] for i, p in enumerate(upper)})
        self.depth = len(levels) - 1

    def pairs(self, asked: dict, held: dict) -> list[tuple[int, int, float]]:
        """(query node, data node, bound) that survive; asked: node -> (radius, worst score), held: node -> radius."""
        below: list[dict] = [{} for _ in range(self.depth + 1)]
        for p in range(len(self.points)):
            below[-1][p] = (asked[p][0], asked[p][1], held.get(p, -np.inf)) if p in asked else (-np.inf, np.inf, held.get(p, -np.inf))
        for level in range(self.depth - 1, -1, -1):
            for p, own in self.children[level].items():
                gap = np.sqrt(((self.points[own] - self.points[p]) ** 2).sum(axis=1))
                s, worst, r = zip(*(below[level + 1][int(c)] for c in own))
                below[level][p] = float((gap + s).max()), min(worst), float((gap + r).max())
        out, todo = [], [(0, 0, 0)]
        while todo:
            level, q, c = todo.pop()
            s, worst, _ = below[level][q]
            r = below[level][c][2]
            if s == -np.inf or r == -np.inf:
                continue
            a, b = self.points[q], self.points[c]
            most = float(a @ b + np.sqrt(a @ a) * r + np.sqrt(b @ b) * s + r * s)
            if most * (1 + 1e-9) + 1e-6 < worst:
                continue
            if level == self.depth:
                out.append((q, c, most))
            else:
                todo += [(level + 1, int(x), int(y)) for x in self.children[level][q] for y in self.children[level][c]]
        return out


def search(asks: CoverTree, q_ids: np.ndarray, data: CoverTree, x_ids: np.ndarray, k: int, best: list[list[tuple]], bound: np.ndarray) -> None:
    """Take the data's candidates into ``best``, each query's (-score, id) in order, at most k; raises ``bound``, the
    scores below which a query's candidates do not count.  A query's own id is no candidate."""
    q, x = asks.x, data.x

    def visit(a, b) -> None:
        (qc, s, q_rows, q_parts), (c, r, rows, parts) = a, b
        most = qc @ c + np.sqrt(qc @ qc) * r + np.sqrt(c @ c) * s + r * s
        if most * (1 + 1e-9) + 1e-6 < bound[q_rows].min():
            return
        if not parts and not q_parts:
            scores = _products(q[q_rows], x[rows])
            hit = (scores >= bound[q_rows][:, None]).astype(bool) & (x_ids[rows][None, :] != q_ids[q_rows][:, None])
            at, of = np.nonzero(hit)
            found = list(zip((-scores[at, of]).tolist(), x_ids[rows[of]].tolist()))
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist() if len(at) else []
            for lo, hi in zip(starts, [*starts[1:], len(at)]):
                i = int(q_rows[at[lo]])
                best[i] = sorted(best[i] + [(int(v), j) for v, j in found[lo:hi]])[:k]
                if len(best[i]) == k:
                    bound[i] = max(bound[i], -best[i][-1][0])
            return
        if parts and (not q_parts or r >= s):
            for n in sorted(parts, key=lambda n: -float(qc @ n[0] + np.sqrt(qc @ qc) * n[1])):
                visit(a, n)
        else:
            for n in q_parts:
                visit(n, b)

    visit(asks.root, data.root)


def _searched(dim: int, k: int):
    """Rows (qnode, qpart, run, asks, rows) in order: every run of data blocks against its query block, best k of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = q_ids = asks = best = bound = None

        def found() -> pa.RecordBatch:
            flat = [(int(q), i, -s) for q, own in zip(q_ids, best) for s, i in own]
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = tuple(batch.column(c)[i].as_py() for c in ("qnode", "qpart", "run"))
                if now != key:
                    if key is not None:
                        yield found()
                    own = batch.column("asks").slice(i, 1).flatten()
                    key, q_ids, asks = now, own.field("vec_id").to_numpy(), CoverTree(_vectors(own.field("v"), dim))
                    best, bound = [[] for _ in q_ids], own.field("floor").to_numpy(zero_copy_only=False).astype(np.float64).copy()
                rows = batch.column("rows").slice(i, 1).flatten()
                search(asks, q_ids, CoverTree(_vectors(rows.field("v"), dim)), rows.field("vec_id").to_numpy(), k, best, bound)
        if key is not None:
            yield found()

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, nodes: int = NODES) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (vec_id, embedding, ...): the k best integer inner products.

    Components become floor(scale * x).  Queries are rows whose vec_id is divisible by ``every``; a query's own id is no
    candidate.  Null vectors, vectors with null or non-finite components and rows without an id take no part; shorter
    vectors count as padded with zeros.  Repeated rows of one id are one row each, as candidates and as queries one."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    ints = written(ints, "topk-vectors")
    n, dim = ints.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not dim:
        return empty
    drawn = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample = _vectors(drawn.column("v").combine_chunks(), dim)
    sample_ids = drawn.column("vec_id").to_numpy()
    picked, gaps = farthest_first(sample, max(1, min(nodes, n // DATA_BLOCK)))
    tree = NodeTree(sample[picked], gaps)
    shared = spark.sparkContext.broadcast((sample, sample_ids, tree.points))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, sample_ids, points = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                own, ids = _vectors(part.column("v"), dim), part.column("vec_id").to_numpy()
                node, gap = nearest(own, points)
                floor = np.full(len(own), -np.inf)
                ask = np.flatnonzero(ids % every == 0)
                if len(ask) and len(sample_ids) > k:
                    scores = _products(own[ask], sample).astype(np.float64)
                    scores[ids[ask][:, None] == sample_ids[None, :]] = -np.inf
                    floor[ask] = np.partition(scores, -k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(node, pa.int32()), pa.array(gap), pa.array(floor)], names=["vec_id", "v", "node", "gap", "floor"])

    placed = written(ints.mapInArrow(assign, "vec_id long, v array<long>, node int, gap double, floor double"), "topk-nodes")
    asks = written(placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "topk-asks")
    held = {r.node: (r.r, r.c) for r in placed.groupBy("node").agg(F.max("gap").alias("r"), F.count(F.lit(1)).alias("c")).collect()}

    def asked(asks: DataFrame) -> dict:
        return {r.node: (r.s, r.worst, r.c) for r in asks.groupBy("node").agg(F.max("gap").alias("s"), F.min("floor").alias("worst"), F.count(F.lit(1)).alias("c")).collect()}

    def dealt(df: DataFrame, sizes: dict, size: int) -> DataFrame:
        """Rows of a node in blocks of about ``size``, a block a row."""
        blocks = F.create_map(*[F.lit(v) for node, c in sizes.items() for v in (node, -(-c // size))])
        df = df.withColumn("part", F.pmod(F.monotonically_increasing_id(), blocks[F.col("node")]).cast("int"))
        return df.groupBy("node", "part").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("rows"))

    def joined(asks: DataFrame, now: dict, pairs: list[tuple[int, int]]) -> DataFrame:
        """(query_id, vec_id, score) of the node pairs, at most k rows for a query and run of blocks."""
        wanted = [(q, -(-now[q][2] // QUERY_BLOCK), c) for q, c in pairs]
        wanted = F.broadcast(spark.createDataFrame(wanted, "qnode int, qparts int, node int"))  # at most NODES^2 rows
        data = dealt(placed, {node: c for node, (_, c) in held.items()}, DATA_BLOCK).withColumn("run", F.pmod(F.xxhash64("node", "part"), F.lit(-(-n // (RUN * DATA_BLOCK)))).cast("int"))
        data = data.join(wanted, "node").withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
        queries = dealt(asks, {node: c for node, (_, _, c) in now.items()}, QUERY_BLOCK).select(F.col("node").alias("qnode"), F.col("part").alias("qpart"), F.col("rows").alias("asks"))
        met = data.join(queries, ["qnode", "qpart"]).select("qnode", "qpart", "run", "asks", "rows")
        met = met.repartition(partitions(spark), "qnode", "qpart", "run").sortWithinPartitions("qnode", "qpart", "run")
        return met.mapInArrow(_searched(dim, k), "query_id long, vec_id long, score long")

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    now = asked(asks)
    if not now:
        return empty
    near: dict[int, list] = {}
    for q, c, most in tree.pairs(now, {node: r for node, (r, _) in held.items()}):
        near.setdefault(q, []).append((-most, c))
    first = []
    for q, found in near.items():
        rows = 0
        for _, c in sorted(found):
            first.append((q, c))
            rows += held[c][1]
            if rows > DATA_BLOCK:
                break
    first = sorted(first)
    early = written(ranked(joined(asks, now, first)).drop("rank"), "topk-first") if first else None
    if early is None:
        return empty
    reached = early.groupBy("query_id").agg(F.min("score").cast("double").alias("_kth"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") == k)
    asks = asks.join(reached.select(F.col("query_id").alias("vec_id"), "_kth"), "vec_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("_kth", F.col("floor")))).drop("_kth")
    asks = written(asks, "topk-asks")
    now = asked(asks)
    late = sorted({(q, c) for q, c, _ in tree.pairs(now, {node: r for node, (r, _) in held.items()})} - set(first))
    out = early.unionByName(joined(asks, now, late)) if late else early
    return ranked(out).select("query_id", "rank", "vec_id", "score")
