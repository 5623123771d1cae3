"""Operator 1: approximate nearest neighbours in a stable projection (after SRS, Sun et al., 2014).

Vectors are projected on a few Gaussian directions (2-stable: the projected
squared distance of two vectors, over their squared distance, is chi-square
distributed).  A k-d tree over the projections, its upper levels fitted on a
bounded sample, deals rows into cells; inside a block another k-d tree lists
projected neighbours incrementally, which are verified on the original
vectors until a chi-square test says that nothing nearer is left with the
wanted probability.  The same test spares a query whole cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import keep
from punctual.llm.vectors import BLOCK_QUERIES, BLOCK_ROWS, best, finite, matrix, meet, one_dimension, ranked, sample

NEIGHBOURS = 10
DIRECTIONS = 8
# Probability with which a neighbour nearer than the k-th found must have been listed before the search stops.
CONFIDENCE = 0.95
# Rounding allowed to a projected squared distance, as a share of the query's squared norms: products of one row
# and of many differ in the last bits.
ROUNDING = 1e-9
LEAF_ROWS = 32
STEP_LEAVES = 16
MOST_CELLS = 256
_FOUND = "query_id long, vec_id long, score double"


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Distribution function for even degrees of freedom: 1 - exp(-x/2) * sum (x/2)^i / i!."""
    if degrees % 2:
        raise ValueError("even degrees of freedom only")
    h = np.minimum(np.asarray(x, float), 1e6) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, degrees // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(np.array([mid]), degrees)[0] < p else (lo, mid)
    return hi


def reach(stop: float, radius: float, query: np.ndarray, projected: np.ndarray) -> float:
    """Largest projected squared distance at which a row within ``radius`` of ``query`` is looked for."""
    return stop * radius * radius + ROUNDING * float(query @ query + projected @ projected) if radius < np.inf else np.inf


class Cells:
    """Upper levels of the k-d tree: splits and, per cell, the box that holds all its rows."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits: list[tuple] = []  # (dimension, value, left, right); negative: cell number
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        d = points.shape[1]
        self.root = self._grow(points, cells, np.full(d, -np.inf), np.full(d, np.inf))
        self.low, self.high = (np.array([b[i] for b in self.boxes]) for i in (0, 1))

    def _grow(self, points, cells, low, high) -> int:
        if cells > 1 and len(points) > 1:
            dim = int(np.ptp(points, axis=0).argmax())
            value = float(np.quantile(points[:, dim], (cells // 2) / cells))
            left = points[:, dim] < value
            if left.any() and not left.all():
                at = len(self.splits)
                self.splits.append(())
                high_left, low_right = high.copy(), low.copy()
                high_left[dim] = low_right[dim] = value
                a = self._grow(points[left], cells // 2, low, high_left)
                b = self._grow(points[~left], cells - cells // 2, low_right, high)
                self.splits[at] = (dim, value, a, b)
                return at
        self.boxes.append((low, high))
        return -len(self.boxes)

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, who = stack.pop()
            if node < 0:
                out[who] = -node - 1
            elif len(who):
                dim, value, a, b = self.splits[node]
                left = points[who, dim] < value
                stack += [(a, who[left]), (b, who[~left])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from ``point`` to each cell's box."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(1)


class Tree:
    """k-d tree of a block: rows in leaf order and the tight box of each leaf."""

    def __init__(self, points: np.ndarray):
        order, ends = np.arange(len(points)), []
        stack, out = [order], []
        while stack:
            part = stack.pop()
            if len(part) <= LEAF_ROWS:
                out.append(part)
                continue
            dim = int(np.ptp(points[part], axis=0).argmax())
            half = len(part) // 2
            part = part[np.argpartition(points[part, dim], half)]  # by position: equal points are split too
            stack += [part[half:], part[:half]]
        self.order = np.concatenate(out) if out else order
        ends = np.cumsum([len(p) for p in out])
        self.start = ends - [len(p) for p in out]
        self.end = ends
        self.points = points[self.order]
        self.low = np.minimum.reduceat(self.points, self.start, axis=0)
        self.high = np.maximum.reduceat(self.points, self.start, axis=0)

    def search(self, vectors, ids, query, query_id, projected, radius, k, stop) -> tuple[np.ndarray, np.ndarray]:
        """Nearest ``k`` (distances, ids): leaves by gap, their rows verified, until the test holds."""
        gaps = (np.maximum(np.maximum(self.low - projected, projected - self.high), 0) ** 2).sum(1)
        leaves = np.argsort(gaps, kind="stable")
        near, who = np.empty(0), np.empty(0, np.int64)
        at, size = 0, STEP_LEAVES
        while at < len(leaves) and gaps[leaves[at]] <= reach(stop, radius, query, projected):
            some = leaves[at:at + size]
            rows = np.concatenate([np.arange(self.start[i], self.end[i]) for i in some])
            gap = ((self.points[rows] - projected) ** 2).sum(1)
            rows = self.order[rows[gap <= reach(stop, radius, query, projected)]]
            rows = rows[ids[rows] != query_id]
            difference = vectors[rows] - query
            near = np.concatenate([near, np.sqrt(np.einsum("ij,ij->i", difference, difference))])
            who = np.concatenate([who, ids[rows]])
            top = best(near, who, k)
            near, who = near[top], who[top]
            if len(near) == k:
                radius = min(radius, near[-1])
            at, size = at + size, size * 2
        return near, who


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, directions: int = DIRECTIONS,
            confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """The ``k`` nearest found of each query (vec_id, embedding) among all ``vectors``: query_id, rank, vec_id, score.

    Euclidean distance in double precision; the query's own vec_id is no
    candidate; ties go to the smaller vec_id; fewer candidates than ``k`` are
    all returned.  Vectors that are null, empty, zero, of another length than
    the commonest, or hold null or non-finite components take no part, nor
    do rows without vec_id.  Repeated rows are candidates each.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    usable = lambda df: (df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite("embedding"))
                         .filter(F.exists("embedding", lambda x: x != 0)))
    rows = one_dimension(usable(vectors), "embedding")
    count = rows.count()
    drawn = sample(rows, count).toPandas()  # bounded by SAMPLE_ROWS
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn_vectors = np.array(drawn["embedding"].tolist(), np.float64).reshape(len(drawn), -1)
    width = drawn_vectors.shape[1]
    projection = np.random.default_rng(seed).standard_normal((width, directions))
    cells = Cells(drawn_vectors @ projection, max(1, min(MOST_CELLS, -(-count // block_rows))))
    stop = chi_square_quantile(confidence, directions)
    shared = spark.sparkContext.broadcast((projection, cells, drawn_vectors, drawn["vec_id"].to_numpy()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, cells, _, _ = shared.value
        for b in batches:
            if b.num_rows:
                cell = cells.cell(matrix(b.column("embedding")) @ projection)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["vec_id", "embedding", "cell"])

    dealt = keep(rows.mapInArrow(deal, "vec_id long, embedding array<float>, cell int"), "dealt-vectors")
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most MOST_CELLS
    parts = [-(-sizes.get(c, 0) // block_rows) for c in range(len(cells.boxes))]
    asked = usable(queries).filter(F.size("embedding") == width)
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, cells, known, known_ids = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            points = matrix(b.column("embedding"))
            low = points @ projection
            at, block, radii = [], [], []
            for i, q in enumerate(b.column("vec_id").to_pylist()):
                others = known[known_ids != q] - points[i]
                d = np.sqrt(np.einsum("ij,ij->i", others, others))
                radius = float(np.partition(d, k - 1)[k - 1]) if len(d) >= k else np.inf
                for c in np.flatnonzero(cells.gaps(low[i]) <= reach(stop, radius, points[i], low[i])):
                    at += [i] * parts[c]
                    block += [int(c) << 32 | p for p in range(parts[c])]
                    radii += [radius] * parts[c]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), b.column("vec_id").take(take), b.column("embedding").take(take),
                                              pa.array(radii, pa.float64())], names=["block", "query_id", "query", "radius"])

    visits = (asked.mapInArrow(visit, "block long, query_id long, query array<float>, radius double")
              .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")))
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(max(1, p)) for p in parts]), F.col("cell") + 1).cast("long"))
    blocks = (dealt.withColumn("block", F.shiftleft(F.col("cell").cast("long"), 32).bitwiseOR(part)).drop("cell")
              .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        projection = shared.value[0]
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            vectors, ids = matrix(left["embedding"]), left["vec_id"].to_numpy()
            tree = Tree(vectors @ projection)
            asked, low = matrix(right["query"]), matrix(right["query"]) @ projection
            for i, (q, radius) in enumerate(zip(right["query_id"].to_pylist(), right["radius"].to_pylist())):
                near, who = tree.search(vectors, ids, asked[i], q, low[i], radius, k, stop)
                out[0] += [q] * len(near)
                out[1] += who.tolist()
                out[2] += near.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                        names=["query_id", "vec_id", "score"])

    return ranked(meet(blocks, visits, search, _FOUND), k, F.col("score"))
