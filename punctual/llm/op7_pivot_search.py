"""Operator 7: exact top-k inner products by pivot-table elimination (after LAESA).

Integer vectors get one more component, so that the largest inner product is
the least Euclidean distance.  Distances of every row to many pivots are
computed once per block; for a query, the largest difference of pivot
distances bounds the true distance from below, hence the score from above.
Candidates are evaluated in bound order until no bound can reach the k-th
score, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import keep
from punctual.llm.vectors import BLOCK_QUERIES, BLOCK_ROWS, best, finite, matrix, meet, one_dimension, ranked, sample

NEIGHBOURS = 5
SCALE = 256
PIVOTS = 32
STEP_ROWS = 512
_FOUND = "query_id long, vec_id long, score long"


def extended(x: np.ndarray, reach: float) -> np.ndarray:
    """Rows with the component that makes all of them ``sqrt(reach)`` long."""
    rest = np.sqrt(np.maximum(reach - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the point farthest from those chosen."""
    chosen = [int(np.einsum("ij,ij->i", points, points).argmax())]
    far = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (points ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def top_products(rows, ids, table, query, query_id, query_row, reach, floor, k):
    """Best ``k`` (scores, ids) of a block; ``floor`` is a score that k candidates elsewhere reach."""
    bound = np.abs(table - query_row).max(1)
    # Rounding of the distances stays far below this slack.
    slack = 1e-6 * (reach + query @ query) + 1e-3
    most = (reach + query @ query - bound ** 2) / 2 + slack
    order = np.argsort(-most, kind="stable")
    score, who = np.empty(0), np.empty(0, np.int64)
    for at in range(0, len(order), STEP_ROWS):
        if most[order[at]] < floor:
            break
        some = order[at:at + STEP_ROWS]
        some = some[(most[some] >= floor) & (ids[some] != query_id)]
        score = np.concatenate([score, rows[some] @ query])  # integers below 2**53: exact in doubles
        who = np.concatenate([who, ids[some]])
        top = best(-score, who, k)
        score, who = score[top], who[top]
        if len(score) == k:
            floor = max(floor, score[-1])
    return score, who


def top_k(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` highest integer inner products of each query (vec_id, embedding) with all ``vectors``.

    Components become floor(256 * x).  Returns query_id, rank, vec_id, score;
    ties go to the smaller vec_id; the query's own vec_id is no candidate;
    fewer candidates than ``k`` are all returned.  Vectors that are null,
    empty, of another length than the commonest, or hold null or non-finite
    components take no part, nor do rows without vec_id; zero vectors do.
    Repeated rows are candidates each.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    usable = lambda df: (df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite("embedding"))
                         .select("vec_id", whole.alias("x")))
    rows = keep(one_dimension(usable(vectors), "x"), "integer-vectors")
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    count, reach = rows.agg(F.count(F.lit(1)), F.max(squares)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = sample(rows, count).toPandas()  # bounded by SAMPLE_ROWS
    known = np.array(drawn["x"].tolist(), np.float64).reshape(len(drawn), -1)
    asked = usable(queries).filter(F.size("x") == known.shape[1])
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocks = -(-count // block_rows)
    shared = spark.sparkContext.broadcast((choose_pivots(extended(known, reach), pivots), known, drawn["vec_id"].to_numpy()))

    dealt = (rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known, known_ids = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for q, v in zip(b.column("vec_id").to_pylist(), matrix(b.column("x"))):
                score = (known @ v)[known_ids != q]
                out.append(float(np.partition(score, -k)[-k]) if len(score) >= k else -np.inf)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(out)], names=["query_id", "x", "floor"])

    visits = (asked.mapInArrow(floors, "query_id long, x array<double>, floor double")
              .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        pivots = shared.value[0]
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            x, ids = matrix(left["x"]), left["vec_id"].to_numpy()
            table = distances(extended(x, reach), pivots)
            asked = matrix(right["x"])
            to_pivots = distances(np.concatenate([asked, np.zeros((len(asked), 1))], axis=1), pivots)
            for i, (q, floor) in enumerate(zip(right["query_id"].to_pylist(), right["floor"].to_pylist())):
                score, who = top_products(x, ids, table, asked[i], q, to_pivots[i], reach, floor, k)
                out[0] += [q] * len(score)
                out[1] += who.tolist()
                out[2] += score.astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return ranked(meet(dealt, visits, search, _FOUND), k, F.desc("score"))
