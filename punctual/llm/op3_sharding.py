"""Operator 3: shards of near equal bytes by a k-d tree over metadata.

Nodes are split at the distributed weighted median along their widest
dimension.  All nodes of a level are handled together: one aggregation gives
weights and extents, a few more narrow the medians down through histograms.
Only these bounded histograms reach the driver; rows are never moved to be
split.  DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import keep
from punctual.operators.ranking import uniform_rank

SHARDS = 40
ROW_BYTES = 16
BINS = 1024
# A median is narrowed until its bin weighs at most this share of a shard, or holds one key.
TOLERANCE = 1 / 512
ROWS_PER_BUCKET = 50_000
BITS = 31


@dataclass
class Node:
    """A node that stands for ``shards`` shards from ``first`` on, and the search for its median."""

    shards: int
    first: int
    dim: int = 0
    lo: int = 0
    hi: int = 0
    below: int = 0
    target: float = 0.0
    cut: int = 0

    def halves(self) -> list[Node]:
        left = self.shards // 2
        return [Node(left, self.first), Node(self.shards - left, self.first + left)]


def _table(rows: DataFrame, columns: str, values: list[tuple]) -> DataFrame:
    """A few numbers per node (at most one row per shard) as a broadcast table."""
    text = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in values)
    return F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {text} AS t({columns})"))


def _scaled(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Each dimension as a 62-bit key: its place between minimum and maximum, then a hash of the row against ties."""
    wide = df.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{d}") for d, c in dims.items()])
    ends = wide.agg(*[f(f"_{d}").alias(f"{n}{d}") for d in dims for f, n in ((F.min, "lo_"), (F.max, "hi_"))]).first()
    tie = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit((1 << BITS) - 1))
    keys = []
    for d in dims:
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        place = F.floor((F.col(f"_{d}") - F.lit(lo)) / F.lit(max(hi - lo, 1.0)) * F.lit(float((1 << BITS) - 1)))
        keys.append(place.cast("long") * F.lit(1 << BITS) + tie)
    return wide.select("doc_id", "size", "text_crc32", tie.alias("tie"), F.array(*keys).alias("keys"), F.lit(0).cast("long").alias("node"))


def _split_level(rows: DataFrame, nodes: list[Node], tolerance: float) -> tuple[DataFrame, list[Node]]:
    """Split every node that stands for more than one shard; returns the rows in the new nodes."""
    dims = rows.select(F.size("keys")).first()
    width = dims[0] if dims else 0
    ends = [f(F.col("keys")[i]).alias(f"{n}{i}") for i in range(width) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}
    splitting = [n for n in nodes if n.shards > 1]
    searching: dict[int, Node] = {}
    for n in splitting:
        r = stats.get(n.first)
        if r is not None:  # without rows both halves stay empty
            n.dim = max(range(width), key=lambda i: (r[f"hi{i}"] >> BITS) - (r[f"lo{i}"] >> BITS))
            n.lo, n.hi = r[f"lo{n.dim}"], r[f"hi{n.dim}"] + 1
            n.target = r["w"] * (n.shards // 2) / n.shards
            searching[n.first] = n
    while searching:
        ranges = _table(rows, "node, dim, lo, hi, width",
                        [(n.first, n.dim, n.lo, n.hi, -(-(n.hi - n.lo) // BINS)) for n in searching.values()])
        near = (rows.select("node", "size", "keys").join(ranges, "node").withColumn("key", F.expr("keys[int(dim)]"))
                .filter("key >= lo and key < hi").withColumn("bin", F.expr("(key - lo) div width")))
        bins: dict[int, list] = {}
        for r in near.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("key").alias("a"), F.max("key").alias("b")).collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["w"], r["a"], r["b"]))
        for n in list(searching.values()):
            below = n.below
            for _, w, a, b in sorted(bins[n.first]):
                if below + w >= n.target:
                    break
                below += w
            if w <= tolerance or a == b:
                n.cut = a if n.target - below < below + w - n.target else b + 1
                del searching[n.first]
            else:
                n.lo, n.hi, n.below = a, b + 1, below
    if not splitting:
        return rows, nodes
    cuts = _table(rows, "node, dim, cut, above", [(n.first, n.dim, n.cut, n.halves()[1].first) for n in splitting])
    moved = rows.join(cuts, "node", "left").withColumn("node", F.expr("if(keys[int(dim)] >= cut, above, node)"))
    return keep(moved.select(*rows.columns), "shard-level"), [h for n in nodes for h in (n.halves() if n.shards > 1 else [n])]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put all ``docs`` (doc_id, text, lang, source, n_chars) into ``shards`` shards of near equal bytes.

    Size: UTF-8 bytes of the text (null: none) plus 16.  Dimensions: source,
    language, text checksum (equal texts lie together), size and doc_id; null
    counts as the least value.  Ties on a dimension are cut by a hash of the
    row, so a group of any size can be split; rows equal in doc_id and text
    stay together.  A text larger than a shard makes its shard larger.  An
    empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.crc32(F.col("source")).alias("source_n"), F.crc32(F.col("lang")).alias("lang_n"))
    rows = keep(rows, "shard-rows")
    dims = {"source": F.col("source_n"), "lang": F.col("lang_n"), "text": F.col("text_crc32"), "size": F.col("size"), "doc": F.col("doc_id")}
    keyed = keep(_scaled(rows, dims), "shard-keys")
    total, count = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    nodes = [Node(shards, 0)]
    while any(n.shards > 1 for n in nodes):
        keyed, nodes = _split_level(keyed, nodes, (total or 0) / shards * TOLERANCE)
    placed = keyed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"),
                          (F.col("tie") / F.lit(float(1 << BITS))).alias("u"))
    buckets = min(1 << 15, count // (shards * ROWS_PER_BUCKET) + 1)
    return (uniform_rank(placed, ["shard"], "u", ["doc_id", "text_crc32"], "slot", buckets)
            .select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
