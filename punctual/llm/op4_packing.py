"""Operator 4: shortest-pack-first packing over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import TOKEN_STEP_CHARS, keep, steps, strings
from punctual.llm.tokens import text_encoder
from punctual.operators.ranking import uniform_rank

CAPACITY = 4096
END_ID = 2
# Pieces of one length that one window task orders, about.
ROWS_PER_BUCKET = 2_000
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
_PACKED = _PIECES + ", sequence_id long, offset long, sequence_tokens int, padded_to int"


def cut_documents(docs: DataFrame, tokenizer_file: str, capacity: int) -> DataFrame:
    """Every document as full pieces of ``capacity`` ids and one shorter rest, with checksums."""
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_file)
        for b in steps(batches, "text", TOKEN_STEP_CHARS):
            rows: list[list] = [[], [], [], [], []]
            for doc, raw in zip(b.column("doc_id").to_pylist(), encoder.encode(strings(b, "text"))):
                ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at:at + capacity]
                    for column, value in zip(rows, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


@dataclass
class Pattern:
    lengths: list[int]
    count: int


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Place lengths longest first, each into the packs that hold least, as whole groups of equal packs.

    Packs are kept as patterns with counts, so the work depends on the number
    of distinct lengths (at most ``capacity``), not on the number of pieces.
    """
    groups: dict[int, list[Pattern]] = {}
    room: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and room and -room[0] >= length:
            free = -room[0]
            pattern = groups[free].pop()
            if not groups[free]:
                heapq.heappop(room)
                del groups[free]
            used = min(left, pattern.count)
            left -= used
            if used < pattern.count:
                if free not in groups:
                    groups[free] = []
                    heapq.heappush(room, -free)
                groups[free].append(Pattern(list(pattern.lengths), pattern.count - used))
            pattern.lengths.append(length)
            pattern.count = used
            # Offered again only when no emptier pack is left for this length.
            rest = free - length
            if rest not in groups:
                groups[rest] = []
                heapq.heappush(room, -rest)
            groups[rest].append(pattern)
        if left:
            # New packs, filled with as many pieces of this length as fit evenly.
            each = capacity // length
            full, over = divmod(left, each)
            for count, times in ((full, each), (1 if over else 0, over)):
                if count:
                    rest = capacity - length * times
                    if rest not in groups:
                        groups[rest] = []
                        heapq.heappush(room, -rest)
                    groups[rest].append(Pattern([length] * times, count))
    return [p for free in sorted(groups) for p in groups[free]]


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """One interval of ranks per place in a pattern: the pieces of that length that go there."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        at, total = 0, sum(p.lengths)
        for length in p.lengths:
            first = taken.get(length, 0)
            taken[length] = first + p.count
            rows.append((length, first, base, at, total))
            at += length
        base += p.count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": a[:, 0] << 48 | a[:, 1], "first": a[:, 1], "base": a[:, 2], "offset": a[:, 3], "total": a[:, 4]}


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and further the ids held by its sequence and the
    length that it is padded to (``capacity``, unless what it holds is a power
    of two).  Null text is empty: the end id alone.  Null doc_ids and repeated
    rows are packed like others; an empty table gives no rows; other columns
    are ignored.
    """
    pieces = keep(cut_documents(docs, tokenizer_file, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, capacity)))
    buckets = int(min(1 << 15, max(1, max(histogram.values(), default=0) // ROWS_PER_BUCKET + 1)))
    drawn = pieces.withColumn("u", F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    ranked = uniform_rank(drawn, ["length"], "u", ["doc_id", "start"], "rank", buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = place.value
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy()
            length = b.column("length").to_numpy().astype(np.int64)
            at = np.searchsorted(s["key"], length << 48 | rank, side="right") - 1
            total = s["total"][at]
            padded = np.where(total & (total - 1) == 0, total, capacity)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                + [pa.array(s["base"][at] + rank - s["first"][at]), pa.array(s["offset"][at]),
                   pa.array(total.astype(np.int32)), pa.array(padded.astype(np.int32))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                       "sequence_tokens", "padded_to"])

    return (ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(run, _PACKED)
            .withColumn("length", F.col("length").cast("long")))
