"""Operator 8: token-ID files (rANS) written in document order and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import rans
from punctual.llm.common import TOKEN_STEP_CHARS, fresh_path, keep, run_totals, steps, strings
from punctual.llm.tokens import text_encoder

END_ID = 2
_IDS = "doc_id long, place long, ids binary, counts binary"
_FILE = "part int, block int, before long, n long, payload binary"
_READ = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
VOCABULARY = 1 << 16


def encoded(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Ids of every document, encoded where its text is read; each task adds a row of its ids' frequencies."""
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_file)
        total = np.zeros(VOCABULARY, "<i8")
        for b in steps(batches, "text", TOKEN_STEP_CHARS):
            ids = [raw + end for raw in encoder.encode(strings(b, "text"))]
            total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=VOCABULARY)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(ids, pa.binary()),
                                              pa.nulls(len(ids), pa.binary())], names=["doc_id", "place", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([total.tobytes()], pa.binary())], names=["doc_id", "place", "ids", "counts"])

    return docs.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(run, _IDS)


def token_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents (one row per id reaches the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for raw in b.column("counts"):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(VOCABULARY, np.int64)
    rows = ids.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id int, n long")
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, tokenizer_file: str, path: str, block_tokens: int = rans.BLOCK_TOKENS) -> str:
    """Encode whole texts and write the token file (blocks and their shared table) to ``path``.

    Defined cases: null text is empty and yields the end id alone; a null
    doc_id sorts first and stays null; repeated rows are written each;
    an empty table gives a file without blocks; other columns are ignored.
    A document is never split between blocks, so a very long text makes a
    larger block.
    """
    spark = docs.sparkSession
    ids = keep(encoded(docs, tokenizer_file), "token-ids")
    freq = rans.Table.scaled(token_counts(ids))
    shared = spark.sparkContext.broadcast(freq)  # 2**16 numbers
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ids are shuffled, not texts; equal doc_ids go by their text.
    ordered = (ids.where(F.col("ids").isNotNull()).select("doc_id", "place", "ids").repartitionByRange(n, "doc_id", "place")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = rans.Table(shared.value), TaskContext.get().partitionId()
        block = before = held = 0
        doc_ids, lengths, raw = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            known = np.array([d is not None for d in doc_ids])
            payload = rans.encode_block(np.frombuffer(b"".join(raw), "<u2"), np.array([d or 0 for d in doc_ids], "<i8"),
                                        np.array(lengths, "<u4"), table, known)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                   pa.array([held], pa.int64()), pa.array([payload], pa.binary())]
            block, before, held = block + 1, before + held, 0
            doc_ids.clear(), lengths.clear(), raw.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "before", "n", "payload"])

        for b in batches:
            for doc, one in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                one = one.as_buffer()
                doc_ids.append(doc)
                raw.append(one)
                lengths.append(one.size // 2)
                held += lengths[-1]
                if held >= block_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered.mapInArrow(run, _FILE).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "frequencies binary").write.parquet(f"{path}/table")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode a token file: doc_id, start (ids before it in the whole file), n_tokens, ids_crc32."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first()[0], "<u4")
    blocks = spark.read.schema(_FILE).parquet(f"{path}/blocks")
    bases = spark.sparkContext.broadcast(dict(run_totals(blocks, "part", "n")))  # one entry per written partition
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for b in batches:
            for part, before, payload in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("payload")):
                block = rans.Block(payload.as_py())
                raw = memoryview(block.ids(table).astype("<u4").tobytes())
                ends = np.cumsum(block.lengths, dtype=np.int64)
                starts = ends - block.lengths
                crc = [zlib.crc32(raw[4 * a:4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crc), part, np.int32)), pa.array(block.documents, mask=~block.known),
                     pa.array(starts + bases.value[part] + before), pa.array(block.lengths.astype(np.int64)),
                     pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "before", "payload").mapInArrow(run, _READ).drop("part")


def token_files(docs: DataFrame, tokenizer_file: str, block_tokens: int = rans.BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` as a token file on shared storage and read it back."""
    path = write(docs, tokenizer_file, fresh_path(docs.sparkSession, "token-file"), block_tokens)
    return read(docs.sparkSession, path)
