"""Operator 10: BPE encoding through a transducer lexicon, and decoding."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import lexicon
from punctual.llm.common import TOKEN_STEP_CHARS, held, keep, steps, strings
from punctual.llm.tokens import _PLAIN, Merger, PieceEncoder, pieces

# Words of the lexicon at most, and distinct words that one task counts at once.
LEXICON_WORDS = 200_000
SUMMARY_WORDS = 400_000
_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Word rule of the vocabulary (fixed value), with white space as Unicode defines it.
_SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")


class FrequentWords:
    """Counts of frequent words in bounded memory (Misra and Gries, 1982).

    No word occurring more than total / SUMMARY_WORDS times is lost, and sums
    of such summaries keep that property, so the lexicon is drawn from all text.
    """

    def __init__(self, limit: int = SUMMARY_WORDS):
        self.count, self.limit = Counter(), limit

    def add(self, words) -> None:
        self.count.update(words)
        if len(self.count) > 2 * self.limit:
            floor = sorted(self.count.values(), reverse=True)[self.limit]
            self.count = Counter({w: n - floor for w, n in self.count.items() if n > floor})


def word_counts(docs: DataFrame) -> DataFrame:
    """Plain lower-case words of all texts with their (summarised) counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = FrequentWords()
        for b in steps(batches, "text", TOKEN_STEP_CHARS):
            for text in strings(b, "text"):
                seen.add(pieces(text))
        words = Counter()
        for piece, n in seen.count.items():
            m = _PLAIN.match(piece)
            if m and len(piece) <= 64:
                words[m.group(2).lower()] += n
        words = [(w, n) for w, n in words.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())],
                                         names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer_file: str, limit: int = LEXICON_WORDS) -> str:
    """Build the automaton of the commonest words, ``limit`` at most, and ship its files; returns their folder name."""
    spark = docs.sparkSession
    counts = keep(word_counts(docs), "word-counts")
    # Eighths of powers of two of the counts: a few hundred classes, of which the highest that fit are taken.
    level = F.floor(F.log2("n") * 8).cast("int")
    least, taken = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        taken += r["count"]
        if taken > limit:
            break
        least = r["level"]
    words = [] if least is None else [r["word"] for r in counts.filter(level >= least).select("word").collect()]  # at most ``limit``
    ids = Merger(tokenizer_file).merge(words)
    scratch = tempfile.mkdtemp(prefix="lexicon-")
    name = os.path.basename(scratch)
    lexicon.save(lexicon.build({w.encode(): x for w, x in zip(words, ids)}), os.path.join(scratch, name))
    shutil.make_archive(os.path.join(scratch, name), "zip", os.path.join(scratch, name))
    # Spark fetches the files once per executor, also for executors that join later.
    spark.sparkContext.addArchive(os.path.join(scratch, f"{name}.zip") + f"#{name}")
    return name


class TransducerEncoder(PieceEncoder):
    """Known words by the automaton, others by merging; no tokenizer library."""

    def __init__(self, tokenizer_file: str, lexicon_folder: str):
        super().__init__(tokenizer_file)
        self.lexicon = lexicon.Lexicon(lexicon_folder)
        self.added = added = self.merger.added
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.text_of = {i: t for t, i in (self.merger.vocab | added).items()}

    def plain_words(self, words: list[str]) -> list[bytes]:
        found = self.lexicon.look_up(words)
        unseen = [w for w, ids in zip(words, found) if ids is None]
        merged = iter(self.merger.merge(unseen))
        return [next(merged) if ids is None else ids for ids in found]

    def odd_piece(self, piece: str) -> bytes:
        out = []
        for part in self.special.split(piece) if self.special else [piece]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u2").tobytes())
            elif part:
                normal = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                out.extend(self.plain_words(WORDS.findall(normal)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a space, as the file names no decoder."""
        return " ".join(map(self.text_of.__getitem__, ids))


def transducer_encoder(tokenizer_file: str, lexicon_folder: str) -> TransducerEncoder:
    return held(("transducer", tokenizer_file, lexicon_folder), lambda: TransducerEncoder(tokenizer_file, lexicon_folder))


def encode_documents(docs: DataFrame, tokenizer_file: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode every whole text and decode its ids again: doc_id, ids (16-bit), decoded text.

    Null and empty texts give no ids and empty text; null doc_ids and repeated
    rows are kept; other columns are ignored; an empty table gives no rows.
    """
    return _encoded(docs, tokenizer_file, lexicon_words, "doc_id long, ids binary, decoded string",
                    lambda doc, ids, raw, text: (doc, raw, text))


def _encoded(docs: DataFrame, tokenizer_file: str, lexicon_words: int, schema: str, row) -> DataFrame:
    name = compile_lexicon(docs, tokenizer_file, lexicon_words)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = transducer_encoder(tokenizer_file, SparkFiles.get(name))
        for b in steps(batches, "text", TOKEN_STEP_CHARS):
            rows = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), encoder.encode(strings(b, "text"))):
                ids = np.frombuffer(raw, "<u2").tolist()
                rows.append(row(doc, ids, raw, encoder.decode(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[f for f, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_digests(docs: DataFrame, tokenizer_file: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``encode_documents`` as counts and checksums of ids and decoded text."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _encoded(docs, tokenizer_file, lexicon_words, _OUT,
                    lambda doc, ids, raw, text: (doc, len(ids), sha(" ".join(map(str, ids))), sha(text)))
