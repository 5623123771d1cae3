"""Operator 6: language of texts from a conditional random field over their words.

The field is trained on a bounded sample of labelled texts, from which
code-switched sequences are put together, so that transitions between
languages are learned too.  A text's language is the one with the largest
mean marginal over all its words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm import crf
from punctual.llm.common import held, no_cycles, steps, strings
from punctual.llm.tokens import Memo

UNKNOWN = "und"
# Bound of the training sample: texts per language, and words of each (windows drawn over the whole text).
TRAIN_TEXTS = 300
TRAIN_WORDS = 96
WINDOW = 24
# Words of one language in a row in a code-switched training sequence.
STRETCH = (3, 20)
SEQUENCE = 64
# Bound on the memo of a Python worker.
MEMO_WORDS = 200_000
# Texts whose words have a best marginal below this on average count as of no known language.
LEAST_SCORE = 0.4
_NOT_LETTER = re.compile(r"[\W\d_]+")
_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def letters(piece: str) -> str:
    """Letters of a piece between white space, lower-cased; empty if it has none."""
    return _NOT_LETTER.sub("", piece).lower()


def training_words(docs: DataFrame, texts: int = TRAIN_TEXTS, words: int = TRAIN_WORDS, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(language, words) of about ``texts`` labelled texts per language, at most ``words`` words of each."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.coalesce(*[F.when(F.col("lang") == F.lit(l), F.lit(min(1.0, texts / n))) for l, n in sorted(counts.items())], F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            rows = []
            for doc, text, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                found = [w for w in map(letters, text.split()) if w]
                if len(found) > words:
                    rng = np.random.default_rng([seed, (doc or 0) & 0xFFFFFFFF])
                    starts = rng.integers(0, len(found) - WINDOW + 1, words // WINDOW)
                    found = [w for s in sorted(starts.tolist()) for w in found[s:s + WINDOW]]
                if found:
                    rows.append((lang, found))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                                             names=["lang", "words"])

    sample = usable.filter(draw < rate).mapInArrow(run, "lang string, words array<string>")
    return sorted((r["lang"], r["words"]) for r in sample.limit(2 * texts * max(1, len(counts))).collect())


def code_switched(sample: list[tuple[str, list[str]]], labels: list[str], seed: int = 11) -> list[list[tuple[str, int]]]:
    """Sequences for training: half of them as they are, half with stretches of other languages between."""
    rng = np.random.default_rng(seed)
    by_label: dict[int, list[list[str]]] = {}
    for lang, words in sample:
        by_label.setdefault(labels.index(lang), []).append(words)
    out = []
    for y, texts in by_label.items():
        for i, words in enumerate(texts):
            pairs = [(w, y) for w in words]
            if i % 2 and len(by_label) > 1:
                mixed, at = [], 0
                while at < len(pairs):
                    n = int(rng.integers(*STRETCH))
                    mixed += pairs[at:at + n]
                    at += n
                    z = int(rng.choice([k for k in by_label if k != y]))
                    other = by_label[z][int(rng.integers(len(by_label[z])))]
                    k = int(rng.integers(0, max(1, len(other) - STRETCH[0])))
                    mixed += [(w, z) for w in other[k:k + int(rng.integers(*STRETCH))]]
                pairs = mixed
            out += [pairs[k:k + SEQUENCE] for k in range(0, len(pairs), SEQUENCE)]
    return [q for q in out if q]


def fit(docs: DataFrame, texts: int = TRAIN_TEXTS, words: int = TRAIN_WORDS) -> crf.Model | None:
    """Train on rows of ``docs`` (doc_id, text, lang) that are labelled and not held out; None without any."""
    sample = training_words(docs, texts, words)
    labels = sorted({lang for lang, _ in sample})
    return crf.train(code_switched(sample, labels), labels) if labels else None


class Labeller:
    """Word marginals of whole texts; scores of pieces are kept in a bounded memo."""

    def __init__(self, model: crf.Model):
        self.model = model
        self.memo = Memo(MEMO_WORDS)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the words of all ``texts``, and how many words each has."""
        cut = [t.split() for t in texts]
        new = self.memo.missing(set().union(*cut))
        found = [letters(p) for p in new]
        known = [i for i, w in enumerate(found) if w]
        scores = self.model.scores([found[i] for i in known]).astype(np.float32)
        now = self.memo.now
        now.update(dict.fromkeys(new))
        now.update((new[i], s.tobytes()) for i, s in zip(known, scores))
        rows = [[x for x in map(now.__getitem__, c) if x is not None] for c in cut]
        self.memo.forget_long(new)
        count = np.array([len(r) for r in rows])
        score = np.frombuffer(b"".join([x for r in rows for x in r]), np.float32).reshape(-1, len(self.model.labels)).astype(np.float64)
        first = np.zeros(len(score), bool)
        first[(np.cumsum(count) - count)[count > 0]] = True
        if not len(score):
            return score, count
        return crf.marginals(score, first, self.model.transition, self.model.start)[0], count

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, its mean marginal, and the mean over the words of each word's best marginal, in whatever language."""
        with no_cycles():
            p, count = self.words(texts)
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        some = np.flatnonzero(count)
        if len(some):
            at = (np.cumsum(count) - count)[some]
            mean = np.add.reduceat(p, at, axis=0) / count[some][:, None]
            sure = np.add.reduceat(p.max(1), at) / count[some]
            for i, m, c in zip(some.tolist(), mean, sure.tolist()):
                out[i] = (self.model.labels[int(m.argmax())], float(min(1.0, max(0.0, m.max()))), c)
        return out


def _predicted(key: str, model: crf.Model | None, texts: list[str]) -> list[tuple[str, float, float]]:
    if model is None:
        return [(UNKNOWN, 0.0, 0.0)] * len(texts)
    return held(("labeller", key), lambda: Labeller(model)).predict(texts)


def predict(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; lang and source are not read.

    Null texts and texts without letters are ``und`` with score 0, and so is
    everything if there was no labelled row to learn from.  Null doc_ids
    count as not held out; repeated rows are returned each; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES rows of one number per language
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = _predicted(key, shared.value, strings(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, _OUT)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, and predict all rows."""
    return predict(docs, fit(docs))


def known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose language stays unknown (no letters, or words unsure on average).

    A word is as sure as its best marginal, so a text that switches between
    known languages stays however evenly they share it; ``least`` bounds the
    mean over its words.  All columns stay; a null ``lang`` is filled with the prediction.  With no
    labelled row to learn from only texts without letters go.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            texts = strings(b, "text")
            if shared.value is None:
                keep = [any(map(letters, t.split())) for t in texts]
                yield b.filter(pa.array(keep, pa.bool_()))
                continue
            found = _predicted(key, shared.value, texts)
            i = b.schema.get_field_index("lang")
            lang = pa.array([old or new for old, (new, *_) in zip(b.column(i).to_pylist(), found)], pa.string())
            b = pa.RecordBatch.from_arrays([lang if k == i else b.column(k) for k in range(b.num_columns)], names=b.schema.names)
            yield b.filter(pa.array([n != UNKNOWN and sure >= least for n, _, sure in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
