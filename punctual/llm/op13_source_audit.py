"""Operator 13: how far the sources of one language diverge in their terms.

One translate table lowers letters and blanks separators of a whole text,
``bytes.split`` gives its terms, and a ``Counter`` per document gives
frequencies (each term of it one document).  Tasks add them up per (lang,
source, term) before they shuffle.  Everything after that is sparse: terms
that neither of two sources holds all have the same divergence, which is
multiplied; terms that one holds go by its histogram of counts; only terms
that both hold are met one by one, inside Arrow batches of whole terms that
return one sum per pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import keep, steps, strings
from punctual.llm.words import LETTERS, words

LEAST_DOCS = 10
TOP_TERMS = 10
# Terms that a task holds before it passes its sums on.
HELD_TERMS = 300_000
# Pairs of entries that are worked on at once.
PAIRS_AT_ONCE = 2_000_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SHARED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("excess", pa.int64()), ("both", pa.int64())])


def _flush(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (docs, more) in held.items():
        terms = list(docs)
        n = [docs[t] + more.get(t, 0) for t in terms]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                                          pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                                          pa.array(docs.values(), pa.int64())], schema=_COUNTS)
    held.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, dict]] = {}  # per group: documents of a term, occurrences beyond the first
    for b in steps(batches, "text"):
        for lang, source, text in zip(*(strings(b, c) for c in ("lang", "source", "text"))):
            docs, more = held.setdefault((lang, source), (Counter(), {}))
            frequency = Counter(words(text, LETTERS))
            docs.update(frequency.keys())
            for t, n in frequency.items():
                if n > 1:
                    more[t] = more.get(t, 0) + n - 1
        if sum(len(docs) for docs, _ in held.values()) > HELD_TERMS:
            yield from _flush(held)
    yield from _flush(held)


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * vocabulary)), exactly."""
    wide = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + 2 * vocabulary).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 1 + 1e9, so a square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of sources: the terms of a batch that both hold, and what they give beyond two one-sided ones."""
    for b in batches:
        entries = b.column(b.schema.get_field_index("entries"))
        begin = entries.offsets.to_numpy()
        flat = entries.flatten()
        source = flat.field("source").dictionary_encode()
        name = source.dictionary.to_pylist()
        code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        p, none = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        lang = b.column(b.schema.get_field_index("lang")).dictionary_encode()
        of_row = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = begin - begin[0]
        size = np.diff(begin)
        row = np.repeat(np.arange(len(size)), size)
        totals: dict[int, list[int]] = {}
        # Every entry meets the entries of its own term; ends[] counts such meetings.
        meetings = size[row]
        ends = np.cumsum(meetings)
        at = 0
        while at < len(row):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            left = np.repeat(np.arange(at, upto), meetings[at:upto])
            first = np.concatenate([[0], np.cumsum(meetings[at:upto])[:-1]])
            right = begin[row[left]] + np.arange(len(left)) - np.repeat(first, meetings[at:upto])
            differ = left != right
            left, right = left[differ], right[differ]
            excess = _gap(p[left], p[right]) - _gap(p[left], none[right]) - _gap(none[left], p[right])
            key, group = np.unique((of_row[row[left]] * len(name) + code[left]) * len(name) + code[right], return_inverse=True)
            total, both = np.zeros(len(key), np.int64), np.bincount(group, minlength=len(key))
            np.add.at(total, group, excess)
            for k, t, n in zip(key.tolist(), total.tolist(), both.tolist()):
                have = totals.setdefault(k, [0, 0])
                have[0] += t
                have[1] += n
            at = upto
        langs = lang.dictionary.to_pylist()
        rows = [(langs[k // len(name) ** 2], name[k // len(name) % len(name)], name[k % len(name)], t, n) for k, (t, n) in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SHARED)] if rows else
                                         [pa.array([], f.type) for f in _SHARED], schema=_SHARED)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""
    parts = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, entries): terms in enough documents of a language, with the sources that hold them."""
    return (counts.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("entries"))
            .where(F.col("docs") >= least_docs).select("lang", "term", "n", "entries"))


def _ranked(rows: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    if limit:
        out = out.where(F.col("rank") <= limit)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that mark each source.

    Null text, lang and source are ''; whole texts of any length are read;
    repeated rows count as often as they come; doc_id is not read and other
    columns are ignored; a group without terms still has its pairs; an empty
    table gives no rows.  Equal values rank by item.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = keep(kept_terms(term_counts(docs), least_docs), "audit-terms")
    entry = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("entries").alias("e")).select(
        "lang", "term", "lang_n", "e.source", F.col("e.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    totals = entry.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    # One row per (lang, source): v terms are kept in the language, the source holds ``held`` of them.
    groups = (docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
              .na.fill(0, ["v", "lang_total", "total", "held"])
              .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))))
    groups = keep(groups, "audit-groups")
    shares = (entry.join(groups, ["lang", "source"])
              .withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")),
                            "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
              .select("lang", "source", "term", "p", "q", "p0"))
    marks = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("held").alias("other_held"))
    alone = (shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
             .join(other, "lang").where("source <> other")
             .groupBy("lang", "source", "other").agg(F.sum(F.col("times") * gap(F.col("p"), F.col("q0"))).alias("mine")))
    theirs = alone.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("mine").alias("theirs"))
    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries"))
    shared = (by_term.where(F.size("entries") > 1).select("lang", "entries")
              .mapInArrow(_shared_terms, "lang string, source string, other string, excess long, both long")
              .groupBy("lang", "source", "other").agg(F.sum("excess").alias("excess"), F.sum("both").alias("both")))
    pair = ["lang", "source", "other"]
    pairs = (groups.join(other, "lang").where("source <> other")
             .join(alone, pair, "left").join(theirs, pair, "left").join(shared, pair, "left")
             .na.fill(0, ["mine", "theirs", "excess", "both"]))
    neither = F.col("v") - F.col("held") - F.col("other_held") + F.col("both")
    value = F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(
        F.col("mine") + F.col("theirs") + F.col("excess") + neither * gap(F.col("p0"), F.col("q0")))
    pairs = pairs.select("lang", "source", F.col("other").alias("item"), value.alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(marks, "term", top))
