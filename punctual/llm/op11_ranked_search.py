"""Operator 11: ranked lexical search, term at a time, with limited accumulators.

Documents are indexed in blocks on shared storage: the postings of every
term that a query holds, sorted by term.  A block takes each query's terms
rarest first and adds their exact contributions to one accumulator per
document.  Once the bounds of the terms to come (their largest contribution
in this block) sum to less than the k-th partial score, no accumulator is
created any more: a document first met now could not reach the k best.
Those that exist are still updated exactly, and dropped only when their
score and the remaining bounds fall below the k-th.  A block returns its k
best, and Spark ranks them over all blocks.  All is integer arithmetic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import keep, steps, strings
from punctual.llm.words import LETTERS_AND_DIGITS, words

# Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000
# Text of the queries that are searched in one pass over the blocks; more queries take more passes.
QUERY_BYTES = 8_000_000

_BLOCK = "n_docs long, n_words long, doc_id binary, has_id binary, length binary, term binary, doc binary, tf binary, df array<struct<term:int,n:long>>"
_HIT = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_INDEX = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("doc_id", "has_id", "length", "term", "doc", "tf")],
                    ("df", pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())])))])


def _indexer(vocabulary):
    """Blocks of postings of the terms in the broadcast ``vocabulary`` (term to number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in steps(batches, "text", BLOCK_BYTES):
            lengths, term, doc, tf = [], [], [], []
            for i, text in enumerate(strings(b, "text")):
                found = words(text, LETTERS_AND_DIGITS)
                lengths.append(len(found))
                frequency = Counter(found)
                for t in number.keys() & frequency.keys():
                    term.append(number[t])
                    doc.append(i)
                    tf.append(frequency[t])
            term = np.array(term, np.int32)
            order = np.argsort(term, kind="stable")
            once, df = np.unique(term, return_counts=True)
            ids = b.column(b.schema.get_field_index("doc_id"))
            length = np.array(lengths, np.int64)
            yield pa.RecordBatch.from_pylist([{
                "n_docs": int((length > 0).sum()), "n_words": int(length.sum()),
                "doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                "has_id": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "length": length.astype("<i8").tobytes(),
                "term": term[order].astype("<i4").tobytes(), "doc": np.array(doc, "<i4")[order].tobytes(),
                "tf": np.array(tf, "<i8")[order].tobytes(),
                "df": [{"term": int(t), "n": int(n)} for t, n in zip(once, df)]}], schema=_INDEX)

    return run


def best_of_block(query: list, postings: dict, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block (by position) that may be among the k best, and their exact scores.

    ``query``: its terms, rarest first; ``postings``: term to (documents, contributions, largest contribution).
    """
    lists = [postings[t] for t in query if t in postings]
    remaining = sum(bound for _, _, bound in lists)
    score = np.zeros(n_docs, np.int64)
    for at, (docs, adds, bound) in enumerate(lists):
        score[docs] += adds
        remaining -= bound
        if at + 1 < len(lists) and n_docs > k and np.partition(score, -k)[-k] > remaining:
            break
    else:
        at = len(lists)
    alive = np.flatnonzero(score)
    for docs, adds, bound in lists[at + 1:]:
        # Accumulators only: look each survivor up in the postings, which are sorted by document.
        where = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
        hit = docs[where] == alive
        score[alive[hit]] += adds[where[hit]]
        remaining -= bound
        if len(alive) > k:
            partial = score[alive]
            alive = alive[partial + remaining >= np.partition(partial, -k)[-k]]
    return alive, score[alive]


def _searcher(shared, k: int):
    """The k best of every query in every block (``shared``: queries as term lists, weights, N and L)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, n_all, n_words = shared.value
        for row in (r for b in batches for r in b.to_pylist()):
            has_id = np.frombuffer(row["has_id"], bool)
            ids = np.frombuffer(row["doc_id"], "<i8")
            order = np.lexsort((ids, has_id))  # a null id comes before all others
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            m = np.array([50 + 50 * n * n_all // n_words if n_words else 50 for n in np.frombuffer(row["length"], "<i8").tolist()], np.int64)
            term, doc, tf = np.frombuffer(row["term"], "<i4"), np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["tf"], "<i8")
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
            once, begin = np.unique(term, return_index=True)
            postings = {}
            for t, a, z in zip(once.tolist(), begin.tolist(), [*begin.tolist()[1:], len(term)]):
                adds = weight[t] * impact[a:z]
                postings[t] = doc[a:z], adds, int(adds.max())
            out = []
            for number, terms in queries:
                found, score = best_of_block(terms, postings, len(ids), k)
                found, score = found[score > 0], score[score > 0]
                best = np.lexsort((place[found], -score))[:k]
                out += [(number, int(ids[d]) if has_id[d] else None, int(s)) for d, s in zip(found[best], score[best])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HIT)], schema=_HIT)

    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _pass(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(query, doc_id, score) candidates of some queries, given as (number, text)."""
    spark = docs.sparkSession
    terms = [sorted(set(words(text or "", LETTERS_AND_DIGITS))) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms)))} if terms else {}
    given = spark.sparkContext.broadcast(vocabulary)
    index = keep(docs.select("doc_id", "text").mapInArrow(_indexer(given), _BLOCK), "search-index")
    total = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = total[0] or 0, total[1] or 0
    # One number per term of these queries.
    df = dict(index.select(F.explode("df").alias("e")).groupBy("e.term").agg(F.sum("e.n")).collect())
    weight = {t: term_weight(n_docs, n) for t, n in df.items()}
    rare_first = [(number, sorted((vocabulary[t] for t in ts if vocabulary[t] in df), key=lambda t: (df[t], t)))
                  for (number, _), ts in zip(items, terms)]
    given.unpersist()
    shared = spark.sparkContext.broadcast((rare_first, weight, n_docs, n_words))
    blocks = index.select("doc_id", "has_id", "length", "term", "doc", "tf")
    return blocks.mapInArrow(_searcher(shared, k), "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of every item, by exact score, ties by doc_id.

    Null and empty texts have no terms, so such documents are in no result
    and such items have none.  A null doc_id is ranked before all others;
    repeated documents are each ranked; a repeated row of ``items`` counts
    once, and different texts under one item_id are different items.  A text
    longer than a block is a block of its own.  Other columns are ignored; an
    empty table gives no rows.  Queries are taken in passes of at most about
    ``QUERY_BYTES`` of text (or one item), whose terms are what a pass broadcasts.
    """
    items = keep(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
                 .withColumn("query", F.xxhash64("item_id", "text")), "search-items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + size // QUERY_BYTES
    found = None
    for i in range(passes):
        part = items.where(F.pmod("query", F.lit(passes)) == i).select("query", "text").collect()
        hits = _pass(docs, [(r.query, r.text) for r in part], k)
        found = hits if found is None else found.unionByName(hits)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
