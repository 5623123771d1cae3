"""Operator 12: personal data by fixed forms and by contexts that they teach.

Seed entities are the base matches of four kinds.  Every identifier-like
string of the corpus (it holds a digit or an at sign) is a candidate, and
the two words before it and after it are its lexical patterns.  On the graph
of distinct patterns and instances, a pattern's confidence for a kind is the
mean score of its instances, shrunk by ``PRIOR``; an instance that has the
form of a kind scores 1 for it, any other the mean confidence of its
patterns.  After a few rounds, confident patterns name instances that have
no known form.  Candidates of a known form that the base rules passed over
(two card numbers that only a space parts) are added too.

Everything is DataFrame functions; shares are integers (per mille), so the
result does not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import keep

KINDS = ("email", "ip", "card", "phone")
FOUND = tuple(f"context_{k}" for k in KINDS)

# A run is tried once, from its first character or where the last match ended, so no text takes quadratic time.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole run of digits with single separators, of 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Phone numbers and cards whole, else a run of identifier characters that holds a digit or an at sign.
_TOKEN = "[A-Za-z0-9@._%+-]"
CANDIDATE = rf"{PHONE}|{CARD}|(?<!{_TOKEN})[A-Za-z._%+-]*+[0-9@]{_TOKEN}*+"

CONTEXT_CHARS = 64
LEAST_CHARS = 5
PRIOR = 1
ROUNDS = 3
SURE_PATTERN = 700
SURE_INSTANCE = 500
# Spans are laid over pieces of a text of this length to find which of them overlap.
CELL = 256
# Spans that a fold appends to before it sets them aside, so that many spans take linear time.
CHUNK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is an entity."""
    if kind == "ip":
        return match.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def form_of(text: Column) -> Column:
    """The kind whose form ``text`` has as a whole, or null."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(text.rlike(rf"\A(?:{PATTERNS[kind]})\z") & holds(kind, text), F.lit(kind)).otherwise(out)
    return out


def located(text: Column, pattern: str, ok, kept) -> Column:
    """All matches of ``pattern`` that pass ``ok(match)``, as ``kept(start, match, piece before, piece after)``.

    ``split`` gives the text between the matches; their lengths in code points add up to the offsets.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    # Bound to a variable, the pieces are cut once; the row of the last piece has no match and passes no test.
    rows = F.get(F.transform(F.array(F.split(text, pattern)), lambda gaps: F.arrays_zip(
        matches, gaps.alias("before"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))), 0)
    # Types of an empty fold: what ``kept`` makes of one match.
    one = F.array(kept(F.lit(0).cast("long"), F.lit(""), F.lit(""), F.lit("")))
    none = F.slice(one, 1, 0)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.array(one), 1, 0).alias("done"), none.alias("now"))

    def step(acc, r):
        before, match = r["before"], r["match"]
        start = acc["at"] + F.length(before)
        now = F.when(match.isNotNull() & ok(match), F.concat(acc["now"], F.array(kept(start, match, before, r["after"])))).otherwise(acc["now"])
        full = F.size(acc["now"]) >= CHUNK
        return F.struct((start + F.length(match)).alias("at"),
                        F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
                        F.when(full, F.filter(now, lambda x: x["start"] >= acc["at"])).otherwise(now).alias("now"))

    return F.aggregate(rows, zero, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def _span(start: Column, match: Column, kind: int) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("end"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *FOUND)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _candidate(start: Column, match: Column, before: Column, after: Column) -> Column:
    text = F.regexp_replace(match, r"[._%+-]+\z", "")
    two = r"([^\s]+)"
    left = F.regexp_extract_all(F.lower(F.right(before, F.lit(CONTEXT_CHARS))), F.lit(two))
    right = F.regexp_extract_all(F.lower(F.left(after, F.lit(CONTEXT_CHARS))), F.lit(two))
    patterns = F.array(F.concat(F.lit("< "), F.array_join(F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), 2), " ")),
                       F.concat(F.lit("> "), F.array_join(F.slice(right, 1, 2), " ")))
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"), patterns.alias("patterns"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, candidates) per row; ``key`` names the text."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    base = [located(F.col("text"), PATTERNS[k], lambda m, k=k: holds(k, m), lambda s, m, *_, n=n: _span(s, m, n)) for n, k in enumerate(KINDS)]
    hint = {"email": "@", "ip": ".", "phone": "+"}
    base = [F.when(F.contains("text", F.lit(hint[k])), b).otherwise(F.slice(F.array(_span(F.lit(0).cast("long"), F.lit(""), 0)), 1, 0))
            if k in hint else b for k, b in zip(KINDS, base)]
    long_enough = lambda m: F.length(m) >= LEAST_CHARS
    return docs.select("doc_id", F.md5("text").alias("key"), F.array_sort(F.concat(*base)).alias("base"),
                       located(F.col("text"), CANDIDATE, long_enough, _candidate).alias("candidates"))


def scored_edges(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confidence per pattern (p_) and score per instance (s_), in per mille of each kind, on the edges of unknown form.

    ``edges``: distinct (pattern, text, form).  Patterns that never meet a seed are left out: they stay at 0.
    """
    seeded = edges.where(F.col("form").isNotNull()).select("pattern").distinct()
    edges = keep(edges.join(seeded, "pattern"), "pii-edges")
    seed = {k: F.when(F.col("form") == k, 1000).otherwise(0).cast("long") for k in KINDS}
    zero = [f"s_{k}" for k in KINDS]
    known = edges.withColumns({s: F.lit(0).cast("long") for s in zero})
    for _ in range(rounds):
        value = {k: F.when(F.col("form").isNotNull(), seed[k]).otherwise(F.col(f"s_{k}")) for k in KINDS}
        patterns = known.groupBy("pattern").agg(*[F.call_function("div", F.sum(value[k]), F.count(F.lit(1)) + PRIOR).alias(f"p_{k}") for k in KINDS])
        patterns = keep(patterns, "pii-patterns")
        unknown = edges.where(F.col("form").isNull()).join(patterns, "pattern")
        scores = keep(unknown.groupBy("text").agg(*[F.call_function("div", F.sum(f"p_{k}"), F.count(F.lit(1))).alias(f"s_{k}") for k in KINDS]),
                      "pii-instances")
        known = edges.join(scores, "text", "left").na.fill(0, zero)
    return unknown.join(scores, "text")


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {CELL}"), F.expr(f"(end - 1) div {CELL}"))))


def found_spans(scans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, key, start, kind, end): spans beside the base ones, once per distinct (doc_id, key)."""
    once = scans.select("doc_id", "key", F.explode("candidates").alias("c")).select("doc_id", "key", "c.*")
    once = keep(once.withColumn("form", form_of(F.col("text"))), "pii-candidates")
    each = once.select(F.explode("patterns").alias("pattern"), F.lower("text").alias("text"), "form").where(F.length("pattern") > 2)
    edges = each.groupBy("pattern", "text").agg(F.max("form").alias("form"))
    scored = scored_edges(edges, rounds)
    best = F.greatest(*[F.struct(F.col(f"p_{k}").alias("p"), F.lit(-n).alias("first"), F.lit(n).alias("kind"), F.col(f"s_{k}").alias("s"))
                        for n, k in enumerate(KINDS)])
    sure = (scored.withColumn("best", best).where((F.col("best.p") >= SURE_PATTERN) & (F.col("best.s") >= SURE_INSTANCE))
            .groupBy("pattern", "text").agg(F.min("best.kind").alias("kind")))
    unknown = once.where(F.col("form").isNull()).withColumn("pattern", F.explode("patterns")).withColumn("lowered", F.lower("text"))
    named = (unknown.join(sure.withColumnRenamed("text", "lowered"), ["pattern", "lowered"])
             .groupBy("doc_id", "key", "start", "end").agg(F.min("kind").alias("kind")))
    formed = once.where(F.col("form").isNotNull()).select(
        "doc_id", "key", "start", "end", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("form")).cast("int") - 1)
    added = named.union(formed).distinct()
    # What overlaps a base span is known already.
    old = _cells(scans.select("doc_id", "key", F.explode("base").alias("b")).select("doc_id", "key", F.col("b.start").alias("start"), F.col("b.end").alias("end")))
    old = old.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("cell").alias("at"), F.col("start").alias("a"), F.col("end").alias("z"))
    cells = _cells(added)
    met = cells.join(old, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("cell") == F.col("at"))
                     & (F.col("start") < F.col("z")) & (F.col("a") < F.col("end"))).select("doc_id", "key", "start", "end").distinct()
    met = met.select(*[F.col(c).alias(f"{c}_") for c in met.columns])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("doc_id", "key", "start", "end")]
    return added.join(met, same[0] & same[1] & same[2] & same[3], "left_anti").select("doc_id", "key", "start", "kind", "end")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personal data of every whole text: counts of the base kinds, their digest, and all spans.

    Spans beside the base ones have the kinds ``context_...`` and follow base
    ones that start at the same place.  Null text is empty and holds none;
    null doc_ids and repeated rows are kept, each with all its spans; texts
    of any length are read whole in time linear in them; other columns are
    ignored; an empty table gives no rows.
    """
    scans = keep(scanned(docs), "pii-scans")
    more = (found_spans(scans, rounds).groupBy("doc_id", "key")
            .agg(F.collect_list(F.struct("start", (F.col("kind") + len(KINDS)).alias("kind"), "end")).alias("more")))
    more = more.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "more")
    rows = scans.select("doc_id", "key", "base").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return rows.select("doc_id", *count, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(spans).alias("spans"))
