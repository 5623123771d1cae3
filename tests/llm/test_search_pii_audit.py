"""Operators 11, 12 and 13 against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from punctual.llm import op11_ranked_search, op12_pii, op13_source_audit
from punctual.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTER_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_search(docs, items, k):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in docs]
    bags = [(d, b) for d, b in bags if b]
    n_all, n_words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_all // n_words
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
                    for t in set(TERM.findall((text or "").translate(LOWER))) if b[t])
            if s > 0:
                scored.append((-s, d is not None, d if d is not None else 0))
        out += [(item, r, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [2_000, 16_000_000])
def test_ranked_search(spark, monkeypatch, block):
    monkeypatch.setattr(op11_ranked_search, "BLOCK_BYTES", block)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "été", "ÀB", "X1", "7"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 40]))), 1) for i in range(700)]
    docs += [(9001, None, 1), (9002, "", 1), (9003, " .,- ", 1), (None, "w1 w30 x1", 1), (5, docs[5][1], 1), (9004, "w59 w3 " * 20_000, 1)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unknown words only"), (0, items[0][1]), (0, "w59")]
    got = op11_ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string, score int"),
                                    spark.createDataFrame(items, "item_id long, text string"), 10)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 10)


def test_ranked_search_passes_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 3}") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"a{i} b{i % 3}") for i in range(7)], "item_id long, text string")
    whole = Counter(map(tuple, op11_ranked_search.search(docs, items).collect()))
    monkeypatch.setattr(op11_ranked_search, "QUERY_BYTES", 10)
    assert Counter(map(tuple, op11_ranked_search.search(docs, items).collect())) == whole and whole
    assert op11_ranked_search.search(docs.limit(0), items).count() == op11_ranked_search.search(docs, items.limit(0)).count() == 0


def test_accumulators_stop_without_losing_a_document():
    r = np.random.default_rng(8)
    for _ in range(300):
        n, k = int(r.integers(5, 80)), int(r.integers(1, 6))
        postings, score = {}, np.zeros(n, np.int64)
        for t in range(8):
            docs = np.flatnonzero(r.random(n) < r.random())
            if len(docs):
                adds = r.integers(1, 10 ** int(r.integers(1, 5)), len(docs))
                postings[t] = docs, adds, int(adds.max())
                score[docs] += adds
        query = sorted(postings, key=lambda t: len(postings[t][0]))
        found, got = op11_ranked_search.best_of_block(query, postings, n, k)
        assert (score[found] == got).all()
        want = np.lexsort((np.arange(n), -score))[:k]
        assert set(want[score[want] > 0]) <= set(found)


PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
         "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def brute_pii(text):
    out = []
    for n, kind in enumerate(op12_pii.KINDS):
        for m in PLAIN[kind].finditer(text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), n, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{op12_pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)


def test_personal_data_equals_plain_scan(spark):
    r = random.Random(5)
    parts = ["a", "bob", "@", "x.y", ".com", ".", "-", "+1", " ", "(743)", "555", "-3824", "4465758382889437", "4539 1488 0343 6467",
             "1.2.3.4", "300.1.1.1", "001.2.3.255", "é", "😀", "\n", "12", "0", "%", "_", "5", "  ", "--"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4000)] + [None, "", "z " * 100_000 + "a@b.co"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {x.doc_id: x for x in op12_pii.personal_data(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in op12_pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        assert written(base) == ",".join(":".join(s) for s in spans if s[0] in op12_pii.KINDS)
        added = [(int(a), int(z)) for k, a, z in spans if k not in op12_pii.KINDS]
        assert all(z <= a2 or z2 <= a for a, z in added for a2, _, z2 in base)


def test_many_spans_of_one_text(spark):
    text = "a@b.c, 1.2.3.4 " * 1500
    row = op12_pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(written(brute_pii(text)).encode()).hexdigest() and row.n_ip == 1500


def test_contexts_teach_unseen_identifiers(spark):
    rows = [(i, f"please write to me at user{i}@mail{i}.example.com or call the office. Room {i}", 0) for i in range(12)]
    strange = "please write to me at carol5[at]mail or call the office"
    plain = "there were 10200 people in the hall and 55555 outside"
    rows += [(100, strange, 0), (100, strange, 0), (None, strange, 0), (101, plain, 0), (102, "4465758382889437 4465758382889437", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = defaultdict(list)
    for x in op12_pii.personal_data(docs).collect():
        got[x.doc_id].append(x.spans)
    assert got[100] == ["context_email:22:28"] * 2 and got[None] == ["context_email:22:28"] and got[101] == [""]
    assert got[102] == ["context_card:0:16,context_card:17:33"]  # the base rule takes both as one run of 32 digits
    assert op12_pii.personal_data(docs.limit(0)).count() == 0


def test_pattern_scores_equal_a_plain_loop(spark):
    r = random.Random(9)
    form = {f"i{n}": r.choice([None, None, "email", "phone"]) for n in range(60)}
    edges = sorted({(f"p{r.randint(0, 14)}", r.choice(list(form))) for _ in range(200)})
    got = op12_pii.scored_edges(spark.createDataFrame([(p, t, form[t]) for p, t in edges], "pattern string, text string, form string")).collect()
    by_pattern, by_text = defaultdict(list), defaultdict(list)
    for p, t in edges:
        by_pattern[p].append(t)
    by_pattern = {p: ts for p, ts in by_pattern.items() if any(form[t] for t in ts)}
    for p, ts in by_pattern.items():
        for t in ts:
            by_text[t].append(p)
    score = {(t, k): 1000 * (form[t] == k) for t in form for k in op12_pii.KINDS}
    for _ in range(op12_pii.ROUNDS):
        sure = {(p, k): sum(score[t, k] for t in ts) // (len(ts) + op12_pii.PRIOR) for p, ts in by_pattern.items() for k in op12_pii.KINDS}
        score |= {(t, k): sum(sure[p, k] for p in ps) // len(ps) for t, ps in by_text.items() if not form[t] for k in op12_pii.KINDS}
    assert len(got) == sum(form[t] is None for ts in by_pattern.values() for t in ts)
    for x in got:
        assert [x[f"p_{k}"] for k in op12_pii.KINDS] == [sure[x.pattern, k] for k in op12_pii.KINDS]
        assert [x[f"s_{k}"] for k in op12_pii.KINDS] == [score[x.text, k] for k in op12_pii.KINDS]


def brute_audit(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c, *_ in rows):
        bag = Counter(LETTER_TERM.findall(text.translate(LOWER)))
        counts[lang, source] += bag
        docs[lang].update(bag.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def share(bag):
            total = sum(bag[t] for t in kept)
            return {t: 1 + 10**9 * (bag[t] + 2) // (total + 2 * v) for t in kept}

        q = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -f, rank) for rank, (f, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("least", [1, 10])
def test_source_audit(spark, monkeypatch, least):
    monkeypatch.setattr(op13_source_audit, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(op13_source_audit, "HELD_TERMS", 20)
    r = random.Random(2)
    words = [f"{a}{b}" for a in "abcdef" for b in ("x", "Y", "é", "ÉÀ", "zz")]
    rows = [(r.choice(["en", "de"]), r.choice("pqrs" + "p" * 6), " ".join(r.choices(words, range(1, 31), k=r.randint(0, 30))) + " 1-x_y", 3) for _ in range(300)]
    rows += [(None, None, None, 3), ("en", None, "ax ax", 3), ("fr", "p", "", 3), ("fr", "q", "one", 3), rows[0], ("de", "q", "ax " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string, rank int")
    got = op13_source_audit.divergence(docs, least).collect()
    assert Counter(map(tuple, got)) == brute_audit(rows, least)
    assert op13_source_audit.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    big = [(2**40 + 7, 2**41 + 1, 12345), (0, 9, 3), (10**12, 10**12, 1)]
    df = spark.createDataFrame(big, "c long, n long, v long")
    got = [x[0] for x in df.select(op13_source_audit.share(df.c, df.n, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in big]


def test_queries_are_registered():
    assert {"op11_ranked_search", "op12_pii", "op13_source_audit"} <= QUERIES.keys()
