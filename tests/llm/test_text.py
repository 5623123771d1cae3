"""Operators 2, 3, 6 and 9 on small tables with the awkward cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from punctual.llm import crf, op2_secrets, op3_sharding, op6_language_id, op9_html

R = random.Random(3)


def brute_secrets(text):
    out = []
    for kind, pattern in (("assign", op2_secrets.ASSIGN), ("access", op2_secrets.ACCESS), ("hex", op2_secrets.HEX)):
        for m in pattern.finditer(text):
            least = {"assign": len(m.group(m.lastindex or 0)) >= 8, "access": len(m.group()) >= 16, "hex": len(m.group()) >= 32}[kind]
            if least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], op2_secrets.KINDS.index(s[2])))


def test_secrets_equal_plain_scan():
    parts = ["token", "secret", "PassWord", "api_key", "APIKEY", "passwd", "=", ": ", "'", '"', " ", "AKIA", "akia", "ABCD1234",
             "deadbeef", "0a1b2c3d", "DEADBEEF", "x", "abcdefgh12", "é", "İ", "ſ", "\n"]
    for _ in range(5000):
        text = "".join(R.choice(parts) for _ in range(R.randint(0, 30)))
        assert [s for s in op2_secrets.find(text) if s[2] in op2_secrets.BASE_KINDS] == brute_secrets(text)


def test_checksums_decide():
    body = "gh" * 15
    good = "ghp_" + body + op2_secrets.crc_base62(body)
    assert [s[2] for s in op2_secrets.find(f"x {good}.")] == ["github"]
    assert op2_secrets.find("x ghp_" + body + "000000") == []
    assert op2_secrets.redact(f"x {good}. token=abcdefgh") == "x [github]. [assign]"


def test_secret_table(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "token = abcdefgh", 5), (3, "z" * 200_000 + " AKIA" + "A" * 16, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = {r.doc_id: r for r in op2_secrets.secret_spans(docs).collect()}
    assert got[1].spans == got[2].spans == "" and got[None].spans == "assign:0:16" and got[3].n_access == 1
    clean = op2_secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == 5 and clean.filter("doc_id is null").first().text == "[assign]"
    assert op2_secrets.secret_spans(docs.limit(0)).count() == 0


def test_sharding(spark):
    rows = [(i, "same text" if i % 3 == 0 else "x" * R.randint(0, 400), R.choice(["a", "b", None]), "src", i, 1) for i in range(4000)]
    rows += [(4001, None, None, None, None, 1), (None, "é", None, None, None, 1), (5, "rep", "a", "src", 3, 1), (5, "rep", "a", "src", 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")
    got = op3_sharding.shard(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    total, slots = Counter(), {}
    for r in got:
        total[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(total) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) < 0.05 * sum(total.values()) / 8
    assert op3_sharding.shard(docs.limit(0), 4).count() == 0
    assert op3_sharding.shard(docs.limit(3), 8).count() == 3


PAGES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<html><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>T &copy</h1><p><b>One,  two\n<br>three<p>Four</article>"
     "<footer>f</footer>", "T ©\n\nOne, two three\n\nFour"),
    ("<div id=c><p>Hello, world &#8212; all of it, really.<p>Two<ul><li>x<li>y</ul></div><div class='comments'><p>c, d, e</p></div>"
     "<form><p>name, mail</p></form>", "Hello, world — all of it, really.\n\nTwo\n\nx\n\ny"),
    ("<article><p>cut off <a href='", "cut off"), ("<div>" * 3000 + "deep", "deep"),
    ("<script>var t='</p>';</script><p>a</p><!-- <p>no</p> --><style>p{}</style>", "a"),
]


def test_html(spark):
    for page, text in PAGES:
        assert op9_html.extract(page) == text
    rows = [(i, None if i == 0 else "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(1, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = op9_html.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert op9_html.main_text(pages.limit(0)).count() == 0


LONG = "A sentence of the article, with commas, and with words enough to be worth some points, " * 8 + "ends."
SHORT = "A second section, of one short sentence."


def test_html_keeps_text_beside_the_best_container():
    three = "".join(f"<p>{LONG}</p>" for _ in range(3))
    lead = LONG[:200]
    whole = "\n\n".join([LONG] * 3)
    beside = "Related" + "".join(f"<li><a href=/{i}>Another story, and more, {i}</a></li>" for i in range(9))
    for page, text in [
        (f"<body><h1>T</h1><p>{lead}</p><div>{three}</div></body>", f"T\n\n{lead}\n\n{whole}"),
        (f"<body><h2>Kicker</h2><h1>T</h1><div><a href=x>By A</a></div>Bare <b>text</b> here.<div>{three}</div></body>",
         f"Kicker\n\nT\n\nBare text here.\n\n{whole}"),
        (f"<body><div><section>{three}</section><section><h2>Two</h2><p>{SHORT}</p></section></div></body>", f"{whole}\n\nTwo\n\n{SHORT}"),
        (f"<body><p><a href=x>{lead}</a></p><div>{three}</div><h3>More</h3><ul>{beside}</ul><p>tag</p></body>", whole),
        (f"<body><p>{SHORT}</p><main><h1>T</h1><article>{three}</article></main><p>{SHORT}</p></body>", f"T\n\n{whole}"),
    ]:
        assert op9_html.extract(page) == text


def test_html_class_words_and_forms_spare_the_article():
    three = "".join(f"<p>{LONG}</p>" for _ in range(3))
    whole = "\n\n".join([LONG] * 3)
    for page, text in [
        *((f"<body><div {a}>{three}</div><div class=sidebar><p>Buy this, now.</p></div></body>", whole)
          for a in ("class='content has-sidebar'", "id='page-with-sidebar'", "class='post share-enabled'", "class=widget")),
        (f"<body><form id=aspnetForm><div><p>{SHORT}</p></div><input name=x></form></body>", SHORT),
        (f"<body><form><div class='ad'>Buy</div><article><header class='entry-header'><h1>T</h1></header>{three}</article></form></body>", f"T\n\n{whole}"),
        (f"<body><form><div class=widget><article><p>{SHORT}</p></article></div></form><p>{LONG}</p></body>", f"{SHORT}\n\n{LONG}"),
        (f"<body><article>{three}<div class='social history'><p>{LONG}</p></div></article></body>", f"{whole}\n\n{LONG}"),
        (f"<body><div class=entry><header class='entry-header'><h1>T</h1></header>{three}<form><p>Name, mail.</p></form>"
         f"<div class='post-comments'><p>{LONG}</p></div></div><div class='newsletter'><p>{LONG[:300]}</p></div></body>", f"T\n\n{whole}"),
        (f"<body><header><p>Site, name.</p></header><div id='main'>{three}</div><div class='comments'><p>{LONG}</p></div></body>", whole),
    ]:
        assert op9_html.extract(page) == text


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    score, trans, start = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.array([1, 0, 0, 0, 1, 0, 0, 1, 0], bool)
    got = crf.marginals(score, first, trans, start)[0]
    for a, b in ((0, 4), (4, 7), (7, 9)):
        weight = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = np.exp(start[y[0]] + sum(score[a + k, y[k]] for k in range(b - a)) + sum(trans[y[k], y[k + 1]] for k in range(b - a - 1)))
            for k in range(b - a):
                weight[k, y[k]] += w
        assert np.allclose(got[a:b], weight / weight.sum(1, keepdims=True))


def test_lanes_do_not_change_messages(monkeypatch):
    rng = np.random.default_rng(1)
    score, first = rng.normal(size=(500, 3)), rng.random(500) < 0.05
    first[0] = True
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    wide = crf.marginals(score, first, trans, start)[0]
    monkeypatch.setattr(crf, "LANE", 7)
    assert np.allclose(wide, crf.marginals(score, first, trans, start)[0])


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = op6_language_id.fit(docs, 40, 96)
    extra = [(100_000, None, "en"), (100_001, "", None), (100_002, "12 ... 34", "en"), (100_003, "the of " * 20_000, None)]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in op6_language_id.predict(table, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if got[d].held_out]
    assert {d for d in got if got[d].held_out} == {d for d in got if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97
    assert [got[d].lang_pred for d in (100_000, 100_001, 100_002)] == ["und"] * 3 and got[100_003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = op6_language_id.known_language(table.withColumn("score", table.doc_id))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.filter("doc_id >= 100000").count() == 1
    assert op6_language_id.fit(table.filter("lang = 'xx'")) is None
    assert {r.lang_pred for r in op6_language_id.predict(table.limit(5), None).collect()} == {"und"}


def test_code_switched_words_are_labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labeller = op6_language_id.Labeller(op6_language_id.fit(docs, 40, 96))
    of = {r.lang: r.text.split()[:12] for r in docs.collect()}
    p, count = labeller.words([" ".join(of["de"] + of["en"])])
    names = [labeller.model.labels[i] for i in p.argmax(1)]
    assert count[0] == 24 and names[:9].count("de") >= 8 and names[-9:].count("en") >= 8


def test_evenly_switched_text_is_of_known_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    of = {r.lang: r.text.split()[:12] for r in docs.collect() if r.lang}
    assert len(of) >= 3
    text = " ".join(w for lang in sorted(of) for w in of[lang])
    table = docs.union(spark.createDataFrame([(100_000, text, None), (100_001, "12 ... 34", None)], docs.schema))
    model = op6_language_id.fit(table)
    label, score, sure = op6_language_id.Labeller(model).predict([text])[0]
    assert label in of and score < op6_language_id.LEAST_SCORE < 0.8 < sure
    assert [r.doc_id for r in op6_language_id.known_language(table).filter("doc_id >= 100000").collect()] == [100_000]


@pytest.mark.parametrize("degrees", [2, 8])
def test_chi_square(degrees):
    from punctual.llm.op1_projected_neighbours import chi_square, chi_square_quantile
    draws = (np.random.default_rng(0).standard_normal((200_000, degrees)) ** 2).sum(1)
    for p in (0.5, 0.95):
        x = chi_square_quantile(p, degrees)
        assert abs(chi_square(np.array([x]), degrees)[0] - p) < 1e-9 and abs((draws <= x).mean() - p) < 0.01
