"""Operator 9 on generated pages whose parts are known, and the linear scans of operators 2 and 9."""

import random
import time

import pytest

from punctual.llm import op2_secrets, op5_near_duplicates, op9_html

R = random.Random(6)
WORDS = "the river ran past an old mill where people of our town used to meet after work and talk about weather and harvest".split()


def prose(chars):
    out = []
    while sum(map(len, out)) + len(out) < chars:
        out.append(" ".join(R.choices(WORDS, k=R.randint(6, 14))).capitalize() + R.choice([".", ", too.", "!"]))
    return " ".join(out)


BESIDE = [lambda t, c=c: f'<div class="{c}"><p>{t}</p></div>' for c in
          ("ad", "adverts", "newsletter", "cookie-notice", "sidebar", "promo", "comments", "commentlist", "related", "site-footer")]
BESIDE += [lambda t: '<div class="share-links">' + " ".join(f'<a href="#">{w}</a>' for w in t.split()) + "</div>"]
BESIDE += [lambda t: f"<form><label>{t}</label><input name='q'></form>", lambda t: f"<aside>{t}</aside>", lambda t: f"<footer><p>{t}</p></footer>",
           lambda t: f'<div role="navigation">{t}</div>', lambda t: f'<section id="comments"><div><p>{t}</p><p>{t}</p></div></section>',
           lambda t: "<nav><ul>" + "".join(f'<li><a href="#">{w}</a></li>' for w in t.split()) + "</ul></nav>"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', "<div>{}</div>"])
def test_pages_of_known_parts(wrap):
    for _ in range(60):
        body = [prose(R.randint(150, 900)) for _ in range(R.randint(3, 8))]
        inside = [f"<p>{b}</p>" for b in body]
        for _ in range(R.randint(0, 2)):
            inside.insert(R.randint(1, len(inside)), R.choice(BESIDE)(prose(R.choice([20, 100, 395, 2000]))))
        around = [R.choice(BESIDE)(prose(R.choice([20, 100, 395]))) for _ in range(R.randint(0, 3))]
        at = R.randint(0, len(around))
        page = ["<header><p>" + prose(R.choice([30, 395])) + "</p></header>", *around[:at], wrap.format("".join(inside)), *around[at:]]
        html = "<html><head><title>t</title></head><body>" + "".join(page) + "</body></html>"
        assert op9_html.extract(html) == "\n\n".join(" ".join(b.split()) for b in body)


def test_names_that_only_sound_like_asides_stay():
    text = prose(600)
    for name in ("content has-sidebar", "story-widget", "entry-content", "post share-enabled", "page-with-sidebar"):
        assert op9_html.extract(f"<body><div class='{name}'><p>{text}</p></div></body>") == text
    assert op9_html.extract(f"<article><p>{text}</p><div class='story-widget'><p>A short line.</p></div></article>") == f"{text}\n\nA short line."
    assert op9_html.extract(f"<form action='/'><div><p>{text}</p><p>{text}</p></div></form>") == f"{text}\n\n{text}"


def test_deep_tags_and_runs_take_linear_time():
    def seconds(f, *a):
        start = time.process_time()
        f(*a)
        return time.process_time() - start

    assert seconds(op9_html.extract, "<x>" * 20_000 + "<p>a</p>") < 3
    assert seconds(op9_html.extract, "<p><button>" + "<x>" * 20_000) < 3
    assert seconds(op2_secrets.find, "eyJ" * 350_000) < 20  # 1 MB
    assert [s[2] for s in op2_secrets.find("eyJ" * 3 + " eyJhIjoxfQ.eyJhIjoxfQ.sig")] == ["jwt"]


def test_clashing_names_in_the_near_duplicate_stage(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 1, 2), (2, text, "b", 1, 2), (3, None, "c", 1, 2), (4, "short", "d", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _txt string, txt int, kept_txt int")
    kept = op5_near_duplicates.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert op5_near_duplicates.without_near_duplicates(docs.limit(0)).count() == 0
