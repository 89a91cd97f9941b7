"""Operators over pages and vectors, and the pipeline."""

import math
import re
import time
from collections import Counter
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesafety.llm import html, language, markup, queries, simhash, topk


# Pages.
class Article(HTMLParser):
    """The text within <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.inside and tag in ("p", "br", "h1", "article"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if self.inside and tag in ("p", "h1"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_extraction_matches_a_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        p = Article()
        p.feed(r["html"])
        want = " ".join("".join(p.parts).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


FRAME = """<html><head><title>T</title><style>p{}</style></head><body class="home"><div id="top-nav"><a href="/">Home</a></div><header><h2>Site</h2></header>
<div class="page"><div class="sidebar"><p>Side</p></div><div class="content">%s</div><div id="comments"><p>Reader says</p></div></div>
<div class="cookie-notice">We use cookies</div><form><p>Name</p></form><script>var x = "<p>no</p>";</script><footer>Foot</footer></body></html>"""


def test_deduced_slot_without_named_elements(spark):
    rows = [(k, f"http://h.example/{k}", FRAME % (f"<h1>Head {k}</h1><p>Text &amp; <b>bo</b>ld {k} &#233;<br>next<ul><li>one<li>two</ul><aside>note</aside>" + "<p>more words here" * 5)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "slot", "text", "token", "key")})
    for r in html.extract(df).collect():
        k = r["page_id"]
        assert r["text"] == f"Head {k} Text & bold {k} é next one two" + " more words here" * 5
    assert [tuple(r) for r in html.templates(df).collect()] == [("h.example", "html/body/div/div")]


def test_pages_of_all_kinds(spark):
    rows = [(1, None, None), (2, "http://a.example/", ""), (3, "nowhere", "plain <i>te</i>xt &lt;b&gt;"), (4, "http://a.example/x", "<article><p>One<p>Two <!-- no --> three</article>"), (4, "http://a.example/x", "<article><p>One<p>Two <!-- no --> three</article>"), (5, "http://a.example/y", "<article><p>cut <b>off"), (6, "http://b.example", "<nav><a>menu</a></nav><main><article><header><h1>H</h1></header><p>P</p></article></main>"), (7, "http://c.example", "<p>" + "long words " * 50000 + "</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "", 2: "", 3: "plain text <b>", 4: "One Two three", 5: "cut off", 6: "H P", 7: ("long words " * 50000).strip()}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_text_stays(spark):
    rows = [(k, f"http://h.example/{k}", f"<html><body><nav>m</nav><article><p>Same opening line.</p><p>Own {k}.</p></article></body></html>") for k in range(5)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Same opening line. Own {k}." for k in range(5)}


def test_text_beside_the_largest_container_stays(spark):
    page = lambda body: f"<html><body>{body}</body></html>"
    kinds = {
        "title.example": (lambda k: page(f"<h1>Title {k}</h1><div>{'text ' * 40}</div>"), lambda k: f"Title {k} " + "text " * 39 + "text"),
        "split.example": (lambda k: page(f"<section>{'first ' * 3}</section><div>{'second ' * 7}</div>"), lambda k: "first " * 3 + "second " * 6 + "second"),
        "bare.example": (lambda k: f"<div>note</div><p>{'long ' * 30}</p>", lambda k: "note " + "long " * 29 + "long"),
    }
    rows = [(k, f"http://{h}/{k}", make(k)) for h, (make, _) in kinds.items() for k in range(5)]
    want = {(h, k): text(k) for h, (_, text) in kinds.items() for k in range(5)}
    # Pages of several sites under the host '': one has text beside the others' path, one has two articles.
    rows += [(k, None, page(f"<div>own {k}</div>")) for k in range(6)] + [(8, None, page("<div>teaser</div><p>the text</p>")), (9, None, "<article>one</article><section><main>two</main></section>")]
    want |= {("", k): f"own {k}" for k in range(6)} | {("", 8): "teaser the text", ("", 9): "one two"}
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {((r["url"] or "//").split("/")[2], r["page_id"]): r["text"] for r in got} == want


# Five hosts' worth of frames: a fixed slogan in a neutral element beside the text, and words that repeat in the text.
LAYOUT = '<html><body><div class="x1"><p>Buy our fine wares</p></div><div class="c1"><p>Own text {k} about topic {k}</p><p>Same line everywhere</p></div><div class="x2"><p>Open all day</p></div></body></html>'


def test_template_is_deduced_from_the_vectors(spark):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", LAYOUT.format(k=f"{k}" * 20)) for k in range(6)], "page_id long, url string, html string")
    text = lambda found: {r["page_id"]: r["text"] for r in html.extract(df, deduced=found).collect()}
    own = {k: f"Own text {str(k) * 20} about topic {str(k) * 20} Same line everywhere" for k in range(6)}
    tokens = html.occurrences(df)
    assert text(html.deduce(tokens)) == own and text(None) == own
    # Without classes (each token with a vector of its own) nothing is known to be fixed; nor with all tokens in one class, whose order doesn't hold.
    every = {k: f"Buy our fine wares {own[k]} Open all day" for k in own}
    assert text(html.deduce(tokens.withColumn("vector", F.col("token")))) == every
    mixed = tokens.withColumn("high", F.when(F.col("name") == "", -F.col("high")).otherwise(F.col("high")))
    assert text(html.deduce(mixed)) == every  # a class out of order is not valid


def test_classes_must_nest(spark):
    """Two elements that come and go together, but stand in different slots of the template, are no part of it."""
    body = lambda k: f'<html><body><div class="a"><p>Own {k} {"word " * 9}{k}</p>{"<p class=z>Two of us</p>" if k % 3 else ""}</div><div class="b"><h2>Fixed</h2>{"<p class=y>Here too</p>" if k % 3 else ""}</div></body></html>'
    df = spark.createDataFrame([(k, f"http://h.example/{k}", body(k)) for k in range(9)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {k: f"Own {k} {'word ' * 9}{k}" + (" Two of us Here too" if k % 3 else "") for k in range(9)}


def neutral(page):
    """The page without names that tell what an element is for."""
    names = "nav header footer aside form button section main article".split()
    page = re.sub(rf"<(/?)({'|'.join(names)})\b", lambda m: f"<{m[1]}div" + ("" if m[1] else f" class=q{'abcdefghi'[names.index(m[2])]}x"), page)
    return re.sub(r'class="ad"', 'class="zk"', page)


def test_the_template_finds_the_text_without_names(spark, sf_dir):
    """Neutral names: the given pages' articles come from the template alone, on hosts that have enough pages."""
    pages = [r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r["html"] and r["url"]]
    host = lambda r: r["url"].split("/")[2]
    n = Counter(map(host, pages))
    df = spark.createDataFrame([(r["page_id"], r["url"], neutral(r["html"])) for r in pages], "page_id long, url string, html string")
    want = {r["page_id"]: html.Page(r["html"]).text(0, frozenset()) for r in pages if n[host(r)] >= html.LEAST_PAGES}
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    tokens = html.occurrences(df)
    off = {r["page_id"]: r["text"] for r in html.extract(df, deduced=html.deduce(tokens.withColumn("vector", F.col("token")))).collect()}
    assert sum(got[k] == t for k, t in want.items()) >= 0.95 * len(want) > 0
    assert not any(off[k] == t for k, t in want.items())


def test_thin_slots(spark):
    box = lambda name, text: f'<div class="{name}">{text}</div>'
    page = lambda k, *more, words=90: "<html><body>" + box("ka", f"<p>Buy {k}</p>") + box("kb", f"<p>{f'w{k} ' * words}</p><div class=ke>By {k}</div>") + "".join(more) + "</body></html>"
    text = lambda rows: {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = lambda k, words=90: f"{f'w{k} ' * words}By {k}"
    got = text(
        [(k, f"http://thin.example/{k}", page(k)) for k in range(6)]  # the box before the text goes, the line within it stays
        + [(10, "http://thin.example/10", "<html><body>" + box("ka", "<p>A page that has its text here</p>") + "</body></html>")]  # most of this page
        + [(20 + k, f"http://title.example/{k}", page(k, box("kc", f"<h1>Title {k}</h1>"))) for k in range(6)]  # a title is no thin slot
        + [(30 + k, f"http://half.example/{k}", page(k, box("kd", f"<p>{f'v{k} ' * 30}</p>"))) for k in range(6)]  # nor is a third of the text
        + [(40 + k, f"http://two.example/{k}", page(k)) for k in range(2)]  # two pages tell nothing
        + [(50 + k, f"http://h{k}.many.example/{k}", page(k)) for k in range(6)]  # unless their domain has more such hosts
    )
    assert got == (
        {k: body(k) for k in range(6)} | {10: "A page that has its text here"} | {20 + k: f"Buy {k} {body(k)} Title {k}" for k in range(6)}
        | {30 + k: f"Buy {k} {body(k)} {f'v{k} ' * 30}".strip() for k in range(6)} | {40 + k: f"Buy {k} {body(k)}" for k in range(2)}
        | {50 + k: body(k) for k in range(6)}
    )


def plain_fixed(pages, support=0.5):
    """Fixed texts of a host's template, with whole occurrence vectors and every page's order: (parents, tokens)."""
    found = [html.Page(p).tokens() for p in pages]
    parent, name = {}, {}
    for f in found:
        for t, (up, kind, *_) in f.items():
            parent[t], name[t] = min(up, parent.get(t, up)), min(kind, name.get(t, kind))
    vector = {t: tuple(f[t][2] if t in f else 0 for f in found) for t in parent}
    frequent = {t for t, v in vector.items() if sum(x > 0 for x in v) >= support * len(pages)}
    classes = {}
    for t in frequent - {0}:
        if max(vector[t]) == 1:
            classes.setdefault(vector[t], set()).add(t)

    def ordered(tokens):
        orders = {tuple(sorted(tokens, key=lambda t: f[t][3])) for f in found if tokens <= set(f)}
        return len(orders) == 1

    valid = [(v, c) for v, c in classes.items() if len(c) >= 2 and ordered(c)]
    template, fixed = {0}, set()
    for _, mine in sorted(valid, key=lambda x: (-sum(n > 0 for n in x[0]), -len(x[1]), min(x[1]))):
        outer = set()
        for t in mine:
            up = parent[t]
            while up not in template and up not in mine:
                up = parent.get(up, 0)
            outer |= {up} - mine
        if len(outer) == 1:
            template |= {t for t in mine if name[t]}
            fixed |= {t for t in mine if not name[t]}
    return parent, fixed


def test_classes_are_those_of_whole_vectors(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(1000, size=n))
    blocks = ["<div class=a><p>Terms of use</p><p>All rights kept</p></div>", "<p class=b>Read more below</p>", "<div class=c><h3>Latest</h3></div>", "<p class=d>Seen twice</p>"]
    hosts = {}
    for h in range(6):
        mine = [b for b in blocks if rng.random() < 0.7]
        rare = blocks[3] if h % 2 else ""
        hosts[f"h{h}.example"] = ["<html><body>" + "".join(mine[: 1 + h % 2]) + f"<div class=text><h1>{word(3)}</h1><p>{word(40)}</p>{'<p>Same line</p>' if h % 3 else ''}<p>{word(20)}</p></div>" + "".join(mine[1 + h % 2 :]) + (rare if k % 2 else rare * 2) + "</body></html>" for k in range(7)]
    rows = [(100 * i + k, f"http://{h}/{k}", page) for i, (h, pages) in enumerate(hosts.items()) for k, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    some = 0
    for r in html.deduce(html.occurrences(df)).collect():
        parent, fixed = plain_fixed(hosts[r["host"]])

        def inside(t, parent=parent, slot=r["slot"]):
            while t:
                t = parent.get(t, 0)
                if t == slot and slot:
                    return True
            return False

        assert set(r["fixed"]) == {t for t in fixed if not inside(t)}
        some += len(r["fixed"])
    assert some > 8


def test_templates_are_the_same_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(100 * h + k, f"http://h{h}.example/{k}", LAYOUT.format(k=f"{k}" * 20)) for h in range(3) for k in range(6)] + [(999, None, "<p>x</p>")], "page_id long, url string, html string")
    want = sorted(map(tuple, html.extract(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html.extract(df, broadcast_tokens=0).collect())) == want and len(want) == 19


@pytest.mark.parametrize(
    ("markup_", "text"),
    [
        ('<main><p>Story</p><article class="comment"><p>Reader says hi</p></article></main>', "Story"),
        ('<article><p>Story</p></article><article class="comment-item"><p>Reader says hi</p></article>', "Story"),
        ('<article><p>One</p><div class="related-work"><p>Two</p></div><div class="search">Three</div><div class="social">Four</div><div id="form-2">Five</div><div class="social-science">Six</div></article>', "One Two Three Four Five Six"),
        ('<article><p>One</p><div class="related"><a href="/x">Other story</a></div><div class="share"><a>Tell</a> <a>Send</a></div><aside>Side</aside><div class="ad">Buy</div><div class="newsletter-box">Join</div></article>', "One"),
        ('<div class="has-sidebar"><p>Text</p><div class="sidebar">Side</div></div>', "Text"),
        ('<div role="banner">Top</div><div role="main"><p>Text</p></div><div>Other</div>', "Text"),
        ('<p title="a > b">One</p><p class=don\'t>Two</p><p title=\'open>Three</p>', "One Two Three"),
        ("<p>a < b &lt; c && d<p>x</p", "a < b < c && d x"),
        ("<p>one<svg/>two<script>if (a < b) {}</SCRIPT >three<style>p{}", "onetwothree"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a b c d e f g"),
        ("<p>It<!-- gone -->em <b>bo</b>ld<br>next<!-->last", "Item bold nextlast".replace("nextlast", "nextlast")),
    ],
)
def test_markup_of_all_kinds(markup_, text):
    assert html.Page(markup_).text(0, frozenset()) == text


# Languages.
def test_languages_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_language(spark, sf).collect()
    pages = {r["page_id"]: re.search(r'<html lang="(\w+)"', r["html"])[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    assert np.mean([r["lang"] == pages[r["page_id"]] for r in rows]) >= 0.97
    assert all(0 < r["probability"] <= 1 + 1e-9 for r in rows)


def test_evidence_is_fused(spark):
    docs = spark.createDataFrame([(k, "en", "the cat and the dog went home with the ball") for k in range(20)] + [(k + 50, "de", "der hund und die katze gehen nach hause mit dem ball") for k in range(20)], "doc_id long, lang string, text string")
    page = '<html lang="{}"><body>{}</body></html>'
    rows = [(k, f"http://a.de/{k}", page.format("de", "der hund und die katze gehen nach hause")) for k in range(20)] + [(k, f"http://b.uk/{k}", page.format("en", "the cat and the dog went home")) for k in range(20, 40)]
    rows += [(100, "http://a.de/x", page.format("de", "ball")), (101, "http://b.uk/x", page.format("en", "ball")), (102, "http://a.de/y", page.format("de", "the cat and the dog went home with the ball " * 20)), (103, None, None), (104, "", ""), (103, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("lang", "host", "declared", "n", "evidence")})
    out = language.identify(df, docs.withColumn("share", F.lit(1)))
    got = {r["page_id"]: r["lang"] for r in out.collect()}
    assert out.count() == len(rows) and all(got[k] == ("de" if k < 20 else "en") for k in range(40))
    assert (got[100], got[101], got[102]) == ("de", "en", "en") and got[103] in ("de", "en")
    assert [r["lang"] for r in language.identify(df.limit(3), docs.limit(0)).collect()] == [None] * 3
    assert language.identify(df.limit(0), docs).count() == 0


def plain_language(pages, docs, most=200.0, smooth=1.0, borrow=20.0):
    """The same fusion with dictionaries, a page at a time: (language by text, language, probability) for each page."""
    from urllib.parse import urlparse

    def grams(text):
        from casesafety.llm.features import code_points, sequence_ngrams

        return [int(g) & 65535 for a in sequence_ngrams(code_points(f" {text.lower()} "), range(1, 4), 48) for g in a] if text else []

    langs = sorted({x for _, x, _ in docs})
    counts = {x: Counter(g for _, y, t in docs if y == x for g in grams(t or "")) for x in langs}
    log_p = {x: (lambda g, c=counts[x]: math.log((c[g] + 0.1) / (sum(c.values()) + 0.1 * 65536))) for x in langs}
    facts = []
    for _, url, page in pages:
        text = " ".join(re.sub(r"<[^>]*>", " ", page or "").split())
        g = grams(text)
        e = {x: sum(map(log_p[x], g)) / max(1, len(g)) * (len(g) * most / (len(g) + most)) for x in langs}
        e = {x: v - max(e.values()) for x, v in e.items()}
        z = sum(map(math.exp, e.values()))
        host = (urlparse(url or "").hostname or "") if "://" in (url or "") else ""
        labels = host.split(".")
        domain = ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in language.SHARED else labels[-2:])
        said = re.search(r"<html lang=.(\w+)", page or "")
        facts.append((e, {x: math.exp(v) / z for x, v in e.items()}, host, domain, labels[-1], said[1] if said else ""))
    whole = {x: sum(f[1][x] for f in facts) for x in langs}
    p_all = {x: (whole[x] + smooth) / (sum(whole.values()) + smooth * len(langs)) for x in langs}
    out = []
    for e, share, *keys in facts:
        host, domain, suffix, said = ([f for f in facts if f[2 + k] == keys[k]] for k in range(4))
        total = {}
        for x in langs:
            n = lambda rows, x=x: sum(f[1][x] for f in rows) - share[x]  # noqa: E731, B023
            p_domain = (n(domain) + borrow * p_all[x]) / (len(domain) - 1 + borrow)
            prior = (n(host) + borrow * p_domain) / (len(host) - 1 + borrow)
            given = [(n(rows) + smooth) / (whole[x] - share[x] + smooth * (len({f[2 + k] for f in facts}) + 1)) for rows, k in ((suffix, 2), (said, 3))]
            total[x] = e[x] + math.log(prior) + sum(map(math.log, given))
        best = max(langs, key=lambda x: (total[x], -langs.index(x)))
        out.append((max(langs, key=lambda x: (e[x], -langs.index(x))), best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


@pytest.mark.parametrize("way", ["broadcast", "shuffled", "long"])
def test_fusion_matches_the_plain_version(spark, monkeypatch, way):
    if way != "broadcast":
        monkeypatch.setattr(language, "BROADCAST_NUMBERS", 0)
    if way == "long":
        monkeypatch.setattr(language, "WIDE", 1)
    rng = np.random.default_rng(6)
    words = {"en": "the cat and dog went home with ball".split(), "de": "der hund und die katze gehen nach hause".split(), "fr": "le chien et la maison avec une balle".split()}
    text = lambda x, n: " ".join(rng.choice(words[x], n))
    docs = [(k, x, text(x, 9)) for k, x in enumerate(["en", "de", "fr"] * 6)] + [(90, "en", None)]
    hosts = ["http://a.co.uk/", "http://www.a.co.uk/", "http://b.co.uk/", "http://x.de/", "http://y.de/", "http://c.com.au/", "http://d.com/", "nowhere"]
    pages = []
    for k in range(60):
        x = ["en", "de", "fr"][int(rng.integers(3))]
        declared = f' lang="{x if rng.random() < 0.8 else "de"}"' if rng.random() < 0.9 else ""
        pages.append((k, hosts[int(rng.integers(8))] + str(k), f"<html{declared}><body><p>{text(x, int(rng.integers(3)))}</p></body></html>"))
    pages += [(100, None, None), (101, "", "")]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, lang string, text string")).collect()}
    for (k, _, _), (by_text, lang, p) in zip(pages, plain_language(pages, docs), strict=True):
        assert (got[k]["text_lang"], got[k]["lang"]) == (by_text, lang) and got[k]["probability"] == pytest.approx(p, rel=1e-4), k


def test_more_than_two_hundred_languages(spark):
    text = lambda k: f"{chr(97 + k // 18)}{chr(97 + k % 18)}z " * 30
    docs = spark.createDataFrame([(k, f"l{k:03}", text(k)) for k in range(300)], "doc_id long, lang string, text string")
    pages = spark.createDataFrame([(k, "http://h.example/", f"<p>{text(k)}</p>") for k in (0, 37, 299)], "page_id long, url string, html string")
    assert {r["page_id"]: r["lang"] for r in language.identify(pages, docs).collect()} == {k: f"l{k:03}" for k in (0, 37, 299)}


def test_long_and_broken_pages_take_linear_time():
    for page in ("<a " * 1_700_000, "<" * 5_000_000, "<div>" * 100_000, "<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000, "<div>" * 50_000 + "</b>" * 50_000, "<a b='" * 800_000, "</" * 2_000_000, "<!--" * 1_000_000):
        began = time.time()
        p = html.Page(page)
        p.tokens(), p.text(1, frozenset((1,))), markup.visible_text(page)
        assert time.time() - began < 20, page[:20]


# Vectors.
def plain_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if i % 50 == 0}):
        scored = []
        for q in {tuple(v) for j, v in good if j == i}:
            scored += [(-int(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k_is_exact(spark, monkeypatch, small):
    if small:  # many blocks, ranges and groups
        for name, n in (("ROWS", 7), ("RANGE_ROWS", 40), ("GROUP", 3), ("LANE", 4), ("SLICE", 3), ("FEW", 0)):
            monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    rows += [(700 + i, rows[50][1]) for i in range(12)] + [(1000, rows[0][1]), (1001, None), (1002, []), (1003, [1.0, None]), (1050, [float("nan")] * 8), (1004, [float("inf")] * 8), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (None, rows[0][1]), (150, rows[150][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "score", "rank", "part")})
    vectors = topk.whole_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("id % 50 = 0")).collect()))
    assert got == sorted(plain_top(rows))


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    vectors = topk.whole_vectors(df, "vec_id", "embedding")
    assert topk.top_k(vectors, vectors.where("id % 50 = 0")).count() == 0
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert [tuple(r) for r in topk.top_k(vectors, vectors.where("id = 1")).collect()] == [(1, 1, 2, 256 * 512)]


def test_finite_components_of_any_size(spark):
    big = [1e16, 1.0], [3e9, 3e9], [2.0**52 + 1, -0.001], [-1e18, 1e-3], [1e-300, 2.5]
    rows = [(k, list(v)) for k, v in enumerate(big)] + [(50, [1e-3, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.whole_vectors(df, "vec_id", "embedding")
    exact = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
    got = topk.top_k(vectors, vectors.where("id in (50, 100)")).collect()
    want = []
    for q in (50, 100):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
    # The best score of [3e9, 3e9] is beyond a long, as is that of the first row: an error that says so. A low one that isn't among the best is none.
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(vectors, vectors.where("id = 1")).collect()
    few = topk.whole_vectors(spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e16, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert [tuple(r) for r in topk.top_k(few.where("id != 1"), few.where("id = 1"), 2).collect()] == [(1, 1, 3, 256 * 256 * 10**13), (1, 2, 4, 0)]


def test_pairs_are_pruned_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 0)
    monkeypatch.setattr(topk, "GROUP", 64)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(64, 16))
    rows = [(i, (centre[i % 64] + rng.normal(size=16) * 0.02).tolist()) for i in range(16384)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    groups, blocks = topk.prepared(vectors, vectors.where("id % 50 = 0"))
    assert topk.pairs(groups, blocks).count() < 0.85 * groups.count() * blocks.count()


# Pipeline.
def test_pipeline_keeps_what_its_stages_keep(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after and set(after.items()) <= set(before.items()), name
        if name == "SimHash near-dedup":
            first = {r["doc_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] == r["component_id"]}
            assert set(after) == first
        if name == "benchmark decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            squeezed = {k: " ".join(t.split()).lower() for k, t in before.items()}
            hit = {k for k, t in squeezed.items() if any(" ".join(x.split()).lower() in t for x in items)}
            assert not hit & set(after) and len(before) - len(after) >= len(hit)
        docs = kept
    mixed = {r["doc_id"]: r["taken"] for r in p.run(spark, sf_dir).collect()}
    last = {r["doc_id"] for r in docs.collect()}
    assert set(mixed) <= last and all(mixed.values())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated and long rows, columns of clashing names, and empty tables."""
    import corpus_pipeline as p

    good, bad = "calm kind warm mild fair nice words of a quiet day".split(), "vile foul rude mean nasty cruel".split()
    rng = np.random.default_rng(2)
    text = lambda w, n: " ".join(rng.choice(w, n))
    rows = [(k, text(bad if k % 4 == 0 else good, 25), "ab"[k % 2]) for k in range(60)]
    rows += [(None, text(good, 25), "a"), (None, text(good, 25), None), (3, rows[3][1], "b"), (70, rows[5][1], "a"), (71, None, None), (72, "", "a"), (73, text(good, 30000), "a"), (74, text(good, 9) + " this passage is of the benchmark itself " + text(good, 9), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("times", "size", "score", "label", "row", "id", "hash", "copy", "key", "lang")})
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "this passage is of the benchmark itself"), (None, None)], "item_id long, text string")
    for name, some in (("full", docs), ("none", docs.limit(0))):
        d = str(tmp_path / name)
        some.write.parquet(f"{d}/documents.parquet")
        labels.where("true" if name == "full" else "false").write.parquet(f"{d}/labels.parquet")
        items.where("true" if name == "full" else "false").write.parquet(f"{d}/benchmark.parquet")
    out = p.run(spark, str(tmp_path / "full"))
    assert set(docs.columns) | {"size", "source_size", "target", "taken"} == set(out.columns) and len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert all(r["taken"] > 0 and r["times"] == "times" and r["size"] == len(r["text"].split()) for r in got)
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert len(kept) == len(set(kept)) and set(kept) <= {(k, t) for k, t, _ in rows}
    texts = [t for _, t in kept]
    assert len(texts) == len(set(texts)) and not any("benchmark itself" in t for t in texts) and not any(set(t.split()) <= set(bad) for t in texts)
    clean = {t for k, t, _ in rows if t and k != 74 and set(t.split()) <= set(good)}
    assert len(clean - set(texts)) <= 0.35 * len(clean)  # near copies, and what the mix leaves out
    empty = p.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and set(empty.columns) == set(out.columns)
