"""Main text of generated sites, whose articles are known, and of pages that are hard to read."""
import time

import numpy as np

from sluice.llm import html

WORDS = "river stone energy market window garden letter number winter answer copper violet ocean signal method".split()


def page_of(draw, host):
    """(html, text) of one page: the article's blocks inside what its host puts on every page."""
    say = lambda n: " ".join(draw.choice(WORDS, n))
    blocks, parts = [], []

    def put(tag, shown, text, extra=""):
        parts.append(f"<{tag}{extra}>{shown}</{tag}>")
        blocks.append(text)
    title = say(4)
    put("h1", title, title, ' id="related-work"')
    for _ in range(int(draw.integers(2, 6))):
        a, b = say(int(draw.integers(5, 30))), say(3)
        kind = int(draw.integers(8))
        if kind == 0:
            put("p", f"{a} <b>{b}</b>\n  &amp; more", f"{a} {b} & more")
        elif kind == 1:
            put("p", f"{a} <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> {b}", f"{a} E=m {b}")
        elif kind == 2:
            parts.append(f"<blockquote><p>{a}</p><footer>{b}</footer></blockquote>")
            blocks.extend([a, b])
        elif kind == 3:
            put("div", a, a, ' class="legal"' if host % 3 < 2 else "")
        elif kind == 4:
            parts.append(f"<ul><li>{a}<li>{b}</ul>")
            blocks.extend([a, b])
        elif kind == 5:
            parts.append(f"<p>{a} <button>Buy</button><script>x('<p>')</script>{b}</p><div class='share'>Share this</div>")
            blocks.append(f"{a} {b}")
        elif kind == 6:
            put("h2", b, b)
        else:
            parts.append(f"<table><tr><td>{a}<td>{b}</table>")
            blocks.extend([a, b])
    body = "".join(parts)
    if host % 3 == 0:
        body = f"<article class='post has-sidebar'>{body}<footer>Filed under news</footer></article>"
    elif host % 3 == 1:
        body = f"<main>{body}</main>"
    else:  # no article element: the host's boxes are told by their recurrence alone
        body = f"<div>{body}</div>"
    box = f"<div>Read also at host {host}</div><div>All rights of host {host}</div>"
    return (f"<html><head><title>{title}</title><style>p{{}}</style></head><body class='no-sidebar'><header><a href=/>Host {host}</a></header><nav><ul><li>Home<li>About</ul></nav>{box}"
            f"<div class='search-engine-history'></div>{body}<aside>Popular</aside><section class='comments'><p>{say(6)}</p></section><div class='cookie-notice'>We use cookies</div>"
            f"<form><input> Search</form><footer>Imprint</footer></body></html>"), "\n".join(blocks)


def test_generated_sites(spark):
    draw = np.random.default_rng(10)
    rows, want = [], {}
    for host in range(6):
        for k in range(12):
            page, text = page_of(draw, host)
            rows.append((100 * host + k, f"http://host{host}.example/{k}", page))
            want[100 * host + k] = text
        rows.append((100 * host + 50, f"http://host{host}.example/copy", rows[-1][2]))  # a copy of an article on its host
        want[100 * host + 50] = want[100 * host + 11]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_time_grows_with_the_page():
    """Open elements without end, ends without beginning, items inside unknown elements: one pass each."""
    def took(make, n):
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            html.parse(make(n))
            best = min(best, time.perf_counter() - t)
        return best
    for make in (lambda n: "<div>" * n + "</x>" * n, lambda n: "<div>" * n + "</section>" * n, lambda n: "<li><div>" + "<foo>" * n + "</li>" * n,
                 lambda n: "<foo>" * n + "<td>" * n, lambda n: "<foo>" * n + "<body>" * n, lambda n: "<ul><li>" * n + "</p>" * n):
        assert took(make, 16000) < 12 * took(make, 4000) + 0.05


def test_names_and_phrases():
    page = "<body><div class='search-engine-history'><p>How engines search</p></div><div class='site-nav'>Go</div><div class='social-share-buttons'>x</div><p>one <svg><text>pic</text></svg>two</p></body>"
    assert html.main_text(page) == "How engines search\none two"
    assert html.main_text("<article><p>a</p><footer>by me</footer><blockquote>q<footer class='ad'>Buy</footer></blockquote></article>") == "a\nq"
