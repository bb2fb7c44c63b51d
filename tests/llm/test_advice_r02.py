"""Whole-job cases of the second review, one or more a finding."""
import zlib

import numpy as np
import pytest

from sluice.llm import html, langid, tokens
from sluice.llm.queries import tokenizer_path


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(df).collect()}


def test_html_template_beside_template(spark):
    row = [(i, f"http://h/{i}", f"<body><div>A</div><div>B</div><div>story {i}</div><div>C</div><div>D</div></body>") for i in range(8)]
    box = [(20 + i, f"http://k/{i}", f"<article><p>Follow us</p><ul><li>one</li><li>two</li></ul><p>words of story {i}</p><h2>More</h2><p>Thanks</p></article>") for i in range(8)]
    got = texts(spark, row + box)
    assert all(got[i] == f"story {i}" for i in range(8)) and all(got[20 + i] == f"words of story {i}" for i in range(8))


def test_html_copies_are_no_template(spark):
    said = [f"paragraph {k} of an article that was put on many pages of the host" for k in range(6)]
    body = "".join(f"<div>{x}</div>" for x in said)
    nav = [(i, f"http://h/{i}", f"<nav>place {i}</nav><div class=ad>ad {i}</div>{body}") for i in range(8)]
    box = [(20 + i, f"http://k/{i}", f"{body}<div>no. {i}</div>") for i in range(8)]
    heading = [(40 + i, f"http://m/{i}", f"<article><h2>{'Method' if i < 6 else 'Notes'}</h2><p>story of page {i}</p></article>") for i in range(16)]
    got = texts(spark, nav + box + heading)
    assert all(got[i] == "\n".join(said) for i in range(8)) and all(got[20 + i] == "\n".join(said + [f"no. {i}"]) for i in range(8))
    assert got[40] == "Method\nstory of page 0"


STORY = "<article><h1>T</h1><p>The story.</p></article>"


@pytest.mark.parametrize("page", [
    *(f"<body><div class='{x}'>{STORY}</div></body>" for x in ("layout has-sidebar", "no-sidebar", "menu-open", "has-header", "page menu")),
    f"<body><form id='aspnetForm'>{STORY}</form></body>", f"<html><head><title>t</title><body>{STORY}</body></html>", f"<head><title>t</title>{STORY}", f"<head><noscript>on<body>{STORY}", f"<head><noscript>on</noscript>{STORY}",
    f"<div class='related'><article>x</article></div><div class='site-nav'>{STORY}</div><aside><article>y</article></aside>",
    f"<main><div class=related><article>x</article></div>{STORY}</main>", f"<div data-id='search'>{STORY}</div>", f"<div class=sidebar><main>{STORY}</main></div>",
    f"{STORY}<div id=comments><article class='comment-body'>a long reader comment, longer than the story</article></div>",
    "<div class='has-sidebar'><h1>T</h1><p>The story.</p></div>", "<form id=f><h1>T</h1><p>The story.</p></form><div class=site-footer>f</div>"])
def test_html_wrappers_keep_the_article(page):
    assert html.main_text(page) == "T\nThe story."


def test_html_blocks_of_an_article():
    heads = "".join(f"<h2 id='{x}'>{x}</h2><p>t</p>" for x in ("search", "related-work", "social-policy", "legal-form"))
    gone = "<div class='post share'>s</div><nav>n</nav><div class=related>r</div><section id=comments>c</section><form>f</form>"
    assert html.main_text(f"<article>{heads}<div class='legal-form'>kept</div>{gone}</article>") == "search\nt\nrelated-work\nt\nsocial-policy\nt\nlegal-form\nt\nkept"
    assert html.main_text("<header>h</header><div class='site-nav'>n</div><h2 id=search>Search</h2><p>text of the page</p><div id=footer>f</div>") == "Search\ntext of the page"


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path())
    said = ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|>\nb", "a <|endoftext|", "<|endof text|>", "plain words", "", None, "plain <|endoftext|>"]
    got = tokens.write_and_read(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), tokenizer_path(), with_ids=True).orderBy("doc_id").collect()
    at = 0
    for r, text in zip(got, said):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def ppm(trained, text, order=3):
    """Code length of ``text`` by PPM-C with exclusion, after the texts ``trained``: the definition, byte by byte."""
    seen = {}
    for t in trained:
        for k in range(order + 1):
            for i in range(k, len(t)):
                c = seen.setdefault(t[i - k: i], {})
                c[t[i]] = c.get(t[i], 0) + 1
    bits = 0.0
    for i, b in enumerate(text):
        out = set()
        for k in range(min(order, i), -1, -1):
            c = {x: n for x, n in seen.get(text[i - k: i], {}).items() if x not in out}
            if not c:
                continue
            every = sum(c.values()) + len(c)
            if b in c:
                bits += np.log2(every / c[b])
                break
            bits += np.log2(every / len(c))
            out |= set(c)
        else:
            bits += np.log2(256 - len(out))
    return bits


def grams(trained):
    import collections
    return [(lang, k, int.from_bytes(g, "big"), n) for lang, ts in trained.items() for k in range(1, 5)
            for g, n in collections.Counter(t[i: i + k] for t in ts for i in range(len(t) - k + 1)).items()]


def test_code_lengths_by_brute_force():
    draw = np.random.default_rng(5)
    trained = {f"l{k}": ["".join(draw.choice(list("abcdé \n" if k else "xyzaж日 "), 80)).encode() for _ in range(6)] + [b"q"] for k in range(11)}
    said = [b"", b"a", b"ab", "abcdé日".encode(), b"zzz?!\x00", *(ts[1][:50] for ts in trained.values()), *("".join(draw.choice(list("abcxyz"), 60)).encode() for _ in range(5))]
    want = [[ppm(ts, t) for _, ts in sorted(trained.items())] for t in said]
    data, off = np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)])
    m = langid.Model(grams(trained))
    assert m.langs == sorted(trained) and np.allclose(m.bits(data, off), want, atol=1e-9)


def test_keep_identified(spark):
    draw = np.random.default_rng(6)
    known = {"en": "the cat and dog of a house ran to that old river with many red birds while rain fell on green hills".split(),
             "fr": "le chat et chien de une maison sont dans la vieille rivière avec des oiseaux rouges pendant que tombe".split()}
    rows = [(len(known) * i + k, " ".join(draw.choice(ws, int(draw.integers(3, 60)))), lang) for i in range(60) for k, (lang, ws) in enumerate(known.items())]
    shared = ["on", "a", "cat", "de", "la rivière", "red birds", "house", "des chat"]
    rows += [(1000 + i, x, None) for i, x in enumerate(shared)]
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    junk = ["".join(draw.choice(letters, n)) for n in (60, 300, 3000)] + ["Съешь же ещё этих мягких французских булок, да выпей чаю", "Zażółć gęślą jaźń, a potem wszyscy poszli do domu, bo było już późno",
                                                                        "x9$kQ zz#7 pL!! 0qW vv%% " * 8, "12 34", ""]
    rows += [(2000 + i, x, "en" if i < 2 else None) for i, x in enumerate(junk)]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {r[0] for r in rows if r[0] < 2000}


def test_quality_fit_rounds():
    from sluice.llm import quality
    assert quality.ROUNDS >= 200
