"""Main text of web pages: site-template removal by subtree hashes, then the article's blocks.

Method. A page is read as a tree of its block elements (unclosed and crossed tags are repaired as browsers do in the common
cases; inline elements only carry text). Every subtree is hashed over its tag, its attributes' class, id and role, and its text.
Spark counts on how many different pages of each host a subtree occurs; on ``MIN_PAGES`` or more it recurs. What does not recur is the
page's own text. Recurring subtrees on pages with ``MIN_PAGES`` different own texts or more are the site's template and are deleted,
whatever stands beside them. Copies of one article have equal own texts, or hardly any (under a part in ``OWN_PART`` of the main text),
so the article's recurring paragraphs stay. Paragraphs, headings, items and cells inside an article or main element
must also be on half of the host's different pages, since a short heading or cell recurs in different articles.

Elements that never hold article text go by name, role or class words: navigation, page headers and footers, asides, scripts, styles,
notices, adverts, sharing and reader comments. Outside an article a part of a class or id (``site-nav``) is enough, or being a form,
unless the element holds an article or half of the page's text; names of a state (``has-sidebar``) say nothing. Inside an article
it takes a whole class, or the id of the reader comments. What holds a main element stays; what holds articles goes only by
name, role or whole class and if the articles outside such elements have as much text. A quotation's footer names its source and stays. A head ends at the first element or text that can't be in it.
Pages with an article (or main) element that is left give its blocks, others the body's.

Text. Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order by
one line feed; a line break element is white space. Nothing else is dropped or cut.

Defined results: null html is an empty page; a page without text gives an empty string; a null url is a host of
its own (null); repeated rows count as one page and get equal results; an empty table gives an empty result; other columns
are ignored. Text of any length is treated whole, by one task for each page.
"""
from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import Tables

MIN_PAGES, OWN_PART = 5, 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
          "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          # formulas are text of their line
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "munder", "mover", "munderover", "mspace", "mstyle", "mpadded",
          "menclose", "mfenced", "mtable", "mtr", "mtd", "semantics"}
#: Opening tags that end a paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dt", "dd", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hgroup", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
#: Content elements: inside an article part of a template only if they are on half of the host's pages.
CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "td", "th", "tr", "figcaption", "caption"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "aside", "iframe", "svg", "canvas", "object", "button", "select", "textarea", "input",
           "option", "menu", "dialog", "footer", "audio", "video", "map", "noembed", "noframes", "annotation", "annotation-xml"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class and id names, between punctuation.
CLASSES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb",
           "breadcrumbs", "footer", "sidebar", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "gdpr", "notice",
           "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "comment", "comments", "disqus", "reply",
           "replies", "respond", "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer"}
#: Of these, those that inside an article may be its subject.
SUBJECTS = {"legal"}
#: Never part of a template.
WHOLE = {"html", "head", "body", "article", "main"}
#: These hold a page's head outside an article, but the title inside one.
HEADS = {"header", "masthead"}
#: A name with one of these words tells how an element looks just now, not what it is.
STATES = {"has", "no", "not", "with", "without", "open", "opened", "closed", "active", "enabled", "disabled", "visible"}
#: Reader comments: ids of their element, and the names of an article that is one.
COMMENT_IDS = {"comment", "comments", "disqus", "disqus_thread", "respond", "replies"}
_COMMENT = re.compile(r"(?:comment|comments|reply|comment-body|comment-item|(?:div-)?(?:comment|reply)-?\d+)\Z")
#: What a head can hold.
METADATA = {"title", "base", "link", "meta", "style", "script", "noscript", "template", "noframes", "bgsound", "basefont", "head", "html"}
#: An opening tag that ends an open element of these names (end tags left out).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that stop the search for an element to end.
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "html", "main", "aside", "nav", "td", "th", "blockquote", "form"}


class Node:
    __slots__ = ("tag", "names", "items", "hash", "drop", "outside", "inside", "weak", "named")

    def __init__(self, tag: str, attributes: str):
        """outside, inside: an article, reasons to drop it; weak: a lesser one outside."""
        self.tag, self.items, self.hash, self.names, self.drop = tag, [], 0, "", False
        self.inside, self.weak, self.named = tag in DROPPED, False, False
        self.outside = self.inside or tag == "header"
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                self.names += f" {key}={value}"
                if tag in ("html", "body") or key == "id" and tag in CONTENT:  # a heading's id is made from its words
                    continue
                if key == "role":
                    self._strong(tag != "main" and value.strip() in ROLES)
                elif key.endswith("hidden"):
                    self._strong(key == "hidden" or value == "true")
                elif tag == "article":
                    self._strong(any(_COMMENT.match(x) for x in value.split()))
                elif tag != "main":
                    for name in value.split():
                        if name in (CLASSES - SUBJECTS if key == "class" else COMMENT_IDS):
                            self._strong(True)
                        elif name in CLASSES or name in HEADS:
                            self.outside = True
                        elif not self.weak:
                            said = [x for x in re.split(r"[^a-z]+", name) if x]
                            # what a name ends with is what it is; it may begin so if it is short or goes on so
                            hits = [x in CLASSES or x in HEADS for x in said]
                            self.weak = not STATES & set(said) and any(hits) and (hits[-1] or hits[0] and (len(said) < 3 or hits[1]))

    def _strong(self, yes: bool) -> None:
        self.inside |= yes
        self.outside |= yes
        self.named |= yes


def _mark(root: Node) -> None:
    """Sets ``drop`` of every node."""
    nodes, above, within, quoted = [root], [-1], [False], [False]  # within: an article; quoted: a quotation, whose footer names its source
    for k, x in enumerate(nodes):
        article = within[k] or x.tag in ("article", "main")
        quote = quoted[k] or x.tag == "blockquote"
        for i in x.items:
            if isinstance(i, Node):
                nodes.append(i)
                above.append(k)
                within.append(article)
                quoted.append(quote)
    n = len(nodes)
    strong = [x.named if q and x.tag == "footer" else x.inside if a else x.outside for x, a, q in zip(nodes, within, quoted)]
    # characters below a node, those of its articles, and whether it holds an article or a main element
    chars, held, holds, main = [0] * n, [0] * n, [False] * n, [False] * n
    for k in range(n - 1, -1, -1):
        x, up = nodes[k], above[k]
        chars[k] += sum(len(i.strip()) for i in x.items if isinstance(i, str))
        own = x.tag in ("article", "main") and not strong[k]
        if own:
            held[k] = chars[k]
        if main[k]:
            strong[k] = False
        if up >= 0 and (holds[k] or not strong[k]):
            chars[up] += chars[k]
            held[up] += held[k]
            holds[up] |= holds[k] or own
            main[up] |= main[k] or own and x.tag == "main"
    free, covered = held[0], [False] * n
    for k in range(1, n):
        covered[k] = covered[above[k]]
        if strong[k] and holds[k] and not covered[k]:
            free -= chars[k] if within[k] else held[k]
            covered[k] = True
    for k, x in enumerate(nodes):
        if strong[k]:
            x.drop = not holds[k] or free >= (chars[k] if within[k] else held[k])
        elif x.tag == "form" or x.weak and not within[k]:
            x.drop = not holds[k] and 2 * chars[k] < chars[0]


class Stack:
    """Open elements, and of every name where they are open, so that no end tag walks through them."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Closes the k-th element and all in it."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.at.get(t))), default=0)

    def end_head(self, tag: str = "") -> None:
        """Closes a head that is open; a body element also ends what stands open in it."""
        if self.nodes[-1].tag == "head":
            self.cut(len(self.nodes) - 1)
        elif tag == "body" and self.at.get("head"):
            self.cut(self.at["head"][0])


def parse(page: str) -> Node:
    """The tree of block elements; items are texts and nodes in order."""
    root = Node("", "")
    stack, at, n = Stack(root), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            if not page[at: m.start()].isspace():
                stack.end_head()
            stack.nodes[-1].items.append(page[at: m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag and not m[1] and tag not in METADATA:
            stack.end_head(tag)
        if not tag or tag in INLINE:
            continue
        if m[1]:
            if tag == "br":
                stack.nodes[-1].items.append(" ")
            k = stack.last((tag,))
            if k and (tag not in CONTENT or k >= stack.last(SCOPES)):
                stack.cut(k)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                stack.nodes[-1].items.append(" " if tag == "br" else "" if tag == "wbr" else Node("hr", ""))
            continue
        if tag in ENDS_P and stack.nodes[-1].tag == "p":
            stack.cut(len(stack.nodes) - 1)
        if tag in ENDS:
            k = stack.last(ENDS[tag])
            if k and k >= stack.last(SCOPES - ENDS[tag]):
                stack.cut(k)
        node = Node(tag, m[3] or "")
        stack.nodes[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.items.append(page[at: end.start() if end else n])
            at = page.find(">", end.start()) + 1 or n if end else n
            continue
        stack.push(node)
    if at < n:
        if not page[at:].isspace():
            stack.end_head()
        stack.nodes[-1].items.append(page[at:])
    _mark(root)
    return root


def _hash(node: Node, seed: int = 7) -> int:
    """Sets the hash of every subtree; 0 for those without text. Iterative: depth is the page's choice."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [i for i in x.items if isinstance(i, Node)]
    for x in reversed(order):
        parts = [" ".join(i.split()) if isinstance(i, str) else f"\x00{i.hash:x}" if i.hash else "" for i in x.items]
        said = "\x01".join(p for p in parts if p)
        x.hash = xxhash.xxh64_intdigest(f"{x.tag}\x00{x.names}\x00{said}".encode("utf-8", "replace"), seed) >> 1 if said else 0
    return node.hash


def _kept(root: Node) -> list[tuple[Node, bool]]:
    """Every node that is not dropped, and whether it stands in an article or main element or is one."""
    out, todo = [], [(root, False)]
    while todo:
        node, article = todo.pop()
        if node.drop:
            continue
        article |= node.tag in ("article", "main")
        out.append((node, article))
        todo += [(i, article) for i in node.items if isinstance(i, Node)]
    return out


def subtrees(page: str, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """(hash, kind, characters, hash of the characters) of every subtree with text: kind 0 can't be template, 1 can, 2 is an article's paragraph
    or the like, -1 is the page. Characters are the main text's that stand in the node itself."""
    root = parse(page)
    _hash(root, seed)
    nodes = _kept(root)
    own = [" ".join("".join(i if isinstance(i, str) else " " for i in x.items).split()) for x, _ in nodes]
    articles = any(said and article for said, (_, article) in zip(own, nodes))
    out = []
    for said, (x, article) in zip(own, nodes):
        if x.hash:
            said = said if article or not articles else ""
            kind = -1 if x is root else 0 if x.tag in WHOLE else 2 if article and x.tag in CONTENT else 1
            out.append((x.hash, kind, len(said), xxhash.xxh64_intdigest(said.encode("utf-8", "replace")) >> 24 if said else 0))
    return out


def main_text(page: str, template: frozenset | set = frozenset(), wide: frozenset | set = frozenset(), seed: int = 7) -> str:
    """The article's blocks, or the body's if no article is left; ``template`` holds hashes of deleted subtrees, ``wide`` those of them
    that go as paragraphs of an article too."""
    root = parse(page)
    if template:
        _hash(root, seed)

    def blocks(articles: bool) -> list[str]:
        out: list[str] = []
        held: list[str] = []

        def end():
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(text)
        todo: list = [(root, not articles, False)]
        while todo:
            item, inside, article = todo.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                if inside:
                    held.append(item)
            else:
                if item.drop:
                    held.append(" ")
                    continue
                if item.hash in (wide if article and item.tag in CONTENT else template) and item.tag not in WHOLE:
                    held.append(" ")
                    continue
                here = item.tag in ("article", "main")
                end()
                todo.append((None, inside, article))
                todo += [(x, inside or here, article or here) for x in reversed(item.items)]
        end()
        return out
    return "\n".join(blocks(True) or blocks(False))


def _seed(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "replace"), 7)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a page: id, url, text, n_chars."""
    tables = Tables(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")) \
        .withColumn("host", host).withColumn("page", F.xxhash64("host", "html"))

    def list_subtrees(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [(p, h if x[1] < 0 else None, *x) for h, p, page in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))) for x in sorted(set(subtrees(page, _seed(h))))]
                cols = list(zip(*found)) if found else [[], [], [], [], [], []]
                yield pa.record_batch({"page": pa.array(cols[0], pa.int64()), "host": pa.array(cols[1], pa.string()), "subtree": pa.array(cols[2], pa.int64()),
                                       "kind": pa.array(cols[3], pa.int32()), "chars": pa.array(cols[4], pa.int64()), "said": pa.array(cols[5], pa.int64())})
    seen = tables.write(rows.select("host", "page", "html").mapInArrow(list_subtrees, "page long, host string, subtree long, kind int, chars long, said long"), "subtrees")
    # a subtree's hash has the host in it; counts are of different pages
    recurring = seen.where("kind > 0").select("subtree", "page").distinct().groupBy("subtree").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    # own text: what doesn't recur. A page that is there n times has n roots.
    marked = seen.join(recurring.withColumnRenamed("subtree", "r"), F.col("subtree") == F.col("r"), "left")
    rare, times = F.col("r").isNull(), F.sum(F.when(F.col("kind") == -1, 1))
    each = marked.groupBy("page").agg(F.max("host").alias("host"), F.collect_set(F.when(F.col("kind") > 0, F.col("r"))).alias("found"), F.sum(F.when(rare, F.col("chars")).otherwise(0)).alias("own"), F.sum("chars").alias("all"),
                                      (F.sum(F.when(rare, F.col("said")).otherwise(0).cast("decimal(28,0)")) / times).cast("decimal(38,0)").alias("text"))
    each = tables.write(each.withColumn("differs", (F.col("own") > 0) & (F.col("own") * OWN_PART >= F.col("all"))), "pages")
    tables.drop("subtrees")
    on = each.where("size(found) > 0").select("page", "host", "text", "differs", F.explode("found").alias("subtree"))
    texts_of = on.where("differs").select("subtree", "text").distinct().groupBy("subtree").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_pages)
    sizes = each.groupBy("host").agg(F.count("*").alias("size"))
    spread = on.groupBy("subtree").agg(F.count("*").alias("pages"), F.max("host").alias("host")).join(texts_of, "subtree").join(sizes, "host")
    template = tables.write(spread.select("subtree", (2 * F.col("pages") >= F.col("size")).alias("wide")), "template")
    gone = on.select("page", "subtree").join(template, "subtree").groupBy("page").agg(F.collect_set("subtree").alias("gone"), F.collect_set(F.when(F.col("wide"), F.col("subtree"))).alias("wide"))
    joined = rows.join(gone.withColumnRenamed("page", "g"), F.col("page") == F.col("g"), "left").select("id", "url", "html", "host", "gone", "wide")

    def texts(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = [main_text(page, set(g or ()), set(w or ()), _seed(h)) for page, g, w, h in zip(*(part.column(c).to_pylist() for c in ("html", "gone", "wide", "host")))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["id", "url", "text", "n_chars"])
    kind = dict(rows.dtypes)["id"]
    return joined.mapInArrow(texts, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
