"""Main text of web pages: a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

# --- DOM ------------------------------------------------------------------

#: HTML's element classes.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
UNSEEN = frozenset("head select button svg object datalist canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these, unless one of the second set is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
#: Attribute of labelled pages: "1" main text, "0" not, inherited where it is missing.
LABEL = "data-main"


@dataclass
class Dom:
    """Block elements and runs of text, in page order; a parent precedes its children."""

    parent: list[int] = field(default_factory=list)
    #: (tag, attributes) of an element; None of a run
    element: list[tuple[str, str] | None] = field(default_factory=list)
    #: (text, characters in links) of a run
    run: list[tuple[str, int] | None] = field(default_factory=list)

    def add(self, parent: int, element, run) -> int:
        self.parent.append(parent)
        self.element.append(element)
        self.run.append(run)
        return len(self.parent) - 1


def parse(page: str) -> Dom:
    """The block tree of a page, as browsers mend it: implied end tags, stray
    end tags ignored, inline elements never close blocks, what is open at the end
    closes there. Character references are decoded, white space becomes one space.
    Open elements are known by their places on the stack, tag by tag, so every tag
    of the page takes a few steps, however many elements are open."""
    dom = Dom()
    root = dom.add(-1, ("html", ""), None)
    # (tag, block node, whether in a link, whether unseen)
    stack: list[tuple[str, int, bool, bool]] = [("", root, False, False)]
    # Places on the stack of the elements of each tag that an end tag can still close, and of all blocks.
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    pieces: list[tuple[str, bool]] = []

    def flush():
        if pieces:
            whole = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if whole:
                linked = sum(len("".join(html.unescape(p).split())) for p, a in pieces if a)
                dom.add(stack[-1][1], None, (whole, linked))
            pieces.clear()

    def pop(to: int):
        if blocks and blocks[-1] >= to:
            flush()
        while len(stack) > to:
            tag = stack.pop()[0]
            if places[tag] and places[tag][-1] == len(stack):
                places[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def find(tags, stop=frozenset()) -> int:
        """The innermost of ``tags``, unless one of ``stop`` lies within it; 0: none."""
        i = last(tags)
        return i if i and last(stop) < i else 0

    def innermost(tags) -> int:
        """The innermost of ``tags``, all of them blocks, unless another block lies within it."""
        i = last(tags)
        return i if i and blocks[-1] == i else 0

    # Nothing is a tag after the last ">": it is not sought there again and again.
    at, end, until = 0, len(page), page.rfind(">") + 1
    while at < end:
        m = TOKEN.search(page, at, until) if at < until else None
        text = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        if text and not stack[-1][3]:
            pieces.append((text, stack[-1][2]))
        # What a comment without an end holds goes to the end of the page.
        if not m or m.end() == until and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
            break
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "br" and not stack[-1][3]:
                pieces.append((" ", False))
            elif i := find({tag}):
                if tag in BLOCK or not blocks or blocks[-1] <= i:
                    pop(i)
                else:
                    places[tag].pop()
                    stack[i] = ("*", *stack[i][1:])
            continue
        if tag in RAW:
            m = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = m.end() if m else end
            continue
        if tag == "body" and (i := find({"head"})):
            pop(i)
        if tag in BLOCK:
            if i := innermost(("p",)):
                pop(i)
            if tag in CLOSES and (i := find(*CLOSES[tag])):
                pop(i)
            if tag in HEADINGS and (i := innermost(HEADINGS)):
                pop(i)
            flush()
        if tag in VOID:
            if tag == "br" and not stack[-1][3]:
                pieces.append((" ", False))
            continue
        _, node, link, unseen = stack[-1]
        if tag in BLOCK and not unseen and tag not in ("html", "body"):
            node = dom.add(node, (tag, attrs.strip()), None)
        places[tag].append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, node, link or tag == "a", unseen or tag in UNSEEN))
    pop(1)
    flush()
    return dom


# --- Features -------------------------------------------------------------

#: Beginnings of words in class, id and role that hint at what an element is.
HINTS = {
    "nav": ("nav", "menu", "breadcrumb", "toc", "pagination", "pager", "tabs", "skip"),
    "head": ("head", "masthead", "topbar", "logo", "brand", "toolbar", "hero"),
    "foot": ("foot", "copyright", "legal", "colophon", "bottom", "imprint"),
    "side": ("side", "aside", "widget", "rail", "related", "recommend", "trending", "popular", "more", "teaser", "complementary"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "commercial", "outbrain", "taboola", "dfp"),
    "notice": ("notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "warning", "disclaimer", "announce", "message", "toast"),
    "form": ("form", "search", "login", "signup", "register", "input", "contact"),
    "comment": ("comment", "reply", "replies", "disqus", "discussion", "respond", "feedback", "review", "thread"),
    "share": ("share", "social", "tags", "meta", "byline", "author", "rating", "print", "follow"),
    "main": ("article", "main", "content", "post", "entry", "story", "body", "text", "page", "news", "blog", "prose"),
}
WHOLE = frozenset(("ad", "ads", "more", "toc", "body", "text", "page"))
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def element_features(element: tuple[str, str]) -> tuple[str, ...]:
    """Tag, and the hints among the words of class, id and role."""
    tag, attrs = element
    words = set()
    for name, *value in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            words |= {w.lower() for w in _words.findall("".join(value))}
    found = [h for h, starts in HINTS.items() if any(w == s or s not in WHOLE and w.startswith(s) for w in words for s in starts)]
    return (f"tag {tag}", *(f"hint {h}" for h in found), *(("no hint",) if not found else ()))


def run_features(run: tuple[str, int]) -> tuple[str, ...]:
    """Length, share of links, and closing punctuation."""
    text, linked = run
    letters = len(text) - text.count(" ")
    return (
        f"length {min(8, int(math.log2(len(text) + 1)))}",
        f"links {round(3 * min(1, linked / max(letters, 1)))}",
        f"stop {text[-1] in '.!?:…。”»'}",
    )


# --- Model ----------------------------------------------------------------


@dataclass(frozen=True)
class TreeModel:
    """Binary labels on a tree. A run is 1 if it is main text, an element if
    anything in it is. ``edge[kind, tag][x][y]`` is the potential of parent x and
    child y (kind 0: element, 1: run) under a parent of that tag, tag "" for the
    others; ``odds[tag, feature]`` the log odds of a feature under such a parent."""

    edge: dict
    odds: dict[tuple[str, str], float]
    cache: dict = field(default_factory=dict, repr=False, compare=False)

    def _ratio(self, dom: Dom, i: int) -> float:
        """exp of the summed log odds of a node's features."""
        above = dom.element[dom.parent[i]][0]
        if dom.run[i] is not None:
            return self._odds(above, run_features(dom.run[i]))
        key = above, dom.element[i]
        known = self.cache.get(key)
        if known is None:
            if len(self.cache) > 20_000:
                self.cache.clear()
            known = self.cache[key] = self._odds(above, element_features(dom.element[i]))
        return known

    def _odds(self, above: str, features: tuple[str, ...]) -> float:
        total = sum(self.odds.get((above, f), self.odds.get(("", f), 0.0)) for f in features)
        return math.exp(max(-30.0, min(30.0, total)))

    def _edge(self, dom: Dom, i: int) -> tuple:
        kind = int(dom.run[i] is not None)
        return self.edge.get((kind, dom.element[dom.parent[i]][0])) or self.edge[kind, ""]

    def marginals(self, dom: Dom) -> list[float]:
        """P(label = 1) of every node, by sum-product: messages go up from the
        leaves, then down from the root."""
        n = len(dom.parent)
        up0, up1 = [1.0] * n, [1.0] + [self._ratio(dom, i) for i in range(1, n)]
        say0, say1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            e, p = self._edge(dom, i), dom.parent[i]
            s = up0[i] + up1[i]
            a, b = up0[i] / s, up1[i] / s
            say0[i], say1[i] = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            x, y = up0[p] * say0[i], up1[p] * say1[i]
            up0[p], up1[p] = x / (x + y), y / (x + y)
        down0, down1 = [1.0] * n, [1.0] * n
        out = [0.0] * n
        out[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, n):
            e, p = self._edge(dom, i), dom.parent[i]
            # What the parent knows without this child.
            x, y = down0[p] * up0[p] / say0[i], down1[p] * up1[p] / say1[i]
            a, b = x * e[0][0] + y * e[1][0], x * e[0][1] + y * e[1][1]
            down0[i], down1[i] = a / (a + b), b / (a + b)
            u, v = down0[i] * up0[i], down1[i] * up1[i]
            out[i] = v / (u + v)
        return out

    def text(self, page: str | None, threshold: float = 0.5) -> str:
        """Main text of a page: its runs of main text, joined by newlines."""
        if not page:
            return ""
        dom = parse(page)
        p = self.marginals(dom)
        return "\n".join(r[0] for r, x in zip(dom.run, p, strict=True) if r is not None and x >= threshold)


def labels(dom: Dom) -> list[int]:
    """Labels of a labelled page's nodes."""
    n = len(dom.parent)
    own = [0] * n
    for i in range(1, n):
        own[i] = own[dom.parent[i]]
        if dom.element[i] is not None:
            for name, *value in ATTRIBUTE.findall(dom.element[i][1]):
                if name == LABEL:
                    own[i] = int("".join(value) == "1")
    out = [x if r is not None else 0 for x, r in zip(own, dom.run, strict=True)]
    for i in range(n - 1, 0, -1):
        out[dom.parent[i]] |= out[i]
    return out


def train(pages: Iterable[str], smoothing: float = 0.5, least: float = 1.0) -> TreeModel:
    """Fits potentials by counting over labelled pages, whose elements carry
    ``data-main="1"`` or ``"0"``; log odds under ``least`` count as 0."""
    edge: Counter = Counter()
    seen: tuple[Counter, Counter] = Counter(), Counter()
    n: Counter = Counter()
    for page in pages:
        dom = parse(page)
        y = labels(dom)
        for i in range(1, len(y)):
            kind = int(dom.run[i] is not None)
            for tag in ("", dom.element[dom.parent[i]][0]):
                edge[kind, tag, y[dom.parent[i]], y[i]] += 1
                n[kind, tag, y[i]] += 1
                seen[y[i]].update((kind, tag, f) for f in (run_features(dom.run[i]) if kind else element_features(dom.element[i])))
    odds = {}
    for kind, tag, f in seen[0] | seen[1]:
        # Under a parent's tag where there is enough to count, else under any.
        if not tag or min(n[kind, tag, 0], n[kind, tag, 1]) >= 20:
            p1, p0 = ((seen[k][kind, tag, f] + smoothing) / (n[kind, tag, k] + 2 * smoothing) for k in (1, 0))
            value = math.log(p1 / p0)
            # Siblings are not independent: weak evidence, repeated, would outweigh strong.
            odds[tag, f] = value if abs(value) >= least else 0.0

    def potentials(kind, tag, x):
        base = [edge[kind, "", x, y] + smoothing for y in (0, 1)]
        row = [base[y] / sum(base) * 2 + (edge[kind, tag, x, y] if tag else edge[kind, "", x, y]) for y in (0, 1)]
        # Nothing under an element without main text is main text, but for mistakes.
        row = row if x else [sum(row), sum(row) * 1e-6]
        return tuple(v / sum(row) for v in row)

    tags = {(kind, tag) for kind, tag, _, _ in edge} | {(0, ""), (1, "")}
    return TreeModel({(k, t): (potentials(k, t, 0), potentials(k, t, 1)) for k, t in tags}, odds)


# --- Labelled pages -------------------------------------------------------


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    """``n`` pages of many layouts with labels: the training sample. The text is
    noise; what is learned is what elements look like."""
    r = random.Random(seed)
    pick = r.choice

    def word():
        return "".join(pick("etaoinshrdlucmfwyp") for _ in range(r.randint(1, 9)))

    def sentence():
        return " ".join(word() for _ in range(r.randint(2, 24))).capitalize() + pick([".", ".", ".", "?", "!"])

    def prose(k=None):
        return " ".join(sentence() for _ in range(k or r.randint(1, 5)))

    def plain(s):
        """Main text may be anything: a word, a list of codes, a line without a stop."""
        k = r.random()
        if k < 0.6:
            return s
        if k < 0.75:
            return sentence()[: r.randint(2, 40)]
        if k < 0.85:
            return f" {pick('|;#*·-')} ".join(word() for _ in range(r.randint(2, 60)))
        return " ".join(word() for _ in range(r.choice([1, 1, 2, 5, 30])))

    def inline(s):
        return s if r.random() < 0.75 else f"<{(t := pick(['b', 'i', 'em', 'strong', 'span', 'a href=/x']))}>{s}" + (f"</{t.split()[0]}>" if r.random() < 0.8 else "<br>")

    def cls(*names):
        name = pick(names)
        if not name or r.random() < 0.12:
            return ""
        name = pick(["", "", "site-", "page-", "c-", "js-"]) + name + pick(["", "", "", "-wrapper", "-box", "-1", " clearfix"])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def links(k=None):
        items = [f"<li><a href='/{word()}'>{' '.join(word() for _ in range(r.randint(1, 4)))}</a></li>" for _ in range(k or r.randint(2, 8))]
        return f"<ul>{''.join(items)}</ul>"

    def off(tag, attrs, inner):
        return f'<{tag}{attrs} {LABEL}="0">{inner}</{tag}>'

    def noise(k=None):
        """What surrounds main text may be anything, too."""
        return plain(prose(k))

    def people():
        def one():
            tag, name = pick(["div", "div", "li", "li", "p", "article"]), pick(["comment", "reply", "comment-body"])
            return f"<{tag} class='{name}'>{pick(['', f'<b>{word()}</b> '])}{pick(['<p>', ''])}{noise(r.randint(1, 3))}</{tag}>"

        head = pick(["", f"<h{r.randint(2, 4)}>{word()} {word()}</h3>"])
        return off(pick(["section", "div", "aside", "ul", "ol"]), pick([' class="comments"', ' id="comments"', ' class="comment-list"', ' id="discussion"', ' class="reader-comments"', ' id="disqus_thread"', ' class="responses replies"']), head + "".join(one() for _ in range(r.randint(1, 6))))

    def boiler():
        kind = r.randrange(11)
        if kind == 0:
            return off("nav", cls("", "menu", "main-nav", "breadcrumbs"), links())
        if kind == 1:
            return off(pick(["div", "ul", "section"]), cls("menu", "nav", "navbar", "navigation", "breadcrumb", "tabs"), links())
        if kind == 2:
            return off("header", cls("", "site-header", "masthead", "top"), pick(["", f"<h1>{sentence()}</h1>", f"<div>{sentence()}</div>"]) + pick(["", links(), f"<p>{sentence()}</p>"]))
        if kind == 3:
            return off(pick(["footer", "footer", "div"]), cls("footer", "site-footer", "copyright", "legal", "colophon"), pick([f"&copy; {noise(1)}", f"<p>&copy; {noise(2)}</p>", links() + f"<p>{sentence()}</p>"]))
        if kind == 4:
            return off(pick(["aside", "aside", "div"]), cls("sidebar", "side", "widget", "related", "recommended", "right-rail"), f"<h3>{word()}</h3>" + pick([links(), f"<p>{noise()}</p>", "".join(f"<div><a href=/>{sentence()}</a></div>" for _ in range(4))]))
        if kind == 5:
            return off(pick(["div", "aside", "section", "p"]), pick([' class="ad"', ' class="ads"', ' id="ad-1"', ' class="advert"', ' class="advertisement"', ' class="sponsored"', ' class="promo-box"', ' class="banner"']), pick([noise(), f"<a href=/>{sentence()}</a>", f"<b>{sentence()}</b> {noise(1)}"]))
        if kind == 6:
            return off(pick(["div", "section", "aside", "dialog"]), cls("notice", "cookie", "cookie-notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "announcement", "disclaimer"), pick([noise(), f"<p>{noise()}</p><a href=/>{word()}</a>"]))
        if kind == 7:
            return off("form", cls("", "search-form", "login", "signup", "contact"), pick(["", f"<label>{sentence()}</label>"]) + f"<p>{noise(1)}</p><input name=q><button>{word()}</button>")
        if kind == 8:
            return off(pick(["div", "ul"]), cls("share", "social", "tags", "byline", "post-meta", "author", "meta"), pick([links(3), " ".join(f"<a href=/>{word()}</a>" for _ in range(4)), f"{word()} {word()}"]))
        if kind == 9:
            return people()
        return off(pick(["div", "section"]), "", links() if r.random() < 0.7 else " ".join(f"<a href=/>{word()} {word()}</a> |" for _ in range(6)))

    def block():
        k = r.random()
        if k < 0.66:
            return f"<p>{inline(plain(prose()))}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.76:
            return f"<h{(h := r.randint(2, 4))}>{' '.join(word() for _ in range(r.randint(1, 8)))}</h{h}>"
        if k < 0.84:
            t = pick(["ul", "ol"])
            return f"<{t}>{''.join(f'<li>{pick([prose(1), word(), inline(plain(sentence()))])}</li>' for _ in range(r.randint(1, 6)))}</{t}>"
        if k < 0.88:
            return f"<blockquote>{pick([prose(), f'<p>{prose()}</p>'])}</blockquote>"
        if k < 0.91:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{plain(sentence())}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if k < 0.94:
            return f"<pre>{prose()}</pre>"
        if k < 0.97:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        return pick([f"<div>{plain(prose())}</div>", f"<section><p>{plain(prose())}</p></section>", f"{plain(prose())}<br>", f"<section>{prose()}</section>"])

    def article():
        inner = [f"<h1>{plain(sentence())}</h1>"] if r.random() < 0.7 else []
        if r.random() < 0.1:
            inner = [f"<header>{inner[0]}</header>"] if inner else []
        for _ in range(pick([1, 1, 2, 3, 5, 8, 14])):
            inner.append(block())
            if r.random() < 0.08:
                inner.append(boiler())
        if r.random() < 0.15:
            inner.append(people())
        body = "".join(inner)
        if r.random() < 0.3:
            body = f"<div{cls('content', 'article-body', 'entry-content', 'post-body', 'text', '')}>{body}</div>"
        if r.random() < 0.15:
            body = f"<section{cls('section', '')}>{body}</section>"
        tag, attrs = pick([("article", ""), ("article", cls("post", "story", "article", "entry")), ("main", cls("", "content")), ("div", cls("content", "main", "article", "post", "entry", "story", "main-content", "article-body")), ("section", cls("content", "main", "story")), ("div", "")])
        return f'<{tag}{attrs} {LABEL}="1">{body}</{tag}>'

    out = []
    for _ in range(n):
        parts = [boiler() for _ in range(r.randint(0, 5))] + ([article()] if r.random() < 0.96 else []) + [boiler() for _ in range(r.randint(0, 5))]
        body = "".join(parts)
        if r.random() < 0.4:
            body = f"<div{cls('wrapper', 'container', 'page', 'main', '')}>{body}</div>"
        out.append(f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>{body}</body></html>")
    return out


# --- Operator -------------------------------------------------------------


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Main text of ``pages`` (page_id, url, html): ``(page_id, url, text,
    n_chars)``, n_chars in code points.

    Blocks of main text in page order, joined by one newline; within a block,
    character references are decoded and white space is one space. A null or
    empty page, or one without main text, has an empty text. Repeated rows are
    extracted each; an empty table gives an empty table; other columns are
    ignored. Very long pages, deep nesting and tags or comments without an end take
    time in proportion to their length. Without a model, one is trained on
    :func:`labelled_pages`.
    """
    model = model or train(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast((model.edge, model.odds))

    def rows(batches):
        own = TreeModel(*shared.value)
        for b in sliced(batches, 64):
            text = [own.text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
