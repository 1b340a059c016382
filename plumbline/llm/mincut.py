"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text with features of their place in the markup. A logistic classifier gives each block a cost for either
label, which are the capacities to the source (content) and the sink (boilerplate); blocks next to each other or under one parent
are joined by smoothness edges that weaken with their distance in the tree. The maximum flow separates content from boilerplate.
The classifier is trained on pages that are made up here, from many layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, text_chunks

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is never text of the page; of the first, everything up to the end tag is raw.
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
UNSEEN = RAW | frozenset("head svg select button object canvas audio video datalist".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option optgroup".split())
#: A start tag ends an open element of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME = frozenset("nav aside form footer menu search dialog".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role that tell of boilerplate, and of content.
BAD = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline chrome comment comments consent contact cookie cookies copyright discussion disqus dropdown feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup privacy promo promoted promotion recommended related replies reply responses search share sharing sidebar signup skyscraper social sponsor sponsored subscribe tags teaser toolbar topbar widget".split())
GOOD = frozenset("article articlebody body content entry main maintext post postbody prose story text".split())
FEATURES = ("one", "main", "good", "chrome", "header", "bad", "bad_inside", "links", "links_main", "length", "heading", "sentence", "item", "item_main", "hidden", "symbols")
LENGTH = FEATURES.index("length")


class Node:
    """A block element, and how deep it stands."""

    __slots__ = ("up", "depth")

    def __init__(self, up: Node | None):
        self.up, self.depth = up, up.depth + 1 if up else 0


class Block:
    __slots__ = ("text", "node", "x")

    def __init__(self, text: str, node: Node, x: tuple):
        self.text, self.node, self.x = text, node, x


def steps(a: Node, b: Node) -> int:
    """Elements between a and b by their common ancestor, without the two. Over a page's blocks in order, as much as the page has elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return max(0, n - 2)


@lru_cache(8192)
def _hints(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role tell of boilerplate, of content, and whether the element is hidden."""
    bad = good = hidden = False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
            words = set(re.split(r"[^a-z]+", words.lower()))
            bad |= bool(words & BAD)
            good |= bool(words & GOOD)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return bad, good and not bad, hidden


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with white space made single and character references decoded."""
    out: list[Block] = []
    # element: (tag, node of the innermost block element, main, good, chrome, header, bad, bad inside main, hidden, unseen, link, its tag)
    stack: list[tuple] = [("", Node(None), 0, 0, 0, 0, 0, 0, 0, 0, 0, "")]
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = len(text)
                e = stack[-1]
                tag = e[11]
                links, item = min(1.0, linked / n), tag in ("li", "td", "th", "dt", "dd", "option")
                main = e[2] and not (e[4] or e[6])
                symbols = sum(text.count(c) for c in "|»©·•")
                x = (1.0, e[2], e[3], e[4], e[5], e[6], e[7], links, links * main, min(1.0, math.log1p(n) / 6), tag[0:1] == "h" and tag[1:] in "123456" and len(tag) == 2, text[-1] in ".!?…”\"'»:;", item, item and main, e[8], 0.0 if main else min(1.0, symbols / 3))
                out.append(Block(text, e[1], x))
            parts.clear()
            linked = 0

    def pop(k: int) -> None:
        if any(e[0] in BLOCK for e in stack[k:]):
            close()
        del stack[k:]

    at, raw = 0, None
    n = len(page)
    last = page.rfind(">") + 1  # what stands after it can't be markup
    while at < n:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}\s*[^>]*>", re.I).search(page, at)
            raw = None
            at = m.end() if m else n
            continue
        m = _TOKEN.search(page, at, last)
        stop = m.start() if m else n
        if stop > at and stack[-1][0] == "head" and not page[at:stop].isspace():
            pop(len(stack) - 1)  # text can't stand in a head
        if stop > at and not stack[-1][9]:
            text = page[at:stop]
            parts.append(text)
            if stack[-1][10]:
                linked += len(text)
        if not m:
            break
        at = n if m[0].startswith("<!--") and m.end() == last and not m[0].endswith("-->") else m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in ("td", "th", "table", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends, and what it holds
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ENDS[tag]:
                        pop(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            close()
        if tag in RAW:
            raw = tag if not attributes.rstrip().endswith("/") else None
            continue
        if tag in VOID:
            continue
        bad, good, hidden = _hints(attributes)
        e = stack[-1]
        main = e[2] or tag in MAIN
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        node, own = (Node(e[1]), tag) if tag in BLOCK else (e[1], e[11])
        stack.append((tag, node, main, e[3] or good, e[4] or tag in CHROME, e[5] or (tag == "header" and not main), e[6] or bad, e[7] or (main and (bad or tag in CHROME)), e[8] or hidden, e[9] or tag in UNSEEN, e[10] or tag == "a", own))

    close()
    return out


def _made_up(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """Pages of many layouts, with the set of their content's texts."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]

    def words(k: int) -> str:
        return " ".join(rng.choices(vocabulary, k=max(1, k)))

    def sentence(k: int) -> str:
        return words(k).capitalize() + pick(".", ".", ".", "!", "?")

    for _ in range(n):
        content: set[str] = set()

        def say(text: str, content: set[str] = content) -> str:
            content.add(text)
            return text

        links = lambda: "<ul>" + "".join(f'<li><a href="#">{words(rng.randrange(1, 4))}</a></li>' for _ in range(rng.randrange(2, 8))) + "</ul>"
        plain = rng.random() < 0.3  # a page whose class names tell nothing
        name = lambda: "-".join(rng.choices(vocabulary, k=rng.randrange(1, 3)))
        kind = lambda *x: f' {pick("class", "id")}="{name() if plain else pick(*x)}"'

        def listed(say=say) -> str:
            """What an article may hold besides running text: lists, of links too, tables, definitions, code and captions."""
            texts = [words(rng.randrange(1, 9)) for _ in range(rng.randrange(2, 7))]
            for t in texts:
                say(t)
            shape = rng.randrange(6)
            if shape == 0:
                return "<ul>" + "".join(f'<li><a href="#">{t}</a></li>' for t in texts) + "</ul>"
            if shape == 1:
                return "<ol>" + "".join(f"<li>{t}</li>" for t in texts) + "</ol>"
            if shape == 2:
                return "<table>" + "".join(f"<tr><td>{t}</td></tr>" for t in texts) + "</table>"
            if shape == 3:
                return "<dl>" + "".join(f"<{d}>{t}</{d}>" for d, t in zip(("dt", "dd") * 4, texts, strict=False)) + "</dl>"
            if shape == 4:
                return "".join(f"<pre>{t}</pre>" for t in texts)
            return "".join(f'<figure><img src="x"><figcaption>{t}</figcaption></figure>' for t in texts)

        ad = lambda: f"<div{kind('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo box')}>{sentence(rng.randrange(3, 15))}</div>"
        story = ""
        if rng.random() < 0.9:
            story += f"<h1>{say(words(rng.randrange(2, 10)))}</h1>"
        for _ in range(rng.randrange(1, 12)):
            story += pick(f"<p>{say(sentence(rng.randrange(1, 120)))}</p>", f"<p>{say(sentence(rng.randrange(1, 60)))}", f"<p>{say(sentence(rng.randrange(5, 60)))}</p>", f"<h2>{say(words(rng.randrange(1, 6)))}</h2>", f"<ul><li>{say(sentence(rng.randrange(2, 20)))}</li></ul>", f"<blockquote>{say(sentence(rng.randrange(4, 40)))}</blockquote>")
            if rng.random() < 0.12:
                story += listed()
            if rng.random() < 0.08:
                story += pick(ad(), f"<aside>{sentence(8)}{links()}</aside>", f"<form>{words(3)}<input></form>")
        if rng.random() < 0.3:
            story += f"<section{kind('comments', 'discussion', 'replies')}>" + "".join(f"<p>{sentence(rng.randrange(2, 50))}</p>" for _ in range(rng.randrange(1, 5))) + "</section>"
        open_, shut = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{kind('content', 'post body', 'entry', 'main text', 'article')}>", "</div>"), (f"<section{kind('story', 'content')}>", "</section>"), ("<div>", "</div>")) if not plain else pick(("<article>", "</article>"), ("<main>", "</main>"), (f"<article{kind('x')}>", "</article>"))
        head = pick(f"<header><h2>{words(3)}</h2>{links()}</header>", f"<div{kind('header', 'masthead', 'topbar')}>{sentence(5)}{links()}</div>", "")
        nav = pick(f"<nav>{links()}</nav>", f"<div{kind('menu', 'navbar', 'breadcrumb')}>{links()}</div>", links(), "")
        side = pick(f"<aside>{''.join(f'<p>{sentence(rng.randrange(2, 30))}</p>' for _ in range(2))}{links()}</aside>", f"<div{kind('sidebar', 'widget', 'related')}><h3>{words(2)}</h3><p>{sentence(12)}</p>{links()}</div>", "")
        note = pick(f"<div{kind('cookie notice', 'consent', 'gdpr popup')}><p>{sentence(rng.randrange(4, 40))}</p></div>", f"<form><p>{sentence(6)}</p><label>{words(2)}</label><input></form>", "")
        after = pick(f"<div{kind('comments', 'comment list', 'disqus')}>" + "".join(f"<div><p>{sentence(rng.randrange(2, 60))}</p></div>" for _ in range(4)) + "</div>", "", "")
        foot = pick(f"<footer>&copy; {words(2)} &middot; {sentence(6)}{pick('', links())}</footer>", f"<div{kind('footer', 'copyright')}><p>&copy; {words(4)} | {words(2)} | {words(2)}</p></div>", "")
        banner = pick(ad(), "")
        if plain:  # then elements must tell
            tell = lambda t: re.sub(r"<(div|section)\b", "<aside", t).replace("</div>", "</aside>").replace("</section>", "</aside>")
            story, note, head, nav, side, after, foot, banner = map(tell, (story, note, head, nav, side, after, foot, banner))
        if rng.random() < 0.2:  # an article alone
            open_, shut = pick(("", ""), ("<div>", "</div>"), ("<section>", "</section>"))
            note = head = nav = side = after = foot = banner = ""
        yield f"<html><body>{note}{head}{nav}{banner}{side if rng.random() < 0.5 else ''}{open_}{story}{shut}{after}{side if rng.random() < 0.5 else ''}{foot}", content


@lru_cache(2)
def classifier(pages: int = 400, seed: int = 5) -> tuple[float, ...]:
    """Weights of FEATURES for content, by Newton steps on the blocks of made-up pages."""
    x, y = [], []
    for page, content in _made_up(pages, seed):
        for b in blocks(page):
            x.append(b.x)
            y.append(b.text in content)
    x, y, w = np.array(x, float), np.array(y, float), np.zeros(len(FEATURES))
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.3, x.T @ (p - y) + 0.3 * w)
    return tuple(w.tolist())


def minimum_cut(supply: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. supply: capacity from the source less that to the sink; edges (a, b, capacity) count both ways.

    Maximum flow by augmenting paths, each from one node with supply to the nearest one with demand. Nodes from which none can be
    reached any more never reach one again and are not searched twice; they are the source's side."""
    n = len(supply)
    left = list(supply)
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [c, c]
    tiny = 1e-9
    closed = [False] * n  # no demand in reach
    for start in range(n):
        while left[start] > tiny and not closed[start]:
            by = {start: -1}
            queue, end = [start], -1
            for v in queue:
                if left[v] < -tiny:
                    end = v
                    break
                for e in near[v]:
                    w = to[e]
                    if room[e] > tiny and w not in by and not closed[w]:
                        by[w] = e
                        queue.append(w)
            if end < 0:
                for v in queue:
                    closed[v] = True
                break
            path, v = [], end
            while by[v] != -1:
                path.append(by[v])
                v = to[by[v] ^ 1]
            flow = min(left[start], -left[end], *(room[e] for e in path))
            left[start] -= flow
            left[end] += flow
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
    return closed


def extract(page: str | None, weights: tuple[float, ...] | None = None, smooth: float = 1.0, decay: float = 0.45) -> str:
    """The page's main text; empty for an empty page or one without content."""
    found = blocks(page or "")
    if not found:
        return ""
    weights = weights or classifier()
    supply = []
    for b in found:
        z = sum(w * v for w, v in zip(weights, b.x, strict=True))
        # the costs' difference, log p - log(1 - p); long blocks weigh more
        supply.append(max(-8.0, min(8.0, z)) * (0.5 + b.x[LENGTH]))
    edges = []
    last: dict[Node | None, int] = {}
    for i, b in enumerate(found):
        if i and (c := smooth * decay ** min(64, steps(found[i - 1].node, b.node))) > 1e-3:
            edges.append((i - 1, i, c))
        parent = b.node.up
        if (j := last.get(parent)) is not None and j < i - 1:
            edges.append((j, i, smooth * decay))
        last[parent] = i
    keep = minimum_cut(supply, edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    text: the blocks labelled content, in page order, joined by newlines; a null or empty page, or one without content, has an empty
    text. Ids and urls are passed on, null or repeated. Broken markup is read as far as it goes, whole pages always. Columns other
    than the three are not read.
    """
    weights = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["i", "u"]), b.column(2)], names=["k", "t"]) for b in batches)
        for keys, texts in text_chunks(keyed):
            out = [extract(t, weights) for t in texts]
            yield batch_of(_OUT, [[k["i"] for k in keys], [k["u"] for k in keys], out, [len(t) for t in out]])

    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("t")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
