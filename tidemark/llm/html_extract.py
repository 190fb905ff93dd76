"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree; inline markup belongs to the block around it. Each block is content or not. Its
own features (kind of element, words of its class and id and of those above, length, share of links, punctuation, paragraphs
beside and within it, its share of the page's text) give a potential, and each parent-child pair one that depends on both states and on the kind of child. Sum-product messages, upward and then
downward, yield every block's exact marginal; blocks more likely content than not make the text. Weights are fitted by
gradient ascent on the likelihood of labelled pages (``PAGES``, written for this purpose), whose gradient is the
observed less the expected features under the same marginals.

Everything runs page by page, so nothing is shuffled. Text of scripts, styles, comments and other elements without
text of their own never counts. Character references are decoded, white space within a block becomes one space, blocks
are joined by a newline in page order; nothing else is dropped or cut.

Edge cases: null or empty html gives an empty text; a page of any length is read whole, in time that grows in proportion, broken or not; text outside any element is a block of its own; broken markup is
read as browsers would, roughly; nesting may be of any depth; repeated rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What shows no text of its own in a page, controls of forms included.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg annotation annotation-xml object head button select datalist".split())
_RAW_TEXT = frozenset("script style textarea title iframe noembed noframes xmp".split())
# What may stand in a head, whose end tag is optional; anything else ends it.
_IN_HEAD = frozenset("html head title meta link base style script noscript template".split())
# What opening a block ends an svg that was not closed, unless it stands in one of these.
_SVG_HTML = frozenset("foreignobject desc".split())
# What an opening tag closes before it opens (fixed values).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_ENDS_P = BLOCKS - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend", "select"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LABEL = re.compile(r"data-(main|rest)\b")


class Block(NamedTuple):
    tag: str
    parent: int
    names: str
    label: int  # 1 or 0 where a labelled page says so, else -1


def blocks_of(page: str) -> tuple[list[Block], list[list[str]], list[int], list[tuple[int, str]]]:
    """The tree of blocks; each block's own text pieces; letters inside links of each; and all text runs in page order.

    A run is the text of one block between two other blocks: what follows a child block is a run of its own.
    """
    blocks, own, linked = [Block("#page", -1, "", -1)], [[]], [0]
    runs: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, each with its block
    hidden = links = 0
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if hidden or not piece:
            return
        block = stack[-1][1]
        plain = entities.unescape(piece)
        if not runs or runs[-1][0] != block or split[0]:
            if not plain.strip():
                return
            runs.append((block, []))
            split[0] = False
        runs[-1][1].append(plain)
        own[block].append(plain)
        if links:
            linked[block] += len(plain.strip())

    split = [False]  # whether the next text starts a new run
    depths: dict[str, list[int]] = {}  # where elements of each kind are open, so that none is looked for by a walk
    block_depths: list[int] = []

    def top(*tags: str) -> int:
        """The innermost open element of some kinds, 0 where there is none."""
        return max((d[-1] for t in tags if (d := depths.get(t))), default=0)

    def close(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            tag, _ = stack.pop()
            depths[tag].pop()
            hidden -= tag in RAW
            links -= tag == "a"
            if tag in BLOCKS:
                block_depths.pop()
                split[0] = True

    def end_head() -> None:
        if depth := top("head"):
            close(depth)

    last = page.rfind(">")
    while at < n:
        m = _TOKEN.search(page, at) if at <= last else None  # no tag ends behind ``last``
        if stack[-1][0] == "head" and page[at : m.start() if m else n].strip():
            end_head()
        if m is None:
            text(page[at:].partition("<!--")[0])  # an open comment hides the rest, all else is text
            break
        text(page[at : m.start()])
        at = m.end()
        slash, tag, attrs = m[1] if m[2] else m[4], m[2] or m[5], m[3] if m[2] else m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            depth = top(tag)
            if depth and (tag in BLOCKS or depth >= top("table", "article", "main", "body")):
                close(depth)
            continue
        if tag not in _IN_HEAD and (stack[-1][0] == "head" or tag == "body") and depths.get("head"):
            end_head()
        if tag in BLOCKS and (depth := top("svg")) > max(top(*_SVG_HTML), block_depths[-1] if block_depths else 0):
            close(depth)
        if tag in _RAW_TEXT:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "hr":
                    split[0] = True
                text(" ")
            continue
        if tag in _ENDS_P and block_depths and stack[block_depths[-1]][0] == "p":
            close(block_depths[-1])
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            stop = top(*stops)
            above = [d[k] for t in ends if (d := depths.get(t)) and (k := bisect_right(d, stop)) < len(d)]
            if above:
                close(min(above))
        block = stack[-1][1]
        if tag in BLOCKS:
            names = " ".join(x for a in _ATTR.findall(attrs) for x in a[1:] if x)
            label = _LABEL.search(attrs)
            blocks.append(Block(tag, block, names, blocks[block].label if label is None else int(label[1] == "main")))
            own.append([])
            linked.append(0)
            block, split[0] = len(blocks) - 1, True
        if attrs.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        depths.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            block_depths.append(len(stack))
        stack.append((tag, block))
        hidden += tag in RAW
        links += tag == "a"
    return blocks, own, linked, [(b, " ".join("".join(p).split())) for b, p in runs]


# Words of class and id names that tell what a block is for (fixed values).
OUTER = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail footer foot bottom header head masthead banner ad ads advert adverts advertisement sponsor sponsored promo promoted "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup login form search share sharing social related recommended more comment comments discussion reply replies respondent "
    "widget toolbar pager pagination tags meta legal copyright disclaimer contentinfo complementary".split()
)
INNER = frozenset("article content main post story entry hentry text body copy prose page-content articlebody maincontent".split())
COMMENT = frozenset("comment comments discussion reply replies respondent".split())
_TAGS = {t: t for t in "center p li td div section article main aside nav header footer form ul ol table tr blockquote pre h1 body html dd".split()} | dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), "h2")
_NAME = re.compile(r"[a-z]+")


#: Letters from which on a text is a paragraph, and the share of links from which on it isn't (for features alone).
_PARAGRAPH, _LINKED = 80, 0.25


class Around(NamedTuple):
    """What lies about a block: letters and linked letters within it, paragraphs among its children and siblings, letters of the page, what is above."""

    letters: int = 0
    linked: int = 0
    kids: int = 0
    company: int = 0
    page: int = 0
    in_outer: bool = False
    in_reader: bool = False


def _few(n: int) -> str:
    return ("none", "one")[n] if n < 2 else "more"


def named(block: Block) -> tuple[bool, bool, bool]:
    """Whether a block's names or kind say that it is outside the text, inside it, or for readers' comments."""
    names = set(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", block.names).lower()))
    return bool(names & OUTER and not names & INNER), bool(names & INNER and not names & OUTER), bool(names & COMMENT)


def block_features(block: Block, text: str, linked: int, depth: int, around: Around) -> list[str]:
    outer, inner, reader = named(block)
    size = len(text)
    share = linked / size if size else 0.0
    kind = _TAGS.get(block.tag, "other")
    length = "none" if not size else "short" if size < 25 else "line" if size < 80 else "some" if size < 250 else "long"
    out = ["bias", f"tag={kind}", f"length={length}", f"{kind}:{length}"]
    out += ["outer"] * outer + ["inner"] * inner + ["reader"] * reader + ["in-outer"] * around.in_outer + ["in-reader"] * around.in_reader
    if size:
        out.append("links=" + ("most" if share > 0.6 else "many" if share > 0.25 else "few" if linked else "none"))
        out += ["stop"] * (text[-1:] in ".!?…\"”»") + ["rights"] * bool(_RIGHTS.search(text[:60]))
        out += [f"company={_few(around.company)}", f"{length}:company={_few(around.company)}"]
    if around.letters:
        lies = around.linked / around.letters
        out.append(f"{kind}:below=" + ("links" if lies > 0.6 else "mixed" if lies > 0.25 else "text"))
        part = (around.letters - around.linked) / max(1, around.page)
        out.append("page=" + ("most" if part > 0.5 else "half" if part > 0.25 else "some" if part > 0.08 else "little"))
    out += [f"kids={_few(around.kids)}"] * (not size)
    return out + ["deep"] * (depth > 8)


#: How a note on rights begins (a fixed value).
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights", re.I)
#: Pairs: child kinds whose state hangs together with the parent's in their own way.
_PAIR = {t: t for t in "p nav aside footer header form ul li div section article main h1 td table".split()}


class Tree(NamedTuple):
    parents: list[int]
    features: list[list[str]]
    pairs: list[str]
    labels: list[int]


def tree_of(blocks: list[Block], own: list[list[str]], linked: list[int]) -> Tree:
    n = len(blocks)
    depth, in_outer, in_reader, kids = [0] * n, [False] * n, [False] * n, [0] * n
    texts = [" ".join("".join(x).split()) for x in own]
    below = [[len(t), k] for t, k in zip(texts, linked, strict=True)]
    told = [named(b) for b in blocks]
    paragraph = [len(t) >= _PARAGRAPH and k <= _LINKED * len(t) for t, k in zip(texts, linked, strict=True)]
    for i in range(n - 1, 0, -1):
        up = blocks[i].parent
        kids[up] += paragraph[i]
        for j in (0, 1):
            below[up][j] += below[i][j]
    page = below[0][0] - below[0][1]
    features = []
    for i, b in enumerate(blocks):
        if i:
            up = b.parent
            depth[i] = depth[up] + 1
            in_outer[i] = in_outer[up] or told[up][0] or blocks[up].tag in ("nav", "aside", "footer")
            in_reader[i] = in_reader[up] or told[up][2]
        company = kids[b.parent] - paragraph[i] if i else 0
        features.append(block_features(b, texts[i], linked[i], depth[i], Around(*below[i], kids[i], company, page, in_outer[i], in_reader[i])))
    return Tree([b.parent for b in blocks], features, [_PAIR.get(b.tag, "other") for b in blocks], [b.label for b in blocks])


class Weights(NamedTuple):
    """own[feature]: for being content; pair[kind][parent's state][child's state]."""

    own: dict[str, float]
    pair: dict[str, tuple[tuple[float, float], tuple[float, float]]]


_FLAT = ((0.0, 0.0), (0.0, 0.0))


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(tree: Tree, weights: Weights) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Sum-product over the tree: P(content) of each block, and P(parent, child) of each block but the first.

    Children come after their parents, so one backward sweep sends all messages upward and one forward sweep downward.
    """
    n = len(tree.parents)
    low, high = [0.0] * n, [0.0] * n  # log potential with all messages from below
    for i, fs in enumerate(tree.features):
        high[i] = sum(weights.own.get(f, 0.0) for f in fs)
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n
    pair = [weights.pair.get(k, _FLAT) for k in tree.pairs]
    for i in range(n - 1, 0, -1):
        p, w = tree.parents[i], pair[i]
        up[i] = _add(low[i] + w[0][0], high[i] + w[0][1]), _add(low[i] + w[1][0], high[i] + w[1][1])
        low[p] += up[i][0]
        high[p] += up[i][1]
    down_low, down_high = [0.0] * n, [0.0] * n
    content, edges = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        if i:
            p, w = tree.parents[i], pair[i]
            a, b = low[p] + down_low[p] - up[i][0], high[p] + down_high[p] - up[i][1]
            joint = (a + w[0][0] + low[i], a + w[0][1] + high[i], b + w[1][0] + low[i], b + w[1][1] + high[i])
            top = max(joint)
            e = [math.exp(x - top) for x in joint]
            total = sum(e)
            edges[i] = tuple(x / total for x in e)  # type: ignore[assignment]
            down_low[i], down_high[i] = _add(a + w[0][0], b + w[1][0]), _add(a + w[0][1], b + w[1][1])
        z = low[i] + down_low[i] - high[i] - down_high[i]
        content[i] = 1 / (1 + math.exp(min(700.0, max(-700.0, z))))
    return content, edges


_SHELL = '<!DOCTYPE html><html><head><title>x</title></head><body data-rest>%s</body></html>'
_LONG = "The river rose through the night, and by morning the lower fields were under water. Nobody in the village had seen it so high, not even those who remember the old bridge."
_MORE = "They moved the animals first. Then, with boats lent by the mill, they fetched the old people from the houses at the bend; it took until noon."
_LINE = "No one was hurt, the mayor said."
_MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport and games</a></li><li><a href='/a'>About us</a></li></ul>"
#: Labelled pages: data-main marks what is content, data-rest what is not; blocks within follow.
PAGES = [
    _SHELL % f"<nav>{_MENU}</nav><div class='ad'>Buy two lamps now and get the third for free. Offer ends soon.</div><article data-main><h1>High water</h1><p>{_LONG}<p>{_MORE}</p><p>{_LINE}</p></article><footer>&copy; The Valley Post &middot; All rights reserved by us.</footer>",
    _SHELL % f"<div class=ad>Lamps.</div><nav>{_MENU}</nav><article data-main><h1>Water</h1><p><b>{_LINE}<br><p>{_LONG}</p><p>And.</p><p>{_MORE}</p></article><footer>&copy; a.example &middot; Some words no.</footer>",
    _SHELL % f"<header><h1>The Valley Post</h1><nav>{_MENU}</nav></header><main data-main><h1>High water in the valley</h1><p>{_LONG}</p><h2>Boats</h2><p>{_MORE}</p><ul><li>Two boats came from the mill.</li><li>One came from the school.</li></ul><blockquote><p>{_LINE}</p></blockquote></main><aside><h2>Most read</h2>{_MENU}<p>Five walks along the river for the weekend.</p></aside><footer><p>Contact us at any time. Printed in the valley.</p></footer>",
    _SHELL % f"<div id='header'><div class='logo'>Valley</div>{_MENU}</div><div id='content' data-main><h1>Flood</h1><p>{_MORE}</p><p>{_LONG}</p><div class='share' data-rest><a href='#'>Share</a> <a href='#'>Mail</a></div><table><tr><td>Level in the morning</td><td>Four metres and ten</td></tr></table></div><div id='comments'><h3>Comments</h3><div class='comment'><p>I was there and it was worse than that, believe me. The road was gone.</p></div><div class='comment'><p>{_MORE}</p></div><form><p>Write what you think about it here, please.</p><input type=text></form></div><div id='footer'>Imprint and privacy</div>",
    _SHELL % f"<div class='cookie-notice'><p>We use cookies to make this site better for you. Read how we use them, and choose what you allow.</p><form><p>Accept all of them.</p></form></div><div class='page'><div class='sidebar'><h3>Related</h3><p>Three villages want a higher dam, and one does not.</p>{_MENU}</div><div class='article-body' data-main><h2>After the flood</h2><p>{_LONG}</p><p>{_LINE}</p><p>{_MORE}</p><figure><figcaption>The bridge at noon.</figcaption></figure></div><div class='newsletter'><p>Sign up for our letter and get the news each morning.</p></div></div>",
    _SHELL % f"<section class='promo'><p>Try the paper for four weeks. It costs you nothing.</p></section><section><article data-main><header data-main><h1>Dams</h1><p>By our reporter</p></header><section><p>{_LONG}</p><p>{_MORE}</p></section><pre>level 410</pre></article><section class='comments' data-rest><article><p>{_LONG}</p></article><article><p>Well said.</p></article></section></section><form action='/s'><div>Search the archive for a word</div></form><footer><div>{_MENU}</div><p>All texts are ours and may not be copied.</p></footer>",
    _SHELL % f"<table><tr><td>{_MENU}</td><td data-main><h1>Old page</h1><p>{_LONG}</p>{_MORE}<p>{_LINE}</p></td></tr></table><div class='banner'>Visit our shop today, it is open.</div>",
    _SHELL % f"<div class='post' data-main><h1>Note</h1><div>{_LONG}</div><div>{_MORE}</div><ol><li>{_LINE}</li><li>Go home.</li></ol></div><div class='related-posts'><h4>More</h4><p>{_LINE}</p></div><div role='contentinfo'>Copyright of the Post.</div>",
    _SHELL % f"<header>{_MENU}<p>{_LINE}</p></header><article data-main><p>{_LINE}</p><p>Of it.</p><p>{_LONG}</p></article><aside class='ads'><p>{_LONG}</p></aside><div class='alert'><p>{_MORE}</p></div>",
]

_BITS = ("Yes", "The end", "Up the hill", "Of it.", _LINE, "BOATS!! ALL DAY!! EVERY DAY!!", _MORE, _LONG, "one two one two three three", f"{_LONG} {_MORE} {_LONG}", "More of the same with no end in sight, and so on for a line")


def _short_page(i: int) -> str:
    """A page whose article is a headline and a few paragraphs of any length, among the usual rest."""
    words = [_BITS[(i + 3 * k) % len(_BITS)] for k in range(1 + i % 4)]
    body = "".join(f"<p>{w}</p>" for w in words) if i % 2 else f"<p><b>{words[0]}<br>" + "".join(f"<p>{w}</p>" for w in words[1:])
    rest = (f"<div class='ad'>{_BITS[(i + 5) % len(_BITS)]}</div>", f"<aside><p>{_BITS[(i + 2) % len(_BITS)]}</p></aside>", f"<div class='notice'><p>{_BITS[(i + 7) % len(_BITS)]}</p></div>", "")[i % 4]
    tail = f"<div class='comments'><div class='comment'><p>{_BITS[(i + 4) % len(_BITS)]}</p></div></div>" if i % 5 == 0 else ""
    main = ("<article data-main>%s</article>", "<main data-main>%s</main>", "<article data-main>%s</article>", "<div class='content' data-main>%s</div>")[i % 4]
    return _SHELL % (f"<nav>{_MENU}</nav>{rest}" + main % f"<h1>{_BITS[(i + 1) % len(_BITS)]}</h1>{body}" + tail + f"<footer>&copy; a.example &middot; {_BITS[i % len(_BITS)]}</footer>")


PAGES += [_short_page(i) for i in range(44)]
# Pages of other make-up: short items and steps in articles, tables, headers within, no usual frame.
_ITEMS = ("One egg", "Two cups of flour", "Salt", "A spoon of butter", "Warm milk")
_STEPS = ("Mix the flour and the salt.", "Add <a href='/milk'>warm milk</a>", "<a href='/knead'>Knead the dough</a>", "Bake it.")


def _other_page(i: int) -> str:
    listed = "".join(f"<li>{x}</li>" for x in _ITEMS[: 2 + i % 4])
    steps = "".join(f"<li>{x}</li>" for x in _STEPS[: 2 + i % 3])
    parts = (f"<ul>{listed}</ul>", f"<p>{_LINE}</p><ul>{listed}</ul><ol>{steps}</ol>", f"<header data-main><h1>{_BITS[i % 4]}</h1></header><ol>{steps}</ol><p>{_MORE}</p>", f"<h2>{_BITS[(i + 1) % 4]}</h2><p>{_LONG}</p><dl><dt>Serves</dt><dd>Four</dd></dl><ul>{listed}</ul>")
    notice = (f"<form data-rest><p>{_BITS[i % 3]}</p><input></form>", "", f"<div class='notice' data-rest><p>{_LINE}</p></div>", "")[i % 4]
    name = ("", " class='post-header-wide'", " class='entry share-open'", " id='story'")[i // 2 % 4]
    tag = ("article", "main", "article", "div class='content'")[i % 4] if not name else ("article", "main")[i % 2]
    main = f"<{tag}{name} data-main><h1>{_BITS[(i + 2) % 4]}</h1>{parts[i % 4]}{notice}</{tag.split()[0]}>"
    before = (f"<div id=top>{_MENU}</div>", f"<header><p>The Post</p><ul><li><a href='/'>Home</a><li><a href='/b'>Bread</a></ul></header>", "", f"<nav><a href='/'>Home</a> <a href='/x'>All recipes</a></nav>")[i % 4]
    after = (f"<section class='related'><ul><li><a href='/r'>{_LINE}</a></li><li><a href='/s'>Soups</a></li></ul></section>", "<footer><ul><li><a href='/i'>Imprint</a></li><li><a href='/p'>Privacy</a></li></ul></footer>", "<aside><h3>Popular</h3><ul><li><a href='/q'>Quick bread</a></li></ul></aside>", "")[i // 3 % 4]
    return f"<body data-rest>{before}{main}{after}"


PAGES += [_other_page(i) for i in range(24)]
# Pages of divs without telling names, blogs, tables and bare bodies: what surrounds a text must tell.
_TEXTS = (f"<p>{_LONG}</p><p>{_MORE}</p>", f"<p>{_LONG}</p><p>{_LINE}</p><p>{_MORE}</p>", f"<div>{_LONG}</div><div>{_MORE}</div><div>{_LINE}</div>", f"<p>{_MORE}</p><ul><li>{_LINE}</li><li>Go home.</li></ul><p>{_LONG}</p>",
          f"{_LONG}<br><br>{_MORE}", f"<p>{_LONG}</p><h3>Boats</h3><p>{_MORE}</p>", f"<p>{_MORE}</p>", f"<p>{_LONG}</p><table><tr><th>Day</th><td>Noon</td></tr><tr><td>Level</td><td>Four metres</td></tr></table><p>{_MORE}</p>")
_LINKS = ("<a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a>", _MENU, "<span><a href='/a'>About us</a></span> | <span><a href='/c'>Write to us</a></span>", "<a href='/'>The Valley Post</a>")
_ENDS = ("Copyright 2021 The Valley Post", "&copy; The Valley Post. All rights reserved.", "Printed in the valley", "(c) a.example", "Copyright of the Post. Nothing may be copied without asking us first, and then only in part.")
_ASIDES = (f"<h3>Most read</h3>{_MENU}", "<h4>Search</h4><form><input></form>", "<p>Five walks along the river for the weekend.</p>", f"<h3>Archive</h3><ul><li><a href='/1'>May</a></li><li><a href='/2'>June</a></li></ul>", "")


def _bare_page(i: int) -> str:
    text, links, end, side = _TEXTS[i % 8], _LINKS[i // 2 % 4], _ENDS[i % 5], _ASIDES[i // 3 % 5]
    title = f"<{'h1 h2 h3 h2'.split()[i % 4]}>{_BITS[i % 5]}</{'h1 h2 h3 h2'.split()[i % 4]}>"
    said = f"<div><p>{(_MORE, _LINE, _LONG)[i % 3]}</p></div>"
    comments = ("", f"<section id='comments' data-rest><h3>Two comments</h3><article><p>{_LONG}</p></article><article><p>{_LINE}</p></article></section>", f"<div class='discussion' data-rest>{said}{said}</div>", f"<ol class='comment-list' data-rest><li>{said}</li><li>{said}</li></ol>")[i % 4]
    kind = i % 9
    if kind == 0:
        return _SHELL % f"<div>{links}</div><div data-main>{title}{text}</div><div>{end}</div>"
    if kind == 1:
        return _SHELL % f"<div class='c1'>{links}</div><div class='c2'><div class='c3' data-main>{title}{text}</div><div class='c4'>{side}</div></div><div class='c5'>{end}</div>"
    if kind == 2:
        return _SHELL % f"<div id='page'><div id='masthead'>{links}</div><div class='hentry' data-main><h2 class='entry-title'>{_BITS[i % 5]}</h2><div class='entry-meta' data-rest><a href='/d'>May 4</a> by <a href='/w'>a writer</a></div><div class='entry-content'>{text}</div></div>{comments}<div class='widget-area'>{side}</div><div id='colophon'>{end}</div></div>"
    if kind == 3:
        return _SHELL % f"<table><tr><td>{_LINKS[3 - i // 9 % 4]}</td></tr><tr><td>{links}</td><td data-main>{title}{text}</td><td>{side}</td></tr><tr><td>{end}</td></tr></table>"
    if kind == 4:
        return f"<html><body data-rest><p>{links}</p><h1 data-main>{_BITS[i % 5]}</h1>" + "".join(f"<p data-main>{t}</p>" for t in (_LONG, _MORE, _LINE)[: 2 + i % 2]) + f"<hr><p>{end}</p></body></html>"
    if kind == 5:
        return _SHELL % f"<header>{_LINKS[3]}</header><article data-main>{title if i % 2 else ''}{(text, f'<p>{_BITS[i % 5]}</p>')[i // 9 % 2]}</article>{comments}<footer>{end}</footer>"
    if kind == 6:
        return _SHELL % f"<div class='wrap'><div class='row'><div class='col-8' data-main>{title}{text}</div><div class='col-4'>{side}{links}</div></div>{comments}</div><div class='row'><small>{end}</small></div>"
    if kind == 7:
        return _SHELL % f"<center>{links}</center><div><div><div data-main>{title}{text}</div></div></div><center><font>{end}</font></center>"
    return _SHELL % f"<section>{links}</section><section data-main>{title}{text}<p data-rest><a href='/m'>Read more about the flood</a></p></section>{comments}<section><p>{end}</p></section>"


PAGES += [_bare_page(i) for i in range(63)]
# Adverts, notices and site names of any length beside and within plainly marked texts.
_AD = ("ad", "advert", "sponsored", "banner-top", "promo", "notice", "cookie-consent", "ads")


def _advert_page(i: int) -> str:
    said = _BITS[(3 * i + 1) % len(_BITS)]
    ad = f"<div class='{_AD[i % 8]}' data-rest>{said if i % 3 else f'<p>{said}</p>'}</div>"
    text = f"<h1>{_BITS[(i + 2) % 5]}</h1>{_TEXTS[i % 8]}"
    tag = ("article", "main", "article", "div class='story'")[i % 4]
    inside = text.replace("</p><p>", f"</p>{ad}<p>", 1) if i % 2 and "</p><p>" in text else text
    before = (f"<nav>{_MENU}</nav>", "<header><a href='/'>The Valley Post</a></header>", f"<header><a href='/'>Post</a></header><nav>{_MENU}</nav>", "")[i // 2 % 4]
    side = ("", f"<aside class='sidebar'><p>More on the valley</p>{_MENU}</aside>")[i // 4 % 2]
    return _SHELL % f"{before}{ad if inside is text else ''}<{tag} data-main>{inside}</{tag.split()[0]}>{side}<footer>{_ENDS[i % 5]}</footer>"


PAGES += [_advert_page(i) for i in range(44)]
# Fragments without the page around them.
PAGES += [f"<article data-main>{''.join(f'<p>{w}</p>' for w in _BITS[i : i + 1 + i % 3])}</article>" for i in range(len(_BITS))]
PAGES += [f"<nav>{_MENU}</nav><main data-main><h1>{_BITS[i]}</h1><p>{_BITS[i + 1]}</main><footer>{_BITS[i + 2]}</footer>" for i in range(0, 8, 2)]


def fit(pages: list[str], rounds: int = 250, rate: float = 0.4, ridge: float = 0.01) -> Weights:
    """Gradient ascent on the pages' log-likelihood: observed features less those expected under the marginals."""
    trees = [tree_of(*blocks_of(p)[:3]) for p in pages]
    trees = [t._replace(labels=[max(0, x) for x in t.labels]) for t in trees]
    own: dict[str, float] = {}
    pair: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        weights = Weights(own, {k: tuple(map(tuple, v.tolist())) for k, v in pair.items()})
        g_own: dict[str, float] = {}
        g_pair: dict[str, np.ndarray] = {}
        for t in trees:
            content, edges = marginals(t, weights)
            for i, (fs, y, p) in enumerate(zip(t.features, t.labels, content, strict=True)):
                for f in fs:
                    g_own[f] = g_own.get(f, 0.0) + y - p
                if i:
                    g = g_pair.setdefault(t.pairs[i], np.zeros((2, 2)))
                    g[t.labels[t.parents[i]], y] += 1
                    g -= np.array(edges[i]).reshape(2, 2)
        for f, g in g_own.items():
            own[f] = own.get(f, 0.0) + rate * (g / len(trees) - ridge * own.get(f, 0.0))
        for k, g in g_pair.items():
            pair[k] = pair.get(k, np.zeros((2, 2))) + rate * (g / len(trees) - ridge * pair.get(k, 0.0))
    return Weights(own, {k: tuple(map(tuple, v.tolist())) for k, v in pair.items()})


@lru_cache(maxsize=1)
def trained() -> Weights:
    return fit(PAGES)


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    blocks, own, linked, runs = blocks_of(page)
    content, _ = marginals(tree_of(blocks, own, linked), weights)
    return "\n".join(text for block, text in runs if text and content[block] >= 0.5)


def _extract(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("html")
            texts = [main_text(pages[i].as_py(), shared.value) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(_extract(shared), "page_id bigint, url string, text string, n_chars bigint")
