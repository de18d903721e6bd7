"""Main-text extraction: boosted trees over DOM nodes and hierarchical decoding.

1. ``parse`` builds a tree of elements from tag soup: scripts, styles, comments, markup, form controls with their labels and elements hidden by their
   attribute or inline style (display or visibility) go, optional end tags (of the head, too) are implied, a tag cut off at the end of the page is dropped.
   A page is scanned once from left to right and each element opened and closed once, so broken pages cost no more than others.
2. ``node_features``: depth, subtree text, link and tag density, punctuation, attribute tokens, the element's kind, and
   how it compares with its siblings, its parent and the page.
3. Gradient-boosted trees give each node the chance of being inside the article. ``pages`` carry no labels, so the
   trees are fitted on pages that ``sample_page`` makes up: random layouts of articles among menus, headers, sidebars,
   notices, adverts, forms and reader comments, with random element names, class names and words.
4. ``decode`` finds the most likely consistent reading of the whole tree: a node is around the article, inside it or
   noise; children of noise are noise, children of article nodes are article or noise. No child can contradict its parent.
5. The text of article nodes, one line a block, character references decoded, white space runs made one space.

Defined cases: null or empty html, or a page without text: empty text, 0 characters; plain text without tags is one
article; pages are read whole; repeated rows and null ids are handled row by row; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.llm.boosting import Boosted, boost
from tallyloom.llm.common import tidy

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("script style noscript template title iframe textarea head canvas audio video button select option datalist label".split())
#: What may stand in a head; any other element or text ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
RAW = frozenset("script style title textarea iframe noscript".split())
RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in RAW}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
GOOD = frozenset("article content post entry body main text story page blog hentry prose paragraph read".split())
BAD = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar menu sidebar side aside footer header head top bottom breadcrumb crumbs comment comments"
    " reply disqus cookie consent notice alert popup modal overlay related more recommended share social follow widget tag tags subscribe newsletter signup login search"
    " form pagination pager meta byline copyright legal toolbar links".split()
)
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|([!?]|/(?=[^>])))")
#: One attribute, or what ends the tag. Possessive: a page is read once, whatever it holds.
ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
SPACE = re.compile(r"\s+")
PUNCT = re.compile(r"[.,;:!?]")
TOKENS = re.compile(r"[a-z]+")
LEADING_ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:visibility\s*:\s*hidden|display\s*:\s*none)\b", re.I)


class Node:
    __slots__ = ("tag", "names", "parent", "items", "truth", "chars", "linked", "tags", "marks", "words", "paragraphs", "state", "hidden")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, truth: str = ""):
        self.tag, self.names, self.parent, self.truth = tag, names, parent, truth
        self.items: list = []
        self.hidden = False
        self.chars = self.linked = self.tags = self.marks = self.words = self.paragraphs = self.state = 0


def attributes(page: str, at: int) -> tuple[int, dict[str, str], bool]:
    """(where the tag ends, its attributes, whether it closes itself), from the end of the tag's name; -1 if the page ends first.

    Quotes count only right after an equals sign; a quoted value that nothing closes ends where an unquoted one would.
    """
    out: dict[str, str] = {}
    while True:
        m = ATTR.match(page, at)
        if m is None:
            return -1, out, False
        if m[1]:
            return m.end(), out, page[m.end() - 2] == "/"
        value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5]
        out.setdefault(m[2].lower(), value or "")
        at = m.end()


CONTAINERS = ("ul", "ol", "dl", "table", "tbody", "select")


def parse(page: str) -> Node:
    root = Node("html", (), None)
    stack, at, n = [root], 0, len(page)
    depths: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
    blocks: list[int] = []  # and of all open blocks

    def close(depth: int) -> None:
        """End the element at this place of the stack and all inside it; each element is ended once."""
        while len(stack) > depth:
            gone = stack.pop()
            depths[gone.tag].pop()
            if gone.tag in BLOCK:
                blocks.pop()

    def place(tag: str) -> int:
        known = depths.get(tag)
        return known[-1] if known else -1

    def text(start: int, end: int) -> None:
        if end > start:
            if stack[-1].tag == "head" and not page[start:end].isspace():
                close(len(stack) - 1)
            stack[-1].items.append(page[start:end])

    while at < n:
        m = OPEN.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        if m[3]:
            end = page.find("-->", m.start() + 4) if page[m.end() : m.end() + 1] != ">" else m.end() - 2
            at = end + 3 if end >= 0 else n
            continue
        if m[4]:
            end = page.find(">", m.end())
            at = end + 1 if end >= 0 else n
            continue
        tag = m[2].lower()
        at, attrs, closed = attributes(page, m.end())
        if at < 0:  # a tag cut off at the end of the page
            break
        if m[1]:
            if (depth := place(tag)) >= 0:
                close(depth)
            continue
        if tag not in IN_HEAD and tag != "html" and (depth := place("head")) > place("template"):  # the head's end tag is optional
            close(depth)
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK and blocks and stack[blocks[-1]].tag == "p":  # a block ends an open paragraph, up to the nearest other block
            close(blocks[-1])
        if tag in CLOSES:
            depth = max(map(place, CLOSES[tag]))
            if depth > max(map(place, CONTAINERS)):
                close(depth)
        names, truth, hidden = (), "", False
        if attrs:
            names = tuple(TOKENS.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower()))
            truth = attrs.get("data-truth", "")
            hidden = "hidden" in attrs or HIDDEN_STYLE.search(attrs.get("style", "")) is not None
        node = Node(tag, names, stack[-1], truth)
        node.hidden = hidden
        stack[-1].items.append(node)
        if tag not in VOID and not closed:
            depths.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    return root


def nodes_of(root: Node) -> list[Node]:
    """Elements outside dropped ones, parents before children, with their subtree sums."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node) and x.tag not in DROPPED and not x.hidden)
    for node in order:
        for x in node.items:
            if isinstance(x, str):
                s = x.strip()
                node.chars += len(s)
                node.words += s.count(" ") + 1 if s else 0
                node.marks += len(PUNCT.findall(s))
        node.linked = node.chars if node.tag == "a" else 0
        node.tags, node.paragraphs = 1, int(node.tag == "p")
    for node in reversed(order):
        if (p := node.parent) is not None:
            p.chars += node.chars
            p.words += node.words
            p.marks += node.marks
            p.linked += node.chars if node.tag == "a" else node.linked
            p.tags += node.tags
            p.paragraphs += node.paragraphs
    return order


KINDS = [
    ("article", "main"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dd", "dt"),
    ("table", "tbody", "tr", "td", "th"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "input", "button", "select", "label", "fieldset"),
    ("div",), ("section",), ("figure", "figcaption"),
]
KIND = {t: i for i, ts in enumerate(KINDS) for t in ts}


def node_features(blocks: list[Node]) -> np.ndarray:
    """A row a block-level node; parents come before children."""
    total = max(1, blocks[0].chars)
    depth: dict[int, int] = {}
    good: dict[int, int] = {}
    bad: dict[int, int] = {}
    kin: dict[int, list[Node]] = {}
    seen: dict[int, int] = {}
    for b in blocks:
        kin.setdefault(id(b.parent), []).append(b)
    largest = {k: max(x.chars for x in peers) for k, peers in kin.items()}
    alike = {k: Counter(x.tag for x in peers) for k, peers in kin.items()}
    rows = []
    for b in blocks:
        p = b.parent
        depth[id(b)] = depth.get(id(p), 0) + 1
        g, w = sum(t in GOOD for t in b.names), sum(t in BAD for t in b.names)
        good[id(b)], bad[id(b)] = good.get(id(p), 0) + g, bad.get(id(p), 0) + w + (b.tag in ("nav", "footer", "aside", "form"))
        peers = kin[id(p)]
        i = seen[id(p)] = seen.get(id(p), -1) + 1
        chars = max(1, b.chars)
        most = largest[id(p)]
        kind = [0.0] * len(KINDS)
        if b.tag in KIND:
            kind[KIND[b.tag]] = 1.0
        rows.append([
            depth[id(b)], np.log1p(b.chars), b.chars / total, b.linked / chars, b.tags / chars, b.marks / max(1, b.words), b.chars / max(1, b.words),
            np.log1p(b.words), np.log1p(b.paragraphs), np.log1p(b.tags), g, w, good[id(b)], bad[id(b)], i / max(1, len(peers) - 1), np.log1p(len(peers)),
            alike[id(p)][b.tag] / len(peers), b.chars / max(1, most), b.chars / max(1, p.chars if p else b.chars),
            KIND.get(p.tag, -1) if p else -1, *kind,
        ])
    return np.array(rows, np.float64)


def _blocks(order: list[Node]) -> list[Node]:
    """Block-level nodes that hold text; each one's parent link then skips inline elements."""
    block_of: dict[int, Node | None] = {}
    keep = []
    for i, n in enumerate(order):
        above = block_of[id(n.parent)] if n.parent is not None else None
        if block := n.tag in BLOCK or i == 0:
            n.parent = above
            if n.chars > 0:
                keep.append(n)
        block_of[id(n)] = n if block else above
    return keep


ENTER = -0.3  # log odds against an article starting at a node
AROUND, INSIDE, NOISE = 0, 1, 2


def decode(blocks: list[Node], chance: np.ndarray) -> None:
    """Sets every node's state to that of the best consistent reading (max-sum over the tree)."""
    number = {id(b): i for i, b in enumerate(blocks)}
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    parent = [number.get(id(b.parent), -1) for b in blocks]
    sums = np.zeros((len(blocks), 3))  # what the children add for each state of the node
    best = np.zeros((len(blocks), 3))
    for i in range(len(blocks) - 1, -1, -1):
        best[i] = (no[i] + sums[i, AROUND], yes[i] + sums[i, INSIDE], no[i] + sums[i, NOISE])
        if (q := parent[i]) >= 0:
            sums[q, AROUND] += max(best[i, AROUND], best[i, INSIDE] + ENTER)
            sums[q, INSIDE] += max(best[i, INSIDE], best[i, NOISE])
            sums[q, NOISE] += best[i, NOISE]
    for i, b in enumerate(blocks):
        above = AROUND if parent[i] < 0 else blocks[parent[i]].state
        if above == AROUND:
            b.state = INSIDE if best[i, INSIDE] + ENTER > best[i, AROUND] else AROUND
        else:
            b.state = INSIDE if above == INSIDE and best[i, INSIDE] >= best[i, NOISE] else NOISE


def decoded(text: str) -> str:
    """Character references as characters; a number beyond all characters is the replacement character, however long."""
    if "&#" in text:
        text = LONG_REFERENCE.sub("\ufffd", LEADING_ZEROS.sub(r"\1", text))
    return entities.unescape(text)


def article(root: Node) -> str:
    """The text of INSIDE nodes in page order, a line a block."""
    lines: list[str] = []
    part: list[str] = []

    def flush() -> None:
        line = SPACE.sub(" ", decoded("".join(part))).strip()
        part.clear()
        if line:
            lines.append(line)

    todo: list = [(root, root.state == INSIDE)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        x, inside = item
        if isinstance(x, str):
            if inside:
                part.append(x)
            continue
        if x.tag in DROPPED or x.hidden:
            continue
        if x.tag == "br":
            part.append(" ")
            continue
        block = x.tag in BLOCK
        if block:
            flush()
            inside = x.state == INSIDE
            todo.append(None)
        todo.extend((y, inside) for y in reversed(x.items))
    flush()
    return "\n".join(lines)


def sample_page(rnd: random.Random) -> str:
    """A made-up page; data-truth="1" marks article nodes, and "0" what is inside an article but not of it."""
    syllables = ["en", "th", "ra", "lo", "qu", "er", "ti", "on", "mi", "sa", "che", "ung", "ción", "eau", "st", "in", "or", "ble"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    text = lambda a, b: ". ".join(words(3, 14).capitalize() + rnd.choice(["", "", ", " + words(2, 8)]) for _ in range(rnd.randint(a, b))) + "."
    pick = rnd.choice
    t = lambda: ' data-truth="1"'

    def named(tag: str, options: list[str], inner: str, extra: str = "") -> str:
        name = pick(options) if options and rnd.random() < 0.75 else ""
        attr = f' {pick(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attr}{extra}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rnd.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rnd.random() < 0.7 else pick([" | ", " ", ""]).join(items)

    menu = lambda: named(pick(["nav", "nav", "div"]), ["nav", "menu", "navbar", "top-menu", "breadcrumb", "links"], links(2, 9))
    advert = lambda: named("div", ["ad", "ads", "advert", "banner", "promo-box", "sponsored"], pick([text(1, 2), f"<p>{text(1, 2)}</p>", f"<a href=x>{words(3, 9)}</a>"]))
    notice = lambda: named(pick(["div", "div", "dialog"]), ["cookie-notice", "consent", "alert", "notice", "popup"], f"<p>{text(1, 3)}</p><button>{word()}</button>")
    form = lambda: f"<form>{words(1, 4)}<input name=q><label>{words(1, 2)}</label><button>{word()}</button></form>"
    foot = lambda: named(pick(["footer", "footer", "div"]), ["footer", "bottom", "copyright", "legal"], pick(["", "<p>"]) + f"&copy; {word()}.example &middot; {text(1, 2)}" + pick(["", links(2, 5)]))
    aside = lambda: named(pick(["aside", "div"]), ["sidebar", "side", "related", "widget", "recommended"], f"<h3>{words(1, 4)}</h3>" + links(3, 8) + pick(["", f"<p>{text(1, 2)}</p>"]))
    remarks = lambda: named(pick(["section", "div"]), ["comments", "comment-list", "disqus", "replies"], f"<h3>{words(1, 2)}</h3>" + "".join(named("div", ["comment", "reply"], f"<p>{text(1, 4)}</p>") for _ in range(rnd.randint(1, 6))))
    share = lambda: named("div", ["share", "social", "tags", "byline", "meta"], pick([links(2, 4), words(2, 5)]))

    def passage() -> str:
        r = rnd.random()
        if r < 0.75:
            inner = text(1, 9)
            if rnd.random() < 0.2:
                inner += f' <a href="/x">{words(1, 3)}</a> {text(1, 2)}'
            if rnd.random() < 0.2:
                inner = f"<b>{inner}" + pick(["</b>", "<br>", ""])
            if rnd.random() < 0.05:  # a block ends the paragraph, and the text after it is the article's own
                inner += f"<div{t()}>{text(1, 2)}</div>{words(1, 9)}"
            return f"<p{t()}>{inner}" + pick(["</p>", "</p>", ""])
        if r < 0.83:
            return f"<h2{t()}>{words(2, 7)}</h2>"
        if r < 0.9:
            return f"<ul{t()}>" + "".join(f"<li{t()}>{text(1, 2)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
        if r < 0.95:
            return f"<blockquote{t()}><p{t()}>{text(1, 4)}</p></blockquote>"
        return f"<table{t()}>" + "".join(f"<tr{t()}><td{t()}>{words(1, 4)}</td><td{t()}>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"

    parts = [f"<h1{t()}>{words(2, 9)}</h1>"] if rnd.random() < 0.85 else []
    for _ in range(pick([1, 1, 2, 3, 4, 6, 9])):
        parts.append(passage())
        if rnd.random() < 0.12:
            parts.append(pick([advert, share, aside, form, notice])())
    if rnd.random() < 0.1:
        parts = parts[:1]
    if rnd.random() < 0.15:
        parts.append(pick([remarks, share])())
    bare = rnd.random() < 0.12
    tag = pick(["article", "article", "article", "main", "div", "div", "section"])
    names = ["content", "post", "entry", "article-body", "story", "text", "main"]
    whole = "".join(parts) if bare else named(tag, [] if tag in ("article", "main") else names, "".join(parts), t())
    if rnd.random() < 0.3:
        whole = named("div", ["wrapper", "page", "container", "row", "main"], whole + pick(["", remarks(), aside()]))
    before = [f() for f in (menu, advert, notice, form, aside) if rnd.random() < 0.45]
    if rnd.random() < 0.4:
        before.insert(0, named("header", ["header", "top", "masthead"], f"<h2>{words(1, 3)}</h2>" + menu()))
    after = [f() for f in (remarks, aside, advert, share, notice) if rnd.random() < 0.3] + ([foot()] if rnd.random() < 0.85 else [])
    rnd.shuffle(before)
    return "<html><head><title>x</title></head><body>" + "".join([*before, whole, *after]) + "</body></html>"


def _truth(blocks: list[Node]) -> np.ndarray:
    return np.array([float(b.truth == "1") for b in blocks])


@lru_cache(2)
def model(pages: int = 1500, seed: int = 23) -> Boosted:
    rnd, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        blocks = _blocks(nodes_of(parse(sample_page(rnd))))
        xs.append(node_features(blocks))
        ys.append(_truth(blocks))
    return boost(np.vstack(xs), np.concatenate(ys), trees=80, depth=4)


def extract(pages: list[str | None], trees: Boosted) -> list[str]:
    roots = [parse(p) if p else None for p in pages]
    held = [(_blocks(nodes_of(r)) if r is not None else []) for r in roots]
    held = [b if b and b[0].chars else [] for b in held]
    rows = [node_features(b) for b in held if b]
    chance = trees.chance(np.vstack(rows)) if rows else np.empty(0)
    at, out = 0, []
    for root, blocks in zip(roots, held):
        if not blocks:
            out.append("")
            continue
        if len(blocks) == 1:  # bare text
            blocks[0].state = INSIDE
        else:
            decode(blocks, chance[at : at + len(blocks)])
        at += len(blocks)
        out.append(article(root))
    return out


def main_text(pages: DataFrame, chunk: int = 200) -> DataFrame:
    """page_id, url, text, n_chars of each row; the trees are fitted once and sent to the tasks (a few kB)."""
    trees = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            html, texts = [h if isinstance(h, str) else None for h in pdf["html"]], []
            for i in range(0, len(html), chunk):
                texts += extract(html[i : i + chunk], trees)
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(tidy(run), "page_id long, url string, text string, n_chars long")
