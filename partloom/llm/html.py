"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags. Each block becomes a vector of its tag path
(tags, classes, ids and roles, hashed), of its hashed words, and of a few measures such as length and link share. A
bidirectional LSTM in numpy reads the page's blocks in order, so that every block is judged with the whole document
around it; blocks labelled as content are the page's text. The network is trained here on generated pages.

Defined results: null, empty or markup-only pages give an empty text; text outside any tag is a block like any other;
tags never closed end with their parent or the page; an svg, iframe, select or the like that closes itself or is never
closed hides nothing; formulas stay in their
block; a block's path holds all its open elements, however deep; repeated rows give repeated results; other columns
are kept, but for one named as the result; pages are read whole.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lstm
from .common import prepare, without

PATH_SLOTS, WORD_SLOTS, EMBED, WORDS, HIDDEN = 8192, 512, 20, 8, 16
NUMBERS = 7
#: Of the sum over a path's slots.
PATH_SCALE = np.float32(0.25)
#: Pages read by the network at once.
BATCH = 128
CACHE = 400_000

# Inline elements, elements without content, elements whose content is not markup, elements that show nothing, and what a start tag closes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr br".split())
FORMULA = frozenset("math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp".split())
SILENT = frozenset("script style noscript iframe template svg annotation annotation-xml select datalist noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th tr body html article section div main aside nav header footer form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block:
    __slots__ = ("node", "text", "links")

    def __init__(self, node: int, text: str, links: int):
        self.node, self.text, self.links = node, text, links


class Leaves(list):
    """A page's blocks in order; nodes: of each block-level element that was open, the one around it (-1: none) and what its path holds for it."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, str]] = []

    def path(self, block: Block) -> tuple[str, ...]:
        out, at = [], block.node
        while at >= 0:
            at, label = self.nodes[at]
            out.append(label)
        return tuple(out[::-1])


def leaves(page: str | None) -> Leaves:
    """The page's blocks: the innermost open element, text with its white space made one space, letters in links."""
    page = page or ""
    out = Leaves()
    stack: list[tuple[str, int]] = []  # name, and the innermost node from it on
    counts: dict[str, int] = {}
    buffer: list[str] = []
    last: dict[str, int] = {}
    links = silent = at = 0

    def ends(name: str) -> int:
        """Where the last end tag of that name stands: an element without one hides nothing."""
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(f"</{name}", page, re.I)), default=-1)
        return last[name]

    def flush() -> None:
        nonlocal links
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append(Block(stack[-1][1] if stack else -1, text, links))
            buffer.clear()
        links = 0

    def push(name: str, label: str | None) -> None:
        nonlocal silent
        node = stack[-1][1] if stack else -1
        if label is not None:
            out.nodes.append((node, label))
            node = len(out.nodes) - 1
        stack.append((name, node))
        counts[name] = counts.get(name, 0) + 1
        silent += name in SILENT

    def pop_to(i: int) -> None:
        nonlocal silent
        for name, _ in stack[i:]:
            counts[name] -= 1
            silent -= name in SILENT
        del stack[i:]

    def close(names, scope=frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                pop_to(i)
                return
            if stack[i][0] in scope:
                return

    def say(piece: str) -> None:
        nonlocal links
        if piece and not silent:
            held = entities.unescape(piece) if "&" in piece else piece
            buffer.append(held)
            if counts.get("a"):
                links += len(held)

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending and silent:
            first = next(i for i, (x, _) in enumerate(stack) if x in SILENT)
            if any(x == name for x, _ in stack[first:]):
                close({name})
                continue
            if not counts.get(name):
                continue
            pop_to(first)  # never closed: it ends with its parent
        if ending:
            if name not in INLINE and name not in FORMULA and name not in SILENT:
                flush()
            if counts.get(name):
                close({name})
            continue
        if name in INLINE or name in FORMULA or name in SILENT and name not in RAW:
            if name == "br":
                buffer.append(" ")
            elif name not in VOID and not (attributes.endswith("/") and (name in SILENT or name in FORMULA)) and (name not in SILENT or ends(name) > at):
                push(name, None)
            continue
        if silent:  # nothing in it makes a block
            if name in RAW:
                at = end.start() if (end := _END[name].search(page, at)) else len(page) if name in ("script", "style") else at
            elif name not in VOID and not attributes.endswith("/"):
                push(name, None)
            continue
        flush()
        if name in CLOSES_P and counts.get("p"):
            close({"p"}, SCOPE - {"p"})
        if name in CLOSES_OWN and any(counts.get(x) for x in CLOSES_OWN[name]):
            close(CLOSES_OWN[name], frozenset({"ul", "ol", "dl", "table", "select"}))
        if name in VOID:
            continue
        label = name + "".join(f" {name}.{p.lower()} .{p.lower()}" for a in _NAMES.finditer(attributes) for p in _PARTS.findall(a[2] or a[3] or a[4] or ""))
        if name in RAW:
            end = _END[name].search(page, at)
            if end is None and name not in ("script", "style"):  # never closed: its content is markup like any other
                continue
            inside = page[at : end.start() if end else len(page)]
            at = end.start() if end else len(page)
            if name not in SILENT:
                push(name, label)
                say(inside)
                flush()
                pop_to(len(stack) - 1)
            continue
        push(name, label)
    say(page[at:])
    flush()
    return out


class _Slots(dict):
    """Text -> hashed slots, kept while there is room."""

    def __init__(self, slots: int, salt: bytes, split: bool):
        self.slots, self.salt, self.split = slots, salt, split

    def __missing__(self, key):
        if len(self) > CACHE:
            self.clear()
        parts = key.split() if self.split else [key]
        self[key] = found = [zlib.crc32(self.salt + x.encode()) % self.slots for x in parts]
        return found


_paths, _word_slots = _Slots(PATH_SLOTS, b"p", True), _Slots(WORD_SLOTS, b"w", False)


def _new_on_path(nodes: list[tuple[int, str]]) -> list[list[int]]:
    """Of each node the slots that none of the nodes around it has: what repeats along a path counts once."""
    out: list[list[int]] = []
    stack: list[int] = []
    there: set[int] = set()
    for i, (around, label) in enumerate(nodes):
        while stack and stack[-1] != around:  # nodes come in the order of their start tags
            there.difference_update(out[stack.pop()])
        own = [s for s in dict.fromkeys(_paths[label]) if s not in there]
        out.append(own)
        there.update(own)
        stack.append(i)
    return out


class Read:
    """A page for the network: of each node, the one around it and its slots; of each block, its node, word slots and measures."""

    def __init__(self, blocks: Leaves):
        self.around = np.array([n for n, _ in blocks.nodes], np.int64)
        self.slots = _new_on_path(blocks.nodes)
        self.depth = np.zeros(len(blocks.nodes), np.int64)
        for i, n in enumerate(self.around.tolist()):
            if n >= 0:
                self.depth[i] = self.depth[n] + 1
        self.node = np.array([b.node for b in blocks], np.int64)
        self.words, self.numbers = [], np.zeros((len(blocks), NUMBERS), np.float32)
        for i, b in enumerate(blocks):
            own = b.text.lower().split()
            self.words.append([_word_slots[w][0] for w in own])
            n = len(b.text)
            deep = self.depth[b.node] + 1 if b.node >= 0 else 0
            self.numbers[i] = (np.log1p(n) / 5, np.log1p(len(own)) / 4, min(1.0, b.links / n), b.text[-1] in ".!?:;\"”", i / (len(blocks) + 1), 1.0 if i == 0 else 0.0, min(int(deep), 12) / 10)

    def path_slots(self) -> list[list[int]]:
        """Of each block the slots of its whole path."""
        held: list[list[int]] = []
        for n, own in zip(self.around.tolist(), self.slots):
            held.append((held[n] if n >= 0 else []) + own)
        return [held[n] if n >= 0 else [0] for n in self.node.tolist()]


def _sums(slots: list[list[int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = np.array([s for x in slots for s in x], np.int64)
    n = np.array([len(x) for x in slots], np.int64)
    of = np.repeat(np.arange(len(slots)), n)
    if len(flat) > 200_000:  # a very long page: add up slot by slot
        out = np.zeros((len(slots), table.shape[1]), np.float32)
        np.add.at(out, of, table[flat])
    else:
        out = np.stack([np.bincount(of, table[flat, d], len(slots)) for d in range(table.shape[1])], 1) if len(flat) else np.zeros((len(slots), table.shape[1]))
    return out, n


def _means(slots: list[list[int]], table: np.ndarray) -> np.ndarray:
    out, n = _sums(slots, table)
    return (out / np.maximum(n, 1)[:, None]).astype(np.float32)


def _path_sums(pages: list[Read], table: np.ndarray) -> np.ndarray:
    """Sums over the distinct slots of whole paths, so that neutral wrappers add little and take nothing away.

    Sums go from each node to those within it: deep pages cost no more than their nodes.
    """
    starts = np.cumsum([0, *(len(r.around) for r in pages)])
    around = np.concatenate([np.where(r.around < 0, -1, r.around + s) for r, s in zip(pages, starts)])
    depth = np.concatenate([r.depth for r in pages])
    sums, _ = _sums([x for r in pages for x in r.slots], table)
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(ends, ends[1:]):  # one step for each depth
        at = order[a:b]
        sums[at] += sums[around[at]]
    node = np.concatenate([np.where(r.node < 0, -1, r.node + s) for r, s in zip(pages, starts)])
    out = np.tile(table[0].astype(np.float32), (len(node), 1))
    out[node >= 0] = sums[node[node >= 0]]
    return out * PATH_SCALE


def _vectors(p: dict, pages: list[Read]) -> np.ndarray:
    """Of all the pages' blocks, one after another."""
    return np.hstack([_path_sums(pages, p["paths"]), _means([x for r in pages for x in r.words], p["words"]), np.concatenate([r.numbers for r in pages])])


def _run(p: dict, vectors: list[np.ndarray], keep: bool = False):
    """Content scores of pages padded to one length, with what training needs."""
    steps = max(map(len, vectors))
    x, mask = np.zeros((steps, len(vectors), EMBED + WORDS + NUMBERS), np.float32), np.zeros((steps, len(vectors)), np.float32)
    for j, v in enumerate(vectors):
        x[: len(v), j], mask[: len(v), j] = v, 1
    states, held = lstm.both_ways({k: v for k, v in p.items() if k[:2] in ("f_", "r_")}, (x @ p["f_x"], x @ p["r_x"]), mask, keep)
    return states @ p["out"] + x @ p["skip"] + p["bias"], x, mask, states, held


# ---- generated pages for training ----

# Boilerplate words, and the names that page parts go by.
CHROME = "home about contact login register subscribe newsletter copyright rights reserved privacy policy terms cookies accept close menu search share tweet comment comments reply posted advertisement sponsored related popular latest news archive categories tags next previous sign up follow us email address submit your name click here read more all view cart help faq sitemap by on this site uses we use".split()
BAD_NAMES = {
    "nav": "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs pagination pager tabs site-nav toc".split(),
    "header": "header site-header masthead topbar banner branding logo page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot".split(),
    "aside": "sidebar side aside related related-posts popular widget widgets recommended more-stories trending right-column left-column".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad ad-slot dfp".split(),
    "notice": "notice cookie cookie-notice consent gdpr alert message popup modal overlay disclaimer cookie-banner warning".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form".split(),
    "comments": "comments comment comment-list replies responses discussion disqus reader-comments user-comments thread".split(),
    "share": "share social social-links sharing share-buttons author-bio byline-links tags tag-list meta-links".split(),
}
NEUTRAL_NAMES = "wrap wrapper container inner outer row col column grid box layout page site section block group cell region flex area holder root app".split()
GOOD_NAMES = "content article post entry story main body text article-body post-content entry-content main-content page-content blog-post single prose".split()


def example(seeds: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is content."""
    rng = random.Random(int(seeds.integers(2**62)))
    any_of, between = rng.choice, rng.randrange
    pick = lambda *x: rng.choice(x)
    chance = lambda p: rng.random() < p
    syllables = "an er the on in re ti es or ly wh ou nd st qu ai eau ment en sch ung keit lich ción ado mente los der et de la".split()
    made: list[str] = []
    marks: list[bool] = []

    def word() -> str:
        return "".join(rng.choices(syllables, k=between(1, 5)))

    def words(lo: int, hi: int, chrome: float = 0.0) -> str:
        return " ".join(any_of(CHROME) if chance(chrome) else word() + pick("", "", "", "", ",", ".", "&amp;", "%%%") for _ in range(between(lo, hi))).capitalize()

    def sentence(lo: int = 3, hi: int = 40) -> str:
        return words(lo, hi) + pick(".", ".", ".", "")

    def block(tag: str, text: str, good: bool, attrs: str = "", end: bool = True) -> None:
        made.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if end else ""))
        marks.append(good)

    def opened(tag: str, names: list[str] | None, p: float = 0.8) -> str:
        attrs = f' {pick("class", "class", "id")}="{any_of(names)}{pick("", "", " box", " wrap-1")}"' if names and chance(p) else ""
        made.append(f"<{tag}{attrs}>")
        return tag

    def closed(tag: str) -> None:
        made.append(f"</{tag}>")

    def wrapped() -> list[str]:
        """Elements that say nothing, mostly none or a few, one in another: plain, neutrally named, or named by chance."""
        n = pick(0, 0, 0, 1, 1, 2, 3, between(3, 13))
        out = []
        for _ in range(n):
            name = any_of([None, any_of(NEUTRAL_NAMES), any_of(NEUTRAL_NAMES), any_of(NEUTRAL_NAMES) + "-" + any_of(NEUTRAL_NAMES), word() + word()])
            out.append(opened(pick("div", "div", "div", "div", "section"), [name] if name else None, 1.0))
        return out

    def unwrapped(tags: list[str]) -> None:
        for tag in reversed(tags):
            closed(tag)

    def list_of_links(n: int) -> None:
        made.append("<ul>")
        for _ in range(n):
            text = words(1, 4, 0.4)
            block("li", f'<a href="/{word()}">{text}</a>' if chance(0.85) else text, False)
        made.append("</ul>")

    def clutter(kind: str) -> None:
        around = wrapped() if chance(0.3) else []
        bare = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        semantic = bare is not None and chance(0.65)
        tag = opened(bare if semantic else pick("div", "section", "div"), BAD_NAMES[kind], 0.4 if semantic else 1.0)
        chrome = pick(0.0, 0.2, 0.6)
        within = wrapped() if chance(0.3) else []
        if kind == "nav":
            list_of_links(between(2, 8))
        elif kind == "comments":
            if chance(0.6):
                block(pick("h2", "h3"), words(1, 4, 0.6), False)
            for _ in range(between(1, 5)):
                inner = opened(pick("div", "li", "article"), ["comment", "reply", "comment-body"], 0.8)
                if chance(0.5):
                    block("div", words(1, 3), False, ' class="author"')
                for _ in range(between(1, 3)):
                    block("p", sentence(3, 40), False)
                closed(inner)
        elif kind == "form":
            for _ in range(between(1, 3)):
                block(pick("p", "button", "div", "legend"), words(1, 5, 0.6), False)
            made.append('<input type="text">')
        elif kind == "aside":
            if chance(0.6):
                block(pick("h2", "h3", "h4"), words(1, 4, 0.4), False)
            if chance(0.5):
                list_of_links(between(2, 6))
            else:
                for _ in range(between(1, 4)):
                    block("p", sentence(3, 25), False)
        elif chance(0.5):
            made.append(("&copy; " if kind == "footer" else "") + words(2, 20, chrome))
            marks.append(False)
        else:
            for _ in range(between(1, 4)):
                block(pick("p", "div", "p"), words(2, 25, chrome) if chance(0.6) else sentence(3, 25), False)
        unwrapped(within)
        closed(tag)
        unwrapped(around)

    made.append("<!DOCTYPE html><html><head>")
    if chance(0.9):
        block("title", words(2, 10), False)
    made.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    site = wrapped()
    if chance(0.25):
        clutter("notice")
    for kind in ("header", "nav", "ad", "notice", "form"):
        if chance(0.35 if kind not in ("nav", "ad") else 0.55):
            clutter(kind)
    outer = opened(pick("div", "main", "section"), ["page", "container", "wrapper", "main", "layout"], 0.8) if chance(0.5) else None
    if outer and chance(0.25):
        clutter(pick("aside", "nav", "ad"))
    around = wrapped()
    body = opened(pick("article", "article", "article", "main", "div"), GOOD_NAMES, 0.5) if chance(0.75) else opened("div", GOOD_NAMES, 1.0)
    inner = opened(pick("div", "section"), GOOD_NAMES, 1.0) if chance(0.25) else None
    if chance(0.85):
        block(pick("h1", "h1", "h2"), sentence(2, 14), True)
    within = wrapped()
    for _ in range(pick(0, 1, 2, 3, 4, 6, 9, 14, 25)):
        r = rng.random()
        if chance(0.05):  # wrappers end and others begin amid the article
            unwrapped(within)
            within = wrapped()
        if r < 0.6:
            block("p", sentence(1, 60), True, end=chance(0.9))
        elif r < 0.7:
            block("p", f"<b>{sentence(1, 14)}<br>", True, end=False)
        elif r < 0.77:
            block(pick("h2", "h3"), sentence(1, 8), True)
        elif r < 0.83:
            made.append(tag := pick("<ul>", "<ol>"))
            for _ in range(between(1, 5)):
                block("li", sentence(1, 15), True)
            made.append(tag.replace("<", "</"))
        elif r < 0.88:
            made.append("<blockquote>")
            block("p", sentence(3, 30), True)
            made.append("</blockquote>")
        elif r < 0.91:
            block("pre", words(2, 15), True)
        elif r < 0.94:
            made.append("<table><tr>")
            block("td", words(1, 4), True)
            block("td", words(1, 4), True)
            made.append("</tr></table>")
        elif r < 0.97:
            block("p", f'{words(2, 10)} <a href="#">{words(1, 4)}</a> {sentence(2, 10)}', True)
        else:
            clutter(pick("ad", "share", "notice", "aside", "form"))
    unwrapped(within)
    if chance(0.15):
        clutter("comments")
    if inner:
        closed(inner)
    if chance(0.15):
        clutter(pick("share", "aside", "comments", "form"))
    closed(body)
    unwrapped(around)
    for kind in ("comments", "aside", "ad", "share", "form", "footer", "notice"):
        if chance(0.3 if kind != "footer" else 0.75):
            clutter(kind)
    if outer:
        closed(outer)
    if chance(0.3):
        clutter("footer")
    unwrapped(site)
    if chance(0.7):
        made.append("</body></html>")
    return "".join(made), marks


@functools.lru_cache(2)
def trained(pages: int = 2500, epochs: int = 7, seed: int = 12) -> dict[str, np.ndarray]:
    """The labeller's parameters, fitted on so many generated pages; deterministic."""
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, marks = example(rng)
        blocks = leaves(page)
        if len(blocks) == len(marks):  # an empty block that was generated is not a leaf
            data.append((Read(blocks), np.array(marks, np.float32)))
    width = EMBED + WORDS + NUMBERS
    p = {f"f_{n}": v for n, v in lstm.init(rng, width, HIDDEN).items()} | {f"r_{n}": v for n, v in lstm.init(rng, width, HIDDEN).items()}
    p |= {"paths": rng.normal(0, 0.3, (PATH_SLOTS, EMBED)), "words": rng.normal(0, 0.3, (WORD_SLOTS, WORDS)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "skip": np.zeros(width), "bias": np.zeros(1)}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    adam = lstm.Adam()
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(data))
        for i in range(0, len(order), 32):
            part = [data[j] for j in order[i : i + 32]]
            ends = np.cumsum([len(m) for _, m in part])[:-1]
            z, x, mask, states, held = _run(p, np.split(_vectors(p, [r for r, _ in part]), ends), keep=True)
            y = np.zeros_like(mask)
            for j, (_, marks) in enumerate(part):
                y[: len(marks), j] = marks
            d = ((lstm._sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
            grads, in_f, in_r = lstm.both_back(held, d[:, :, None] * p["out"])
            dx = in_f @ p["f_x"].T + in_r @ p["r_x"].T + d[:, :, None] * p["skip"]
            flat = x.reshape(-1, width)
            grads |= {"f_x": flat.T @ in_f.reshape(-1, 4 * HIDDEN), "r_x": flat.T @ in_r.reshape(-1, 4 * HIDDEN), "out": np.tensordot(states, d, ((0, 1), (0, 1))), "skip": flat.T @ d.ravel(), "bias": d.sum()[None]}
            flat_d = np.concatenate([dx[: len(m), j] for j, (_, m) in enumerate(part)])
            for name, slots, cut in (("paths", [q for r, _ in part for q in r.path_slots()], slice(0, EMBED)), ("words", [q for r, _ in part for q in r.words], slice(EMBED, EMBED + WORDS))):
                n = np.array([len(q) for q in slots])
                share = np.full(len(n), PATH_SCALE) if name == "paths" else 1 / np.maximum(n, 1)
                at, size = np.array([v for q in slots for v in q], np.int64), len(p[name])
                given = np.repeat(flat_d[:, cut] * share[:, None], n, axis=0)
                grads[name] = np.stack([np.bincount(at, given[:, d], size) for d in range(given.shape[1])], 1).astype(np.float32)
            adam.step(p, grads)
    return p


def extract(pages: list[str | None], p: dict) -> list[str]:
    """The main text of each page: its content blocks, joined by an empty line."""
    found = [leaves(x) for x in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        part = order[at : at + max(1, min(BATCH, 20_000 // len(found[order[min(at + BATCH, len(order)) - 1]])))]
        at += len(part)
        ends = np.cumsum([len(found[i]) for i in part])[:-1]
        vectors = np.split(_vectors(p, [Read(found[i]) for i in part]), ends)
        z = _run(p, vectors)[0]
        for j, i in enumerate(part):
            out[i] = "\n\n".join(b.text for b, s in zip(found[i], z[:, j]) if s > 0)
    return out


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each page's html in `out` (a column of that name is replaced)."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(trained())  # some 150 kB

    @F.arrow_udf(T.StringType())
    def text(rows: pa.Array) -> pa.Array:
        return pa.array(extract(rows.to_pylist(), shared.value), type=pa.string())

    made = text(F.col(html))
    return pages.withColumn(out, made) if out == html else without(pages, out).withColumn(out, made)
