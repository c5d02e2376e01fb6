"""Main text of web pages by composite text density.

A page becomes a tree of block elements; inline markup is transparent but counted. For every block
that a reader sees, menus and adverts included, the density is characters per tag, damped by its
share of link text against the body's; a block's density sum is that of its children. The block with
the greatest sum is the heart of the page, and the least density on its path to the body is the
threshold: other blocks that reach it, and whose greatest subtree has a sum of a comparable size, belong
to the article as well, which is the lowest block that holds them all. A heading before it is part of it.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out by element, role
and class name, and blocks that are mostly a list of links; such blocks can't be the heart either (comments
may be denser than the article). A class name counts only if all its words say so: `has-sidebar` and
`page-header-fixed` don't. No name empties an article: a named block stays if it holds most of the text and either
the page's main heading or next to all that is read, and where nothing is left of a page with text enough for an article,
names are passed over and density alone decides. Scripts, styles and hidden elements are never read.

Null or empty html, and pages without text, give an empty text. Unclosed, crossing and cut-off
markup is read as far as it goes. Depth is bounded by an explicit stack, so any nesting is read.
Rows are judged one by one: very long pages, repeated rows, ties (the first block wins) and empty
tables are plain cases. Columns named text or n_chars in the input are replaced, all others kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathom.llm.common import ready

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video xmp noembed noframes select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Another block belongs to the article if its greatest density sum is at least this share of the heart's.
COMPARABLE = 0.25
#: A start tag in the key closes an open tag in the value, up to its list or table.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol menu dl table body article section div main".split())

# Elements, roles and words of class names that aren't part of an article, and words that say nothing by themselves.
ASIDE = frozenset("nav header footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer sidebar side aside widget related recommended recommendations share sharing social skip hidden toc".split()
)
PLAIN = frozenset("site page main global top bottom left right primary secondary box bar block area section wrapper wrap container list links link item items row inner outer content post posts article articles entry form buttons button icons thread reader user dialog region".split())
#: A named block stays if it holds more than half of the text and what lies outside is less than this share of it.
NEXT_TO_NOTHING = 0.1
#: A page whose only text is a named block of fewer characters has no article.
LEAST_ARTICLE = 100
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W_]", re.ASCII)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))")


class Block:
    __slots__ = ("tag", "parent", "kids", "chars", "links", "tags", "link_tags", "total", "density", "inline", "named", "talk", "gone", "unseen")

    def __init__(self, tag: str, parent: "Block | None", named: bool = False, talk: bool = False, unseen: bool = False):
        self.tag, self.parent, self.kids, self.inline = tag, parent, [], {}
        self.named, self.talk, self.gone, self.unseen = named, talk, False, unseen
        self.chars = self.links = self.tags = self.link_tags = 0
        self.total = self.density = 0.0


def named(value: str) -> bool:
    """Whether one of the names in a class or id is made of NAMES and PLAIN words only, with one of NAMES."""
    return any(w & NAMES and w <= NAMES | PLAIN for w in ({x.lower() for x in _WORDS.findall(name)} for name in value.split()))


def unwanted(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """Whether an element isn't part of an article, whether it holds reader comments, and whether it isn't shown at all."""
    if tag == "head":
        return True, False, True
    aside, talk = tag in ASIDE, False
    if not raw or "=" not in raw:
        return aside, talk, raw != "" and re.search(r"(?:^|\s)hidden(?:\s|$)", raw) is not None
    for name, *values in _ATTR.findall(raw):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, True
        if name == "role" and value.lower() in ROLES:
            aside = True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and named(value):
            aside = True
            talk = talk or any(w.lower() in COMMENTS for w in _WORDS.findall(value))
    return aside, talk, False


def parse(page: str) -> Block:
    """The tree; a block's kids are blocks and (text, is link) runs in page order.

    Every tag is read in constant time on average: open blocks are counted by name, once for the page and once
    since the last block that ends the search for an open list item, cell or paragraph.
    """
    root = Block("#root", None)
    stack, scopes, opened, links, pos, end = [root], [{}], {}, 0, 0, len(page)

    def say(text: str) -> None:
        if text:
            stack[-1].kids.append((text, links > 0))

    def push(block: Block) -> None:
        stack[-1].kids.append(block)
        stack.append(block)
        opened[block.tag] = opened.get(block.tag, 0) + 1
        scopes[-1][block.tag] = scopes[-1].get(block.tag, 0) + 1
        if block.tag in SCOPE:
            scopes.append({})

    def pop() -> str:
        nonlocal links
        block = stack.pop()
        if block.tag in SCOPE:
            scopes.pop()
        scopes[-1][block.tag] -= 1
        opened[block.tag] -= 1
        links -= block.inline.get("a", 0) + (block.tag == "a")
        return block.tag

    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag, at = m[2].lower(), stack[-1]
        if m[1]:
            if tag in INLINE:
                if at.inline.get(tag):
                    at.inline[tag] -= 1
                    links -= tag == "a"
                elif at.tag == tag:
                    pop()
            elif opened.get(tag):
                while pop() != tag:
                    pass
            elif tag == "p":
                say(" ")
            continue
        if tag in RAW:
            if not m[0].endswith("/>") or tag in ("script", "style", "textarea", "title"):
                close = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, pos)
                pos = close.end() if close else end
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            say(" " if tag == "br" else "")
            at.tags += 1
            continue
        if tag in INLINE:
            at.tags += 1
            block = Block(tag, at, *unwanted(tag, m[3]))
            if tag == "a":
                links += 1
                at.link_tags += 1
            if not (block.named or block.unseen):
                at.inline[tag] = at.inline.get(tag, 0) + 1
                continue
            push(block)
            continue
        closing = ("p",) if tag in CLOSES_P else SAME.get(tag, ())
        if any(scopes[-1].get(c) for c in closing):
            while pop() not in closing:
                pass
        if tag in VOID:
            stack[-1].tags += 1
            continue
        push(Block(tag, stack[-1], *unwanted(tag, m[3])))
    return root


def blocks_of(root: Block) -> list[Block]:
    """Blocks that a reader sees, parents first."""
    out, stack = [], [root]
    while stack:
        b = stack.pop()
        if not b.unseen:
            out.append(b)
            stack += [k for k in reversed(b.kids) if type(k) is Block]
    return out


def weigh(order: list[Block]) -> None:
    """Characters, tags, link-adjusted densities and density sums of all blocks."""
    for b in reversed(order):
        b.tags += 1
        for k in b.kids:
            if type(k) is Block:
                if not k.unseen:
                    b.chars += k.chars
                    b.links += k.links
                    b.tags += k.tags
                    b.link_tags += k.link_tags
            else:
                n = len("".join(k[0].split()))
                b.chars += n
                b.links += n if k[1] else 0
    body = next((b for b in order if b.tag == "body"), order[0])
    share = body.links / max(1, body.chars)
    for b in order:
        if b.chars:
            plain = max(1, b.chars - b.links)
            base = math.log(b.chars / plain * b.links + share * b.chars + math.e)
            ratio = b.chars / max(1, b.links) * b.tags / max(1, b.link_tags)
            b.density = max(0.0, b.chars / b.tags * math.log(max(ratio, 1.0) + 1.0) / max(base, 1.0))
        if b.parent is not None:
            b.parent.total += b.density


def weight(b: Block) -> float:
    return b.total or b.density * 0.5


def region(heart: Block, others: list[Block], body: Block) -> Block:
    """The heart's lowest ancestor that holds the others as well, or more while most of the text is below (but not the body)."""
    line = [heart]
    while line[-1] is not body:
        line.append(line[-1].parent)
    place = {id(b): k for k, b in enumerate(line)}
    at, passed = 0, set()
    for b in others:
        while id(b) not in place and id(b) not in passed:
            passed.add(id(b))
            b = b.parent
        at = max(at, place.get(id(b), 0))
    up = line[at]
    while up.parent is not None and up is not body and up.parent is not body and 2 * up.chars > up.parent.chars:
        up = up.parent
    return up


def leave_out(order: list[Block]) -> None:
    """Marks the blocks that aren't read: named ones with all they hold, unless they hold the article, and lists of links."""
    whole = order[0].chars - order[0].links
    heads, longest = set(), {}  # the blocks with the page's heading in them; the most text of an article element in a block
    for b in reversed(order):
        if b.tag in ("h1", "main") and b.chars or id(b) in heads:
            heads.update((id(b), id(b.parent)))
        most = max(longest.get(id(b), 0), b.chars - b.links if b.tag == "article" else 0)
        longest[id(b.parent)] = max(longest.get(id(b.parent), 0), most)
    for b in order:
        plain = b.chars - b.links
        alone = whole - plain < NEXT_TO_NOTHING * plain and plain >= LEAST_ARTICLE and not b.talk
        stays = 2 * plain > whole and (id(b) in heads or alone or 2 * longest.get(id(b), 0) > plain and not b.talk)
        listed = b.link_tags >= 3 and b.links > 0.7 * b.chars and b.tag in ("ul", "ol", "div", "section", "table", "p", "dl")
        b.gone = b.parent is not None and b.parent.gone or b.named and not stays or listed  # lists of links are menus, whatever their names


def chosen_blocks(order: list[Block]) -> list[Block]:
    """The blocks that density chooses among those that aren't left out, in page order, none inside another."""
    body = next((b for b in order if b.tag == "body" and b.chars and not b.gone), order[0])
    within = [b for b in blocks_of(body) if b.chars and not b.gone]
    if not within:
        return []
    heart = max(within, key=weight)
    path, up = {id(heart)}, heart
    threshold = heart.density
    while up is not body:
        up = up.parent
        path.add(id(up))
        threshold = min(threshold, up.density)
    best: dict[int, Block] = {}
    for b in reversed(within):  # the greatest sum in each subtree
        best[id(b)] = max([b, *(best[id(k)] for k in b.kids if type(k) is Block and id(k) in best)], key=weight)
    others = [best[id(b)] for b in within if id(b) not in path and b.density >= threshold and b.total and weight(best[id(b)]) >= COMPARABLE * weight(heart)]
    chosen = {id(region(heart, others, body))}
    chosen |= {id(b) for b in within[: within.index(heart)] if b.tag == "h1"}
    picked, inside = [], set()
    for b in within:
        if b.parent is not None and id(b.parent) in inside:
            inside.add(id(b))
        elif id(b) in chosen:
            picked.append(b)
            inside.add(id(b))
    return picked


def content(root: Block) -> list[Block]:
    """The article's blocks, in page order, none inside another. Without any, names are passed over."""
    order = blocks_of(root)
    weigh(order)
    leave_out(order)
    picked = chosen_blocks(order)
    if order[0].chars - order[0].links >= LEAST_ARTICLE and not any(lines(b) for b in picked):
        for b in order:
            b.gone = False
        picked = chosen_blocks(order)
    return picked


def lines(block: Block) -> list[str]:
    """The text of each run of inline content between block boundaries, in page order."""
    out, run = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[object] = [block]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif type(x) is Block:
            if not (x.gone or x.unseen):
                close()
                stack.append(None)
                stack += reversed(x.kids)
        else:
            run.append(x[0])
    close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(line for b in content(parse(page)) for line in lines(b)) if page else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars instead of the html column."""
    ready(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(html_col).to_pylist()]
            made = [pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), "text", "n_chars"])

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*(f.name for f in kept), html_col).mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
