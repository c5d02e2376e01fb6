"""The main text of pages that the test builds itself, so that it knows the article."""

import html
import math
import random
import time

import duckdb
import pytest

from fathom.llm import html_text
from fathom.llm.common import ready

WORDS = "river stone cloud market garden window letter summer branch copper signal harbour winter forest music".split()


def sentence(rnd, least=8, most=25):
    return " ".join(rnd.choices(WORDS, k=rnd.randint(least, most))).capitalize() + "."


def links(rnd, n):
    return "<ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rnd.choices(WORDS, k=n)) + "</ul>"


def page(rnd, kind):
    """A page and its article's lines; kind is how the article is marked up."""
    title = sentence(rnd, 3, 8)
    paragraphs = [sentence(rnd) + " " + sentence(rnd) + (" & more <x>" if rnd.random() < 0.3 else "") for _ in range(rnd.randint(3, 12))]
    marked = [f"<p>{html.escape(p)}</p>" for p in paragraphs]
    body = f"<h1>{title}</h1>"
    if kind == "sections":
        half = len(marked) // 2
        body += f"<section>{''.join(marked[:half])}</section><section>{''.join(marked[half:])}</section>"
    else:
        body += "".join(marked)
    article = {"article": "<article>{}</article>", "div": "<div id=content>{}</div>", "sections": "<div class=wrap><div class=story>{}</div></div>", "main": "<main><div>{}</div></main>"}[kind].format(body)
    around = [f"<nav>{links(rnd, 8)}</nav>", f"<div class='ad'>{sentence(rnd, 4, 8)}</div>", f"<header>{sentence(rnd, 3, 5)}</header>", f"<div id='cookie-notice'>{sentence(rnd)}</div>"]
    after = [f"<aside>{''.join(f'<p>{sentence(rnd)}</p>' for _ in range(3))}</aside>", f"<div class='comments'>{''.join(f'<div class=reply><p>{sentence(rnd)}</p></div>' for _ in range(rnd.choice([0, 4, 30])))}</div>", f"<form><label>{sentence(rnd, 3, 5)}</label><input></form>", f"<footer><p>&copy; {sentence(rnd)}</p></footer>"]
    rnd.shuffle(around)
    rnd.shuffle(after)
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(around)}{article}{''.join(after)}<script>x('</p>')</script></body></html>", [title, *paragraphs]


@pytest.mark.parametrize("kind", ["article", "div", "sections", "main"])
def test_the_article_is_found_among_all_else(kind):
    rnd = random.Random(kind)
    for _ in range(60):
        source, want = page(rnd, kind)
        assert html_text.main_text(source) == "\n".join(want), source


def test_density_decides_without_names(sf, spark, monkeypatch):
    """With no element, role or class name known as boilerplate, nearly all pages still give the same text."""
    pages = [r.html for r in ready(spark).read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "unwanted", lambda tag, raw: (tag == "head", tag == "head"))
    same = sum(html_text.main_text(p) == w for p, w in zip(pages, want))
    assert same >= 0.9 * len(pages)
    assert sum(html_text.main_text(p.replace("<article", "<div").replace("</article", "</div")) == w for p, w in zip(pages, want)) == same


def densities(block):
    """(characters, tags, density sum) of a block by recursion, without links."""
    kids = [k for k in block.kids if type(k) is html_text.Block and not k.unseen]
    chars = sum(len("".join(k[0].split())) for k in block.kids if type(k) is tuple) + sum(k.chars for k in kids)
    return chars, sum(k.density for k in kids)


def test_sums_are_those_of_the_children():
    source, _ = page(random.Random(3), "sections")
    order = html_text.blocks_of(html_text.parse(source))
    html_text.weigh(order)
    for b in order:
        chars, total = densities(b)
        assert (b.chars, b.total) == (chars, pytest.approx(total)) and (b.density > 0) == (b.chars > b.links or b.density > 0)


def test_odd_pages(spark):
    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [(1, None, None, "t", 7), (1, "u", "", "t", 7), (2, "u", long, None, None), (2, "u", "<div hidden>x</div><p>y", "t", 1), (2, "u", "<div hidden>x</div><p>y", "t", 1)]
    df = ready(spark).createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 1_499_999] and all(len(r.text) == r.n_chars for r in got)
    assert html_text.main_text("<div>" * 100_000 + "deep") == "deep"


ARTICLE = "<h1>A title of some words</h1>" + "".join(f"<p>Sentence {k} of an article that goes on with some more words.</p>" for k in range(15))
TEXT = html_text.main_text(f"<body>{ARTICLE}</body>")


@pytest.mark.parametrize("name", ["content", "layout has-sidebar", "container no-sidebar", "side-by-side", "page-header-fixed", "entry share-buttons-enabled", "sidebar", "menu", "comments", "ads"])
def test_no_wrapper_empties_an_article(name):
    menu = "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul></nav>"
    wrapped = f"<body>{menu}<div class='{name}'>{ARTICLE}<div class='share-buttons'>Share this</div></div><footer>At the foot</footer></body>"
    assert len(TEXT) > 800 and html_text.main_text(wrapped) == TEXT
    assert html_text.main_text(f"<body><form>{menu}<div>{ARTICLE}<input><button>Send</button></div></form></body>") == TEXT


def test_names_count_by_whole_words():
    named = [html_text.named(n) for n in ("ad", "x ad", "siteFooter", "cookie-notice", "main_nav", "comment-list", "share-buttons", "TOC", "has-sidebar", "no-ads", "side-by-side", "page-header-fixed", "content", "post", "adagio", "")]
    assert named == [True] * 8 + [False] * 8


def test_comments_longer_than_the_article_stay_out():
    comments = "".join(f"<div class=comment><p>Reply {k} that has quite a number of words in it, too.</p></div>" for k in range(60))
    assert html_text.main_text(f"<body><div id=content>{ARTICLE}</div><div class=comments>{comments}</div></body>") == TEXT
    assert html_text.main_text("<body><p>Only a <span class=ad>bad </span>line.</p></body>") == "Only a line."


@pytest.mark.parametrize(
    "source",
    ["<b>{n}</b><h1>x", "<b>*n<h1>x</h1>*n", "<div>*n</section>*n", "<i>*n<b>*n</i>*n", "<svg/>*n", "<dt><div>*1<x>*n<dd></dd>*n", "<p>*n", "<h1>*n", "<li><p>a*n", "<span class=ad>*n", "<div class='*1ad *n'>*1", "<div =*1aaaa*n>*1", "<a href=\"*n", "<!--*n", "<script>*1</script *n", "<div>x*n</div><p>y</p>*n"],
)
def test_long_pages_take_time_in_proportion(source):
    """2 MB or so of each pattern; a quadratic reader would take hours."""
    parts = [p for p in source.split("*")]
    n, text = 100_000, parts[0]
    for p in parts[1:]:
        times, rest = (n, p[1:]) if p[:1] == "n" else (1, p[1:])
        tag = text[text.rfind("\0") + 1 :]
        text = text[: text.rfind("\0") + 1] + tag * times + "\0" + rest
    began = time.process_time()
    html_text.main_text(text.replace("\0", ""))
    assert time.process_time() - began < 60


def chosen_by_recursion(root):
    """The article's lines by the rules as they are said, walked again for every block."""
    seen = lambda b: [k for k in b.kids if type(k) is html_text.Block and not k.unseen]
    runs = lambda b: [k for k in b.kids if type(k) is tuple]
    down = lambda b: [b] + [x for k in seen(b) for x in down(k)]
    count = lambda text: sum(not c.isspace() for c in text)
    tags = lambda b: 1 + own[id(b)][0] + sum(map(tags, seen(b)))
    link_tags = lambda b: own[id(b)][1] + sum(map(link_tags, seen(b)))
    chars = lambda b: sum(count(k[0]) for x in down(b) for k in runs(x))
    links = lambda b: sum(count(k[0]) for x in down(b) for k in runs(x) if k[1])
    own = {id(b): (b.tags, b.link_tags) for b in down(root)}
    body = next((b for b in down(root) if b.tag == "body"), root)

    def density(b):
        c, n = chars(b), links(b)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - n) * n + links(body) / max(1, chars(body)) * c + math.e)
        return max(0.0, c / tags(b) * math.log(max(c / max(1, n) * tags(b) / max(1, link_tags(b)), 1) + 1) / max(base, 1))

    every = down(root)
    dense = {id(b): density(b) for b in every}
    total = {id(b): sum(dense[id(k)] for k in seen(b)) for b in every}
    weight = {id(b): total[id(b)] or dense[id(b)] / 2 for b in every}
    plain = {id(b): chars(b) - links(b) for b in every}

    def gone(b):
        if b.parent is not None and gone(b.parent):
            return True
        head = any(x.tag in ("h1", "main") and chars(x) for x in down(b))
        alone = plain[id(root)] - plain[id(b)] < 0.1 * plain[id(b)] >= 10 and not b.talk
        article = any(x.tag == "article" and 2 * plain[id(x)] > plain[id(b)] for x in down(b)) and not b.talk
        if b.named and not (2 * plain[id(b)] > plain[id(root)] and (head or alone or article)):
            return True
        return link_tags(b) >= 3 and links(b) > 0.7 * chars(b) and b.tag in ("ul", "ol", "div", "section", "table", "p", "dl")

    left = {id(b) for b in every if not gone(b)}
    body = next((b for b in every if b.tag == "body" and chars(b) and id(b) in left), root)
    within = [b for b in down(body) if chars(b) and id(b) in left]
    if not within:
        return []
    heart = max(within, key=lambda b: weight[id(b)])
    line = [heart]
    while line[-1] is not body:
        line.append(line[-1].parent)
    threshold = min(dense[id(b)] for b in line)
    others = [max((x for x in down(b) if x in within), key=lambda x: weight[id(x)]) for b in within if b not in line and dense[id(b)] >= threshold]
    others = [x for x in others if weight[id(x)] >= 0.25 * weight[id(heart)]]
    up = next(b for b in line if all(x in down(b) for x in others))
    while up is not body and up.parent is not body and up.parent is not None and 2 * chars(up) > chars(up.parent):
        up = up.parent
    picked = [b for b in within if b is up or b.tag == "h1" and within.index(b) < within.index(heart)]
    picked = [b for b in picked if not any(b in down(x) for x in picked if x is not b)]

    def text(b):
        out, run = [], ""
        for k in b.kids:
            if type(k) is tuple:
                run += k[0]
            elif k.unseen or id(k) not in left:
                continue
            else:
                out, run = [*out, run, *text(k)], ""
        return [*out, run]

    return [t for b in picked for t in (" ".join(html.unescape(x).split()) for x in text(b)) if t]


def test_choice_is_that_of_a_plain_recursion():
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    rnd = random.Random(11)
    pages += [page(rnd, kind)[0] for kind in ("article", "div", "sections", "main") for _ in range(10)]
    for p in pages:
        assert "\n".join(chosen_by_recursion(html_text.parse(p))) == html_text.main_text(p)
