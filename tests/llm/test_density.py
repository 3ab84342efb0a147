"""Main text by density alone: wrapping forms, labels, named sections, pages without structure, and a slow reading of the method."""

from __future__ import annotations

import html
import math
import random
import re
from html.parser import HTMLParser

import pytest

from quern.llm import html_text

LONG = "Words of the page itself, enough of them to be dense, and then some more."
MORE = "Another paragraph of the page, as long as the first one is, or nearly so."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i} of the page</a></li>" for i in range(6)) + "</ul>"
LOGIN = "<form action=/in><label>Name</label><input name=n><label>Word</label><input name=w><button>Log in</button></form>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=aspnetForm action=x><div><h1>T</h1><p>{LONG}</p><p>{MORE}</p></div></form></body>", f"T {LONG} {MORE}"),
        (f"<body><form id=f><input type=hidden><article><p>{LONG}</p></article></form></body>", LONG),
        (f"<article><p>{LONG}</p>{LOGIN}<p>{MORE}</p></article>", f"{LONG} {MORE}"),
        (f"<body><div><p>{LONG}</p><p>{MORE}</p></div>{LOGIN}</body>", f"{LONG} {MORE}"),
        ("<article><p>Use the <label>field name</label> here.</p></article>", "Use the field name here."),
        (f"<main><section id=search><p>{LONG}</p></section><section id=form><p>{MORE}</p></section><section><p>{LONG}</p></section></main>", f"{LONG} {MORE} {LONG}"),
        (f"<main><p>{LONG}</p><section id=related>{LINKS}</section><section class=comments><p>{MORE}</p></section></main>", LONG),
    ],
)
def test_tags_and_names_alone_drop_no_dense_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_structure_or_names(spark):
    """Structural tags made div, names removed: as before for 90 pages of 100 and more."""
    same = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())
        bare = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|form|section)\b", r"<\1div", re.sub(r'\s(?:class|id|role)="[^"]*"', "", r.html))
        same += html_text.main_text(bare) == plain
        total += 1
    assert total == 2500 and same >= 0.9 * total


class Plain(HTMLParser):
    """A tree of well-formed markup: nodes are [tag, children], children are nodes and texts."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["body", []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


INLINE = {"a", "b", "i", "span"}


def slow_text(page):
    """The method, said again on a plain tree: every measure of every node by walking all below it."""

    def walk(node):
        yield node
        for c in node[1]:
            if not isinstance(c, str):
                yield from walk(c)

    def texts(node, linked=False):
        linked = linked or node[0] == "a"
        for c in node[1]:
            if isinstance(c, str):
                yield c, linked
            else:
                yield from texts(c, linked)

    def measures(node):
        of = lambda t: len("".join(t.split()))
        found = list(texts(node))
        below = list(walk(node))[1:]
        return sum(of(t) for t, _ in found), len(below), sum(of(t) for t, k in found if k), sum(n[0] == "a" for n in below)

    root = Plain(page).root

    def drop_menus(node):
        def menu(n):
            c, _, lc, lt = measures(n)
            return n[0] not in INLINE | {"p"} and lt >= 4 and 10 * lc >= 9 * c

        node[1] = [c for c in node[1] if isinstance(c, str) or not menu(c)]
        for c in node[1]:
            if not isinstance(c, str):
                drop_menus(c)

    c, _, lc, lt = measures(root)
    if not (lt >= 4 and 10 * lc >= 9 * c):
        drop_menus(root)
    blocks = [n for n in walk(root) if n[0] not in INLINE]
    parent = {id(k): n for n in blocks for k in n[1] if not isinstance(k, str)}
    for n in walk(root):  # an inline node's blocks would belong to its block; made pages have none
        assert n[0] not in INLINE or all(isinstance(k, str) or k[0] in INLINE for k in n[1])
    cb, _, lcb, _ = measures(root)
    if not cb:
        return ""

    def density(n):
        c, t, lc, lt = measures(n)
        t = max(t, 1)
        if not c:
            return 0.0
        if not lcb:
            return c / t
        base = math.log(c / max(c - lc, 1) * lc + lcb / cb * c + math.e)
        return c / t * (math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(math.log(base), 1e-3))

    kids = lambda n: [k for k in n[1] if not isinstance(k, str) and k[0] not in INLINE]
    total = {id(n): sum(density(k) for k in kids(n)) if kids(n) else density(n) for n in blocks}
    core = max(blocks, key=lambda n: total[id(n)])  # the first of equals
    up = lambda n: [n, *up(parent[id(n)])] if id(n) in parent else [n]
    threshold = min(density(n) for n in up(core))
    marked = [core]

    def mark(n):
        if density(n) >= threshold:
            below = [m for m in blocks if any(x is n for x in up(m))]
            best = max(below, key=lambda m: total[id(m)])
            if not any(best is m for m in marked):
                marked.append(best)
            for k in kids(n):
                mark(k)

    mark(root)

    def common(nodes):
        return [n for n in blocks if all(any(x is n for x in up(m)) for m in nodes)][-1]

    top = common(marked)
    if top is root and core is not root:
        marked = [m for m in marked if total[id(m)] >= 0.3 * total[id(core)] or m is core]
        top = common(marked)
        roots = marked if top is root else [top]
    else:
        roots = [top]
    said = []

    def read(n, inside):
        inside = inside or any(n is r for r in roots) or (top is not root and n[0] in ("h1", "h2", "h3") and parent.get(id(n)) is parent.get(id(top)) and before(n, top))
        for k in n[1]:
            if isinstance(k, str):
                said.append(k if inside else " ")
            else:
                said.append("" if k[0] in INLINE else " ")
                read(k, inside)
                said.append("" if k[0] in INLINE else " ")

    def before(a, b):
        order = [id(n) for n in blocks]
        return order.index(id(a)) < order.index(id(b))

    read(root, False)
    return " ".join("".join(said).split())


def made_page(rng):
    words = lambda n: " ".join("".join(rng.choice("abcde&<") for _ in range(rng.randint(1, 8))) for _ in range(n))

    def inline():
        t = html.escape(words(rng.choice([1, 3, 10, 40])))
        return rng.choice([t, t, t, f"<b>{t}</b>", f"<a>{t}</a>", f"{t} <span><a>{t}</a></span> {t}"])

    def block(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            return f"<p>{''.join(inline() for _ in range(rng.randint(1, 3)))}</p>"
        if kind < 0.55:
            return f"<h2>{html.escape(words(3))}</h2>"
        if kind < 0.7:
            return "<ul>" + "".join(f"<li><a>{html.escape(words(rng.randint(1, 4)))}</a></li>" for _ in range(rng.randint(1, 7))) + "</ul>"
        return f"<div>{''.join(block(depth - 1) for _ in range(rng.randint(0, 4)))}{inline() if rng.random() < 0.2 else ''}</div>"

    return "<div>" + "</div><div>".join("".join(block(3) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) + "</div>"


def test_made_pages_equal_the_slow_reading():
    rng = random.Random(5)
    pages = [made_page(rng) for _ in range(300)]
    found = [html_text.main_text(p) for p in pages]
    for page, text in zip(pages, found):
        assert text == slow_text(page), page
    whole = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in pages]
    assert sum(len(t) < len(w) for t, w in zip(found, whole)) > 60  # something goes in many
