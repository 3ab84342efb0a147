"""Main text of web pages by composite text density.

A page is parsed into a tree of elements (unclosed and misnested tags as browsers take them). What can't be article text by
its element (scripts, styles, forms, navigation, footers, asides, ...) goes first, and so do elements of which a whole token
of class, id or role says furniture (``site-nav``, but not ``has-sidebar`` or ``market-share``). A name is only a hint: it cuts
no element that holds most of the page's text outside links, unless an article or main element outside it holds text, and
no paragraph or section as dense as the element it stands in; names of adverts, notices and comments cut both, but never all of a
page. A form stays if it wraps the page: if it holds most of that text and is as dense as the rest. Menus go too: elements with ``MENU`` links or more that hold nine tenths of their characters, unless the page has
nothing else. For every remaining node, with C characters, T tags, LC link characters and LT link tags below it, and LCb, Cb those of the body,

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

(C / T where the page has no link). A node's sum is the sum of its children's densities. The node of maximum sum is the
core; the threshold is the least density on the path from it to the body. From the body down, every node that reaches the
threshold gives the node of maximum sum at or below it, and the main text is the least subtree that holds them all, with the
headings before it in its element. If only the body holds them all, those whose sum is below ``BESIDE_CORE`` of the core's go, and the rest
alone is it. In that subtree nothing is dropped.

An article or main element is a hint too. If there is one, or if several hold half of the page's text outside links, the core
is looked for in them, and inside the one around the core (an article before a main) the threshold is ``LOWERED`` of what it is elsewhere,
since short paragraphs are less dense than their article. Inline elements count as tags but are no nodes of their own. Of a
header inside an article, by element or by name, the headings stay.

Output: character references decoded; white space inside a block is one space; trimmed; blocks joined by one space.

Defined results: null and empty pages, and pages without text, give an empty string; pages of any length are parsed whole;
repeated rows are parsed each; null urls and ids pass through; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts, placed, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+|[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
UNENDED = re.compile(r"<(?:!--.*|/?[A-Za-z!?/][^<>]*)\Z", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp", "noscript", "template", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
CUT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "object", "canvas", "menu", "dialog", "fieldset"}
FORMS = {"form", "fieldset"}  # cut unless they wrap the page
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img ruby rb rt rp".split()
)
SAID = set(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising "
    "adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup share sharing social comment comments disqus respond replies related recommended "
    "breadcrumb breadcrumbs pagination pager widget toolbar login copyright complementary contentinfo search form skip".split()
)
BESIDE = set(  # words that say where furniture is or what it is made of
    "site main page post article entry content top bottom left right primary secondary global local mobile desktop sticky "
    "wrapper wrap container inner outer bar box list block area section links link buttons button icons text js "
    "user reader readers visitor thread feed panel group unit slot zone region module component item items body title heading "
    "posts articles stories entries media trail window column col row grid strip google".split()
)
NEVER_MAIN = {"ad", "ads", "advert", "advertisement", "comment", "comments", "reply", "replies", "related", "sponsored", "promo"}
NEVER_TEXT = NEVER_MAIN | {"notice", "notices", "cookie", "cookies", "consent", "gdpr"}  # names that cut a paragraph of any density
KEPT = {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
STAYS, GOES, HEADS = 0, 1, 2  # what furniture does: stays, goes, or is a header, of which headings stay inside an article
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MENU, LOWERED, BESIDE_CORE = 4, 0.1, 0.3
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}  # any other tag ends the head
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Tree:
    """Block nodes of a page in document order; node 0 stands for the body."""

    def __init__(self) -> None:
        self.tag, self.parent, self.cut = ["body"], [-1], [STAYS]
        self.firm = [True]  # whether a cut holds for a paragraph of any density
        self.chars, self.links, self.tags, self.link_tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # of text and breaks, with the node they are in

    def add(self, tag: str, parent: int, cut: int, firm: bool = True) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.cut, cut), (self.firm, firm), (self.chars, 0), (self.links, 0), (self.tags, 0), (self.link_tags, 0)):
            column.append(value)
        return len(self.tag) - 1


def _furniture(tag: str, attributes: str) -> tuple[int, bool]:
    """What becomes of the element, and whether that holds for a paragraph of any density."""
    if tag == "header":
        return HEADS, True
    if tag in CUT:
        return GOES, tag not in FORMS
    if tag in KEPT or "=" not in attributes:
        return STAYS, True
    said: set[str] = set()
    for m in NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in WORD.findall(name)}
            if words <= SAID | BESIDE:
                said |= words
    said &= NEVER_MAIN if tag in ("article", "main") else SAID
    return STAYS if not said else HEADS if said == {"header"} else GOES, bool(said & NEVER_TEXT)


def parse(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int, bool]] = []  # open elements: tag, block node, inside a link
    node, link, at = 0, False, 0
    ends = page.rfind(">") + 1  # nothing behind it is markup but what the page breaks off in

    def text(part: str) -> None:
        if not part:
            return
        part = html.unescape(part)
        tree.pieces.append((node, part))
        n = len(part) - part.count(" ") if part.isascii() else sum(map(len, part.split()))
        tree.chars[node] += n
        if link:
            tree.links[node] += n

    while True:
        m = MARKUP.search(page, at) if at < ends else None
        if m is None:
            text(UNENDED.sub("", page[at:]))
            return tree
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag not in INLINE:
                tree.pieces.append((node, " "))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            node, link = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            continue
        if tag == "html":
            continue
        if tag == "body" or (stack and stack[0][0] == "head" and tag not in IN_HEAD):
            stack.clear()
            node, link = 0, False
        if tag == "body":
            continue
        if tag in ENDS_P or tag in SAME:
            same, stop = SAME.get(tag, ({"p"}, {"table", "td", "th", "button", "object", "article", "section", "div", "blockquote", "li"}))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    del stack[i:]
                    break
                if stack[i][0] in stop:
                    break
            node, link = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if tag not in INLINE:
            tree.pieces.append((node, " "))
        if tag not in RAW:
            tree.tags[node] += 1
        if tag == "a":
            tree.link_tags[node] += 1
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        if tag in INLINE:
            inner = tree.add(tag, node, GOES) if _furniture(tag, m[3])[0] else node
            stack.append((tag, inner, link or tag == "a"))
        else:
            inner = tree.add(tag, node, *_furniture(tag, m[3]))
            stack.append((tag, inner, link))
        node, link = stack[-1][1], stack[-1][2]


def _spare(tree: Tree, article: list[int]) -> None:
    """Takes back cuts by name alone, and of forms, of nodes that hold most of the page's text outside links, and cuts by name of
    paragraphs and sections as dense as what they stand in. A form must be as dense as the rest of the page, too."""
    n, tag, parent, cut = len(tree.tag), tree.tag, tree.parent, tree.cut
    by_name = [cut[i] != STAYS and tag[i] != "header" and (tag[i] not in CUT or tag[i] in FORMS) for i in range(n)]
    if not any(by_name):
        return
    plain, tags = [c - k for c, k in zip(tree.chars, tree.links)], tree.tags[:]
    declared = [0] * n  # of plain, what article and main elements hold
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if not by_name[i] and (cut[i] == GOES or (cut[i] == HEADS and article[p] < 0)):
            continue
        if article[i] == i and cut[i] == STAYS:
            declared[i] = plain[i]
        plain[p] += plain[i]
        tags[p] += tags[i]
        declared[p] += declared[i]
    for i in range(1, n):
        if by_name[i] and tag[i] in ("p", "section") and not tree.firm[i] and plain[i] * max(tags[parent[i]], 1) >= plain[parent[i]] * max(tags[i], 1) > 0:
            cut[i] = STAYS
    for i in range(1, n):
        most = plain[i] >= plain[0] > 0 if tree.firm[i] else 2 * plain[i] > plain[0]
        if tag[i] in FORMS:
            most = most and plain[i] * max(tags[0] - tags[i], 1) >= (plain[0] - plain[i]) * max(tags[i], 1)
        if by_name[i] and most and (article[parent[i]] >= 0 or declared[i] == declared[0]):
            cut[i] = STAYS


def _below(tree: Tree, gone: list[bool], mute: list[bool]) -> tuple[list[int], ...]:
    """Characters, link characters, tags and link tags at and below every node, without those that are gone."""
    chars, links, tags, link_tags = columns = (tree.chars[:], tree.links[:], tree.tags[:], tree.link_tags[:])
    for i in range(len(gone)):
        if mute[i]:
            chars[i] = links[i] = 0
    for i in range(len(gone) - 1, 0, -1):
        p = tree.parent[i]
        if gone[i]:
            for column in columns:
                column[i] = 0
            tags[p] -= 1  # the element itself
            link_tags[p] -= tree.tag[i] == "a"
            continue
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
        link_tags[p] += link_tags[i]
    return columns


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    tree = parse(page)
    n = len(tree.tag)
    tag, parent, cut = tree.tag, tree.parent, tree.cut
    article = [-1] * n  # article: the nearest article or main element, itself included
    for i in range(1, n):
        p = parent[i]
        article[i] = i if tag[i] in ("article", "main") else article[p]
    _spare(tree, article)
    gone = [False] * n
    for i in range(1, n):
        p = parent[i]
        gone[i] = gone[p] or cut[i] == GOES or (cut[i] == HEADS and article[p] < 0)
    in_header, in_heading = [False] * n, [False] * n
    for i in range(1, n):
        in_header[i] = in_header[parent[i]] or cut[i] == HEADS
        in_heading[i] = in_heading[parent[i]] or tag[i] in HEADINGS
    mute = [a and not b for a, b in zip(in_header, in_heading)]  # of a header inside an article, only headings speak
    chars, links, tags, link_tags = _below(tree, gone, mute)
    menu = [i for i in range(n) if not gone[i] and tag[i] != "p" and link_tags[i] >= MENU and 10 * links[i] >= 9 * chars[i]]
    if menu and 0 not in menu:
        for i in menu:
            gone[i] = True
        for i in range(1, n):
            gone[i] = gone[i] or gone[parent[i]]
        chars, links, tags, link_tags = _below(tree, gone, mute)
    if not chars[0]:
        return ""
    share = links[0] / chars[0]
    density = [0.0] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(tags[i], 1), links[i], link_tags[i]
        if not c:
            continue
        density[i] = c / t
        if links[0]:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[i] *= math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(math.log(base), 1e-3)
    total, children = [0.0] * n, [0] * n
    for i in range(1, n):
        if not gone[i]:
            total[parent[i]] += density[i]
            children[parent[i]] += 1
    for i in range(n):
        if not children[i]:
            total[i] = density[i]
    outer = [-1] * n  # the outermost article, or failing that main, around each node, itself included
    for i in range(1, n):
        p = outer[parent[i]]
        outer[i] = p if p >= 0 and (tag[p] == "article" or tag[i] != "article") else i if article[i] == i else p
    declared = [chars[i] - links[i] for i in range(n) if article[i] == i and article[parent[i]] < 0 and chars[i] > links[i]]
    hinted = len(declared) == 1 or 2 * sum(declared) >= max(1, chars[0] - links[0])
    core = max((i for i in range(n) if article[i] >= 0 or not hinted), key=lambda i: (total[i] if not gone[i] else -1.0, -i))
    threshold, i = density[core], core
    while i > 0:
        i = parent[i]
        threshold = min(threshold, density[i])
    best = list(range(n))  # the node of maximum sum at or below each
    for i in range(n - 1, 0, -1):
        if not gone[i] and total[best[i]] > total[best[parent[i]]]:
            best[parent[i]] = best[i]
    dense, marked, home = [False] * n, {core}, outer[core]
    for i in range(n):
        least = threshold * (LOWERED if home >= 0 and outer[i] == home else 1)
        dense[i] = not gone[i] and density[i] >= least and (i == 0 or dense[parent[i]])
        if dense[i] and (article[best[i]] >= 0 or not hinted):
            marked.add(best[i])

    def common(nodes: set[int]) -> int:
        held = [int(i in nodes) for i in range(n)]
        for i in range(n - 1, 0, -1):
            held[parent[i]] += held[i]
        return max((i for i in range(n) if held[i] == len(nodes)), default=0)  # document order: the last is the deepest

    root, roots = common(marked), set()
    if root == 0 and core != 0:  # blocks beside each other: short ones are furniture, however they are made
        marked = {i for i in marked if total[i] >= BESIDE_CORE * total[core]} | {core}
        root = common(marked)
        roots = marked if root == 0 else {root}
    else:
        roots = {root}
    inside = [False] * n
    for i in range(n):
        before = root > i > 0 and parent[i] == parent[root] and tag[i] in HEADINGS
        inside[i] = not gone[i] and (i in roots or before or (i > 0 and inside[parent[i]]))
    return " ".join("".join(part if inside[i] and not mute[i] else " " for i, part in tree.pieces).split())


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` with a column ``text`` in place of the html."""
    at, rows = pages.columns.index(html_col), placed(pages)
    kept = [i for i in range(len(pages.columns)) if i != at and pages.columns[i] != "text"]
    names = [f"c{i}" for i in kept]
    schema = StructType([rows.schema.fields[i] for i in kept]).add("text", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = pa.array([main_text(h) for h in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), texts], names=[*names, "text"])

    return rows.mapInArrow(run, schema).toDF(*(pages.columns[i] for i in kept), "text")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
