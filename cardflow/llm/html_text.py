"""Main text of web pages by scores on the element tree.

A lenient parse builds the tree: end tags that are missing or left over, unclosed comments and truncated pages are taken as browsers take them.
Elements that are no article by their tag or role (menus, headers, footers, notices, scripts, hidden ones) are set aside. A form, or a word of the class or id
(sidebar, advert, comments), makes an element suspect: it is set aside too, unless it holds most of the page's text or the article itself, as a wrapper
does; then it stays with half its score. Each paragraph gives points for its length and commas to its ancestors, fewer with the distance, and an element's
points are discounted by the share of its text that stands in links. The best container is kept, widened to the article or main element it lies in and
articles beside that which score well, or else joined by its siblings that score well, are headings, or are paragraphs of text. In it, lists that
consist of links are dropped where less than 80 characters come before them, as menus are.

Text: character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by a newline, empty ones left out.

Defined results: a null or empty page, or one without text, gives an empty string. Pages are read whole; other columns are not looked at. Depth and length are not limited:
nothing recurses."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.frames import table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Start tags that end an open p, and those that end an open element of a group up to a border.
_ENDS_P = BLOCK - frozenset("body caption head html option optgroup tbody td tfoot th thead tr li dd dt".split()) | frozenset(("li", "dd", "dt"))
_GROUPS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What no article is: tags, roles, and words of class or id.
BAD_TAGS = frozenset("nav header footer aside button select input textarea dialog menu script style noscript iframe template head title svg canvas object audio video".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BAD_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs
footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations
comment comments commentlist reply replies respond disqus discussion feedback widget toolbar pagination pager login signin signup skip hidden""".split())
#: Words that name a place or a part of a layout, so that a wrapper of the article can have them as well; and words that turn a name into one of a state.
LAYOUT_WORDS = frozenset("side rail sidebar widget header masthead banner notice notices alert toolbar share sharing social nav navbar navigation menu form".split())
STATE_WORDS = frozenset("has no not with without is enabled disabled".split())
#: A suspect element stays from this share of the page's plain text on, by whether all its words are of the layout.
LAYOUT_SHARE, CONTENT_SHARE = 0.5, 0.9
#: Plain characters before a list of links that make it a part of the text.
TEXT_BEFORE_LINKS = 80
NEVER_BAD = frozenset(("html", "body", "article", "main"))
#: Shares of a paragraph's points for its parent, the parent of that, and so on.
SHARES = (1.0, 0.5, 0.25, 0.12, 0.06)


class Node:
    __slots__ = ("bad", "children", "length", "linked", "parent", "points", "suspect", "tag")

    def __init__(self, tag: str, parent: Node | None, bad: bool, suspect: frozenset[str] = frozenset()):
        self.tag, self.parent, self.bad, self.suspect, self.children, self.points, self.length, self.linked = tag, parent, bad, suspect, [], 0.0, 0, 0

    def score(self) -> float:
        return self.points * (1 - self.linked / self.length) * (0.5 if self.suspect else 1) if self.length else 0.0


def _judge(tag: str, attributes: str, stack: list[Node]) -> tuple[bool, frozenset[str]]:
    """Whether an element is set aside whatever it holds, and the words that make it suspect."""
    if tag in BAD_TAGS:
        return not (tag == "header" and any(n.tag in ("article", "main") for n in stack)), frozenset()
    words = {"form"} if tag == "form" else set()
    if not attributes or tag in NEVER_BAD:
        return False, frozenset(words)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, frozenset()
    if found.get("role", "").lower() in BAD_ROLES:
        return True, frozenset()
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = _WORDS.findall(name)
        if STATE_WORDS.isdisjoint(parts):
            words.update(BAD_WORDS.intersection(parts))
    return False, frozenset(words)


def parse(page: str) -> Node:
    root = Node("html", None, False)
    stack, at = [root], 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK and stack[i].tag != "p":
                        break
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK or stack[i].tag == "button":
                    break
        if tag in _GROUPS:
            ends, border = _GROUPS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in border:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        bad, suspect = _judge(tag, m[3], stack)
        node = Node(tag, stack[-1], stack[-1].bad or bad, suspect)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _walk(node: Node) -> Iterator[tuple[Node, bool]]:
    """Each element when it opens (True) and when it closes."""
    todo = [(node, True)]
    while todo:
        n, opens = todo.pop()
        yield n, opens
        if opens:
            todo.append((n, False))
            todo += [(c, True) for c in reversed(n.children) if isinstance(c, Node)]


def _set_aside(root: Node) -> None:
    """Decides on the suspect elements, those of content before those of the layout, which are held against the text that is left by then."""
    links, plain, articles, mains, suspects = 0, {}, {}, {}, []
    for n, opens in _walk(root):
        links += (1 if opens else -1) * (n.tag == "a")
        if n.bad:
            continue
        if opens:
            plain[id(n)] = 0 if links else sum(len(c.strip()) for c in n.children if isinstance(c, str))
            if n.suspect:
                suspects.append(n)
            continue
        if n.parent:
            plain[id(n.parent)] += plain[id(n)]
            articles[id(n.parent)] = articles.get(id(n.parent), False) or n.tag == "article" or articles.get(id(n), False)
            mains[id(n.parent)] = mains.get(id(n.parent), False) or n.tag == "main" or mains.get(id(n), False)
    left = plain.get(id(root), 0)
    for of_layout in (False, True):
        share = LAYOUT_SHARE if of_layout else CONTENT_SHARE
        whole = left
        for n in suspects:
            if n.bad or (n.suspect <= LAYOUT_WORDS) != of_layout or mains.get(id(n)) or (of_layout and articles.get(id(n))):
                continue
            # a link list or an empty box has no plain text, and no share of it
            if plain[id(n)] and plain[id(n)] >= share * whole:
                continue
            left -= plain[id(n)]
            for inner, opens in _walk(n):
                inner.bad = inner.bad or opens


def _measure(root: Node) -> list[Node]:
    """Text and linked text of each element, without what was set aside; points; and the elements that have some."""
    links, scored = 0, {}
    for n, opens in _walk(root):
        links += (1 if opens else -1) * (n.tag == "a")
        if n.bad:
            continue
        if opens:
            n.length = sum(len(c.strip()) for c in n.children if isinstance(c, str))
            n.linked = n.length if links else 0
            continue
        if n.parent:
            n.parent.length += n.length
            n.parent.linked += n.linked
        blocks = any(isinstance(c, Node) and c.tag in BLOCK for c in n.children)
        if not n.length or n.tag in HEADINGS or not (n.tag in ("p", "pre", "blockquote", "td") or (n.tag in BLOCK and not blocks) or
                                                     (n.tag in BLOCK and any(isinstance(c, str) and c.strip() for c in n.children))):
            continue
        commas = sum(c.count(",") for c in n.children if isinstance(c, str))
        points, up = (1 + commas + min(n.length / 100, 3)) * (1 - n.linked / n.length), n.parent
        for share in SHARES:
            if up is None:
                break
            up.points += points * share
            scored[id(up)] = up
            up = up.parent
    return list(scored.values())


def _collect(nodes: list[Node]) -> str:
    blocks, now, before = [], [], 0

    def end() -> None:
        nonlocal before
        text = _SPACES.sub(" ", "".join(now)).strip()
        if text:
            blocks.append(text)
            before += len(text)
        now.clear()

    for top in nodes:
        todo: list = [(top, True)]
        while todo:
            n, opens = todo.pop()
            if isinstance(n, str):
                now.append(n)
                continue
            if n.tag in BLOCK:
                end()
            if opens and (n.bad or (before < TEXT_BEFORE_LINKS and _is_menu(n))):
                continue
            if n.tag == "br":
                now.append(" ")
            if opens:
                todo.append((n, False))
                todo += [(c, True) for c in reversed(n.children)]
        end()
    return "\n".join(blocks)


def _is_menu(n: Node) -> bool:
    if n.tag not in ("ul", "ol", "dl") or n.linked < 0.7 * n.length:
        return False
    return sum(isinstance(c, Node) for c in n.children) > 1


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _set_aside(root)
    scored = _measure(root)
    if not scored:
        return _collect([root])
    best = max(scored, key=Node.score)
    up, whole = best, None
    while up is not None:
        if up.tag in ("article", "main"):
            whole = up
        up = up.parent
    if whole is not None:
        inner = best
        while inner is not whole and inner.tag != "article":
            inner = inner.parent
        if inner.tag != "article" or inner.parent is None:
            return _collect([inner])
        least = max(2.0, 0.2 * inner.score())
        return _collect([c for c in inner.parent.children
                         if isinstance(c, Node) and not c.bad and (c is inner or (c.tag == "article" and c.score() >= least))])
    if best.parent is None:
        return _collect([best])
    least = max(2.0, 0.2 * best.score())
    kept = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.bad:
            continue
        plain = c.length and c.linked < 0.25 * c.length
        if c is best or c.score() >= least or c.tag in HEADINGS or (c.tag in ("p", "pre", "blockquote") and plain):
            kept.append(c)
    return _collect(kept)


def extract(page: Column) -> Column:
    """The main text of a page."""

    def of(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(p.as_py()) for p in pages), pa.string())

    return F.arrow_udf(of, "string")(page)


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_main_text": (query, None)}
