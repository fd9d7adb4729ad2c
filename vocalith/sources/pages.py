"""Articles out of web pages.

HTML isn't XML, so no built-in can select from it: a pandas UDF parses each page with the
standard library's parser. Which elements make title, byline and text are parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of HTML: elements without content; those that close an open paragraph; what an
# open element hides from end tags and closings below it, for paragraphs, list items and all else;
# blocks that end tags of inline elements don't cross; inline elements that go on in the next block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_PARAGRAPH_SCOPE, _ITEM_SCOPE, _TABLE_SCOPE = _SCOPE | {"button"}, _SCOPE | {"ol", "ul"}, frozenset({"html", "table", "template"})
_BLOCK = _ENDS_P | _SCOPE | {"body", "button", "tr", "tbody", "thead", "tfoot", "select", "iframe", "noscript", "textarea", "title", "head"}
_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: So many inline elements that are alike go on at most.
_ALIKE = 3
#: Open elements that a start tag closes, and the scope in which it looks for them.
_CLOSES = {
    "li": ({"li"}, _ITEM_SCOPE), "dt": ({"dt", "dd"}, _SCOPE), "dd": ({"dt", "dd"}, _SCOPE), "option": ({"option"}, _SCOPE), "optgroup": ({"option", "optgroup"}, _SCOPE),
    "td": ({"td", "th"}, _TABLE_SCOPE), "th": ({"td", "th"}, _TABLE_SCOPE), "tr": ({"tr"}, _TABLE_SCOPE), **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, _TABLE_SCOPE)),
}
_SPACE = re.compile(f"^{T.SPACE}+|{T.SPACE}+$")


@dataclass(frozen=True)
class Selectors:
    """Each is a class (`.name`) or an element, perhaps inside another (`article p`)."""

    title: str = ".headline"
    byline: str = ".byline--lite"
    text: str = ".paragraph--lite"
    #: Leave out a text element that is the last child of its parent.
    skip_last: bool = True


class _Node:
    __slots__ = ("tag", "classes", "parent", "children", "parts")

    def __init__(self, tag: str, classes: tuple[str, ...], parent: _Node | None):
        self.tag, self.classes, self.parent = tag, classes, parent
        self.children: list[_Node] = []
        self.parts: list[str | _Node] = []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                todo += reversed(part.parts)
        return "".join(out)


class _Tree(HTMLParser):
    """The tree that browsers make of a page, as far as selections can see it.

    Left-out end tags are supplied at whatever depth, end tags that match nothing in scope are
    ignored, and inline elements that a block's end cut off go on after it. Content that a table
    can't have stays where it is, and misnested inline elements aren't parted in two.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", (), None)
        self.nodes: list[_Node] = []
        self.open: Counter[str] = Counter()
        self.format: list[tuple[str, tuple[str, ...]]] = []  # inline elements that no end tag has closed

    def _add(self, tag: str, classes: tuple[str, ...], stays: bool = True) -> None:
        node = _Node(tag, classes, self.at)
        self.at.children.append(node)
        self.at.parts.append(node)
        self.nodes.append(node)
        if stays:
            self.at = node
            self.open[tag] += 1

    def _leave(self, node: _Node) -> None:
        """Close all open elements up to this one."""
        end = node.parent
        while self.at is not end:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _found(self, tags: set[str], scope: frozenset[str]) -> _Node | None:
        """The innermost open element of the tags that nothing in scope hides."""
        node = self.at if any(self.open[t] for t in tags) else self.root
        while node.parent is not None:
            if node.tag in tags:
                return node
            if node.tag in scope:
                return None
            node = node.parent
        return None

    def _close(self, tags: set[str], scope: frozenset[str]) -> bool:
        if node := self._found(tags, scope):
            self._leave(node)
        return node is not None

    def _go_on(self) -> None:
        """Open the inline elements again that a block's end has closed."""
        if not self.format:
            return
        have, node = Counter(), self.at
        while node.parent is not None:
            have[node.tag, node.classes] += 1
            node = node.parent
        for entry in self.format:
            if have[entry]:
                have[entry] -= 1
            else:
                self._add(*entry)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = tuple((dict(attrs).get("class") or "").split())
        if tag in ("html", "body") and any(n.tag == tag for n in self.nodes):
            return
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in _ENDS_P:
            self._close({"p"}, _PARAGRAPH_SCOPE)
        if tag[0] == "h" and tag[1:].isdigit() and self.at.tag[:1] == "h" and self.at.tag[1:].isdigit():
            self._leave(self.at)
        if tag == "a" and any(t == "a" for t, _ in self.format):
            self.handle_endtag("a")
        if tag not in _BLOCK:
            self._go_on()
        self._add(tag, classes, tag not in _VOID)
        if tag in _FORMAT:
            if self.format.count((tag, classes)) >= _ALIKE:
                self.format.remove((tag, classes))
            self.format.append((tag, classes))
        elif tag in ("td", "th", "caption"):
            self.format = []

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):  # what comes after still belongs to the body
            return
        if tag in _FORMAT:
            for entry in reversed(self.format):
                if entry[0] == tag:
                    self.format.remove(entry)
                    break
            self._close({tag}, _BLOCK)
        elif tag == "p":
            if not self._close({"p"}, _PARAGRAPH_SCOPE):
                self._add("p", (), False)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "table"):
            self._close({tag}, _TABLE_SCOPE - {tag})
        elif tag in _BLOCK:
            self._close({tag}, (_ITEM_SCOPE if tag == "li" else _SCOPE) - {tag})
        elif tag not in _VOID:
            self._close({tag}, _BLOCK)

    def handle_data(self, data: str) -> None:
        if self.format and data.strip():
            self._go_on()
        self.at.parts.append(data)


def _is(node: _Node, simple: str) -> bool:
    return simple[1:] in node.classes if simple[0] == "." else node.tag == simple


def _matches(node: _Node, selector: str) -> bool:
    *outer, own = selector.split()
    if not _is(node, own):
        return False
    while outer and (node := node.parent) is not None:
        if _is(node, outer[-1]):
            outer.pop()
    return not outer


def _fed(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def parsed(html: str) -> _Node:
    """The root of a page's tree."""
    return _fed(html).root


def extract_page(html: str | None, selectors: Selectors) -> tuple[str, str, str]:
    """Title, byline (the texts of all their elements, trimmed) and text (the trimmed texts of its elements, one a line)."""
    tree = _fed(html)
    title, byline = (_SPACE.sub("", "".join(n.text() for n in tree.nodes if _matches(n, s))) for s in (selectors.title, selectors.byline))
    last = lambda n: n.parent.children[-1] is n
    body = [_SPACE.sub("", n.text()) for n in tree.nodes if _matches(n, selectors.text) and not (selectors.skip_last and last(n))]
    return title, byline, "\n".join(body)


def extract(pages: DataFrame, selectors: Selectors | None = None, html_col: str = "html") -> DataFrame:
    """pages without their HTML, with title, byline and text, and `error` where there is no page or it couldn't be parsed."""
    selectors = selectors or Selectors()

    @F.pandas_udf("title string, byline string, text string, error string")
    def parse(html: pd.Series) -> pd.DataFrame:
        rows = []
        for page in html:
            if not isinstance(page, str):
                rows.append((None, None, None, "no page"))
                continue
            try:
                rows.append((*extract_page(page, selectors), None))
            except Exception as e:  # noqa: BLE001  one bad page mustn't end the others
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["title", "byline", "text", "error"], dtype=object)

    return pages.withColumn("_article", parse(F.col(html_col))).select(*[c for c in pages.columns if c != html_col], "_article.*")


def fetch(articles: DataFrame, pages: DataFrame, site: str = "https://lite.cnn.com") -> DataFrame:
    """Articles (uuid, url) with the HTML of their page out of a table of pages; null where there is none. Of pages that share a URL the least HTML counts."""
    html = pages.groupBy(F.col("url").alias("_page")).agg(F.min("html").alias("html"))
    return articles.join(html, F.concat(F.lit(site), F.col("url")) == F.col("_page"), "left").drop("_page")


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles to go on with, and a dead-letter table of those that couldn't be fetched or parsed."""
    bad = F.col("error").isNotNull()
    return parsed.where(~bad).drop("error"), parsed.where(bad).select("uuid", "url", "error")
