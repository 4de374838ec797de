"""The outline of fetched pages: paragraphs, sections and linked cards.

One read of the HTML gives the page's elements with their place in the document, and what
the rules of ``fundcat.operators.page_facts`` ask about. The rules themselves are column
expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from fundcat.functions.urls import canonical

_HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "form", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose text stands apart from what follows.
_APART = {"p", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "br"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements before which an open paragraph ends.
_BLOCKS = _HEADINGS | {"address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An element that ends an open one of its kind, as far as the next enclosing list or table.
_LISTED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Where a section of text ends.
_SECTION_ENDS = {"h1", "h2", "h3", "h4", "dt"}
_BOXES = {"article", "li", "figure", "p"}
MAX_TEXT, MAX_CONTEXT, MAX_LABEL = 100_000, 1_800, 200

CARD = "struct<place:int,title:string,url:string,context:string,image:string,alt:string>"
SCHEMA = f"page_id long, url string, title string, text string, paragraphs array<string>, sections array<struct<heading:string,text:string>>, cards array<{CARD}>, self {CARD}"


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Outline(HTMLParser):
    """Elements in document order as parallel lists, without those that are not shown.
    ``begin`` and ``end`` bound an element's text among the pieces, ``last`` its
    descendants among the elements."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = [""]
        self.attrs: list[dict] = [{}]
        self.parent: list[int] = [-1]
        self.begin: list[int] = [0]
        self.end: list[int] = [0]
        self.last: list[int] = [0]
        self.pieces: list[str] = []
        self.open: list[int] = [0]
        #: Open elements by tag, and all by tag, so that neither nesting nor length makes a
        #: search long.
        self.opened: Counter[str] = Counter()
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.hidden: list[str] = []
        self.feed(html)
        self.close()
        while self.open:
            self._pop()

    # -- building

    def _pop(self) -> None:
        at = self.open.pop()
        self.opened[self.tags[at]] -= 1
        if self.tags[at] in _APART:
            self.pieces.append(" ")
        self.end[at], self.last[at] = len(self.pieces), len(self.tags) - 1

    def _until(self, at: int) -> None:
        while self.open[-1] >= at:
            self._pop()

    def _close_open(self, tag: str) -> None:
        kinds, bounds = _LISTED.get(tag, (set(), set()))
        for at in reversed(self.open if any(self.opened[k] > 0 for k in kinds) else ()):
            if self.tags[at] in bounds:
                break
            if self.tags[at] in kinds:
                self._until(at)
                break
        if tag in _BLOCKS and self.opened["p"] > 0:
            for at in reversed(self.open):
                if self.tags[at] in ("table", "td", "th"):
                    break
                if self.tags[at] == "p":
                    self._until(at)
                    break
        if tag in _HEADINGS and self.tags[self.open[-1]] in _HEADINGS:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag in _HIDDEN:
                self.hidden.append(tag)
            return
        self._close_open(tag)
        if tag in _HIDDEN:
            self.hidden.append(tag)
            return
        at = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parent.append(self.open[-1])
        self.begin.append(len(self.pieces))
        self.end.append(-1)
        self.last.append(at)
        self.open.append(at)
        self.opened[tag] += 1
        self.by_tag[tag].append(at)
        if tag in _VOID:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements alone

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        ends = _HEADINGS if tag in _HEADINGS else {tag}
        for at in reversed(self.open if any(self.opened[k] > 0 for k in ends) else ()):
            if self.tags[at] in ends:
                self._until(at)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)

    # -- asking

    def text(self, at: int, most: int | None = None) -> str:
        """The text of an element, its first ``most`` characters."""
        if most is None:
            return squeeze("".join(self.pieces[self.begin[at] : self.end[at]]))
        out, length = [], 0
        for piece in self.pieces[self.begin[at] : self.end[at]]:
            out.append(piece)
            length += len("".join(piece.split()))
            if length > most:
                break
        return squeeze("".join(out))[:most]

    def inside(self, at: int, *tags: str) -> Iterator[int]:
        found = (self.by_tag[t][bisect_right(self.by_tag[t], at) : bisect_right(self.by_tag[t], self.last[at])] for t in tags)
        return iter(sorted(i for some in found for i in some))

    def first(self, at: int, *tags: str) -> int | None:
        found = [self.by_tag[t][k] for t in tags if (k := bisect_right(self.by_tag[t], at)) < len(self.by_tag[t])]
        return min((i for i in found if i <= self.last[at]), default=None)

    def closest(self, at: int, tags: set[str]) -> int | None:
        while at > 0:
            if self.tags[at] in tags:
                return at
            at = self.parent[at]
        return None

    def after(self, at: int) -> Iterator[int]:
        """The siblings that follow an element."""
        i, stop = self.last[at] + 1, self.last[self.parent[at]]
        while i <= stop:
            yield i
            i = self.last[i] + 1


def _picture(page: Outline, img: int | None, url: str) -> tuple[str | None, str]:
    """A picture's url if the page's own host has it, and its caption."""
    if img is None:
        return None, ""
    full = _full(page.attrs[img].get("src", ""), url)
    same = full is not None and urlsplit(full).hostname == urlsplit(url).hostname
    return full if same else None, squeeze(page.attrs[img].get("alt", ""))[:MAX_LABEL]


def _full(href: str, url: str) -> str | None:
    try:
        return canonical(urljoin(url, href)) if href else None
    except ValueError:
        return None


def outline(url: str | None, html: str | None) -> tuple:
    """Title, main text, paragraphs, sections, cards and what the page says of itself."""
    url, page = url or "", Outline(html or "")
    root = page.first(0, "main")
    body = page.first(0, "body")
    root = root if root is not None else (body if body is not None else 0)
    text = page.text(root)[:MAX_TEXT]
    h1, named = page.first(0, "h1"), page.first(0, "title")
    title = (page.text(h1) if h1 is not None else "") or (page.text(named) if named is not None else "")
    paragraphs = [page.text(p) for p in page.inside(0, "p")]
    sections = []
    for head in page.inside(0, "h2", "h3", "h4", "dt"):
        said = []
        for i in page.after(head):
            if page.tags[i] in _SECTION_ENDS:
                break
            said.append("".join(page.pieces[page.begin[i] : page.end[i]]))
        sections.append((page.text(head), squeeze("".join(said))[:MAX_TEXT]))
    cards = []
    for a in page.inside(root, "a"):
        target = _full(page.attrs[a].get("href", ""), url)
        if target is None:
            continue
        box = page.closest(a, _BOXES)
        box = page.parent[a] if box is None else box
        near, section = page.first(box, "h2", "h3", "h4"), page.closest(a, {"section"})
        over = page.first(section, "h2", "h3") if section is not None else None
        head = page.text(near, MAX_CONTEXT) if near is not None else ""
        label = page.text(a, MAX_CONTEXT) or head
        context = squeeze((page.text(over, MAX_CONTEXT) if over is not None else "") + " " + page.text(box, MAX_CONTEXT))[:MAX_CONTEXT]
        cards.append((len(cards), (head if head and is_list(label) else label)[:MAX_LABEL], target, context, *_picture(page, page.first(box, "img"), url)))
    figure = next((f for f in page.inside(root, "figure") if (c := page.first(f, "figcaption")) is not None and page.text(c)), None)
    own = [p for p in map(page.text, page.inside(root, "p")) if SAMPLE.search(p) or AWARDED.search(p)]
    img = page.first(figure, "img") if figure is not None else None
    self = (-1, title[:MAX_LABEL], canonical(url), " ".join(own[:3])[:MAX_CONTEXT], *_picture(page, img, url))
    return title[:250], text, paragraphs, sections, cards, self


#: Wordings of sample applications, of awards, and labels of lists.
SAMPLE = re.compile(r"\b(sample|example|successful|funded)\s+(?:grant\s+)?(?:applications?|proposals?|narratives?)\b|\b(?:application|proposal)\s+(?:examples?|samples?)\b", re.I | re.A)
AWARDED = re.compile(r"\b(recipients?|grantees?|award winners?|funded projects?|funded by|received (?:a |the )?grant|awarded (?:a |the )?grant|supported by|grant recipients?)\b", re.I | re.A)
LIST = re.compile(r"^(?:(?:view|see|all|past|previous|our|recent|current|\d{4})\s+)*(?:grant\s+)?(?:recipients|grantees|projects|awards|winners|stories|read more|learn more|apply now)$", re.I | re.A)


def is_list(label: str) -> bool:
    return bool(LIST.search(label))


def outlines(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` -> ``(page_id, url, title, text, paragraphs, sections,
    cards, self)``, one row per page; null and broken HTML gives what can be read of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "title", "text", "paragraphs", "sections", "cards", "self"]
        card = ("place", "title", "url", "context", "image", "alt")
        for b in batches:
            for at in range(0, len(b), 100):  # an outline may be longer than its page
                part, rows = b.iloc[at : at + 100], []
                for i, u, h in zip(part["page_id"], part["url"], part["html"], strict=True):
                    title, text, paragraphs, sections, cards, own = outline(u, h)
                    rows.append((i, u, title, text, paragraphs, [{"heading": x, "text": y} for x, y in sections], [dict(zip(card, c, strict=True)) for c in cards], dict(zip(card, own, strict=True))))
                yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)
