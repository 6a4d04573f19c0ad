"""The main text of web pages by the distribution of text over line blocks.

Markup is stripped and the page becomes lines, one for each block of text. The lengths of the lines are summed over
sliding windows. Where the sums surge, running text starts, and where they dive, it ends; what lies between is kept.

Lines are not all worth the same. Text in elements that hold no article, such as menus, headers, footers, sidebars,
notices, forms and comments by readers have length 0 and are never kept, and neither are lines outside a marked article
that consist mostly of links. A name like "no-sidebar" on what encloses the article, or most of the page, says nothing
about the text inside. Where a page marks its article, lines inside the mark are never so short that the text could dive
between them: on such pages the marks decide, not the windows. On other pages a run opens at a heading, a sentence or a line of
some length, so that the last line of a menu does not open it, and a page with little text has its fullest window as surge.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from playlog.llm.tables import as_texts, blocks

WINDOW = 3
SURGE = 60  # letters in a window that start running text
BACK = 4  # lines before that in which a heading belongs to it

# Elements by what they are to a reader.
_UNSEEN = "script style noscript template svg math iframe object canvas audio video textarea select title".split()
_ASIDE = "nav header footer aside form button menu dialog fieldset".split()
_ARTICLE = "article main".split()
_INLINE = (
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr"
).split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Words in the class, id or role of an element that say that it is no part of the article.
_NAMES = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer discussion disqus footer form gdpr header masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices pager pagination popup privacy promo promoted promotion recommended related "
    "reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toc toolbar widget alert complementary contentinfo"
).split()

_NO_ARTICLE = "ad ads advert comment comments promo related replies reply sponsored".split()

_HEADINGS = "h1 h2 h3 h4 h5 h6".split()

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"<]*"|'[^'<]*'|[^>])*+)>""", re.S)
_CLOSINGS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _UNSEEN}
_TAG_STARTS = re.compile(r"</?[a-zA-Z]")
_SENTENCE = re.compile(r"""[.!?:;…]["')\]»”’]*\Z""")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+")
_NAME, _PART, _UNSHOWN = 1, 2, 3  # what closes an element off: its kind or a whole name, a part of a name, being hidden
_SPACE = re.compile(r"\s+")

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


class _Page:
    """The lines of a page: text, letters inside links, whether inside a marked article, the element; and what closes
    lines off."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, str]] = []
        # First and last line of the elements that close off, why, and the articles inside: the first and the last.
        self.offs: list[list[int]] = []
        # First and last line of the articles that are not off by themselves.
        self.articles: list[list[int]] = []
        self._text: list[str] = []
        self._linked = 0
        # Open elements: name, whether it marks the article, whether it is a link, the block it is in; and what is to be told
        # their end.
        self._open: list[tuple[str, bool, bool, str]] = []
        self._names: Counter[str] = Counter()
        self._ends: list[tuple[list[int] | None, list[int] | None]] = []
        self._counts = [0, 0]

    def _close(self, place: int) -> None:
        """Close the open elements from a place on."""
        for name, *marks, _ in self._open[place:]:
            self._names[name] -= 1
            self._counts = [n - mark for n, mark in zip(self._counts, marks, strict=True)]
        for off, article in self._ends[place:]:
            if off:
                off[1], off[4] = len(self.lines), len(self.articles)
            if article:
                article[1] = len(self.lines)
        del self._open[place:], self._ends[place:]

    def finish(self) -> None:
        self.end_line()
        self._close(0)

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        if text:
            self.lines.append((text, self._linked, self._counts[0] > 0, self._open[-1][3] if self._open else ""))
        self._text, self._linked = [], 0

    def text(self, text: str) -> None:
        text = unescape(text)
        self._text.append(text)
        if self._counts[1]:
            self._linked += len("".join(text.split()))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name not in _INLINE:
            self.end_line()
        if name in _VOID or attributes.endswith("/"):
            return
        named = [next(x for x in found.groups() if x is not None).lower() for found in _NAMED.finditer(attributes)]
        article = name in _ARTICLE
        # The header of an article holds its title.
        off = 0
        if _HIDDEN.search(attributes):
            off = _UNSHOWN
        elif name in _ASIDE and not (name == "header" and self._counts[0]):
            off = _NAME
        elif name not in ("body", "html"):
            listed = _NO_ARTICLE if article else _NAMES
            if any(not set(own.split()).isdisjoint(listed) for own in named):
                off = _NAME
            elif not self._counts[0] and any(not set(_PARTS.findall(own)).isdisjoint(listed) for own in named):
                # Inside an article a part of a name, as in "notice-board", says too little.
                off = _PART
        # A paragraph ends where the next block starts, as its closing tag may be left out.
        if name not in _INLINE and self._open and self._open[-1][0] in ("p", *_HEADINGS):
            self._close(len(self._open) - 1)
        here, ends = len(self.lines), (None, None)
        if off:
            ends = ([here, here, off, len(self.articles), 0], None)
            self.offs.append(ends[0])
        elif article:
            ends = (None, [here, here])
            self.articles.append(ends[1])
        self._ends.append(ends)
        block = name if name not in _INLINE else self._open[-1][3] if self._open else ""
        self._open.append((name, article, name == "a", block))
        self._names[name] += 1
        self._counts = [n + mark for n, mark in zip(self._counts, (article, name == "a"), strict=True)]

    def end(self, name: str) -> None:
        if name not in _INLINE:
            self.end_line()
        if not self._names[name]:
            return
        for place in range(len(self._open) - 1, -1, -1):
            if self._open[place][0] == name:
                # What was left open inside ends too.
                self._close(place)
                break


def _page(html: str) -> _Page:
    """The lines of a page, in one pass: what has been looked for to the end of the page in vain is not looked for again."""
    page, at, text = _Page(), 0, 0
    last, tags, unclosed = html.rfind(">"), True, set()
    while (at := html.find("<", at)) >= 0:
        match, end = None, -1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            end = len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at) + 1 if at < last else -1
        elif tags and at < last and (match := _TAG.match(html, at)):
            end = match.end()
        elif at + 1 < len(html) and (html[at + 1].isalpha() or html[at + 1] == "/"):
            # A tag does not end before the page does, and neither will those after it: no quotes are open here.
            tags = tags and not _TAG_STARTS.match(html, at)
        if end < 0:
            at += 1
            continue
        if at > text:
            page.text(html[text:at])
        at = end
        name = match[2].lower() if match else ""
        if name in _UNSEEN:
            # Up to the closing tag nothing counts, whatever it looks like.
            closing = None if match[1] or name in unclosed else _CLOSINGS[name].search(html, at)
            if closing:
                at = html.find(">", closing.end()) + 1 or len(html)
            elif not match[1]:
                unclosed.add(name)
                at = len(html) if name in ("script", "style") else at
        elif match and match[1]:
            page.end(name)
        elif match:
            page.start(name, match[3])
        text = at
    page.text(html[text:])
    page.finish()
    return page


def _off(page: _Page, letters: np.ndarray) -> np.ndarray:
    """Which lines are closed off; what encloses the article, or most of the page, may not mean what its names say."""
    before = np.concatenate([[0], np.cumsum(letters)])
    sizes = [int(before[last] - before[first]) for first, last in page.articles]
    inner, reached = 0, 0
    for (first, last), size in zip(page.articles, sizes, strict=True):
        # Articles inside others are counted with them.
        if first >= reached:
            inner, reached = inner + size, last
    chief = np.concatenate([[0], np.cumsum([2 * size > inner for size in sizes])])
    most = np.concatenate([[0], np.cumsum([2 * size > before[-1] for size in sizes])])
    changes = np.zeros(len(letters) + 1, np.int64)
    for first, last, why, start, end in page.offs:
        if why == _NAME and most[end] > most[start]:
            continue
        if why == _PART and (chief[end] > chief[start] or 2 * (before[last] - before[first]) > before[-1]):
            continue
        changes[first] += 1
        changes[last] -= 1
    return np.cumsum(changes[:-1]) > 0


def _runs(lengths: np.ndarray, opens: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and a dive of the windows over them.

    A window holds a line and those after it. A run starts at a line that may open one and whose window surges, or at a heading
    a few lines before it; it ends where a window is empty. Where nothing surges, the fullest window of the page does.
    """
    padded = np.concatenate([lengths, np.zeros(WINDOW - 1, np.int64)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW).sum(axis=1)
    fullest = int(windows[opens].max(initial=0))
    surge = min(SURGE, fullest)
    kept, inside, ended = np.zeros(len(lengths), bool), False, 0
    for line in range(len(lengths)):
        if not inside and opens[line] and surge and windows[line] >= surge:
            inside = True
            # Date, author and the like may stand between a heading and the text.
            for before in range(line - 1, max(ended, line - BACK) - 1, -1):
                if not lengths[before]:
                    break
                if heads[before]:
                    kept[before:line] = True
                    break
        elif inside and windows[line] == 0:
            inside, ended = False, line
        kept[line] |= inside
    return kept & (lengths > 0)


def main_text(html: str) -> str:
    """The main text of a page, a block a line; empty where there is none."""
    page = _page(html)
    lines = page.lines
    if not lines:
        return ""
    letters = np.array([len(text.replace(" ", "")) for text, *_ in lines])
    linked = np.array([own for _, own, *_ in lines])
    off = _off(page, letters)
    marked = np.array([own for _, _, own, _ in lines]) & ~off
    if marked.any():
        lengths = np.where(marked, np.maximum(letters, SURGE), 0)
        kept = _runs(lengths, lengths > 0, np.zeros(len(lines), bool))
    else:
        blocks_of = [block for *_, block in lines]
        heads = np.array([block in _HEADINGS for block in blocks_of])
        # A whole paragraph that is a link is text, a line of links in a list is none.
        text = (2 * linked <= letters) | (np.array([block == "p" for block in blocks_of]) & (letters >= SURGE))
        rights = np.array([bool(_RIGHTS.match(line)) for line, *_ in lines])
        lengths = np.where(~off & text & ~rights, letters, 0)
        # Short lines that are no sentence, such as those of a menu, neither open a run nor end it.
        ends = np.array([bool(_SENTENCE.search(line)) for line, *_ in lines])
        opens = (lengths > 0) & (heads | ends | (letters >= SURGE // 2))
        kept = _runs(lengths, opens, heads)
        told = np.flatnonzero(kept & (ends | (letters >= SURGE // 2)))
        if len(told):
            for line in range(len(lines)):
                if kept[line] and not opens[line]:
                    following = told[np.searchsorted(told, line)] if line < told[-1] else -1
                    kept[line] = following >= 0 and bool((lengths[line:following] > 0).all())
    return "\n".join(text for (text, *_), keep in zip(lines, kept, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "html"):
        texts = [main_text(html) if html else "" for html in as_texts(block.column("html"))]
        yield pa.record_batch(
            {
                "page_id": block.column("page_id"),
                "url": block.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(text) for text in texts], pa.int64()),
            }
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, a row for each input row.

    ``pages`` has ``page_id, url, html``. A null or empty page, or one without running text, has an empty text. Null ids
    and addresses stay null, repeated rows stay repeated, an empty table gives an empty one. There is no shuffle.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, EXTRACTED)
