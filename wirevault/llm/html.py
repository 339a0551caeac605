"""The main text of web pages by the distribution of text over blocks of lines.

Markup is stripped so that every block element becomes a line. A line weighs as many characters as
it has outside of links; lines of menus, adverts and the like (told by their element, class or id)
weigh nothing and are never kept. Weights are summed over a window that slides along the lines: the
text surges where the sum rises over a threshold and dives where it has fallen again, and what
stands between a surge and a dive is a run. An `article` or `main` element is set off from the rest
by empty lines, and none of its lines is too short to surge. The heaviest run wins, with the other
runs of the same article; without such an element all runs are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

WINDOW = 3  # lines
SURGE = 86  # characters in a window
# An article that is lighter than text outside of it by more than this factor is a teaser.
TEASER = 4

# Kinds of elements, and words in classes and ids of elements that hold no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img picture".split()
)
REGION = frozenset("article main".split())
DROPPED = frozenset(
    "nav aside footer form noscript template svg math select button datalist fieldset dialog menu canvas audio video "
    "object applet map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion "
    "banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside masthead header footer "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus respond reply replies share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager search searchform copyright disclaimer form".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
# Class names that begin so tell what is beside or missing, as in `has-sidebar`.
ABOUT_OTHERS = frozenset("has with without no non is not hide show".split())
# An opened element ends another one that stands open.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
# What an opened element cannot end beyond.
HOLDS = frozenset("ul ol dl table tbody thead tfoot article main section div body".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<raw>script|style|title|textarea|iframe|xmp|noframes|noembed)\b[^>]*>.*?(?:</(?P=raw)\b[^<>]*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<more>(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|"[^"]{0,4096}+"|'[^']{0,4096}+')*+(?=>)|[^<>]*)>?""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


def _attributes(more: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(more)}


def _named(attributes: dict[str, str], names: frozenset) -> bool:
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if words and words[0] not in ABOUT_OTHERS and not names.isdisjoint(words):
            return True
    return False


class _Lines:
    """Turns markup into lines: (text or None where it is dropped, weight, region)."""

    def __init__(self, by_name: bool):
        self.by_name = by_name
        self.lines: list[tuple[str | None, int, int]] = []
        self.stack: list[tuple[str, bool, bool]] = []  # tag, dropped, region
        self.open: Counter = Counter()
        self.dropped = self.links = self.regions = self.region = self.named_chars = 0
        self.parts: list[tuple[str, bool]] = []  # of the line, and whether inside a link
        self.gone = 0  # characters dropped in the place of the line

    def text(self, raw: str) -> None:
        if not self.dropped:
            self.parts.append((raw, self.links > 0))
        elif raw and not raw.isspace():
            self.gone += len(raw)
            self.named_chars += len(raw) if self.dropped_by_name() else 0

    def flush(self) -> None:
        text = " ".join(unescape("".join(p for p, _ in self.parts)).split()) if self.parts else ""
        if text:
            linked = sum(len(p.strip()) for p, link in self.parts if link)
            self.lines.append((text, max(0, len(text) - linked), self.region))
        elif self.gone:
            self.lines.append((None, 0, self.region))
        self.parts, self.gone = [], 0

    def dropped_by_name(self) -> bool:
        return not any(dropped and tag in DROPPED and tag != "form" for tag, dropped, _ in self.stack)

    def border(self) -> None:
        self.lines.extend([(None, 0, 0)] * WINDOW)

    def start(self, tag: str, more: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        attributes = _attributes(more) if more else {}
        dropped = self._is_dropped(tag, attributes)
        if tag in INLINE and not dropped:
            if tag == "a" and "href" in more.lower():
                if self.stack and self.stack[-1][0] == "a":
                    self._pop()
                self._push(tag, False, False)
                self.links += 1
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in ("td", "th") and not dropped:
            self.text(" ")  # cells of a row are one line
        elif tag not in INLINE:
            self.flush()
        self._imply_ends(tag)
        region = not dropped and (tag in REGION or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody")
        if region and not self.region and not self.dropped:
            self.flush()
            self.border()
            self.regions += 1
            self.region = self.regions
        else:
            region = False
        if more.endswith("/") and tag in ("svg", "math"):
            return
        self._push(tag, dropped, region)
        self.dropped += dropped

    def _is_dropped(self, tag: str, attributes: dict[str, str]) -> bool:
        if tag in DROPPED:
            return self.by_name or tag != "form"
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and not self.region:
            return True
        if not attributes:
            return False
        if "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        if "style" in attributes and "display:none" in attributes["style"].replace(" ", "").lower():
            return True
        if attributes.get("role", "").lower() in ROLES:
            return True
        if not self.by_name:
            return False
        if tag == "article":
            return _named(attributes, COMMENTS)
        return _named(attributes, NAMES - {"header"} if self.region else NAMES)

    def _push(self, tag: str, dropped: bool, region: bool) -> None:
        self.stack.append((tag, dropped, region))
        self.open[tag] += 1

    def _pop(self) -> str:
        tag, dropped, region = self.stack.pop()
        self.open[tag] -= 1
        if tag == "a":
            self.links -= 1
        if region or (dropped and tag not in INLINE):
            self.flush()
        self.dropped -= dropped
        if region:
            self.region = 0
            self.border()
        return tag

    def _imply_ends(self, tag: str) -> None:
        if tag not in INLINE and self.open["p"] and self.stack[-1][0] in ("p", "a"):
            while self.stack and self.stack[-1][0] in ("p", "a"):
                self._pop()
        wanted = ENDS.get(tag)
        if wanted and any(self.open[t] for t in wanted):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in wanted:
                    while len(self.stack) > k:
                        self._pop()
                    if tag != "tr":
                        return
                elif self.stack[k][0] in HOLDS:
                    return

    def end(self, tag: str) -> None:
        if tag not in INLINE and tag not in ("td", "th"):
            self.flush()
        if self.open[tag]:
            while self._pop() != tag:
                pass


def page_lines(html: str, *, by_name: bool = True) -> tuple[list[tuple[str | None, int, int]], int]:
    """The lines of a page, and the characters that were dropped for a class, an id or a form only."""
    lines, at = _Lines(by_name), 0
    for token in _TOKEN.finditer(html):
        lines.text(html[at : token.start()])
        at = token.end()
        if token["raw"]:
            if token["raw"].lower() in ("textarea", "iframe"):
                lines.flush()
        elif token["tag"]:
            tag = token["tag"].lower()
            lines.end(tag) if token["end"] else lines.start(tag, token["more"])
    lines.text(html[at:])
    lines.flush()
    return lines.lines, lines.named_chars


def runs(weights: list[int], *, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Begin and end of the lines between a surge and a dive; ends are lines that weigh something.

    A line belongs to a run if a window over it sums up to `surge`, or to the most that any window
    of the page has where that is less.
    """
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    sums = [total[min(n, i + window)] - total[max(0, i)] for i in range(1 - window, n)]
    limit = min(surge, max(sums, default=0))
    if not limit:
        return []
    found, begin, last = [], None, None
    for i, w in enumerate(weights):
        if max(sums[i : i + window]) >= limit:
            if w:
                begin, last = i if begin is None else begin, i
        elif begin is not None:
            found.append((begin, last + 1))
            begin = None
    if begin is not None:
        found.append((begin, last + 1))
    return found


def main_text(html: str | None, *, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text of a page between its surges and dives, one block a line; empty without any."""
    if not html:
        return ""
    lines, named = page_lines(html)
    left = sum(w for _, w, _ in lines)
    if left < min(surge, named) and not any(region and text for text, _, region in lines):
        lines, _ = page_lines(html, by_name=False)  # a wrapper of the whole page has a telling name
    # No line of an article is too short to surge.
    weights = [max(w, surge) if region and text else w for text, w, region in lines]
    found = runs(weights, window=window, surge=surge)
    if not found:
        return ""
    heavy: Counter = Counter()
    for begin, end in found:
        heavy[lines[begin][2]] += sum(w for _, w, _ in lines[begin:end])
    region = max((r for r in heavy if r), key=lambda r: (heavy[r], -r), default=0)
    if region and heavy[0] > TEASER * max(heavy[region], surge):
        region = 0
    kept = (text for begin, end in found if lines[begin][2] == region for text, _, _ in lines[begin:end])
    return "\n".join(text for text in kept if text)


def main_texts(pages: DataFrame, *, html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """`pages` with the columns `_text` (its main text) and `_n_chars` in place of the markup.

    A null or empty page, and one without any text of its own, has an empty text. Repeated rows are
    extracted each. Markup is read whole, whatever its length, in one pass; what is broken in it is
    read as browsers do, roughly. Other columns pass through, columns named `_text` or `_n_chars` are
    replaced. An empty table gives no rows. No data is moved between tasks.
    """
    kept = [f for f in pages.schema if f.name not in (html, "_text", "_n_chars")]
    schema = StructType([*kept, StructField("_text", StringType()), StructField("_n_chars", LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), window=window, surge=surge) for page in batch.column(html)]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*(f.name for f in kept), html).mapInArrow(extracted, schema)
