"""The main text of web pages by rules over blocks, in two passes.

A page is cut into blocks where block elements begin and end. What stands in menus, footers, forms and the like (by element,
role, class or id) is out. The first pass judges every other block by itself: mostly links is boilerplate; long enough with
many stop words and few links is text; long with hardly any stop words is boilerplate, unless it stands in an article. What
is left undecided, mostly short blocks, takes in the second pass the label of the nearest decided block of the smallest
element around it that holds one (ties: text); an article without decided blocks is text, as is a page without any.

Null html is empty; a page without text gives the empty text. Broken markup (unclosed or stray tags, cut pages) is read as
far as it goes. Rows are kept as they are, repeated or with null ids; only the named columns are read and returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """a about all an and are as at be been but by can for from had has have he her his i if in is it its more not of on or our she
    so that the their there they this to was we were what which who will with would you
    au aux avec ce dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour plus que qui sa se son sur un une vous
    als auch auf aus bei das dass dem den der die ein eine einen er es für hat ich im ist mit nach nicht noch oder sich sie sind und von war wie wir zu zum zur
    al como con del el ella los las lo muy no para pero por si sin su sus y
    che di gli non per sono della il nel una
    da do dos em na não nos os um uma ao mais
    aan dat een het met niet op te van voor zijn""".split()
)

#: Words a block must have to be decided by its stop words, and the shares of stop words that decide.
LEAST_WORDS = 12
TEXT_STOPS = 0.15
FEW_STOPS = 0.05
#: Shares of a block's characters that stand in links: above the first it is boilerplate, up to the second it may be text.
MANY_LINKS = 0.5
SOME_LINKS = 0.3
#: Characters of a block that count as text without stop words where no block of the page has them.
LONG = 200

#: Elements of HTML by what they do to a page's text.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
_REGIONS = frozenset("article main section div body td th ul ol dl table blockquote figure aside nav header footer form center".split())
_CHROME = frozenset("head nav aside footer form noscript template svg math object applet canvas audio video select datalist button fieldset dialog menu map".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
#: An element that begins ends an open one of these, up to the nearest of those that may hold another list or table.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

#: What a class name says of a page's settings, not of what stands in the element: no-sidebar, comments-open.
_SETTING = re.compile(r"(?<![a-z])(?:no|has|with|without|show|hide)-[a-z]+|(?<![a-z])[a-z]+-(?:open|closed|enabled|disabled|on|off)(?![a-z])")
#: Parts of class names and ids. Readers' comments stay out even where they are marked up as articles.
_COMMENTS = re.compile(r"comments?(?![a-z]*ar)|disqus|(?<![a-z])(?:repl(?:y|ies)|respond|reactions|discussion|guestbook)(?![a-z])")
_PARTS = re.compile(
    r"advert|sponsor|promo|sidebar|side-?bar|breadcrumb|footer|navbar|navigation|masthead|cookie|consent|newsletter|subscri|popup|banner|copyright|toolbar|pagination|skip-?link"
    r"|(?<![a-z])(?:ads?|adv|nav|menu|submenu|topmenu|menubar|foot|aside|widgets?|notices?|alerts?|gdpr|modal|overlay|signup|sign-?in|login|share|sharing|social|related|recommended"
    r"|recommendations|trending|pager|search|toc|legal|disclaimer|tags|taboola|outbrain|hidden|sr-only|noprint|byline-links|topbar|teasers?|paywall)(?![a-z])"
)
_HEADER = re.compile(r"(?<![a-z])(?:header|site-?header|page-?header|top-?header)(?![a-z])")
_OF_ARTICLE = re.compile(r"article|post|entry|story|content")
_ARTICLE = re.compile(r"(?<![a-z])(?:article-?(?:body|text|content)?|post-?(?:body|content)|entry-?(?:content|body)?|story-?(?:body|content)?|main-?(?:content|text)?|content)(?![a-z])")

#: A comment, a declaration, or a tag whose quoted values may hold '>'. Nothing is tried twice.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block(NamedTuple):
    """One block of a page; ``label`` is text or boilerplate, ``why`` what decided."""

    text: str
    label: str
    why: str


class _Kind(NamedTuple):
    """What an element's name and attributes say of the text in it."""

    chrome: bool = False
    by_name: bool = False  # by class or id alone, or a form: overruled by the page's main element inside it
    comments: bool = False
    header: bool = False  # chrome unless it stands in an article
    article: bool = False
    main: bool = False


@dataclass(slots=True)
class _Region:
    parent: int
    article: bool
    first: int
    end: int = 0


@dataclass(slots=True)
class _Chrome:
    parent: int
    on: bool
    by_name: bool = False
    comments: bool = False
    holds: int = 0


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> _Kind:
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    if tag in ("html", "body"):
        return _Kind()
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(found.get("style", "").lower()))
    names = " ".join(_CAMEL.sub("-", found.get(n, "")) for n in ("class", "id", "itemprop", "aria-label")).lower().replace("_", "-")
    names = _SETTING.sub(" ", names)
    if _COMMENTS.search(names):
        return _Kind(chrome=True, by_name=True, comments=True)
    if unseen:
        return _Kind(chrome=True)
    if tag in ("article", "main") or role in ("article", "main"):
        return _Kind(article=True, main=True)
    if tag in _CHROME or role in _CHROME_ROLES:
        return _Kind(chrome=True, by_name=tag == "form")
    if _PARTS.search(names):
        return _Kind(chrome=True, by_name=True)
    if tag == "header" or _HEADER.search(names) and not _OF_ARTICLE.search(names):
        return _Kind(chrome=True, by_name=tag != "header", header=True)
    return _Kind(article=bool(_ARTICLE.search(names)))


class _Page:
    """A page's blocks, the elements around each, and which of those are chrome."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.where: list[tuple[int, int]] = []  # region and chrome element of each block
        self.regions = [_Region(-1, False, 0)]
        self.chrome = [_Chrome(-1, False)]
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]  # element, region, chrome
        self.depth: dict[str, int] = {}
        self.pieces: list[str] = []
        self.in_link = self.linked_now = self.breaks = 0
        self.main_met = False
        self._read(html)

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while at < len(html):
            token = _TOKEN.search(html, at, last + 1) if at <= last else None
            cut = html.find("<!--", max(at, last)) if token is None else -1
            if token is None:
                self._text(html[at : cut if cut >= 0 else _unended(html, at)])
                break
            self._text(html[at : token.start()])
            at = token.end()
            name = token[2] or token[5]
            if name is None:
                if token[0].startswith("<!--") and not token[0].endswith(">"):
                    break
                continue
            name = name.lower()
            if token[1] or token[4]:
                self._end(name)
                continue
            self._begin(name, token[3] or token[6] or "")
            if name in _RAW:
                ended = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = ended.end() if ended else len(html)
                self._end(name)
        self._close_block()
        while len(self.open) > 1:
            self._pop()
        self.regions[0].end = len(self.texts)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            if not text.isspace():
                self.breaks = 0
                if self.in_link:
                    self.linked_now += len("".join(text.split()))

    def _close_block(self) -> None:
        text = " ".join(unescape("".join(self.pieces)).split()) if self.pieces else ""
        if text:
            self.texts.append(text)
            self.linked.append(self.linked_now)
            self.where.append(self.open[-1][1:])
        self.pieces, self.linked_now, self.breaks = [], 0, 0

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self._close_block()
            return
        kind = _kind(name, attributes)
        inline = name in _INLINE
        if not inline or kind.chrome:
            self._close_block()
        if name in _ENDS_PARAGRAPH and self.depth.get("p"):
            self._pop_to("p", _REGIONS)
        if name in _SIBLINGS:
            for other in _SIBLINGS[name][0]:
                if self.depth.get(other):
                    self._pop_to(other, _SIBLINGS[name][1])
        if name in _VOID or attributes.endswith("/") and name in ("svg", "path", "use"):
            return
        region, chrome = self.open[-1][1:]
        if kind.main and not self.main_met:
            self.main_met, above = True, chrome
            while above > 0:  # a page laid out inside a form or an element of a telling name
                self.chrome[above].on &= not self.chrome[above].by_name or self.chrome[above].comments
                above = self.chrome[above].parent
        within = self.regions[region].article
        if name in _REGIONS or kind.article:
            self.regions.append(_Region(region, kind.article or within, len(self.texts)))
            region = len(self.regions) - 1
        if kind.chrome and not (kind.header and within):
            self.chrome[chrome].holds += 1
            self.chrome.append(_Chrome(chrome, True, kind.by_name, kind.comments))
            chrome = len(self.chrome) - 1
        self.open.append((name, region, chrome))
        self.depth[name] = self.depth.get(name, 0) + 1
        if name == "a":
            self.in_link += 1

    def _end(self, name: str) -> None:
        if name == "p" or name not in _INLINE:
            self._close_block()
        if self.depth.get(name):
            self._pop_to(name, ())

    def _pop_to(self, name: str, stops) -> None:
        """End the innermost open ``name`` and what is open in it, unless one of ``stops`` stands between."""
        if stops:
            for held, _, _ in reversed(self.open):
                if held == name:
                    break
                if held in stops or not held:
                    return
        while self._pop() != name:
            pass

    def _pop(self) -> str:
        name, region, chrome = self.open[-1]
        if (region, chrome) != self.open[-2][1:]:
            self._close_block()
        self.open.pop()
        if region != self.open[-1][1]:
            self.regions[region].end = len(self.texts)
        self.depth[name] -= 1
        self.in_link -= name == "a"
        return name

    def judged(self) -> list[Block]:
        """All blocks, labelled."""
        out = self._judged()
        if self.texts and not any(b.label == "text" for b in out):
            wrappers = [c for c in self.chrome if c.on and c.by_name and c.holds and not c.comments]
            for c in wrappers:  # all of the page stands in elements named like chrome that hold the chrome as well
                c.on = False
            if wrappers:
                return self._judged()
        return out

    def _judged(self) -> list[Block]:
        n = len(self.texts)
        out_of_it = [False] * len(self.chrome)
        for i, c in enumerate(self.chrome):
            out_of_it[i] = c.on or c.parent >= 0 and out_of_it[c.parent]
        label, why = [""] * n, [""] * n
        undecided = []
        for i, text in enumerate(self.texts):
            region, chrome = self.where[i]
            if out_of_it[chrome]:
                label[i], why[i] = "boilerplate", "element"
                continue
            label[i], why[i] = self._first_pass(text, self.linked[i], self.regions[region].article)
            if not label[i]:
                undecided.append(i)
        if "text" not in label:  # a language without known stop words
            for i in range(n):
                if why[i] in ("", "stop words") and len(self.texts[i]) >= LONG and self.linked[i] <= SOME_LINKS * len(self.texts[i]):
                    label[i], why[i] = "text", "length"
            undecided = [i for i in undecided if not label[i]]
        self._second_pass(label, why, undecided)
        return [Block(*b) for b in zip(self.texts, label, why)]

    def _first_pass(self, text: str, linked: int, in_article: bool) -> tuple[str, str]:
        links = linked / max(1, len(text) - text.count(" "))
        if links > MANY_LINKS:
            return "boilerplate", "links"
        words = _WORD.findall(text.lower())
        if "©" in text and len(words) < 3 * LEAST_WORDS and not in_article:
            return "boilerplate", "copyright"
        if len(words) < LEAST_WORDS:
            return "", ""
        stops = sum(w in STOP_WORDS for w in words) / len(words)
        if stops >= TEXT_STOPS and links <= SOME_LINKS:
            return "text", "stop words"
        if stops < FEW_STOPS and not in_article:
            return "boilerplate", "stop words"
        return "", ""

    def _second_pass(self, label: list[str], why: list[str], undecided: list[int]) -> None:
        """Label what is undecided by its neighbours. What stands in chrome elements is no neighbour."""
        n = len(label)
        decided = [bool(label[i]) and why[i] != "element" for i in range(n)]
        before, after, sums = [-1] * n, [n] * n, [0] * (n + 1)
        for i in range(n):
            before[i] = i if decided[i] else before[i - 1] if i else -1
            sums[i + 1] = sums[i] + decided[i]
        for i in range(n - 1, -1, -1):
            after[i] = i if decided[i] else after[i + 1] if i + 1 < n else n
        reach = []
        for i, r in enumerate(self.regions):
            own = sums[r.end] > sums[r.first] or r.parent < 0 or r.article and not self.regions[r.parent].article
            reach.append(i if own else reach[r.parent])
        first_labels = list(label)
        for i in undecided:
            around = self.regions[reach[self.where[i][0]]]
            near = [(abs(i - j), first_labels[j] != "text", j) for j in (before[i], after[i]) if around.first <= j < around.end]
            if near:
                label[i], why[i] = first_labels[min(near)[2]], "neighbour"
            else:
                label[i], why[i] = "text", "alone"


def _unended(html: str, at: int) -> int:
    """Where a tag begins that the page's end cuts off; else the page's length."""
    cut = re.compile(r"<[/!?a-zA-Z]").search(html, at)
    return cut.start() if cut else len(html)


def blocks(html: str | None) -> list[Block]:
    """Every block of a page with its label, in page order."""
    return _Page(html).judged() if html else []


def main_text(html: str | None) -> str:
    """The blocks of a page that are text, a line each."""
    return "\n".join(b.text for b in blocks(html) if b.label == "text")


def extracted(html: Column) -> Column:
    """``main_text`` of a column."""
    work = lambda pages: pages.map(main_text)
    work.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "string")(html)


def labelled_blocks(html: Column) -> Column:
    """Array of (text, label, why) of every block of a page, for looking into the rules."""
    work = lambda pages: pages.map(lambda p: [b._asdict() for b in blocks(p)])
    work.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "array<struct<text:string,label:string,why:string>>")(html)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns ``keys`` of ``pages``, the main text of each page and its number of code points. No shuffle: a row a page."""
    done = pages.select(*(pages[f"`{k}`"] for k in keys), extracted(pages[f"`{html}`"]).alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
