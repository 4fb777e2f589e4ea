"""Flat text blocks of a web page: runs of text between the tags that open or close a block."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements that begin and end blocks; those whose text is never shown; roles and name parts that mark what is no part
#: of an article. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("button datalist iframe noembed noframes noscript object option script select style svg template textarea title video audio canvas math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDES = frozenset("aside dialog footer menu nav".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus discussion consent cookie cookies gdpr notice notices alert popup modal overlay "
    "footer foot copyright legal header masthead topbar login signup subscribe subscription newsletter menu nav navbar navigation navi pager pagination related recommended recommendations share sharing social sidebar sidebars toolbar widget widgets tags".split()
)
#: Stems that mark such an element wherever they stand in a name; parts by which a name speaks of something else (a page
#: "with sidebar", an article's own header). Fixed values.
ASIDE_STEMS = ("adsby", "advert", "sponsor", "cookie", "comment", "sidebar", "breadcrumb", "newsletter", "disqus", "navbar", "footer")
NEGATIONS = frozenset("has with no without".split())
HEADS, OF_ARTICLES = frozenset("header masthead banner".split()), frozenset("article post entry content story".split())
#: Elements that one of their own kind, opened inside, closes.
CLOSES_ITSELF = frozenset("p li dt dd tr td th".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"  # text that is no markup
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)"  # other markup, or one that the page's end cuts
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z)", re.IGNORECASE)
WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: text, words, words in links, whether in an article, whether in something beside it
Block = tuple[str, int, int, bool, bool]


def marked(attributes: str, inside: bool) -> bool:
    """Whether an element's attributes say that it isn't part of an article, or isn't shown. `inside`: an article."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return True
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True
        if name in ("class", "id") and any(told(text, inside) for text in value.split()):
            return True
    return False


def told(text: str, inside: bool) -> bool:
    """Whether one name of an element says so. An article's header is part of it."""
    parts = {part.lower() for part in WORD_PARTS.findall(text)}
    if parts & NEGATIONS:
        return False
    own = parts & ASIDE_NAMES
    if inside or parts & OF_ARTICLES:
        own -= HEADS
    return bool(own) or any(stem in text.lower() for stem in ASIDE_STEMS)


class Page:
    """Open elements and the block being read."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # name, in an article, beside it, in a form, shown
        self.counts: Counter[str] = Counter()
        self.article, self.beside, self.form, self.shown, self.link = False, False, False, True, False
        self.parts: list[tuple[str, bool]] = []

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join([t for t, _ in self.parts])).split())
        if text:
            links = sum(len(html.unescape(t).split()) for t, link in self.parts if link)
            n = text.count(" ") + 1
            self.blocks.append((text, n, min(n, links), self.article, self.beside or self.form))
        self.parts = []

    def push(self, name: str, attributes: str) -> None:
        self.open.append((name, self.article, self.beside, self.form, self.shown))
        self.counts[name] += 1
        aside = marked(attributes, self.article) if attributes and name not in ("html", "body") else False
        self.beside = self.beside or aside or name in ASIDES or (name == "header" and not self.article)
        if name in ("article", "main"):
            self.article, self.form = True, False  # a form may go around a whole page
        elif name == "form":
            self.form = True
        self.shown = self.shown and name not in SILENT and name != "head"

    def pop(self, name: str) -> None:
        while self.open:
            last, self.article, self.beside, self.form, self.shown = self.open.pop()
            self.counts[last] -= 1
            if last == name:
                return

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = True
        elif name == "br":
            self.parts.append((" ", self.link))
        elif name in BLOCKS or name in SILENT:
            if name in BLOCKS:
                self.end_block()
                if self.open and (self.open[-1][0] == "p" or (self.open[-1][0] == name and name in CLOSES_ITSELF)):
                    self.pop(self.open[-1][0])
                if name == "body":
                    self.shown = True
            if name not in VOID and not attributes.rstrip().endswith("/"):
                self.push(name, attributes)

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif name in BLOCKS or name in SILENT:
            if name in BLOCKS:
                self.end_block()
                if name not in ("a", "div", "section"):
                    self.link = False
            if self.counts[name]:
                self.pop(name)

    def say(self, text: str) -> None:
        if self.shown:
            self.parts.append((text, self.link))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order, with references decoded and white space within a block as one space."""
    read = Page()
    for token in TOKEN.finditer(page):
        if (text := token["text"]) is not None:
            read.say(text)
        elif name := token["name"]:
            (read.end if token["close"] else lambda n: read.start(n, token["attributes"]))(name.lower())  # noqa: B023
        elif token["raw"] is None and not token[0].startswith("<!"):
            name = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", token[0])
            if name and token[0].endswith(">"):
                (read.end if name[1] else lambda n: read.start(n, ""))(name[2].lower())
    read.end_block()
    return read.blocks
