"""Elements of web pages by CSS selectors, in one pass over a page's tags.

A selector is a list of alternatives separated by commas; each is a tag, classes, an id and attributes run together, such as
`article`, `.card`, `li.job[data-id]`, `a[href]`, `a[rel=next]`, `a[href^="/jobs"]`. Combinators and pseudo-classes are refused.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

_NAME = r"[\w-]+"
_ATTRIBUTE = rf"""\[\s*({_NAME})\s*(?:([\^$*~]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]"""
_PART = re.compile(rf"([.#])({_NAME})|{_ATTRIBUTE}")
_TAG = re.compile(rf"{_NAME}|\*")
_COMMA = re.compile(r""",(?![^\[]*\])""")
_TESTS = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": lambda has, want: want in has.split()}
#: Elements without content or end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown.
HIDDEN = frozenset(("script", "style", "template"))


@lru_cache(maxsize=4096)
def compile_selector(selector: str) -> tuple[tuple, ...]:
    """(tag or None, classes, attribute tests) of each alternative."""
    out = []
    for one in _COMMA.split(selector):
        one = one.strip()
        tag = _TAG.match(one)
        at, classes, tests = tag.end() if tag else 0, [], []
        while part := _PART.match(one, at):
            kind, name, attribute, op, *values = part.groups()
            if kind == ".":
                classes.append(name)
            elif kind == "#":
                tests.append(("id", "=", name))
            else:
                tests.append((attribute.lower(), op, next((v for v in values if v is not None), "")))
            at = part.end()
        if not one or at < len(one):
            raise ValueError(f"selector {selector!r}: {one[at:]!r} isn't supported")
        name = tag.group().lower() if tag else "*"
        out.append((None if name == "*" else name, frozenset(classes), tuple(tests)))
    return tuple(out)


def matches(compiled: tuple[tuple, ...], tag: str, attrs: dict[str, str | None]) -> bool:
    for name, classes, tests in compiled:
        if name is not None and name != tag or classes and not classes <= set((attrs.get("class") or "").split()):
            continue
        # An empty value matches none of ^=, $= and *=.
        if all(a in attrs and (op is None or (want or op == "=") and _TESTS[op](attrs[a] or "", want)) for a, op, want in tests):
            return True
    return False


class Card:
    """An element: its text, that of the first title in it, and the address of the first link in it ("": has none; null: no link)."""

    __slots__ = ("texts", "titles", "link")

    def __init__(self):
        self.texts, self.titles, self.link = [], None, None

    text = property(lambda self: "".join(self.texts))
    title = property(lambda self: "".join(self.titles or ()))


class _Pass(HTMLParser):
    def __init__(self, cards: str, titles: str, links: str):
        super().__init__(convert_charrefs=True)
        self.selectors = compile_selector(cards), compile_selector(titles), compile_selector(links)
        self.found: list[Card] = []
        self.open: list[tuple[str, Card | None, list[Card]]] = []  # tag, its card, cards that it is the title of
        self.tags: dict[str, int] = {}  # open elements by tag
        self.within: list[Card] = []  # open cards
        self.titled: list[Card] = []  # those of them whose title is open

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        cards, titles, links = self.selectors
        title_of = []
        if self.within and matches(titles, tag, attrs):
            title_of = [c for c in self.within if c.titles is None]
            for c in title_of:
                c.titles = []
        if self.within and matches(links, tag, attrs):
            for c in self.within:
                c.link = (attrs.get("href") or "") if c.link is None else c.link
        card = None
        if matches(cards, tag, attrs):
            card = Card()
            self.found.append(card)
        if tag not in VOID:
            self.open.append((tag, card, title_of))
            self.tags[tag] = self.tags.get(tag, 0) + 1
            self.within += [card] if card else []
            self.titled += title_of

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.tags.get(tag):
            return
        while True:
            name, card, title_of = self.open.pop()
            self.tags[name] -= 1
            if card:
                self.within.pop()
            if title_of:
                del self.titled[len(self.titled) - len(title_of) :]
            if name == tag:
                return

    def handle_data(self, data):
        if self.within and not any(self.tags.get(t) for t in HIDDEN):
            data = data.strip()
            for c in self.within:
                c.texts.append(data)
            for c in self.titled:
                c.titles.append(data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _closed(m: re.Match) -> str:
    name = m[1] or ""
    return m[0] if name.startswith("#") or name in html5 else f"&amp;{name}"


def select(html: str | None, cards: str, titles: str, links: str, closed: bool = False) -> list[Card]:
    """The cards of a page in order, one in another included; elements that aren't closed last as long as what they lie in.

    closed: a character reference counts only with its semicolon, as in XML; browsers also read some without, such as `&amp`.
    """
    parser = _Pass(cards, titles, links)
    parser.feed(_REFERENCE.sub(_closed, html or "") if closed else html or "")
    parser.close()
    return parser.found
