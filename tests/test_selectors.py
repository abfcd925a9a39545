"""Selectors over streamed tags, against a plain tree of the page; cards by a table of sites."""

from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postsieve.functions.banks import BLOCK_WORDS, NICHE_SITES, PORTALS
from postsieve.sources import readers
from postsieve.sources.selectors import VOID, compile_selector, matches, select


class Tree(HTMLParser):
    """A page as nodes [tag, attrs, parent, children]; children are nodes and strings."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["", {}, None, []]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), self.at, []]
        self.at[3].append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at[2]

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node[0] != tag:
            node = node[2]
        if node is not self.root:
            self.at = node[2]

    def handle_data(self, data):
        self.at[3].append(data)


def below(node):
    for c in node[3]:
        if not isinstance(c, str):
            yield c
            yield from below(c)


def text(node, hidden=False):
    hidden = hidden or node[0] in ("script", "style", "template")
    return "".join((("" if hidden else c.strip()) if isinstance(c, str) else text(c, hidden)) for c in node[3])


def hidden(node):
    return node is not None and (node[0] in ("script", "style", "template") or hidden(node[2]))


def by_tree(html, cards, titles, links):
    name = lambda sel: (lambda n: matches(compile_selector(sel), n[0], n[1]))
    out = []
    for card in filter(name(cards), below(Tree(html).root)):
        title, link = (next(filter(name(s), below(card)), None) for s in (titles, links))
        shown = hidden(card[2])
        out.append((text(card, shown), text(title, hidden(title[2])) if title else "", None if link is None else link[1].get("href") or ""))
    return out


SELECTORS = [("article, div, li", "h1", "a"), (".ad, article", "h1, b", "a[href]"), ("li", "a", "a"), ("ul, p", "li", "a[href^='/']"), ("body", "p, .ad", "a[name]"), ("div.ad.big, footer", "*", "*")]


@pytest.mark.parametrize("by", SELECTORS)
def test_given_pages_as_a_tree_has_them(sf_dir, by):
    pages = pd.read_parquet(Path(sf_dir) / "pages.parquet", columns=["html"])["html"]
    for html in pages:
        assert [(c.text, c.title, c.link) for c in select(html, *by)] == by_tree(html, *by)


PIECES = st.sampled_from(["<div class='card'>", "<div>", "</div>", "<li class='x ad'>", "</li>", "<a href='/u'>", "<a>", "</a>", "<h1>", "</h1>", "text ", " more", "<br>", "<img class='card'>", "<p/>", "</p>", "<script>", "</script>", "<template>", "</template>", "&amp;", "<b class=''>", "</b>"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=25), st.sampled_from([(".card, li", "h1, .x", "a"), ("div", ".card, a", "a[href]"), ("*", "b, h1", "a")]))
def test_any_tags_as_a_tree_has_them(pieces, by):
    html = "".join(pieces)
    assert [(c.text, c.title, c.link) for c in select(html, *by)] == by_tree(html, *by)


def test_selectors():
    yes = lambda sel, tag, **attrs: matches(compile_selector(sel), tag, {k.rstrip("_"): v for k, v in attrs.items()})
    assert yes(".card, article", "article") and yes(".card", "p", class_="a card b") and not yes(".card", "p", class_="cards") and not yes("li.card", "p", class_="card")
    assert yes("a[href]", "a", href=None) and not yes("a[href]", "a") and yes("a[href^='/jobs,x']", "a", href="/jobs,x/1") and yes("#main", "div", id="main") and yes("A", "a")
    assert yes("a[rel~=next]", "a", rel="nofollow next") and yes('[x$="z"]', "i", x="yz") and yes("i[x*=y]", "i", x="xyz") and not yes("i[x*='']", "i", x="xyz") and yes("i[x='']", "i", x="")
    for bad in ("div p", "div > p", "a:first-child", "", "a,,b", "a[", ".", "a!"):
        with pytest.raises(ValueError):
            compile_selector(bad)


def test_cards_by_the_sites_own_selectors(spark):
    card = '<div class="listing big"><div>in <p class="title">Law clerk</p></div><a href="p/1">x</a></div><div class="other"><h2>Not a card</h2></div><article><h3>An article too</h3></article>'
    rows = [(1, "https://www.letsintern.com/internships", card), (2, "https://lawbhoomi.com/category/internships/", card), (3, "https://elsewhere.in/", card), (4, "https://www.letsintern.com/more", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = readers.extract_cards(pages, sites=readers.sites_table(spark, NICHE_SITES)).orderBy("page_id", "idx").collect()
    assert [(r.page_id, r.title, r.url, r.source) for r in got] == [(1, "Law clerk", "https://www.letsintern.com/internships/p/1", "LetsIntern"), (1, "An article too", "", "LetsIntern"), (2, "An article too", "", "LawBhoomi")]
    html = '<div class="views-row"><a name="n"></a><a href="/apply">Young professionals</a></div><div class="task-item"><h3>Trainee call</h3></div>'
    pages = spark.createDataFrame([(1, "https://www.niti.gov.in/careers", html), (2, "https://www.mygov.in/task/", html)], "page_id bigint, url string, html string")
    got = readers.gov_cards(pages, sites=readers.sites_table(spark, PORTALS)).orderBy("page_id", "idx").collect()
    assert [(r.page_id, r.title, r.company, r.url) for r in got] == [(2, "Trainee call", "MyGov", "https://www.mygov.in/task/")]  # the first a of a row has no text


def test_references_without_semicolon(spark):
    html = "<article id='a&amp'><h2>A&amp;B &lt;x&gt; &#65; &copy &amp;lt; &nosuch; &amp</h2><a href='/?a=1&lt=2'>x</a></article>"
    assert [c.title for c in select(html, "article", "h2", "a")] == ["A&B <x> A © &lt; &nosuch; &"]
    assert [(c.title, c.link) for c in select(html, "article", "h2", "a", closed=True)] == [("A&B <x> A &copy &lt; &nosuch; &amp", "/?a=1&lt=2")]
    pages = spark.createDataFrame([(1, "https://a.in/", html)], "page_id bigint, url string, html string")
    for jobs in (readers.extract_cards(pages, closed=True), readers.gov_cards(pages, ("copy",), titles="h2", closed=True)):
        assert [r.title for r in jobs.collect()] == ["A&B <x> A &copy &lt; &nosuch; &amp"]


def test_a_task_holds_the_elements_of_few_pages(spark, monkeypatch):
    """Titles alone leave the task, a few pages at a time, in the order of the pages."""
    monkeypatch.setattr(readers, "_PAGES_AT_ONCE", 3)
    pages = spark.createDataFrame([(i, "https://a.in/", f"<li><b>Title {i}</b> more</li>" if i % 4 else None) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    got = readers._elements(pages, "li", "b", text=False).collect()
    assert [(r.page_id, r.title, r.text) for r in got] == [(i, f"Title {i}", None) for i in range(20) if i % 4]
    assert [r.text for r in readers._elements(pages, "li", "b").collect()] == [f"Title {i}more" for i in range(20) if i % 4]


def test_sites_from_a_file(spark, tmp_path):
    (tmp_path / "sites.json").write_text('[{"name": "A", "url": "https://a.in/x", "cards": "li", "titles": "b"}, {"name": "B", "url": "https://a.in/y", "cards": "p", "titles": "b", "links": "i"}]')
    pages = spark.createDataFrame([(1, "https://a.in/z?q", "<li><b>In a list</b><a href=u>.</a></li><p><b>In a paragraph</b><a href=v>.</a>")], "page_id bigint, url string, html string")
    got = readers.extract_cards(pages, sites=readers.read_sites(spark, str(tmp_path / "sites.json"))).orderBy("source").collect()
    assert [(r.title, r.url, r.source) for r in got] == [("In a list", "https://a.in/z?q/u", "A"), ("In a paragraph", "", "B")]


def test_blocks_of_the_given_pages(spark, sf_dir):
    """All blocks of the given pages, against the tree."""
    rows = pd.read_parquet(Path(sf_dir) / "pages.parquet").sort_values("page_id")
    words, seen, want, n = ("the", "la", "der"), set(), [], {}
    assert BLOCK_WORDS
    for page, url, html in zip(rows["page_id"], rows["url"], rows["html"], strict=True):
        site = url.split("/")[2]
        for k, (body, _, link) in enumerate(by_tree(html, "article, div, li", "h1", "a")):
            if 50 <= len(body) <= 3000 and any(w in body.lower() for w in words) and (site, body) not in seen:
                seen.add((site, body))
                if n.setdefault(site, 0) < 10:
                    n[site] += 1
                    address = link or url
                    want.append((page, k, body, address if address.startswith("http") else url + address, site))
    got = readers.extract_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"), words)
    assert sorted((r.page_id, r.idx, r.text, r.url, r.source) for r in got.collect()) == sorted(want) and want
