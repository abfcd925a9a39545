"""Literals that regexes need, against the regexes themselves; and the extraction built on them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postsieve.functions import banks as b
from postsieve.functions import extract as x
from postsieve.functions.dialect import SPARK, column
from postsieve.functions.factors import factors

REGEXES = [rx for rx, _ in b.ROLE_PATTERNS]
OWN = [r"ab|abc\d", r"(a|b)?c", r"a+b", r"[ab]c{2}", r"x*", r"\bintern\b", r"a(b|c)*d", r"ab?c", r"(?:ab|)c"]


def by_factors(regex: str, text: str) -> bool:
    enough, needed = factors(regex)
    if any(w in text for w in enough):
        return True
    return needed is not None and all(any(w in text for w in words) for words in needed) and bool(re.search(regex, text))


WORDS = st.sampled_from(["software", "dev", "developer", "data", " ", "  ", "science", "full", "-", "stack", "machine", "learning", "ai", "a", "b", "c", "cc", "d", "ab", "1", "corporate", "law", "ui", "/", "ux", "intern", "ship", "research", "analyst"])


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(REGEXES + OWN), st.lists(WORDS, max_size=8))
def test_factors_decide_as_the_regex_does(regex, words):
    text = "".join(words)
    assert by_factors(regex, text) == bool(re.search(regex, text))


def test_factors():
    assert factors(r"(legal|law|paralegal|corporate\s*law)") == (["law", "legal"], None)
    assert factors(r"(data\s*(science|scientist))") == ([], [["data"], ["science", "scientist"]])
    assert factors(r"(cyber\s*security|\d+x)")[1] == [["cyber", "x"], ["security", "x"]]
    assert factors(r"x*") == ([""], None) or by_factors(r"x*", "")
    assert factors(r"[\p{L}_]+@[\p{L}_]+") == ([], [["@"]])


def test_roles_of_a_text_by_the_first_pattern(spark):
    texts = ["Full-Stack  Developer", "data   science and law", "paralegal", "web", "web intern", "we develop apps", "", None, "Corporate\tLaw", "ib analyst", "zzz"]
    want = [next((name for rx, name in b.ROLE_PATTERNS if re.search(rx, (t or "").lower())), "Internship") for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r.role for r in d.select("k", column(x.extract_role, "text").alias("role")).orderBy("k").collect()] == want


PIECE = st.sampled_from(["a", "b.c", "@", "x@y.in", ".", "_", "%", "-", " ", "1", "com", "é", "@@", "q@w.co"])


def test_emails_as_a_plain_search_finds_them(spark):
    """Addresses next to each other, cut by characters that no address ends with, are found as by a plain scan."""
    found = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(PIECE, max_size=12))
    def gather(pieces):
        found.append("".join(pieces))

    gather()
    texts = sorted({*found, "a@b.com_x@c.in", "a@b.in@c.in", "mail:x@y.in,x@y.in", "x" * 5000 + "@y.in " + "w " * 3000})
    plain = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
    want = [", ".join(dict.fromkeys(e for e in plain.findall(t) if not re.search(r"\.(png|jpg|gif|svg)$", e))) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r.e for r in d.select("k", column(x.extract_emails, "text").alias("e")).orderBy("k").collect()] == want


@pytest.mark.parametrize("text", ["mail a.b@c.in", "@", "bit.ly/x", "comment below", "a @ b", "ü@é", "nothing"])
def test_contact_signal(spark, text):
    want = bool(re.search(r"[\w.-]+@[\w.-]+|forms\.gle|bit\.ly|linkedin\.com/in/|comment below", text))
    got = spark.range(1).selectExpr(f"{x.hiring_signals(SPARK, SPARK.lit(text))} AS s").first().s.split(",")
    assert ("contact_method" in got) == want
