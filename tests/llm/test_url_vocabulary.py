import re

from hypothesis import given
from hypothesis import strategies as st

from sluicegate.llm.settings import PAGE_RULES
from sluicegate.llm.url_vocabulary import SOFT, STRICT, automaton, hits, judge_urls

FOUND = automaton(STRICT, SOFT)


def plain_hits(url):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), url)
    count = lambda t: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text))
    return sum(map(count, STRICT)), sorted(t for t in SOFT if count(t))


@given(st.lists(st.sampled_from([*STRICT, *SOFT, "-", "/", ".", "a", "É", "BET", "1"]), max_size=12).map("".join))
def test_hits_against_regular_expressions(url):
    assert hits(FOUND, url) == plain_hits(url)


def test_verdicts(frame):
    cases = [
        ("http://a.com/x", "a.com", "/x", "com/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("HTTP://EXAMPLE.com/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://x.net/fr/a", "x.net", "/fr/a", "net/fr/", "block"),
        ("http://casino.org/", "casino.org", "/", None, "block"),
        ("http://casino.com/", "casino.com", "/", "com/", "allow"),
        ("http://a.org/casinoroyal", "a.org", "/casinoroyal", None, "allow"),
        ("http://a.org/free", "a.org", "/free", None, "allow"),
        ("http://a.org/free-free", "a.org", "/free-free", None, "allow"),
        ("http://a.org/free-bets", "a.org", "/free-bets", None, "block"),
        ("http://u:p@a.org:80?x=/en/", "u:p@a.org:80", "", None, "allow"),
        ("no scheme porn", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://ÄB.org/" + "y/" * 40_000, "Äb.org", "/" + "y/" * 40_000, None, "allow"),
    ]
    rows = [(i, c[0], "clash", "clash") for i, c in enumerate(cases)] + [(0, cases[0][0], "clash", "clash")]
    pages = frame(rows, "page_id bigint, url string, host string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, PAGE_RULES).collect())
    assert got == sorted((i, *c[1:]) for i, c in [*enumerate(cases), (0, cases[0])])


def test_empty(frame):
    assert judge_urls(frame([], "page_id bigint, url string"), PAGE_RULES).collect() == []
