import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import urlfilter
from tidemark.llm.queries import LISTED_DOMAINS, URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.ORG", "https://example.org/es/", "https://a.b.example.org/es/x?q#f",
    "https://example.org/en/1", "https://example.org/en/12/", "https://x.com/fr/1", "https://x.com/de/1", "ftp://badexample.org/es/1",
    "https://spam-farm.example.org/en/9", "https://spam-farm.example.org", "https://www.casino-win.example.net/a", "http://casino-win.example.net?x=/y",
    "http://h#/p", "http://h/p://x.org/", "http://É.org/ü", "https://notspam-farm.example.com/", "http://a..b/", "http://.com/fr/", "://org/",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for line in URL_RULES:
        verdict, target = line.split(" ")
        h, _, p = target.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(target) > len(best[0])):
            best = (target, verdict)
    listed = any(host == d or host.endswith("." + d) for d in LISTED_DOMAINS)
    return host, path, best and best[0], best[1] if best else "block" if listed else "allow", listed


def judge(spark, rows, names="page_id int, url string", **kwargs):
    listed = spark.createDataFrame([(x,) for x in [*LISTED_DOMAINS, *LISTED_DOMAINS, "never.seen.example", None]], "key string")
    return urlfilter.judged(spark.createDataFrame(rows, names), listed, list(URL_RULES), **kwargs)


@pytest.mark.parametrize("kwargs", [{}, {"shard_keys": 3}, {"shard_keys": 3, "most_bytes": 900}])
def test_against_brute_force(spark, kwargs):
    rows = [(i, u) for i, u in enumerate([*URLS, *URLS])]
    got = judge(spark, rows, **kwargs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == brute(r.url), r.url


def test_empty_and_clashing(spark):
    assert judge(spark, []).count() == 0
    got = judge(spark, [(1, "https://spam-farm.example.com/x", 7, 7, 7)], "page_id int, url string, _h1 int, _rule int, verdict int")
    assert got.select("_h1", "_rule", "verdict", "listed").first() == (7, 7, "block", True)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 3000), st.floats(0, 1), st.integers(0, 2**32))
def test_cascade_is_exact(count, share, seed):
    rng = np.random.default_rng(seed)
    h1, h2 = rng.integers(0, 2**64, count, dtype=np.uint64), rng.integers(0, 2**64, count, dtype=np.uint64)
    listed = rng.random(count) < share
    levels = urlfilter.cascade(h1, h2, listed)
    assert (urlfilter.holds(levels, h1, h2) == listed).all()


def test_cascade_is_small():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(0, 2**64, 100_000, dtype=np.uint64), rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    listed = np.arange(100_000) < 2000
    assert sum(len(x.bits) for x in urlfilter.cascade(h1, h2, listed)) < 2000 * 3


def test_equal_hashes_are_noticed():
    same = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError):
        urlfilter.cascade(same, same, np.array([True, False]))


@pytest.mark.parametrize("line", ["org/", "deny org/", "allow /x", ""])
def test_bad_rules(line):
    with pytest.raises(ValueError):
        urlfilter.parse_rule(line)
