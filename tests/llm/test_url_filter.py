import pytest

from voxtable.llm.queries import URL_RULES
from voxtable.llm.url_filter import filter_urls

PAGES = [
    (1, "https://a.example.org/es/1", "x"),
    (2, "http://EXAMPLE.org/en/17?q=1", "x"),
    (3, "http://example.org/en/2#/es/", "x"),
    (4, "http://notexample.org/es/", "x"),
    (5, "https://shop.com/de/1", "x"),
    (6, "https://shop.com/fr/", "x"),
    (7, "https://com/de/", "x"),
    (8, "no scheme", "x"),
    (9, None, "x"),
    (10, "", "x"),
    (11, "ftp://?q", "x"),
    (12, "https://b.net/" + "p" * 100_000, "x"),
    (12, "https://b.net/" + "p" * 100_000, "x"),
    (None, "https://xorg/es/", "x"),
]


def parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([len(rest)] + [rest.index(c) for c in "/?#" if c in rest])
    path = rest[end:].partition("#")[0].partition("?")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def outcomes(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "page_ref long, bad int")


def test_rules_and_parts_equal_brute_force(spark, outcomes):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, bad int")
    out = filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    want = []
    for i, url, _ in PAGES:
        host, path = parts(url)
        want.append((i, host, path, *rule(host, path)))
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule) for r in out))) == sorted(str(w[:4]) for w in want)
    said = {(r.page_id, r.host): r.verdict for r in out}
    assert all(said[w[0], w[1]] == w[4] for w in want if w[4])
    assert set(said.values()) <= {"allow", "block"}


def test_empty_tables(spark, outcomes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert filter_urls(pages.limit(0), outcomes, URL_RULES).count() == 0
    assert filter_urls(pages, outcomes.limit(0), URL_RULES).count() == len(PAGES)


def test_a_bad_host_is_blocked_and_a_good_one_is_not(spark):
    rows = [(i, f"http://{'bad' if i < 60 else 'good'}.example.net/{i}", "x") for i in range(120)]
    seen = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "page_ref long, bad int")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in filter_urls(pages, seen, URL_RULES).collect()}
    assert got == {"bad.example.net": "block", "good.example.net": "allow"}
