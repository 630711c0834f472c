import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lodestar.llm import url_filter as uf


def _place(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def _rule(host, path, rules):
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def _normal(url):
    host, path = _place(url)
    if not host:
        return None
    query = re.match(r"[^?#]*(?:\?([^#]*))?", url.split("://", 1)[1])[1] or ""
    query = "&".join(p for p in query.split("&") if not p.startswith("utm_")).lstrip("&")
    return re.sub(r":(80|443)?$", "", host) + path.rstrip("/") + "?" + query


class _Links(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.found = []
        self.feed(html or "")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and (m := re.match(r"(?is)[\s\d.]*[;,]?\s*url\s*=\s*(.*)", a.get("content", ""))):
            self.found.append(m[1].strip("'\" "))


def _brute(pages, rules, redirects=()):
    """(id, host, path, rule, verdict) by a plain search over all aliases."""
    edges = [(u, urljoin(u, x)) for _, u, h in pages if u and "://" in u for x in _Links(h).found if x]
    edges = [(a, b) for a, b in [*edges, *redirects] if re.match("https?://", b)]
    near, verdicts = {}, {}
    for a, b in [*edges, *((u, u) for _, u, _ in pages if _normal(u))]:
        near.setdefault(_normal(a), set()).add(_normal(b))
        near.setdefault(_normal(b), set()).add(_normal(a))
        for u in (a, b):
            verdicts.setdefault(_normal(u), set()).add(_rule(*_place(u), rules)[1])
    out = []
    for i, u, _ in pages:
        host, path = _place(u)
        rule, verdict = _rule(host, path, rules)
        if verdict is None:
            seen, todo = set(), [_normal(u)] if _normal(u) else []
            while todo:
                if (k := todo.pop()) not in seen:
                    seen.add(k)
                    todo += near[k]
            said = {v for k in seen for v in verdicts[k]}
            verdict = "block" if "block" in said and "allow" not in said else "allow"
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, scale):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{scale}/pages.parquet").select("page_id", "url", "html").collect()]
    got = uf.op11_url_filter(spark, f"/root/testdata/{scale}")
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert _got(got) == _brute(rows, uf.RULES)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, rule int").repartition(4)


LINKED = [
    (1, "http://a.com/de/x", None),  # blocked by rule
    (2, "http://b.net/x", '<link rel="canonical" href="http://a.com/de/x">'),
    (3, "http://b.net/folder/y?q=1", "<LINK HREF='../x' REL='Canonical nofollow'>"),  # through 2
    (4, "https://c.net/r", '<meta http-equiv="refresh" content="0; URL=http://b.net/x/#part">'),
    (5, "http://d.org/z", '<link rel=canonical href=http://a.com/de/x>'),  # its own rule stays, and would save the others
    (6, "http://e.net/1", '<link rel="canonical" href="//shop.com/de/9"/>'),  # the target is no page
    (7, "http://f.net/1", '<!-- <link rel="canonical" href="http://a.com/de/x"> --><script>"<link rel=canonical href=http://a.com/de/x>"</script><a href="http://a.com/de/x">canonical</a>'),
    (8, "http://g.net/1", '<link rel="canonical" href="mailto:a@com"><link rel="stylesheet" href="http://a.com/de/x">canonical'),
    (9, "http://H.net:80/P/?utm_source=f&a=1#top", '<link rel="canonical" href="http://a.com/de/x">'),
    (10, "https://h.net/P?a=1&utm_medium=z", ""),  # one url with 9
    (11, "http://h.net/P?a=2", ""),
    (12, None, '<link rel="canonical" href="http://a.com/de/x">'),
    (13, "a.com/de/x", None),
    (14, "", ""),
    (None, "http://b.net/x", None),
    (2, "http://b.net/x", None),
    (15, "http://com/de/", ""),
    (16, "http://xcom/de/", ""),
    (17, "://a.com/fr/", ""),
    (18, "http://EXAMPLE.ORG/en/1?x", ""),
    (19, "http://www.example.org/es/", ""),
    (20, "http://example.org", ""),
    (21, "http://i.net/a/b/c", '<link rel="canonical" href="./../x?k=1&amp;l=2">'),
    (22, "http://i.net/a/x?k=1&l=2", '<link rel="canonical" href="/de">'),
    (23, "http://q://a.com/de/", ""),
]


def test_links_and_odd_rows(spark):
    without = [r for r in LINKED if r[0] != 5]
    for rows in (LINKED, without):
        assert _got(uf.judge(_frame(spark, rows), uf.RULES)) == _brute(rows, uf.RULES)
    verdicts = {r[0]: r[4] for r in _got(uf.judge(_frame(spark, without), uf.RULES))}
    assert [verdicts[i] for i in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11)] == ["block"] * 5 + ["allow"] * 2 + ["block"] * 2 + ["allow"]
    saved = {r[0]: r[4] for r in _got(uf.judge(_frame(spark, LINKED), uf.RULES))}
    assert saved[1] == "block" and [saved[i] for i in (2, 3, 4, 5)] == ["allow"] * 4  # the allow of 5 takes precedence
    assert uf.judge(_frame(spark, LINKED).limit(0), uf.RULES).collect() == []
    assert {r[4] for r in _got(uf.judge(_frame(spark, LINKED), []))} == {"allow"}


def test_chains_stars_and_redirect_tables(spark):
    rng = random.Random(4)
    sites = [f"http://{a}{i}.{tld}/{p}" for i in range(40) for a in "ab" for tld, p in (("net", "x"), ("com", "de/1"), ("org", "q"), ("io", ""))]
    pages = [(i, u, None) for i, u in enumerate(sites)]
    free = [u for u in sites if ".net" in u or ".io" in u]
    redirects = [(rng.choice(free), rng.choice(free)) for _ in range(60)]
    redirects += [(f"http://chain.net/{i}", f"http://chain.net/{i + 1}") for i in range(50)] + [("http://chain.net/50", "http://t.com/de/")]
    redirects += [(u, "http://hub.net/") for u in free[::4]] + [("http://hub.net", rng.choice([u for u in sites if ".com" in u]))]
    redirects += [(None, "http://a0.net/x"), ("http://a1.net/x", None)]
    pages += [(1000 + i, f"https://chain.net/{i}/", "") for i in range(0, 51, 10)]
    want = _brute(pages, uf.RULES, [r for r in redirects if None not in r])
    table = spark.createDataFrame(redirects, "url string, target string")
    assert _got(uf.judge(_frame(spark, pages), uf.RULES, table)) == want
    assert sum(r[4] == "block" and r[3] is None for r in want) > 10


def test_rules_as_a_table(spark):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org"]
    rules = sorted({(rng.choice(hosts), "/" + "ab/ab"[: rng.randrange(5)]): rng.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(*k, v) for k, v in rules]
    pages = [(i, f"http://{rng.choice(hosts + ['c.b.a.com', 'za.com', 'io'])}/{rng.choice(['', 'a', 'ab', 'ab/', 'ab/a', 'ab/abc', 'b'])}", None) for i in range(120)]
    want = _brute(pages, rules)
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert _got(uf.judge(_frame(spark, pages), frame)) == want == _got(uf.judge(_frame(spark, pages), rules))
    many = rules + [(f"h{i}.example", "/", "block") for i in range(uf.MAX_LISTED)]
    assert _got(uf.judge(_frame(spark, pages), many, html_col=None)) == want
