"""URL rules against a plain statement, and the template tree against one built in dictionaries."""

import math
from collections import defaultdict

import pytest

from gridloom.llm import url_filters
from gridloom.llm.catalog import URL_RULES
from gridloom.llm.url_filters import BOUND, DEPTH, LONGEST, MOST, SUPPORT, WEIGHT


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    stop = min((rest.index(c, end) for c in "?#" if c in rest[end:]), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def tree(urls):
    """(template, purity) of each URL."""
    rows = []
    for url in urls:
        host, path = parts(url)
        found = [s for s in path.split("/") if s]
        r = rule(host, path)
        rows.append([host, found if len(found) <= DEPTH else found[: DEPTH - 1] + ["/".join(found[DEPTH - 1 :])], None if r is None else not r.allow, "", None])
    smooth = lambda some, parent: (sum(x[2] is True for x in some) + WEIGHT * parent) / (sum(x[2] is not None for x in some) + WEIGHT)
    labels = [x[2] for x in rows if x[2] is not None]
    share = sum(labels) / len(labels) if labels else 0.0
    hosts = defaultdict(list)
    for x in rows:
        hosts[x[0]].append(x)
    for some in hosts.values():
        purity = smooth(some, share)
        grow(some, 0, purity, smooth)
    return [(x[3], x[4]) for x in rows]


def grow(some, level, purity, smooth):
    for x in some:
        x[4] = purity
    ended = [x for x in some if len(x[1]) == level]
    p = smooth(ended, purity)
    for x in ended:
        x[3], x[4] = x[3] + "/$", p
    groups, total = defaultdict(list), len(some)
    for x in some:
        if len(x[1]) > level:
            groups[x[1][level]].append(x)
    kept = {s: g for s, g in groups.items() if len(g) >= SUPPORT and len(g) * MOST >= total and len(s) <= LONGEST and not set(s) & set("*$|")}
    wild = [x for s, g in groups.items() if s not in kept for x in g]

    def rates(g):
        n = sum(x[2] is not None for x in g)
        return sum(x[2] is True for x in g) / n if n else None, sum(len(x[1]) == level + 1 for x in g) / len(g), n, len(g)

    order = sorted(kept, key=lambda s: (rates(kept[s])[0] is None, rates(kept[s])[0] or 0.0, rates(kept[s])[1], s))
    branches, last = [], None
    for s in order:
        now = rates(kept[s])
        near = lambda k, n: abs(now[k] - last[k]) < BOUND * (1 / math.sqrt(now[n]) + 1 / math.sqrt(last[n]))
        if last is not None and now[0] is not None and last[0] is not None and near(0, 2) and near(1, 3):
            branches[-1].append(s)
        else:
            branches.append([s])
        last = now
    for name, members in [("|".join(sorted(b)), [x for s in b for x in kept[s]]) for b in branches] + [("*", wild)]:
        if members:
            for x in members:
                x[3] += "/" + name
            grow(members, level + 1, smooth(members, purity), smooth)


ODD = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "HTTP://A.Example.ORG/es/1", "http://example.org/es", "http://example.org?x=/es/", "http://xexample.org/es/1", "http://example.org/en/12/3#/es/",
    "http://com/fr/", "http://x.com/de/a?u=http://y.org/", "x?u=http://q.org/fr/", "http://é.İ.org/en/1\n/x", "http://host.net/" + "a" * 200_000, "http://host.net" + "/seg" * 5000, "http://host.net//a//b/", "http://host.net/*/$/a|b",
]


@pytest.fixture(scope="module")
def urls():
    out = list(ODD)
    for k in range(600):
        tld = ("org", "com", "net")[k % 3]
        out.append(f"http://{'hot' if k % 4 else 'h%d' % (k % 7)}.example.{tld}/{('en', 'es', 'fr', 'de', 'a*')[k % 5]}/{('p', 'q')[k % 2]}/{k * 7919 % 1000}{('', '/', '.html', '?a=1')[k % 4]}")
    return out + out[20:60] + [f"http://bulk.net/{'abcdef'[k % 6]}" for k in range(200)]


def test_judged(spark, urls):
    pages = spark.createDataFrame([(i if i % 50 else None, u, "<p>", "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, template string, purity double").repartition(5)
    got = sorted((tuple(r) for r in url_filters.judged(pages, URL_RULES).collect()), key=str)
    want = []
    for i, (u, (template, purity)) in enumerate(zip(urls, tree(urls))):
        r = rule(*parts(u))
        blocked = purity > 0.5 if r is None else not r.allow
        want.append((i if i % 50 else None, *parts(u), None if r is None else r.text, "block" if blocked else "allow", template, purity))
    assert got == sorted(want, key=str)


def test_branches_merge_and_wildcards(spark):
    urls = [f"http://a.org/{lang}/{k}" for k in range(40) for lang in ("en", "fr")] + [f"http://a.example.org/es/{k}" for k in range(40)] + [f"http://a.example.org/en/2{k}" for k in range(40)]
    out = url_filters.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES)
    assert {(r.host, r.template) for r in out.select("host", "template").distinct().collect()} == {("a.org", "/en|fr/*/$"), ("a.example.org", "/es/*/$"), ("a.example.org", "/en/*/$")}


def test_without_labels_all_is_allowed(spark):
    pages = spark.createDataFrame([(i, f"http://a.net/x/{i}") for i in range(30)], "page_id long, url string")
    assert {(r.verdict, r.purity) for r in url_filters.judged(pages, URL_RULES).collect()} == {("allow", 0.0)}
