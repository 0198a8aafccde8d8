"""URL verdicts against plain Python and SQL, on pages that name other addresses."""

import random
import re
from urllib.parse import urljoin

import duckdb
import pytest

from tallyframe.llm import url_aliases as ua

SCHEMA = "page_id long, url string, html string"


def canonical(link, quote='"'):
    return f"<html><head><LINK rel={quote}canonical{quote} href={quote}{link}{quote}></head></html>"


def refresh(link):
    return f'<meta http-equiv="Refresh" content="0; URL={link}">'


def located(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")


def node(url):
    if url is None or "://" not in url:
        return None
    host, path = located(url)
    absolute = urljoin(f"http://x{path or '/'}", path) if "/." in path else f"http://x{path or '/'}"
    query = re.match(r"(?s).*?://[^?#]*(\?[^#]*)", url)
    return re.sub(":(80|443)$", "", host) + absolute[len("http://x"):] + (query[1] if query else "")


def fitting(url, rules):
    host, path = located(url)
    fits = [(len(h + p), len(h), p, v == "allow", h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[4], "allow" if max(fits)[3] else "block") if fits else (None, None)


def expected(rows, links, rules):
    """``links``: pairs of URLs."""
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    urls = {u for r in rows for u in [r[1]]} | {u for pair in links for u in pair}
    for a, b in links:
        if node(a) is not None and node(b) is not None:
            above[root(node(a))] = root(node(b))
    verdicts = {}
    for u in urls:
        if node(u) is not None and fitting(u, rules)[1]:
            verdicts.setdefault(root(node(u)), set()).add(fitting(u, rules)[1])
    out = []
    for page_id, url, _ in rows:
        rule, verdict = fitting(url, rules)
        if verdict is None:
            group = verdicts.get(root(node(url)), set()) if node(url) is not None else set()
            verdict = "allow" if "allow" in group or not group else "block"
        out.append((page_id, *located(url), rule, verdict))
    return out


LINKS = ["/en/7", "../de/9", "?p=2", "other.html", "//Example.COM/de/1#x", "https://a.example.com/de/4", "#part", "",
         "mailto:a@b.c", "./x/../y", "http://z.example.org/es/1", "https://w.example.org/fr/1", "HTTP://N1.example.net/a?x=1&amp;y=2"]


def generated(seed, n=120):
    rng = random.Random(seed)
    hosts = [f"n{i}.example.net" for i in range(12)] + ["a.example.com", "b.example.com", "example.org", "N3.Example.NET:80"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/7', '/de/9', '/fr/1', '/en/1x', '/a/b/c.html', '/a/./b/../c'])}"
            f"{rng.choice(['', '?p=2', '#x'])}" for _ in range(n)]
    rows, links = [], []
    for i, url in enumerate(urls):
        kind, html = rng.random(), "<html>canonical words</html>"
        if kind < 0.3:
            link = rng.choice(LINKS + urls)
            html = rng.choice([canonical(link), canonical(link, "'"), refresh(link)])
            target = link.replace("&amp;", "&")
            if target and not target.startswith(("#", "mailto:")):
                links.append((url, urljoin(url, target) if "://" not in target else target))
        elif kind < 0.5:
            html = rng.choice(["<!-- %s -->", "<script>x = '%s'</script>", '<a rel="next" href="http://a.example.com/de/1">%s']) % (
                canonical("http://a.example.com/de/1") if kind < 0.4 else "")
            if html.startswith("<a") and kind < 0.4:
                links.append((url, "http://a.example.com/de/1"))
        rows.append((i, url, html))
    return rows, links


@pytest.mark.parametrize("seed", range(1, 5))
def test_components_carry_verdicts(spark, seed):
    rows, links = generated(seed)
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = sorted(str(tuple(r)) for r in ua.report(pages).collect())
    want = expected(rows, links, ua.RULES)
    assert found == sorted(map(str, want))
    assert any(r[3] is None and r[4] == "block" for r in want)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(str, con.execute(ua.REPORT_SQL).fetchall())) == found


def test_redirects_and_many_rules(spark):
    rng = random.Random(9)
    rules = [(rng.choice(["net", "example.net", "n1.example.net", "org"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(5))),
              rng.choice(["allow", "block"])) for _ in range(60)]
    rows = [(i, f"http://n{rng.randrange(3)}.example.{rng.choice(['net', 'org', 'com'])}/" + "".join(rng.choice("ab/") for _ in range(6)), None)
            for i in range(150)]
    moved = [(f"http://old.example.com/{i}", rng.choice(rows)[1]) for i in range(30)] + [(rng.choice(rows)[1], f"http://old.example.com/{i}") for i in range(30)]
    moved += [(None, rows[0][1]), (rows[1][1], None), (rows[2][1], rows[2][1])]
    redirects = spark.createDataFrame(moved, "url string, target string")
    found = ua.judged(spark.createDataFrame(rows, SCHEMA), ua.rules_table(spark, rules), redirects).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, expected(rows, moved, rules)))


def test_hot_target_and_allow_precedence(spark):
    hub = "http://hub.example.net/"
    rows = [(i, f"http://p{i}.example.net/x", canonical(hub)) for i in range(300)]
    rows += [(900, "http://bad.example.com/de/1", canonical(hub))]
    blocked = ua.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.verdict for r in blocked} == {"block"}
    rows += [(901, "http://good.example.com/fr/1", refresh(hub))]
    found = {r.page_id: r.verdict for r in ua.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found.pop(900) == "block" and set(found.values()) == {"allow"}


def test_odd_rows(spark):
    long = "http://" + "a." * 50_000 + "example.org/es/" + "x" * 100_000
    rows = [(1, None, None), (2, "", ""), (3, "no address", canonical("/x")), (None, "http://example.org", None), (5, "://", "<link"),
            (6, long, None), (7, "x://ExÄmple.ORG/es/?a#b", "x" * 200_000), (7, "x://ExÄmple.ORG/es/?a#b", "x" * 200_000), (8, "http://a\nb.org/\n", None)]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, SCHEMA)
    clashing = pages.select("*", *[F.lit("taken").alias(c) for c in ("id", "host", "path", "node", "rule", "verdict", "a", "b", "of", "at")])
    found = ua.report(clashing).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(str(r) for r in expected(rows, [], ua.RULES))
    assert ua.report(pages.limit(0)).collect() == []
    none = spark.createDataFrame([], ua.RULE)
    assert {r.verdict for r in ua.judged(pages, none).collect()} == {"allow"}
