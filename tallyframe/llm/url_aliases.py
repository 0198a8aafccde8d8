"""URL filters that hold for a page's aliases too.

1. Every URL is an address: host (A to Z in lower case, without a default port), path without dot segments (an empty
   one is ``/``) and query. Scheme and fragment are no part of it, so such variants of a URL are one node.
2. Links of equivalence join addresses: ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of the pages, outside
   comments and scripts, resolved against the page's URL, and rows of a table of redirects, if there is one.
3. Rules (host, path, verdict) fit a host and its subdomains where the path starts with the rule's. A URL's host
   suffixes meet the rule hosts, its path's prefixes of the lengths that host's rules have meet the rules: no URL is
   compared with all rules, and the longest rule wins.
4. Connected components over the links carry decisions to aliases: where a member has an allow rule the component is
   allowed, else where one has a block rule it is blocked. A page's own rule stands above its component's verdict; without
   either it is allowed. Targets that are no pages themselves count with their rules.

Built-in functions only. Nodes are 16-byte hashes of addresses; only addresses with a link take part in the
components. A target of a third of all pages is one row per page in a grouped minimum, and its joins are ones that
adaptive execution splits.

A missing URL, or one without ``://``, has an empty host and path, no rule, no alias and is allowed; missing html has no
links. Other schemes than http(s) are no links. Of rules of one length the one with the longer host wins, then the
greater path, then allow. Repeated rows get equal verdicts each; an empty table, or no rules, is fine; columns other
than id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.llm.components import components
from tallyframe.llm.tables import fold
from tallyframe.session import release_staged, stage

RULE = "host string, path string, verdict string"
#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_LOCATION = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_CANONICAL = r"""(?i)\srel\s*=\s*["']?\s*canonical\b"""
_REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?\s*refresh\b"""


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _LOCATION, group), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return fold(_part(url, 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _without_dots(path: Column) -> Column:
    names = F.split(path, "/", -1)
    walked = F.aggregate(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), F.lit(""), lambda so_far, name: F.when(
        name == "..", F.regexp_replace(so_far, "/[^/]*$", "")).when(name == ".", so_far).otherwise(F.concat(so_far, F.lit("/"), name)))
    open_end = F.when(F.element_at(names, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.contains("/."), F.concat(walked, open_end)).otherwise(path)


def node_of(url: Column) -> Column:
    """16 bytes for the address of a URL; missing for what has no address."""
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    address = F.concat(F.regexp_replace(host_of(url), ":(80|443)$", ""), F.when(path == "", F.lit("/")).otherwise(_without_dots(path)), query)
    return F.when(url.contains("://"), F.unhex(F.md5(address)))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)\s{name}{_VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def _absolute(url: Column, link: Column) -> Column:
    """A link as a whole URL; missing where it leads nowhere else or is no http(s) link."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), _part(url, 1))
    path = path_of(url)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/"))
    return (F.when((link == "") | link.startswith("#") | ~url.contains("://"), F.lit(None))
            .when(link.rlike("(?i)^https?://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("?"), F.concat(site, path, link))
            .otherwise(F.concat(site, folder, link)))


def linked_urls(url: Column, html: Column) -> Column:
    """Array of the URLs that a page names as its own other address."""
    shown = F.regexp_replace(html, _HIDDEN, "")
    links = F.filter(F.regexp_extract_all(shown, F.lit(r"(?i)<link\s[^>]*>"), F.lit(0)),
                     lambda tag: tag.rlike(_CANONICAL))
    jumps = F.filter(F.regexp_extract_all(shown, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)),
                     lambda tag: tag.rlike(_REFRESH))
    named = F.concat(F.transform(links, lambda tag: _attribute(tag, "href")),
                     F.transform(jumps, lambda tag: F.regexp_extract(_attribute(tag, "content"), r"""(?i)url\s*=\s*['"]?([^'"]*)""", 1)))
    whole = F.filter(F.transform(named, lambda link: _absolute(url, link)), lambda link: link.isNotNull())
    # most pages name no other address and are searched once
    return F.when(html.rlike("(?i)canonical|http-equiv"), whole).otherwise(F.array().cast("array<string>"))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE)


def fitting_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, rule, verdict`` for every row of ``addresses`` (id, host, path; ids are distinct) that a rule fits."""
    rules = rules.select(fold(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict")).dropna()
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.", -1)))).first()[0] or 0
    names = F.slice(F.split("host", r"\.", -1), -labels, labels) if labels else F.array().cast("array<string>")
    # a host of fewer names than the longest rule host is taken whole
    names = F.when(F.size(F.split("host", r"\.", -1)) < labels, F.split("host", r"\.", -1)).otherwise(names)
    suffixes = F.transform(names, lambda _, i: F.array_join(F.slice(names, i + 1, F.size(names)), "."))
    known = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")).withColumnRenamed("rule_host", "suffix")
    tried = addresses.select("id", "path", F.explode(suffixes).alias("suffix")).join(known, "suffix").select(
        "id", "suffix", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    fits = tried.withColumn("start", F.expr("left(path, n)")).join(
        rules, (F.col("suffix") == F.col("rule_host")) & (F.col("start") == F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("wide"),
                    F.col("rule_path").alias("path"), (F.col("verdict") == "allow").alias("allow"), F.col("rule_host").alias("host"))
    best = fits.groupBy("id").agg(F.max(rank).alias("best"))
    return best.select("id", F.concat("best.host", "best.path").alias("rule"),
                       F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))


def _component_verdicts(decided: DataFrame, links: DataFrame) -> DataFrame:
    """``node, carried``: the verdict of every node that has a rule or is linked with one that has, from
    ``decided`` (node, verdict) and ``links`` (a, b)."""
    labels = components(links)
    of = labels.select(F.col("node").alias("member"), "component")
    grouped = decided.join(of, F.col("node") == F.col("member"), "left").groupBy(F.coalesce("component", "node").alias("whole")).agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("carried"))
    told = stage(grouped)
    members = of.join(told, F.col("component") == F.col("whole")).select(F.col("member").alias("node"), "carried")
    single = told.join(of, F.col("whole") == F.col("member"), "left_anti").select(F.col("whole").alias("node"), "carried")
    out = stage(members.union(single))
    release_staged(told)
    release_staged(labels)
    return out


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages`` (page_id, url, html). ``redirects`` (url, target)
    are further links, of any URLs."""
    url = F.col("url").cast("string")
    rows = stage(pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html")).select(
        F.monotonically_increasing_id().alias("id"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        node_of(F.col("url")).alias("node"), linked_urls(F.col("url"), F.col("html")).alias("targets")))
    far = rows.filter(F.size("targets") > 0).select("node", F.explode("targets").alias("target"))
    ends = ["node", node_of(F.col("target")).alias("b"), "target"]
    links = far.select(*ends)
    others = far.select("target")
    if redirects is not None:
        moved = redirects.select(F.col("url").cast("string").alias("from"), F.col("target").cast("string").alias("target"))
        links = links.union(moved.select(node_of(F.col("from")).alias("node"), *ends[1:]))
        others = others.union(moved.select("target")).union(moved.select("from"))
    pairs = links.select(F.col("node").alias("a"), "b").dropna()
    own = stage(rows.join(fitting_rules(rows.select("id", "host", "path"), rules).withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").drop("of", "targets"))
    outside = others.distinct().select(F.col("target").alias("id"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))
    decided = own.filter(F.col("rule").isNotNull()).select("node", "verdict").union(
        fitting_rules(outside, rules).select(node_of(F.col("id")).alias("node"), "verdict")).distinct()
    carried = _component_verdicts(decided, pairs).withColumnRenamed("node", "at")
    release_staged(rows)
    out = ["page_id", "host", "path", "rule"]
    # rows that need no alias's verdict stay out of the join
    open_rows = F.col("rule").isNull() & F.col("node").isNotNull()
    ruled = own.filter(~open_rows).select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    rest = own.filter(open_rows).join(carried, F.col("node") == F.col("at"), "left").select(
        *out, F.coalesce("carried", F.lit("allow")).alias("verdict"))
    return ruled.union(rest)


def report(pages: DataFrame) -> DataFrame:
    return judged(pages, rules_table(pages.sparkSession, RULES))


def _report_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    value = _VALUE.replace("'", "''")

    def attribute(tag: str, name: str) -> str:
        return "concat(" + ", ".join(f"regexp_extract({tag}, '(?i)\\s{name}{value}', {g})" for g in (1, 2, 3)) + ")"

    def tags(name: str, needs: str) -> str:
        return f"list_filter(regexp_extract_all(shown, '(?i)<{name}\\s[^>]*>'), lambda t: regexp_matches(t, '{needs.replace(chr(39), chr(39) * 2)}'))"

    def parsed(url: str) -> str:
        return (f"lower(coalesce(regexp_extract({url}, '{_LOCATION}', 1), '')) AS host, "
                f"coalesce(regexp_extract({url}, '{_LOCATION}', 2), '') AS path")

    def node(url: str) -> str:
        path = f"regexp_extract({url}, '{_LOCATION}', 2)"
        walked = (f"list_reduce(string_split({path}, '/'), lambda a, s: CASE s WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') "
                  f"WHEN '.' THEN a ELSE a || '/' || s END) || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END")
        return (f"CASE WHEN contains({url}, '://') THEN regexp_replace(lower(regexp_extract({url}, '{_LOCATION}', 1)), ':(80|443)$', '') || "
                f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {walked} ELSE {path} END || "
                f"regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END")

    def fits(table: str) -> str:
        return (f"(SELECT max({{'size': length(r.host || r.path), 'wide': length(r.host), 'path': r.path, 'allow': r.verdict = 'allow', "
                f"'host': r.host}}) FROM rules r WHERE ({table}.host = r.host OR ends_with({table}.host, '.' || r.host)) "
                f"AND starts_with({table}.path, r.path))")

    return f"""WITH RECURSIVE rules(host, path, verdict) AS (VALUES {rules}),
seen AS MATERIALIZED (SELECT row_number() OVER () AS id, page_id, url, html, {parsed('url')}, {node('url')} AS node FROM pages),
shown AS (SELECT id, url, node, regexp_replace(html, '{_HIDDEN}', '', 'g') AS shown FROM seen
  WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
named AS (
  SELECT url, node, trim(replace(unnest(list_concat(
    list_transform({tags('link', _CANONICAL)}, lambda t: {attribute('t', 'href')}),
    list_transform({tags('meta', _REFRESH)}, lambda t: regexp_extract({attribute('t', 'content')}, '(?i)url\\s*=\\s*[''"]?([^''"]*)', 1)))), '&amp;', '&')) AS link
  FROM shown),
linked AS MATERIALIZED (
  SELECT *, {node('target')} AS b FROM (
    SELECT node, CASE
      WHEN link = '' OR starts_with(link, '#') OR NOT contains(url, '://') THEN NULL
      WHEN regexp_matches(link, '(?i)^https?://') THEN link
      WHEN starts_with(link, '//') THEN split_part(url, '://', 1) || ':' || link
      WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
      WHEN starts_with(link, '/') THEN site || link
      WHEN starts_with(link, '?') THEN site || path || link
      ELSE site || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || link END AS target
    FROM (SELECT *, split_part(url, '://', 1) || '://' || regexp_extract(url, '{_LOCATION}', 1) AS site,
                 regexp_extract(url, '{_LOCATION}', 2) AS path FROM named)) WHERE target IS NOT NULL),
edges AS MATERIALIZED (SELECT DISTINCT node AS a, b FROM linked UNION SELECT DISTINCT b, node FROM linked),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
ruled AS MATERIALIZED (SELECT *, {fits('seen')} AS best FROM seen),
decided AS (
  SELECT node, best.allow AS allow FROM ruled WHERE best IS NOT NULL AND node IS NOT NULL
  UNION SELECT b, best.allow FROM (SELECT b, {fits('t')} AS best FROM (SELECT b, {parsed('target')} FROM linked) t) WHERE best IS NOT NULL),
carried AS (
  SELECT a AS node, bool_or(allow) AS allow FROM (
    SELECT reach.a, decided.allow FROM reach JOIN decided ON reach.b = decided.node UNION ALL SELECT node, allow FROM decided) GROUP BY a)
SELECT page_id, host, path, best.host || best.path AS rule,
       CASE WHEN coalesce(best.allow, carried.allow, true) THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN carried USING (node)"""


REPORT_SQL = _report_sql()
