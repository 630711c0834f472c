"""URL verdicts by rules and redirect equivalence (operator 11).

A rule is a host and a path prefix with a verdict.  It fits the urls of its host
and of all subdomains whose path starts with the rule's; of the rules that fit,
the longest (host and path together) gives the verdict.

Urls without a rule take the verdict of their aliases.  A url stands for its
normal form: without scheme, fragment, default port, slashes at the path's end and
``utm_`` parameters.  A page's canonical link (``<link rel="canonical">``), its
``<meta http-equiv="refresh">`` target, and the rows of a table of redirects, where
one is given, are edges between normal forms; the connected components of the
edges are aliases of one another.  A block decision of any url of a component, a
page or only a target, reaches every url of it that no rule decides, unless a rule
allows a url of the component: an explicit allow takes precedence.  A url's own
rule always stays, and urls that nothing decides are allowed.

How it runs: rules in a list are evaluated inside the scan; a table of rules is
joined to the distinct hosts and paths, by every host suffix and every length of
path that rules have.  Pages are grouped by a 128-bit key of the normal form, three
flags each, combined before the shuffle.  Only urls that have edges enter the
components (grouped minima and equi-joins, so a url that is the target of very
many pages is never gathered in one task).  The keys of undecided urls that are
blocked come back to the pages, as a broadcast where they are counted to be few.

Defined results: host is what stands after the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased; path goes on to ``?``, ``#`` or the end; both
are empty for null urls and those without ``://``, which take part in no rule and
no alias.  Rules of equal length that fit: allow wins.  Tags inside comments and
scripts are no links, nor are targets of other schemes than http and https; tags
end at the first ``>``.  Null html has no links.  Repeated rows give a row each;
ids may be null.  Tables may be empty; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import compact, ship_library, small_side, table
from lodestar.llm.graph import components

#: (host, path prefix, verdict) of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Rules in a list up to this many are one expression; more are joined as a table.
MAX_LISTED = 256

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _behind(url: Column) -> Column:
    """What stands after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_behind(url), r"^[^/?#]*", 0), *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """A 128-bit key of the normal form; null for urls without a host."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)?$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_behind(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(?:^|&)utm_[^&]*", ""), r"^&+", "")
    return F.when(host != "", F.unhex(F.md5(F.concat(host, path, F.lit("?"), query))))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null: one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r[0] + r[1])):  # later ones stand before earlier ones
        found = F.when(_fits(host, path, F.lit(h), F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(found)
    return F.when(host != "", found)


def joined_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with rule and verdict, from a table of rules (host, path, verdict) of any size.

    A distinct host and path meets the rules by equality: each of its host's suffixes
    with each length of path that rules of that suffix have.
    """
    # one verdict a rule, allow before block
    table_ = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("verdict"))
    lengths = table_.select("r_host", F.length("r_path").alias("l")).distinct()
    places = urls.select("host", "path").filter("host <> ''").distinct()
    names = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    asked = places.withColumn("r_host", F.explode(suffixes)).join(lengths, "r_host").filter("l <= length(path)").withColumn("r_path", F.expr("substring(path, 1, l)"))
    rule = F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), (F.col("verdict") == "allow").alias("allows"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    decided = asked.join(table_, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(rule).alias("r")).select("host", "path", "r.rule", "r.verdict")
    return urls.join(decided, ["host", "path"], "left")


def resolved(linked: DataFrame) -> DataFrame:
    """(url, target) of rows (url, link): the absolute url of a page's link; empty links and other schemes than http(s) go."""
    link, site, folder = F.col("link"), F.col("site"), F.col("folder")
    parts_ = linked.select("url", "link", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*(?=://)", 0).alias("scheme"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = parts_.withColumns({"site": F.concat("scheme", F.lit("://"), "host"), "folder": F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), "^/", ""))})
    target = (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat("scheme", F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[?#]"), F.concat(site, "path", link))
        .otherwise(F.concat(site, folder, link))
    )
    # written before it is filtered on: a filter would carry the whole expression down, once for every mention
    found = compact(placed.filter(F.trim(link) != "").select("url", target.alias("target")))[0].filter("target IS NOT NULL")
    # the segments . and .. of a path
    split = found.withColumn("segments", F.split(F.substring(path_of(F.col("target")), 2, 1 << 30), "/", -1))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s))
    dotted = F.arrays_overlap("segments", F.array(F.lit("."), F.lit("..")))
    walked = split.withColumn("stack", F.when(dotted, F.aggregate("segments", F.array().cast("array<string>"), step)))
    tail = F.when(F.element_at("segments", -1).isin(".", "..") & (F.size("stack") > 0), "/").otherwise("")
    plain = F.concat(F.regexp_extract("target", r"^[^:]*://[^/?#]*", 0), F.lit("/"), F.array_join("stack", "/"), tail, F.regexp_extract("target", r"[?#].*$", 0))
    return compact(walked.select("url", F.coalesce(plain, F.col("target")).alias("target")))[0]


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty where it is missing."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"""^["']|["']$""", ""), "&amp;", "&"))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): canonical and refresh links of the pages, as absolute urls."""
    html = F.regexp_replace(F.col(f"`{html_col}`"), r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*>.*?(?:</script|$)", " ")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\s[^<>]*>)"), 1)
    able = F.col(f"`{html_col}`").rlike(r"(?i)canonical|http-equiv")
    found = pages.filter(able & F.col(f"`{url_col}`").contains("://")).select(F.col(f"`{url_col}`").alias("url"), F.explode(tags).alias("tag"))
    named = found.select("url", "tag", *[_attribute(F.col("tag"), n).alias(n) for n in ("rel", "href", "http-equiv", "content")])
    is_canonical = F.col("tag").rlike(r"(?i)^<link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    is_refresh = F.col("tag").rlike(r"(?i)^<meta") & (F.lower("`http-equiv`") == "refresh")
    refresh = F.regexp_extract("content", r"(?is)^[\s\d.]*[;,]?\s*url\s*=\s*(.*)$", 1)
    refresh = F.trim(F.regexp_replace(refresh, r"""^["']|["']$""", ""))
    raw, n = compact(named.select("url", F.when(is_canonical, F.col("href")).when(is_refresh, refresh).alias("link")))
    return resolved(raw) if n else raw.withColumnRenamed("link", "target")


def _ruled(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with rule and verdict."""
    if isinstance(rules, DataFrame):
        return joined_rule(urls, rules)
    if len(rules) > MAX_LISTED:
        return joined_rule(urls, urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string"))
    return urls.withColumn("r", listed_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("r.rule"), "verdict": F.col("r.verdict")}).drop("r")


def blocked_keys(pages: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> tuple[DataFrame, int]:
    """(key) of the undecided pages that an alias blocks, and how many; pages: (key, verdict), edges: (url, target)."""
    kept, n_edges = compact(edges.select(key_of(F.col("url")).alias("u"), key_of(F.col("target")).alias("v"), "url", "target").distinct())
    kept = kept.filter("u IS NOT NULL AND v IS NOT NULL")
    marks = pages.filter("key IS NOT NULL").select("key", "verdict", F.col("verdict").isNull().alias("open"))
    if n_edges:  # ends need not be pages
        urls = kept.select(F.inline(F.array(F.struct(F.col("u").alias("key"), F.col("url").alias("url")), F.struct(F.col("v").alias("key"), F.col("target").alias("url")))))
        named = urls.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
        marks = marks.union(_ruled(named, rules).select("key", "verdict", F.lit(False)))
    flags = [F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False)).alias(v) for v in ("block", "allow")]
    by_key = marks.groupBy("key").agg(*flags, F.bool_or("open").alias("open"))
    hit = F.col("block") & ~F.col("allow") & F.col("open")
    if not n_edges:
        return compact(by_key.filter(hit).select("key"))
    members = components(kept.select("u", "v"))
    by_key = by_key.join(members, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    roots = by_key.groupBy("root").agg(*[F.bool_or(c).alias(c) for c in ("block", "allow", "open")]).filter(hit).select("root")
    return compact(by_key.filter("open").join(roots, "root").select("key"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """A row per page: id, host, path, rule (null where none fits), verdict, by_alias (decided by its aliases).

    ``redirects``: a table (url, target) of redirects, besides the links in the pages.
    """
    ship_library(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    ruled = _ruled(rows, rules)
    edges = [links(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        edges.append(redirects.select("url", "target"))
    edges = edges or [pages.sparkSession.createDataFrame([], "url string, target string")]
    blocked, n = blocked_keys(ruled.select("key", "verdict"), edges[0] if len(edges) == 1 else edges[0].union(edges[1]), rules)
    out = ruled.withColumn("by_alias", F.lit(False))
    if n:
        out = ruled.join(small_side(blocked.withColumn("hit", F.lit(True)), n), "key", "left").withColumn("by_alias", F.col("verdict").isNull() & F.coalesce("hit", F.lit(False)))
    verdict = F.coalesce("verdict", F.when(F.col("by_alias"), "block").otherwise("allow"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "by_alias")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op11_url_filter": op11_url_filter}
