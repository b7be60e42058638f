"""URL filter by rules and redirect equivalence, with DataFrame operations only.

A url is judged by the longest rule that fits its host (or a domain above it) and begins its path. Urls that no
rule fits are judged by their aliases. Nodes are urls as they stand, but for scheme, default port and fragment; the
query is part of them. Edges are redirects (those given, and pages' meta refreshes), pages' canonical links, and, if
asked for, conventional redirects: to the host without a leading www or m, to the path without a trailing slash or an
index page, and to the query without utm_ parameters. Connected components are found by distributed label passing over
the edges. In a component an explicit allow rule of any member wins over block rules, a block rule blocks, and without
either a url is allowed.

Links are read outside comments and raw-text elements, their character references decoded (amp, lt, gt, quot, apos and
numbers below 256), and resolved against the page's url; base elements aren't taken into account.

Null urls and urls without "://" have empty host and path, no node, and are allowed; urls and pages of any length are
read whole. Repeated urls are judged each on their own row, and summed by node before they are shuffled. Empty tables
give empty results. Columns other than page_id, url and html don't matter, whatever their names. Rules are few, so they
are part of the expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Where no link is read, and where one is: a canonical link or a meta refresh.
UNREAD = "(?is)<!--.*?(?:-->|\\z)|<(script|style|textarea|title|xmp)\\b.*?(?:</\\1\\b|\\z)"
CANONICAL = "(?is)<link\\s(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
REFRESH = "(?is)<meta\\s(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*?\\bcontent\\s*=\\s*[\"']?\\s*[0-9.]+\\s*[;,]\\s*(?:url\\s*=\\s*)?[\"']?([^\"'\\s>]+)"
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Ids sent to every task at most; beyond, they are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def _rest(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null; of equally long ones the first given."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), reversed(ordered), none)


def _after_path(url: Column) -> Column:
    """The query with its question mark; empty without one."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^?#]*(\\?[^#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without fragment, its scheme always http, its host in lower case without the scheme's own port; null without a host."""
    port = F.when(F.lower(url).startswith("https:"), ":443$").otherwise(":80$")
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    return F.when(host != "", F.concat(F.lit("http://"), host, path_of(url), _after_path(url)))


def conventional(node: Column) -> Column:
    """Where a node redirects by convention; itself if nowhere."""
    host = F.regexp_replace(host_of(node), "^(?:www|m)\\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(node), "/index\\.html?$", "/"), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(_after_path(node), "(?<=[?&])utm_[^&]*(?:&|$)", ""), "[?&]$", "")
    return F.concat(F.lit("http://"), host, path, query)


def decoded(link: Column) -> Column:
    """A link with its character references decoded."""
    numbers = F.array_distinct(F.regexp_extract_all(link, F.lit("&#(?:[0-9]{1,4}|[xX][0-9a-fA-F]{1,4});"), F.lit(0)))
    digits = lambda r: F.regexp_extract(r, "([0-9a-fA-F]+);", 1)
    code = lambda r: F.when(F.lower(r).startswith("&#x"), F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("long")
    out = F.aggregate(numbers, link, lambda text, r: F.when(code(r) < 256, F.replace(text, r, F.call_function("char", code(r)))).otherwise(text))
    for name, character in NAMED:
        out = F.replace(out, F.lit(name), F.lit(character))
    return F.when(link.contains("&"), out).otherwise(link)


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute url, seen from a url; null if either has no host, or the link another kind of scheme."""
    host, path = host_of(url), path_of(url)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^.*/", 0)).otherwise("/")
    whole = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(path, link)).when(link.startswith("#"), F.concat(path, _after_path(url))).otherwise(F.concat(folder, link))
    steps = F.split(F.regexp_extract(whole, "^[^?#]*", 0), "/")
    # Steps "." stay where they are, ".." go up; as the last one they leave a folder.
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    walked = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    walked = F.concat(walked, F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise(""))
    walked = F.when(walked.startswith("/"), walked).otherwise(F.concat(F.lit("/"), walked))
    scheme = F.when(F.lower(url).startswith("https:"), "https:").otherwise("http:")
    inside = F.when(host != "", F.concat(scheme, F.lit("//"), host, walked, F.regexp_extract(whole, "^[^?#]*(.*)$", 1)))
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(~link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), inside)


def links_of(html: Column, url: Column) -> Column:
    """The page's canonical link and meta refresh as an array of absolute urls."""
    low = F.lower(html)
    readable = F.when(low.contains("canonical") | low.contains("refresh"), F.regexp_replace(html, UNREAD, " "))
    found = F.array(F.regexp_extract(readable, CANONICAL, 1), F.regexp_extract(readable, REFRESH, 1))
    return F.filter(F.transform(F.filter(found, lambda x: x != ""), lambda x: resolved(decoded(x), url)), lambda x: x.isNotNull())


def judged(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, conventions: bool = False) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, decided_by.

    pages: page_id, url and, if there, html. redirects: from_url, to_url. conventions: conventional redirects are edges.
    """
    url = F.col("url").cast("string")
    found = links_of(F.col("html").cast("string"), url) if "html" in pages.columns else F.array().cast("array<string>")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), found.alias("links"))
    rows = rows.select("*", matched(F.col("host"), F.col("path"), rules).alias("m"))
    # The page itself isn't kept: what is written is as short as the urls.
    rows = common.materialize(rows.select("page_id", "host", "path", "node", F.transform("links", node_of).alias("targets"), "m.rule", "m.verdict"), "urls")
    edges = rows.where("node is not null").select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url").cast("string")).alias("a"), node_of(F.col("to_url").cast("string")).alias("b")))
    edges = edges.where("a is not null and b is not null").distinct()
    if conventions:
        known = rows.select("node").unionByName(edges.select(F.col("a").alias("node"))).unionByName(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
        edges = edges.unionByName(known.select(F.col("node").alias("a"), conventional(F.col("node")).alias("b")))
    edges = common.materialize(edges.where("a != b").distinct(), "url-links")
    sums = rows.where("node is not null").groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("rule").isNull()).alias("open"))
    # Targets that aren't pages themselves may have rules of their own.
    linked = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    own = matched(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    linked = linked.select("node", (own == "allow").alias("allowed"), (own == "block").alias("blocked"), F.lit(False).alias("open"))
    linked_sums = linked.unionByName(sums.join(linked, "node", "left_semi")).groupBy("node").agg(*(F.max(c).alias(c) for c in ("allowed", "blocked", "open")))
    # Only components with a block rule and a url that no rule fits matter; nodes are numbered by a hash.
    number = lambda c: F.xxhash64(c)
    components = common.connected_components(edges.select(number("a").alias("a"), number("b").alias("b")), merge_first=False)
    members = linked_sums.withColumn("id", number("node")).join(components.select(F.col("node").alias("id"), "component"), "id")
    whole = members.groupBy("component").agg(*(F.max(c).alias(c) for c in ("allowed", "blocked", "open"))).where("open and coalesce(blocked, false) and not coalesce(allowed, false)").select("component")
    blocked = common.materialize(members.where("open").join(whole, "component", "left_semi").select("node", F.lit(True).alias("alias_blocked")), "blocked-aliases")
    few = F.broadcast(blocked) if blocked.count() <= BROADCAST_NODES else blocked
    # Rows that a rule fits, or without a node, don't take part in the join.
    by_alias = F.coalesce("alias_blocked", F.lit(False))
    asks = F.col("rule").isNull() & F.col("node").isNotNull()
    columns = ["page_id", "host", "path", "rule"]
    judged_by_alias = rows.where(asks).join(few, "node", "left").select(*columns, F.when(by_alias, "block").otherwise("allow").alias("verdict"), F.when(by_alias, "alias").otherwise("default").alias("decided_by"))
    others = rows.where(~asks).select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").otherwise("default").alias("decided_by"))
    return others.unionByName(judged_by_alias)


def op7(spark, sf_dir):
    return judged(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _cases(host: str, path: str) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "case " + " ".join(f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}') then '{h}{p}'" for _, h, p in ordered) + " end"


_VERDICTS = "case rule " + " ".join(f"when '{h}{p}' then '{v}'" for v, h, p in RULES) + " end"


_REST = "regexp_extract({0}, '^(?s:.*?)://((?s:.*))$', 1)"
_HOST = "coalesce(translate(regexp_extract(" + _REST + ", '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(" + _REST + ", '^[^/?#]*([^?#]*)', 1), '')"
_QUERY = "coalesce(regexp_extract(" + _REST + ", '^[^?#]*(\\?[^#]*)', 1), '')"
_READABLE = "regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\b|\\z)|<style\\b.*?(?:</style\\b|\\z)|<textarea\\b.*?(?:</textarea\\b|\\z)|<title\\b.*?(?:</title\\b|\\z)|<xmp\\b.*?(?:</xmp\\b|\\z)', ' ', 'g')"


def _node(url: str) -> str:
    host = f"case when starts_with(lower({url}), 'https:') then regexp_replace({_HOST.format(url)}, ':443$', '') else regexp_replace({_HOST.format(url)}, ':80$', '') end"
    return f"case when ({host}) <> '' then 'http://' || ({host}) || {_PATH.format(url)} || {_QUERY.format(url)} end"


#: Of relative links, those without steps "." and ".." and without character references but &amp;.
ORACLE = f"""
with recursive urls as (
    select page_id, url, {_HOST.format("url")} as host, {_PATH.format("url")} as path, {_node("url")} as node, {_READABLE} as html from pages
), tags as (
    select *, list_filter(regexp_extract_all(html, '(?is)<link\\s[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?canonical\\b'))[1] as canonical,
        list_filter(regexp_extract_all(html, '(?is)<meta\\s[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b'))[1] as refresh
    from urls
), hrefs as (
    select url, host, path, node, replace(unnest([regexp_extract(canonical, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), regexp_extract(refresh, '(?is)\\bcontent\\s*=\\s*["'']?\\s*[0-9.]+\\s*[;,]\\s*(?:url\\s*=\\s*)?["'']?([^"''\\s>]+)', 1)]), '&amp;', '&') as href
    from tags where node is not null
), targets as (
    select node, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then href when starts_with(href, '//') then 'http:' || href when starts_with(href, '/') then 'http://' || host || href
        when starts_with(href, '?') then 'http://' || host || case when path = '' then '/' else path end || href when starts_with(href, '#') then url
        else 'http://' || host || case when contains(path, '/') then regexp_extract(path, '^(.*/)', 1) else '/' end || href end as target
    from hrefs where href <> ''
), given as (
    select node as a, {_node("target")} as b from targets
), nodes as (
    select node as n from urls where node is not null union select b from given where b is not null
), edges as (
    select a, b from given where b is not null union select b, a from given where b is not null
), reach as (
    select n as x, n as y from nodes
    union
    select r.x, e.b from reach r join edges e on e.a = r.y
), every as (
    select y, {_HOST.format("y")} as host, {_PATH.format("y")} as path from (select distinct y from reach)
), known as (
    select y, {_VERDICTS} as verdict from (select y, {_cases("host", "path")} as rule from every)
), sums as (
    select r.x as node, bool_or(k.verdict = 'allow') as allowed, bool_or(k.verdict = 'block') as blocked
    from reach r join known k on k.y = r.y where k.verdict is not null group by r.x
), own as (
    select page_id, host, path, node, {_cases("host", "path")} as rule from urls
)
select j.page_id, j.host, j.path, j.rule, coalesce({_VERDICTS}, case when s.blocked and not s.allowed then 'block' else 'allow' end) as verdict
from own j left join sums s on s.node = j.node
"""
