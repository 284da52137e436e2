"""URL filters with redirect equivalence, in DataFrame operations alone.

A page's url is judged by the longest rule that fits; one that no rule fits takes the decision of its
aliases: urls joined to it by canonical links or refresh redirects in the pages' html, through any number
of steps (connected components). An alias that a rule allows outweighs any that a rule blocks; without
either the page is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import durable

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?i)^<link\b.*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
_REFRESH = r"""(?i)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits: its host or a subdomain of it, and a path that starts with its path."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The url as a node: without fragment, its scheme and host lower-cased; null without ``://``."""
    whole = F.regexp_replace(url, r"#[\s\S]*$", "")
    scheme, host, rest = (F.regexp_extract(whole, r"^([\s\S]*?)://([^/?#]*)([\s\S]*)$", i) for i in (1, 2, 3))
    return F.when(url.contains("://"), F.concat(F.translate(scheme, UPPER, LOWER), F.lit("://"), F.translate(host, UPPER, LOWER), F.when(rest == "", F.lit("/")).otherwise(rest)))


def without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments."""
    folded = F.aggregate(
        F.slice(F.split(path, "/"), 2, 1 << 30),
        F.lit(""),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)),
    )
    return F.concat(folded, F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))


def resolved(url: Column, link: Column) -> Column:
    """The link as a whole url, seen from ``url``. Null for links that lead elsewhere than to a host (``mailto:``) or stay on the
    page (``#part``), and for those without a scheme on a page whose url has none."""
    base = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    scheme, host, path = (F.regexp_extract(base, r"^([\s\S]*?)://([^/?#]*)([\s\S]*)$", i) for i in (1, 2, 3))
    site, rest = F.concat(scheme, F.lit("://"), host), F.regexp_extract(link, r"[?#][\s\S]*$", 0)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    own = F.regexp_replace(link, r"[?#][\s\S]*$", "")
    relative = (
        F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, without_dots(own), rest))
        .when(link.startswith("?"), F.concat(base, link))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(url.contains("://") & ~link.startswith("#") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative)


def alias_edges(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(i, j, of_i, of_j): nodes of a page's url and of each url that it redirects to or calls canonical, and what rules say of
    the urls themselves: 2 to allow, 1 to block, 0 nothing. Links that lack a scheme are resolved against the page's url; ``base``
    tags have no effect."""
    url = F.col("url")
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    flat = F.transform(tags, lambda t: F.regexp_replace(t, r"\s+", " "))
    canonical = F.transform(F.filter(flat, lambda t: t.rlike(_CANONICAL)), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(F.filter(flat, lambda t: t.rlike(_REFRESH)), lambda t: F.regexp_extract(t, _URL, 1))
    linked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select(url, F.explode(F.concat(canonical, refresh)).alias("to")).where("to <> ''")
    ends = linked.select(url, resolved(url, F.regexp_replace("to", "&amp;", "&")).alias("to"))

    def code(u: Column) -> Column:
        verdict = _verdict(rule_of(host_of(u), path_of(u), rules), rules)
        return F.when(verdict == "allow", 2).when(verdict == "block", 1).otherwise(0)

    pairs = ends.select(node_of(url).alias("i"), node_of(F.col("to")).alias("j"), code(url).alias("of_i"), code(F.col("to")).alias("of_j"))
    return pairs.where("i is not null and j is not null and i <> j").groupBy("i", "j").agg(F.max("of_i").alias("of_i"), F.max("of_j").alias("of_j"))


def judged_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed; a null html has no links. An
    empty path and ``/`` are one node, but each url is judged by its own path. Pages that repeat are judged alike, with the links
    of all. Extra columns have no effect. An empty table gives an empty one.
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id"), url, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    edges = durable(alias_edges(pages.select("url", "html"), rules))
    found = connected_components(edges)
    own = edges.select(F.col("i").alias("node"), F.col("of_i").alias("own")).unionByName(edges.select(F.col("j").alias("node"), F.col("of_j").alias("own"))).groupBy("node").agg(F.max("own").alias("own"))
    groups = found.join(own, "node").groupBy("component").agg(F.max("own").alias("decision"))
    decided = found.join(groups, "component").where("decision = 1").select("node", F.lit("block").alias("alias_verdict"))
    open_ = rows.where("rule is null and node is not null").join(decided, "node", "left").drop("node", "url")
    ruled = rows.where("rule is not null or node is null").drop("node", "url").withColumn("alias_verdict", F.lit(None).cast("string"))
    both = ruled.unionByName(open_)
    return both.select("page_id", "host", "path", "rule", F.coalesce(_verdict(F.col("rule"), rules), "alias_verdict", F.lit("allow")).alias("verdict"))
