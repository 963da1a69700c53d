"""URL filter by redirect equivalence: host and path rules, spread over alias components.

Only DataFrame expressions run here. Pages are nodes (their address without scheme and
fragment); a page's canonical link and its refresh redirect are edges. Components of that
graph are aliases of one another, so a decision that a rule takes on one address holds for
the aliases that no rule judges; an explicit allow among them outweighs any block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, stage
from .components import connected_components

#: (verdict, host and path) as the contract fixes them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Link and meta tags; comments and elements whose content is no markup are matched first and whole, so nothing in them is a
#: tag. Possessive throughout, and a tag ends where another opens outside quotes: nothing, however long, makes the matcher
#: recurse, turn back or read to the end again and again.
_LINK = (
    r"""(?is)<!--(?:.*?-->|.*+)|<(script|style|textarea|title|template|noscript|iframe|xmp|noembed|noframes)\b[^<>]*+>(?:.*?</\1\s*+>|.*+)"""
    r"""|<(?:link|meta)\b[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
)
#: A name and its value, quotes included, one after the other; the tag's own name comes first.
_PAIR = r"""(?s)([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``. Else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host or subdomain, path prefix) as ``struct(rule, verdict)``; null if none."""
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        hit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def node_of(url: Column) -> Column:
    """The address as a graph node: host, path and query, without scheme and fragment; null if it has no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, path, query))


def _attribute(name: str) -> Column:
    """The first value of an attribute, from the columns ``names`` and ``values``."""
    found = F.get("values", F.array_position("names", name).cast("int") - 1)
    return F.trim(F.replace(F.coalesce(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit("")), F.lit("&amp;"), F.lit("&")))


def _absolute(base: Column, link: Column) -> Column:
    host, path = host_and_path(base)
    scheme = F.concat(F.regexp_extract(base, r"^[^:/?#]*", 0), F.lit("://"))
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(scheme, host, link))
        .when(link.startswith("?"), F.concat(scheme, host, path, link))
        .when((link == "") | link.startswith("#"), F.lit(None))
        .otherwise(F.concat(scheme, host, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` for each canonical link and refresh redirect in a page's HTML."""
    tags = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull()).select(
        "url", F.explode(F.filter(F.regexp_extract_all("html", F.lit(_LINK), 0), lambda t: t.rlike("^(?i)<(?:link|meta)"))).alias("tag")
    )
    pairs = lambda group: F.regexp_extract_all("tag", F.lit(_PAIR), group)
    tags = tags.select("url", F.transform(pairs(1), lower_ascii).alias("names"), pairs(2).alias("values"))
    content = _attribute("content")
    target = F.when(lower_ascii(_attribute("rel")) == "canonical", _attribute("href")).when(
        lower_ascii(_attribute("http-equiv")) == "refresh",
        F.trim(F.regexp_replace(F.regexp_extract(content, r"(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*(.*)$", 1), "^['\"]|['\"]$", "")),
    )
    found = tags.select("url", target.alias("target")).where("target is not null and target <> ''")
    return found.select(node_of(F.col("url")).alias("src"), node_of(_absolute(F.col("url"), F.col("target"))).alias("dst"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Judges each row of ``pages(page_id, url, html)``; one row per input row.

    Returns page_id, host, path, rule, verdict and ``by_alias`` (the verdict came from an alias).
    A null url or one without ``://`` has an empty host and path, no rule and no alias, hence
    ``allow``; null html has no links; repeated rows are judged alike; further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node")).withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    edges = stage(alias_edges(pages).distinct(), "url-edges").df
    members = connected_components(edges).withColumn("url", F.concat(F.lit("any://"), "node"))
    host, path = host_and_path(F.col("url"))
    members = members.select("node", "component", rule_for(host, path, rules)["verdict"].alias("said"))
    spread = members.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    blocked = spread.where("blocked and not coalesce(allowed, false)").select("component", F.lit(True).alias("alias_blocked"))
    blocked = members.join(blocked, "component").select("node", "alias_blocked")
    out = judged.join(blocked, "node", "left")
    by_alias = F.col("hit").isNull() & F.coalesce("alias_blocked", F.lit(False))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        by_alias.alias("by_alias"),
    )
