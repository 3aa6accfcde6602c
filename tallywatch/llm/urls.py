"""URL filter with redirect equivalence, in Spark expressions and joins.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts
with the rule's; the longest rule wins. Pages without a rule get the verdict of their
aliases: pages tied by redirect (meta refresh) or canonical links, directly or over others,
form a component. An explicit allow comes first: one allowed alias allows the component, else
one blocked alias blocks it, else its pages are allowed.

The nodes are addresses: url without scheme and fragment, host in lower case, so that a
link target counts even if it is no page itself; its own rule then counts too. Relative
link targets are resolved against the page (a leading ``/``, ``//`` or ``?``, or else its
folder). Pages of the same address are one node.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and
no links of its own; a null html has no links; repeated rows are judged alike; equally long
rules: allow wins; empty tables give empty results. Rules are a table too and joined by host
suffix, so a block list may be long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywatch.llm.common import bounded, pick
from tallywatch.llm.graph import connected_components
from tallywatch.session import stage

# The rules of the query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path and query; null where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), rest))


def links(html: Column) -> Column:
    """Targets of the canonical links and meta refreshes of a page, as they are written."""
    tag = r"(?is)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(tag), 0)

    def value(t: Column, name: str) -> Column:
        pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
        return F.concat(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])

    def target(t: Column) -> Column:
        refresh = F.regexp_extract(value(t, "content"), r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
        return (
            F.when(value(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), value(t, "href"))
            .when(F.lower(F.trim(value(t, "http-equiv"))) == "refresh", refresh)
            .otherwise(F.lit(""))
        )

    plain = F.transform(tags, lambda t: F.replace(F.trim(target(t)), F.lit("&amp;"), F.lit("&")))
    return F.filter(plain, lambda t: t != "")


def resolve(target: Column, url: Column) -> Column:
    """The absolute url of a link target on the page ``url``."""
    scheme = F.substring_index(url, "://", 1)
    top = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(top, target))
        .when(target.startswith("?"), F.concat(top, path(url), target))
        .otherwise(F.concat(top, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def by_rules(named: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` (distinct) with the ``rule`` and ``verdict`` of the longest that fits."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    rules = pick(rules, "host", "path", "verdict").select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")
    )
    text = F.concat("_host", "_path")
    best = F.max(
        F.struct(
            F.length(text).alias("length"),
            (F.col("_verdict") == "allow").alias("allow"),
            F.concat("_host", "_path").alias("rule"),
            F.col("_verdict").alias("verdict"),
        )
    )
    return (
        named.filter("host != ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(bounded(rules), (F.col("suffix") == F.col("_host")) & F.col("path").startswith(F.col("_path")))
        .groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``host``, ``path``, ``rule``, ``verdict``."""
    page = pick(pages, "page_id", "url", "html")
    # Links and names are read off the pages once; the html goes no further.
    seen = stage(
        page.select(
            "page_id",
            "url",
            host(F.col("url")).alias("host"),
            path(F.col("url")).alias("path"),
            address(F.col("url")).alias("address"),
            links(F.col("html")).alias("links"),
        ),
        "pages",
    )
    linked = (
        seen.filter("address is not null")
        .select("address", "url", F.explode("links").alias("link"))
        .select("address", resolve(F.col("link"), F.col("url")).alias("to"))
        .select("address", "to", address(F.col("to")).alias("target"))
        .filter("target is not null")
        .distinct()
    )
    linked = stage(linked, "links")
    named = (
        seen.select("host", "path")
        .unionByName(linked.select(host(F.col("to")).alias("host"), path(F.col("to")).alias("path")))
        .distinct()
    )
    ruled = stage(by_rules(named, rules), "ruled").select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "rule", F.col("verdict").alias("own")
    )
    same = (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))

    parts = connected_components(linked, "address", "target")
    of_node = (
        seen.filter("address is not null")
        .select("address", "host", "path")
        .unionByName(
            linked.select(
                F.col("target").alias("address"),
                host(F.col("to")).alias("host"),
                path(F.col("to")).alias("path"),
            )
        )
        .distinct()
        .join(ruled, same)
        .select("address", "own")
    )
    told = (
        parts.join(of_node, F.col("node") == F.col("address"))
        .groupBy("component")
        .agg(F.min("own").alias("inherited"))  # allow sorts before block
        .filter("inherited = 'block'")
        .withColumnRenamed("component", "_component")
    )
    blocked = parts.join(told, F.col("component") == F.col("_component"), "left_semi").select(
        F.col("node").alias("_node"), F.lit("block").alias("inherited")
    )
    blocked = stage(blocked, "aliases")
    return (
        seen.join(ruled, same, "left")
        .join(bounded(blocked), F.col("address") == F.col("_node"), "left")
        .select(
            "page_id", "url", "host", "path", "rule",
            F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"),
        )
    )
