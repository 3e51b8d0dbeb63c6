"""URL filtering with redirect equivalence (operator 4), in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.bind import bind
from tidewell.llm.columns import ascii_lower, only
from tidewell.llm.components import components

#: action, host, path; fixed values of the contract
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; empty for null or no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule of each distinct ``(host, path)``: ``host, path, rule, action``.

    Each host becomes its own suffixes (as many rows as it has labels), which
    meet the rules by equality, so long rule lists work as a hash join.  Equal
    lengths go to an allow.
    """
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    rule = F.concat("rule_host", "rule_path")
    found = (
        places.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.startswith("path", "rule_path"))
    )
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("allows"), rule.alias("rule")))
    return (
        found.groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", F.when(F.col("best.allows"), "allow").otherwise("block").alias("action"))
    )


def _name(url: Column) -> Column:
    """A url as a node: lower-case host, no fragment."""
    cut = F.substring_index(url, "#", 1)
    at = F.instr(cut, "://")
    host = F.regexp_extract(_after_scheme(cut), r"^[^/?#]*", 0)
    rest = F.substring(cut, at + 3 + F.length(host), F.length(cut))
    return F.when(at > 0, F.concat(F.substring(cut, F.lit(1), at + 2), ascii_lower(host), rest))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(source, target)`` urls of canonical links and redirects in ``pages(url, html)``.

    Absolute targets, ``//host/path``, ``/path`` and relative ones are
    resolved against the page's url.
    """
    url, html, to = F.col("url"), F.col("html"), F.col("to")
    hinted = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(
            F.regexp_extract_all(html, F.lit(REFRESH_TAG), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH_URL, 1)
        ),
    )
    found = pages.where((F.instr(url, "://") > 0) & hinted).select("url", F.explode(tags).alias("to")).where(to != "")
    found = found.select("url", F.replace(to, F.lit("&amp;"), F.lit("&")).alias("to"))
    bare = F.regexp_extract(url, r"^[^?#]*", 0)
    folder = F.regexp_replace(F.concat(bare, F.when(path_of(url) == "", "/").otherwise("")), r"[^/]*$", "")
    scheme = F.substring_index(url, "://", 1)
    # each step is bound: pasted into one another these expressions outgrow a generated method
    found = bind(bind(bind(found, "folder", folder), "scheme", scheme), "host", host_of(url))
    target = (
        F.when(F.contains(to, F.lit("://")), to)
        .when(F.startswith(to, F.lit("//")), F.concat("scheme", F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat("scheme", F.lit("://"), "host", to))
        .otherwise(F.concat("folder", to))
    )
    found = bind(found, "target", target)
    found = bind(bind(found, "from_node", _name(url)), "to_node", _name(F.col("target")))
    return found.select(F.col("from_node").alias("source"), F.col("to_node").alias("target"))


def _placed(df: DataFrame, url: Column) -> DataFrame:
    return bind(bind(df, "host", host_of(url)), "path", path_of(url))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url, html)``.

    The longest fitting rule decides.  A url without a rule takes the
    decision of its aliases, the urls joined to it by redirects and canonical
    links over any number of steps: block where a blocked one is among them
    and none is explicitly allowed, else allow.  Null urls have no host and no
    alias and are allowed; null html has no links; repeated rows are judged
    alike; other columns are not read.
    """
    rows = _placed(bind(only(pages, "page_id", "url"), "node", _name(F.col("url"))), F.col("url"))
    ruled = rows.join(match_rules(rows, rules), ["host", "path"], "left")
    member = components(alias_edges(only(pages, "url", "html")))
    everyone = member.select("node", "component").union(member.select("component", "component").distinct())
    known = _placed(everyone, F.col("node"))
    known = known.join(match_rules(known, rules), ["host", "path"])
    group = known.groupBy("component").agg(
        F.bool_or(F.col("action") == "block").alias("blocked"), F.bool_or(F.col("action") == "allow").alias("allowed")
    )
    group = group.where(F.col("blocked") & ~F.col("allowed")).select("component")
    blocked = everyone.join(group, "component", "left_semi").select("node", F.lit(True).alias("by_alias"))
    verdict = F.coalesce("action", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return ruled.join(blocked, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
