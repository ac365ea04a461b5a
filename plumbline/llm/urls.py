"""URL filters with redirect equivalence, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's path; the longest rule wins (of equally long ones
allow, then the smallest).

Urls without a rule are judged by their aliases.  Two urls are aliases if they
have the same canonical form (scheme, leading ``www.``, default port,
fragment, ``utm_`` parameters and a closing slash do not matter), or if a
page's canonical link or refresh redirect leads from one to the other, in any
number of steps.  Targets may be relative: they are resolved against the page's
host and folder, ``.`` and ``..`` are folded, and ``&amp;`` is ``&``; a target of
a scheme without ``//`` (``mailto:``) or within the page (``#``) leads nowhere.  Distributed connected components over these links form the
classes; an explicit allow in the class wins, else an explicit block, else the
url is allowed.

Null urls and urls without ``://`` have an empty host and path, no rule and no
aliases, and are allowed.  Null html has no links.  Rows are judged one by
one: repeated rows and null ids stay.  A hot host, url or target is an
ordinary join key of written tables, which skew handling may split; votes are
aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import components, quoted

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between ``://`` and the next of ``/?#``, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that aliases by spelling share; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)\z", "")
    path = F.regexp_replace(path_of(url), r"/\z", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def folded(path: Column) -> Column:
    """A path without the segments ``.`` and ``..`` and what they take back."""
    out = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc)
                      .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.array_join(out, "/")).otherwise(path)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The absolute url of a link's target on a page; null if it leads nowhere."""
    site, rest = F.concat(F.lit("http://"), host), F.regexp_extract(target, r"(?s)([?#].*)\z", 1)
    bare = F.regexp_extract(target, r"(?s)\A([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"(?s)[^/]*\z", "")
    return (F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"\A([A-Za-z][A-Za-z0-9+.-]*:|#|\z)"), None)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("?"), F.concat(site, path, target))
            .when(target.startswith("/"), F.concat(site, folded(bare), rest)).otherwise(F.concat(site, folded(F.concat(folder, bare)), rest)))


def links(html: Column, host: Column, path: Column) -> Column:
    """Absolute targets of canonical links and refresh redirects."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)
    canon = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")), lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    moved = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    targets = F.transform(F.concat(canon, moved), lambda t: F.regexp_replace(t, r"(?i)&(amp|#38|#x26);", "&"))
    return F.filter(F.transform(targets, lambda t: resolved(t, host, path)), lambda t: t.isNotNull())


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for the urls (url, host, path) that some rule fits.

    A host is cut to the numbers of labels that rules have, whatever its own.
    """
    widths = rules.agg(F.collect_set(F.size(F.split("host", r"\.")))).scalar()
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "verdict")
    best = F.min(F.struct((-F.length("rule")).alias("n"), "verdict", "rule"))
    cut = urls.select("url", "path", "host", F.explode(widths).alias("n")).where(F.size(F.split("host", r"\.")) >= F.col("n"))
    return (cut.select("url", "path", F.call_function("substring_index", "host", F.lit("."), -F.col("n")).alias("suffix")).join(own, "suffix")
            .where(F.expr("startswith(path, rule_path)")).select("url", "verdict", F.concat("suffix", "rule_path").alias("rule"))
            .groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.verdict"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: its id, host, path, rule (null if none fits) and verdict."""
    seen = pages.select(quoted(key).alias("id"), quoted(url).alias("url"), quoted(html).alias("html"))
    seen = seen.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    steps = cut_lineage(seen.where("html is not null").select("url", F.explode(links(F.col("html"), F.col("host"), F.col("path"))).alias("target")))
    # targets are judged like pages, so that a redirect to a blocked url counts even if that is no page
    every = seen.select("url").union(steps.select("target")).where(F.col("url").contains("://")).distinct()
    urls = cut_lineage(every.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("form")))
    ruled = cut_lineage(fitting_rules(urls, rules))
    roots = cut_lineage(components(steps.select(canonical(F.col("url")).alias("a"), canonical(F.col("target")).alias("b"))))
    rooted = urls.select("url", "form").join(roots.withColumnRenamed("node", "form"), "form", "left").select("url", F.coalesce("root", "form").alias("root"))
    rooted = cut_lineage(rooted)
    votes = rooted.join(ruled, "url").groupBy("root").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
    blocked = cut_lineage(votes.where("block and not allow").select("root"))
    aliases = cut_lineage(rooted.join(blocked, "root").select("url", F.lit("block").alias("by_alias")))
    return (seen.select("id", "url", "host", "path").join(ruled, "url", "left").join(aliases, "url", "left")
            .select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", "by_alias", F.lit("allow")).alias("verdict")))
