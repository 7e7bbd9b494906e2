"""URL filter: rules on hosts and paths, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.functions.text import once
from stallbook.llm.components import connected_components

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`verdict` (allow or block) for a host with its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query; the operator takes any list that fits one expression.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """The path with its . and .. segments resolved; what leads above the root stays at the root."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/", -1)
    ends_open = F.element_at(parts, -1).isin(".", "..")
    resolved = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.element_at(parts, 1)), step)
    joined = F.concat(F.array_join(resolved, "/"), F.when(ends_open, "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(path)


def address_of(url: Column) -> Column:
    """Host, path without dot segments, and query: the scheme and the part after # name no other resource. Null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), without_dots(path_of(url)), query))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict); null if none fits."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # longer ones ask first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in double quotes, in single ones or bare; empty if there is none."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def _tags(html: Column, name: str, keep) -> Column:
    """The first tag of this name for which keep(tag) holds; null if there is none."""
    tags = F.regexp_extract_all(html, F.lit(rf"""(?i)<{name}\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), 0)
    return F.get(F.filter(tags, keep), 0)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses: the canonical link and the immediate redirect that each page states, if any.

    Attributes may come in any order and any quotes, and `rel` may list several words.
    """
    page = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.lower("html").rlike("canonical|refresh"))
    words = lambda x: F.split(F.lower(x), r"[\x20\x09-\x0D]+")
    link = _tags(F.col("html"), "link", lambda x: F.array_contains(words(_attribute(x, "rel")), "canonical"))
    meta = _tags(F.col("html"), "meta", lambda x: F.trim(F.lower(_attribute(x, "http-equiv"))) == "refresh")
    canonical = F.trim(_attribute(link, "href"))
    moved = F.regexp_extract(_attribute(meta, "content"), r"""(?i)\burl\s*=\s*["']?([^"'\s]+)""", 1)
    canonical, moved = F.coalesce(canonical, F.lit("")), F.coalesce(moved, F.lit(""))
    page = page.withColumn("href", F.explode(F.array(canonical, moved))).where("href <> ''").withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))
    site = F.concat(F.lit("http://"), host_of(F.col("url")))
    href = F.col("href")
    absolute = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#"), F.lit(None))
        .when(href.startswith("?"), F.concat(site, path_of(F.col("url")), href))
        .otherwise(F.concat(site, F.regexp_extract(path_of(F.col("url")), "^.*/", 0), href))
    )
    page = page.select("url", once(absolute).alias("href")).where("href is not null")
    return page.select(once(F.struct(address_of(F.col("url")).alias("source"), address_of(F.col("href")).alias("target"))).alias("link")).select("link.*").dropna()


def judge_pages(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None,
                page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, host, path, rule, alias_verdict, verdict) of every page.

    The longest rule that fits a page decides. Pages without a rule take the decision of their aliases: addresses
    joined by canonical links and redirects, in any number of steps; `redirects` (source, target as URLs) adds
    links that are not in the pages. An allow rule on any alias goes before block rules on others; without a rule on
    any alias the page is allowed. Null URLs and URLs without :// have an empty host and path, no rule and no alias.
    Repeated pages are judged alike and returned as often. An empty table gives no rows; other columns are not read.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select(address_of(F.col("source")), address_of(F.col("target"))).dropna())
    aliases = connected_components(links, "source", "target")
    parts = F.struct(F.regexp_extract("node", "^[^/?]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    aliases = aliases.select("node", "component", once(parts).alias("at")).withColumn("own", rule_of(F.col("at.host"), F.col("at.path"), rules))
    verdicts = aliases.groupBy("component").agg(
        F.when(F.max(F.expr("own.verdict = 'allow'")), "allow").when(F.max(F.expr("own.verdict = 'block'")), "block").alias("alias_verdict"))
    by_address = aliases.join(verdicts, "component").select("node", "alias_verdict")
    parts = F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), address_of(F.col(url)).alias("node"))
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), once(parts).alias("at")).select("page_id", "url", "at.*")
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return judged.join(by_address, "node", "left").select(
        "page_id", "url", "host", "path", F.col("found.name").alias("rule"), "alias_verdict",
        F.coalesce("found.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
