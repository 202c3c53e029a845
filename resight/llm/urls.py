"""URL rules, spread over redirects and canonical links. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm.components import connected_components
from resight.session import cut


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the filter.
RULES = (UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"),
         UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, the first of equal length; else null.

    The rules are few and fixed, so they are one CASE, longest first.
    """
    chosen = F
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = chosen.when(fits, found)
    return chosen


def same_page(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"^[^:/?#]*://[^/?#]*", 0)
    return F.concat(lower_ascii(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


#: What is no markup of the page: comments, scripts and raw text.
NOT_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title)\b.*?(?:</\1\s*>|\z)"
#: The character references that urls in attributes hold.
REFERENCES = (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

#: A canonical link or an immediate refresh (after 0 seconds), attributes in either order.
LINKS = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?\s*0+(?:\.0*)?\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""",
)


def absolute(url: Column, target: Column) -> Column:
    """`target` as seen from `url`: whole urls, those without scheme or host, and paths from the root or beside the page."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    root = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"^.*/", 0), F.lit("")), F.lit("/")))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(
        F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target)).when(
        F.startswith(target, F.lit("/")), F.concat(root, target)).otherwise(F.concat(folder, target))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: a page's url and the url its canonical link or refresh names, both as `same_page` writes them.

    Links in comments, scripts and raw text do not count, nor does a refresh after a while. Only pages that name one of
    the two words at all are searched further.
    """
    named = pages.where(F.col(url_col).contains("://") & F.col(html_col).rlike(r"(?i)canonical|refresh"))
    markup = F.regexp_replace(F.col(html_col), NOT_MARKUP, " ")
    found = F.array_union(*(F.regexp_extract_all(markup, F.lit(pattern), 1) for pattern in LINKS))
    links = named.select(F.col(url_col).alias("_url"), F.explode(found).alias("_target")).where(F.col("_target") != "")
    for reference, sign in REFERENCES:
        links = links.withColumn("_target", F.replace("_target", F.lit(reference), F.lit(sign)))
    return links.select(same_page(F.col("_url")).alias("a"),
                        same_page(absolute(F.col("_url"), F.col("_target"))).alias("b")).where("a != b").distinct()


def alias_verdicts(urls: DataFrame, edges: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """node, inherited: the verdict that every url of a component inherits; allow goes before block.

    `urls` has a column `node`; a url that only a link names takes part too, by the rule that fits it.
    """
    members = connected_components(edges)
    fitting = match_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    ruled = members.withColumn("_own", fitting)
    # 'allow' sorts before 'block'.
    decided = ruled.where(F.col("_own").isNotNull()).groupBy("component").agg(F.min("_own").alias("inherited"))
    return members.join(decided, "component").select("node", "inherited")


def judge_pages(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """`id_col`, host, path, rule, verdict of every row.

    Edges are canonical links and refreshes in the pages, and `redirects` (a, b: urls) if given. A url that a rule fits
    has that rule's verdict; any other one takes the verdict of the urls it is equivalent to, where an allowed one
    outweighs blocked ones, and is allowed if none of them has a rule. A null url or one without `://` has empty host
    and path, no equivalents and is allowed; a null page names no links. Repeated rows and urls are each judged; an
    empty table gives an empty one; columns of other names are not read.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(same_page(F.col("a")).alias("a"), same_page(F.col("b")).alias("b")))
    url = F.col(url_col)
    slim = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        F.when(url.contains("://"), same_page(url)).alias("node"))
    slim = slim.withColumn("found", match_rule(F.col("host"), F.col("path"), rules))
    inherited = alias_verdicts(slim, edges, rules)
    out = slim.join(inherited, "node", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
                      F.coalesce("found.verdict", "inherited", F.lit("allow")).alias("verdict"))
