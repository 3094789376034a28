"""URL filter with redirect equivalence, with DataFrame operations only.

Rules name a host and a path; a rule fits its host and all subdomains where the url's path starts with the rule's path, and
the longest fitting rule decides (longest host, then longest path). A page without a rule is judged by its aliases: pages that
redirect to each other or name the same canonical link are one group (connected components), and a group in which a rule
blocks a page blocks its other pages. A page that a rule allows stays allowed: an explicit rule goes before what aliases say.
Without either, the page is allowed.

Links come from every ``<link rel="canonical" href>`` and ``<meta http-equiv="refresh" content="..;url=..">`` of a page, quoted
or not, and from an optional table of redirects. "&amp;" and references to quotes are decoded; targets relative to the page are
resolved against its url or its ``<base href>``, and targets that are no address (mailto:) are left out. Addresses are
compared without scheme, fragment, default port, case of the host and dot segments.

Rules are looked up by the url's own host suffixes, so a page meets only rules of its hosts. Groups are found on the linked
addresses alone, as 64-bit hashes, with grouped minimums; a page without links takes no part.

Defined results. Null url or one without "://": host and path empty, no rule, allow. Null html: no links. Repeated rows give
equal rows. Two rules with one host and path: allow goes first. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.llm.common import components, cut

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?is)<(?:link|meta|base)\b[^>]*"
CANONICAL = r"""(?is)^<link\b.*(?<![\w-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?![^\s"])|'(?:[^']*\s)?canonical(?![^\s'])|canonical(?![^\s/]))"""
REFRESH = r"""(?is)^<meta\b.*(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b"""
VALUE = r"""(?is)(?<![\w-])NAME\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'][^\s]*))"""
#: The url of a refresh: after "url=", or straight after the seconds.
REFRESH_URL = r"""(?is)^(?:[^"':/?#]*?\burl\s*=\s*|\s*[0-9.]+\s*[;,]\s*(?!url\b))(?:"([^"]*)|'([^']*)|([^\s"'][^\s]*))"""


def let(value: Column, make) -> Column:
    """make(value) with the value computed once: expressions that name it often do not grow with it."""
    return F.get(F.transform(F.array(value), make), 0)


def groups_of(value: Column, pattern: str) -> Column:
    """The one group of three that took part; empty where none did."""
    return F.concat(*[F.regexp_extract(value, pattern, k) for k in (1, 2, 3)])


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, with its character references for "&" and quotes decoded."""
    value = groups_of(tag, VALUE.replace("NAME", name))
    for sign, reference in (('"', "quot|#0*34|#x0*22"), ("'", "apos|#0*39|#x0*27"), ("&", "amp|#0*38|#x0*26")):
        value = F.regexp_replace(value, f"(?i)&(?:{reference});", sign)
    return value


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    rooted = F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(host, let(rooted, lambda r: F.when(r.contains("/."), without_dots(r)).otherwise(r))))


def without_dots(rest: Column) -> Column:
    """A path with query after its segments "." and ".." are applied."""
    path = F.regexp_extract(rest, r"(?s)^/([^?]*)", 1)
    parts = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/", -1)
    nothing = F.array().cast("array<string>")
    parts = F.aggregate(parts, nothing, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"), F.regexp_extract(rest, r"(?s)\?.*", 0))


def resolved(to: Column, url: Column) -> Column:
    """The address that ``to`` names on the page ``url``; null where it is none."""
    return let(F.trim(F.regexp_replace(to, r"[\t\r\n]", "")), lambda t: let(url, lambda u: _resolved(t, u)))


def _resolved(to: Column, url: Column) -> Column:
    base = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(url, r"(?s)^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    below = F.when(to.startswith("?"), F.concat(base, path, to)).otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), to))
    absolute, other = to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return (F.when((to == "") | to.startswith("#"), None).when(absolute, to).when(other, None).when(to.startswith("//"), F.concat(F.lit("http:"), to))
            .when(base == "", None).when(to.startswith("/"), F.concat(base, to)).otherwise(below))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def with_rule(pages: DataFrame, rules: DataFrame, of: str = "page_id") -> DataFrame:
    """(of, url, html, host, path, rule, rule_verdict) of every page, the last two null where no rule fits."""
    rows = pages.select(F.col(of), "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    # A host's suffixes: example.org and org for www.example.org.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_host = rules.groupBy("rule_host").agg(F.collect_list(F.struct(
        F.length("rule_host").alias("h"), F.length("rule_path").alias("p"), (F.col("rule_verdict") == "allow").alias("allow"),
        "rule_host", F.col("rule_path").alias("rule_path"), F.col("rule_verdict").alias("rule_verdict"))).alias("rules"))
    pairs = rows.select("url", F.explode(suffixes).alias("rule_host")).where("url IS NOT NULL").distinct().join(by_host, "rule_host")
    fits = pairs.select("url", F.explode("rules").alias("r")).where(path_of(F.col("url")).startswith(F.col("r.rule_path")))
    best = fits.groupBy("url").agg(F.max("r").alias("r"))
    best = best.select("url", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.rule_verdict").alias("rule_verdict"))
    return rows.join(best, "url", "left").select(of, "url", "html", "host", "path", "rule", "rule_verdict")


def links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(source, target): addresses that stand for each other."""
    marked = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    tags = marked.select("url", F.regexp_extract_all("html", F.lit(TAG), 0).alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b")), lambda t: attribute(t, "href")), lambda x: x != "")
    tags = tags.select("url", F.coalesce(resolved(F.get(bases, 0), F.col("url")), "url").alias("base"), F.explode("tags").alias("tag"))
    to = F.when(F.col("tag").rlike(CANONICAL), attribute(F.col("tag"), "href")).when(F.col("tag").rlike(REFRESH), groups_of(attribute(F.col("tag"), "content"), REFRESH_URL))
    found = tags.select("url", "base", to.alias("to")).where("to <> ''")
    found = found.select(address(F.col("url")).alias("source"), let(resolved(F.col("to"), F.col("base")), address).alias("target"))
    if redirects is not None:
        found = found.unionAll(redirects.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target")))
    return found.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    judged = with_rule(pages, rules).withColumn("node", F.xxhash64(address(F.col("url"))))
    edges = cut(links(pages, redirects), "links")
    groups = components(edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    blocked = judged.where("rule_verdict = 'block'").select("node").distinct().join(groups, F.col("node") == F.col("id")).select(F.col("comp")).distinct()
    bad = groups.join(blocked, "comp", "left_semi").select(F.col("id").alias("node")).distinct().withColumn("by_alias", F.lit(True))
    out = judged.drop("html").join(bad, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
