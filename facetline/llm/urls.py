"""URL filters: rules by host and path, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.llm.common import connected_components, read
from facetline.session import Scratch

#: (verdict, rule) with the rule's host and path written together; fixed values.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, with A-Z lower-cased; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. The rules are a stated list, a parameter."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment, host in lower case: what aliases are compared by. Null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), rest))


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the page's node and that of its canonical link, and that of its refresh target, resolved against the page."""
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>;]+)"
    found = F.array(F.regexp_extract(html, tag, 1), F.regexp_extract(html, refresh, 1))
    rows = pages.where(F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("url"), F.explode(found).alias("to")).where("to != ''")
    to, base = F.col("to"), F.concat(host_of(F.col("url")), path_of(F.col("url")))
    host = host_of(F.col("url"))
    whole = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.startswith("/"), F.concat(F.lit("x://"), host, to))
        .when(to.startswith("?") | to.startswith("#"), F.concat(F.lit("x://"), base, to))
        .otherwise(F.concat(F.lit("x://"), host, F.regexp_extract(F.concat(path_of(F.col("url")), F.lit("/")), r"(?s)^(.*/)[^/]*/?$", 1), to))
    )
    return rows.select(node_of(F.col("url")).alias("a"), node_of(whole).alias("b")).where("a != b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, links: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule and verdict (replacing columns so named), one row per row.

    A page that a rule fits gets the longest rule's verdict, an explicit allow too, whatever its aliases. Any other page
    is blocked if a URL that redirects and canonical links connect it with is blocked by a rule, and else allowed.
    links: (a, b) nodes as node_of() makes them; by default those found in the html. Nulls: a null url fits no rule, has
    no aliases and is allowed; null html has no links. Only components that hold a block are joined to pages.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    links = links_of(pages, url, html) if links is None else links
    nodes = connected_components(scratch, links)
    verdict_of = best_rule(F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules)
    blocked = nodes.where(verdict_of["verdict"] == "block").select("component").distinct()
    alias = scratch.cut(nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("__alias")).distinct())
    base = pages.drop("host", "path", "rule", "verdict")
    best = best_rule(F.col("host"), F.col("path"), rules)
    out = base.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn("__best", best)
    out = out.join(alias, node_of(F.col(url)) == F.col("__alias"), "left")
    return out.withColumn("rule", F.col("__best.rule")).withColumn("verdict", F.coalesce("__best.verdict", F.when(F.col("__alias").isNotNull(), "block").otherwise("allow"))).drop("__best", "__alias")


def op3_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_PARTS = r"""
parts AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
"""
SQL = f"""
WITH RECURSIVE {_PARTS.strip()},
rules(verdict, rule, h, p) AS (VALUES {', '.join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
links AS (
  SELECT host || path || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1) AS a,
    unnest([regexp_extract(html, '(?is)<link [^>]*rel="canonical"[^>]*href="[^"]*?://([^"#]+)', 1), regexp_extract(html, '(?is)<meta [^>]*http-equiv="refresh"[^>]*url=[^">]*?://([^">#]+)', 1)]) AS b
  FROM parts WHERE url LIKE '%://%'),
both_ways AS (SELECT a, b FROM links WHERE b != '' AND a != b UNION SELECT b, a FROM links WHERE b != '' AND a != b),
judged AS (
  SELECT n.a AS node, (SELECT r.verdict FROM rules r WHERE (regexp_extract(n.a, '^[^/?]*') = r.h OR regexp_extract(n.a, '^[^/?]*') LIKE '%.' || r.h) AND starts_with(regexp_extract(n.a, '^[^/?]*([^?]*)', 1), r.p) ORDER BY length(r.rule) DESC LIMIT 1) AS verdict
  FROM (SELECT DISTINCT a FROM both_ways) n),
reached(node) AS (SELECT node FROM judged WHERE verdict = 'block' UNION SELECT e.b FROM reached JOIN both_ways e ON e.a = reached.node),
best AS (
  SELECT page_id, url, host, path, (SELECT r.rule FROM rules r WHERE (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p) ORDER BY length(r.rule) DESC LIMIT 1) AS rule
  FROM parts)
SELECT page_id, host, path, best.rule,
  coalesce(rules.verdict, CASE WHEN url LIKE '%://%' AND host || path || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1) IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM best LEFT JOIN rules ON rules.rule = best.rule
"""
