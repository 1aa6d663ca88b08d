"""URL filter with redirect equivalence.

Pages are linked to the targets of their meta refresh and canonical link, and
to the plain form of their own url (no scheme, fragment, tracking parameters).
Distributed connected components over these links are the alias classes.  A
rule decides its own urls; an alias without a rule is allowed if any member of
its class is allowed by a rule, else blocked if any member is blocked, else
allowed.  Link targets are members of their class, crawled or not.

Null urls and urls without ``://`` have no host, no rule and no alias and are
allowed.  Repeated rows get equal results.  Extra columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revisit.llm.common import staged
from revisit.llm.linking import components

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
TRACKING = r"(?<=[?&])(?:utm_[A-Za-z]+|ref|fbclid|gclid)=[^&#]*&?"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(url: Column) -> Column:
    """Host, path and query without tracking parameters; null without ``://``."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1), TRACKING, "")
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_replace(query, r"[?&]$", "")))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits)


def resolve(target: Column, url: Column) -> Column:
    """A link target as an absolute url: targets without scheme and host are
    taken against the page's host, path and query, and the dot segments of
    their path are worked off.  Null for schemes without ``//``, such as mailto."""
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own, query = path_of(url), F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, r"(?s)^(.*/)", 1))

    def without_dots(path: Column) -> Column:
        last = F.element_at(F.split(path, "/"), -1)
        kept = F.aggregate(F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/"))), F.array().cast("array<string>"), lambda done, x: (
            F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(x == ".", done).otherwise(F.concat(done, F.array(x)))))
        return F.concat(F.lit("/"), F.array_join(kept, "/"),
                        F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))

    site = F.concat(F.lit("http://"), host_of(url))
    return (F.when(target == "", None).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(target.startswith("/"), F.concat(site, without_dots(path), tail))
            .when(target.startswith("?"), F.concat(site, own, target))
            .when(target.startswith("#"), F.concat(site, own, query))
            .otherwise(F.concat(site, without_dots(F.concat(folder, path)), tail)))


def alias_targets(url: Column, html: Column) -> Column:
    """Absolute urls of the page's canonical link and its refresh target."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(
        r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), F.lit(1))
    target = lambda t: F.regexp_replace(F.regexp_extract(t, r"(?i)\b(?:href\s*=\s*[\"']?|url\s*=\s*[\"']?)([^\"'>\s]+)", 1), "&amp;", "&")
    return F.array_compact(F.transform(tags, lambda t: resolve(target(t), url)))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    url, html = F.col(url_col), F.col(html_col)
    node = lambda u: F.struct(F.xxhash64(plain(u)).alias("alias"), rule_for(host_of(u), path_of(u), rules)["verdict"].alias("verdict"))
    # no column of this select is called like url or html: a lambda body would take it instead of the page's
    nodes = F.transform(F.concat(F.array(url), alias_targets(url, html)), node)
    rows = staged(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                               F.when(plain(url).isNotNull(), nodes).alias("nodes"))
                  .withColumn("own", rule_for(F.col("host"), F.col("path"), rules)), "urls")
    rows = rows.select("page_id", "host", "path", "own", F.get("nodes", F.lit(0))["alias"].alias("url"),
                       F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("to"))
    comp = components(rows.select(F.col("url").alias("a"), F.explode("to.alias").alias("b")).where("a <> b"))
    named = (rows.drop("to").join(comp, F.col("url") == F.col("node"), "left")
             .withColumn("class", F.coalesce("component", "url")).drop("node", "component", "url"))
    # a target is in the class of the page that names it, so its verdict counts there
    targets = (rows.select("url", F.explode("to.verdict").alias("verdict")).where("verdict is not null")
               .join(comp, F.col("url") == F.col("node"), "left").select(F.coalesce("component", "url").alias("class"), "verdict"))
    by_class = named.select("class", F.col("own.verdict").alias("verdict")).unionByName(targets) \
        .groupBy("class").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"),
                              F.max((F.col("verdict") == "block").cast("int")).alias("blocked")) \
        .where("class is not null and blocked = 1 and coalesce(allowed, 0) = 0").select(F.col("class").alias("bad"))
    alone = named.where("own is not null or class is null")
    ask = named.where("own is null and class is not null").join(by_class, F.col("class") == F.col("bad"), "left")
    done = lambda df, verdict: df.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
    return done(alone, F.coalesce(F.col("own.verdict"), F.lit("allow"))).unionByName(
        done(ask, F.when(F.col("bad").isNotNull(), "block").otherwise("allow")))
