"""URL rules carried over to aliases: redirects, canonical links and other spellings of an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark.llm.components import components
from clubspark.session import materialize

#: Fixed values: (host, path, verdict); a host stands for its subdomains too.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Query parameters that do not change what a page is.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid|sessionid"

HOST = r"^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """A-Z in lower case; empty for a null or a text without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), f"(?s){HOST}", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """One spelling of an address: no scheme, fragment, tracking parameters, index file or last slash."""
    query = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda part: ~part.rlike(f"^({TRACKING})(=|$)")), "&")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    return F.concat(F.lit("//"), host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def declared(html: Column) -> Column:
    """Array of the addresses that a page names as its own, as they stand there: canonical link, refresh, og:url."""
    tag = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    own = F.filter(
        tag, lambda t: F.lower(t).rlike(r"""(?s)rel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh|property\s*=\s*["']?og:url""")
    )
    address = r"""(?is)(?:href|content)\s*=\s*["']?(?:\s*\d+\s*;\s*url\s*=\s*["']?)?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""
    refresh = r"""(?is)\scontent\s*=\s*["']?\s*[\d.]+\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)"""
    link, og = (rf"""(?is)\s{name}\s*=\s*["']?\s*([^"'\s>]+)""" for name in ("href", "content"))

    def named(t: Column) -> Column:
        low = F.lower(t)
        other = (
            F.when(low.rlike(r"""(?s)http-equiv\s*=\s*["']?refresh"""), F.regexp_extract(t, refresh, 1))
            .when(low.rlike(r"(?s)^<link"), F.regexp_extract(t, link, 1))
            .when(low.rlike(r"""(?s)property\s*=\s*["']?og:url"""), F.regexp_extract(t, og, 1))
            .otherwise("")
        )
        whole = F.regexp_extract(t, address, 1)
        return F.when(whole != "", whole).otherwise(other)

    return F.filter(F.transform(own, named), lambda a: a != "")


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its segments . and .."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"(?s)(^|/)\.\.?$"), "/").otherwise(""))


def resolve(url: Column, target: Column) -> Column:
    """The whole address that target means on the page url; null for other schemes, such as mailto:."""
    origin, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)?[^/]*$", 1))
    return (
        F.when(target.rlike(r"(?is)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?is)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(own), tail))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, "(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), tail))
    )


def aliases(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) between spellings of addresses: a page's own and the one it declares; redirects (source, target) too.

    What a page declares is read relative to its own address; <base> is not looked at.  Redirects are whole addresses.
    """
    named = pages.where(F.col("url").contains("://")).select("url", F.explode(declared(F.coalesce("html", F.lit("")))).alias("target"))
    named = named.select("url", resolve(F.col("url"), F.col("target")).alias("target")).where("target IS NOT NULL")
    edges = named.select(canonical(F.col("url")).alias("u"), canonical(F.col("target")).alias("v"))
    if redirects is not None:
        both = F.col("source").contains("://") & F.col("target").contains("://")
        edges = edges.union(redirects.where(both).select(canonical(F.col("source")), canonical(F.col("target"))))
    return edges


def judge(
    pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, root.

    A page's own rule decides.  Pages without one take the verdict of their class, the
    addresses that spellings, redirects, canonical links and refreshes make one: block
    if a page or an address of the class is blocked by a rule and none is explicitly allowed, else
    allow.  root names the class.  A null url, or one without ://, has an empty host and path, no rule
    and no alias, and is allowed; a null html declares nothing.  Repeated rows give repeated rows; an empty table an
    empty result; further columns are not looked at.
    Addresses and pages of any length are read whole.
    """
    # a class of one spelling needs no edge; only spellings with edges go through the components
    links = materialize(aliases(pages, redirects))
    roots = materialize(components(links))
    url = F.col("url")
    has = F.coalesce(url.contains("://"), F.lit(False))
    rows = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.when(has, canonical(url)).alias("spelling"),
    ).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    rows = materialize(
        rows.join(roots.withColumnRenamed("node", "spelling"), "spelling", "left").withColumn(
            "root", F.coalesce("root", "spelling")
        )
    )
    # addresses that are named but are no page have a verdict too
    named = roots.select("root", rule_of(host_of(F.concat(F.lit("x:"), "node")), path_of(F.concat(F.lit("x:"), "node")), rules).alias("own"))
    said = rows.select("root", "own.verdict").union(named.select("root", "own.verdict")).where("root IS NOT NULL AND verdict IS NOT NULL")
    classes = materialize(
        said.groupBy("root").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    )
    joined = rows.join(classes, "root", "left")
    inherited = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", inherited).alias("verdict"), "root")
