"""URLs: parts, default ports, resolving against a base, filtering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webloom.functions.text import let

# What a crawl never follows.
SKIPPED_ENDINGS = (".jpg", ".jpeg", ".gif", ".png", ".txt")
SKIPPED_PARTS = ("creativecommons.org", "robtex.com", "%", "aljazeeramubasher", "poemhunter", "pinterest.com", "archive.org")
KEPT_ENDS = ("com", "org", "net", "edu", "int", "gov", "mil")


def url_parts(url: Column) -> Column:
    """struct<protocol, host, port, rest>. Without ``//`` after the first character all is rest; rest is ``/``
    if nothing follows the host; the port is null unless a colon follows at least one character of host."""

    def of(u: Column) -> Column:
        at = F.locate("//", u)
        absolute = at > 1
        tail = F.substring(u, at + 2, F.length(u))
        authority = F.substring_index(tail, "/", 1)
        slash, colon = F.locate("/", tail), F.locate(":", authority)
        host = F.when(colon > 1, F.substring(authority, F.lit(1), colon - 1)).otherwise(authority)
        return F.struct(
            F.when(absolute, F.substring(u, F.lit(1), at - 2)).alias("protocol"),
            F.when(absolute, host).alias("host"),
            F.when(absolute & (colon > 1), F.substring(authority, colon + 1, F.length(authority))).alias("port"),
            F.when(~absolute, u).when(slash > 0, F.substring(tail, slash, F.length(tail))).otherwise(F.lit("/")).alias("rest"),
        )

    return F.when(url.isNotNull(), let(url, of))


def _default_port(protocol: Column) -> Column:
    return F.when(protocol == "http", F.lit("80")).when(protocol == "https", F.lit("443"))


def seed_normalize(url: Column) -> Column:
    """protocol://host:port/rest without fragment; null for other schemes without a port and for relative URLs."""
    return let(
        url_parts(url),
        lambda p: F.concat(p["protocol"], F.lit("://"), p["host"], F.lit(":"), F.coalesce(p["port"], _default_port(p["protocol"])), F.substring_index(p["rest"], "#", 1)),
    )


def url_normalize(url: Column, base: Column, drop_non_http: bool = False) -> Column:
    """A link as an absolute URL with a port; null if it isn't followed (files that are no pages, other schemes).

    A bare fragment is the base. Each leading ``../`` takes a segment off the base's folder. An absolute URL
    with a port is kept as it is. Links such as ``mailto:x`` count as relative paths unless ``drop_non_http``.
    """

    def of(p: Column) -> Column:
        rest = F.substring_index(p["rest"], "#", 1)
        relative = p["protocol"].isNull()
        bare = relative & F.contains(p["rest"], F.lit("#")) & (rest == "")
        skipped = F.regexp_extract(rest, r"\.[^.]*$", 0).isin(*SKIPPED_ENDINGS)
        site = let(url_parts(base), lambda b: F.concat(b["protocol"], F.lit("://"), b["host"], F.lit(":"), F.coalesce(b["port"], _default_port(b["protocol"]))))
        ups = F.length(F.regexp_extract(rest, r"^(?:\.\./)*", 0))
        folders = let(F.split(F.regexp_extract(base, r"^(.*)/[^/]*$", 1), "/"), lambda a: F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - (ups / 3).cast("int"), F.lit(1))), "/"))
        inside = F.concat(folders, F.lit("/"), F.substring(rest, ups + 1, F.length(rest)))
        absolute = F.concat(p["protocol"], F.lit("://"), p["host"], F.lit(":"), _default_port(p["protocol"]), rest)
        out = F.when(bare, base).when(skipped, F.lit(None).cast("string"))
        if drop_non_http:
            out = out.when(relative & (p["rest"].rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | p["rest"].startswith("//")), F.lit(None).cast("string"))
        return out.when(relative & ((rest == "") | rest.startswith("/")), F.concat(site, rest)).when(relative, inside).when(p["port"].isNull(), absolute).otherwise(url)

    return F.when(url.isNotNull(), let(url_parts(url), of))


def url_filter(url: Column) -> Column:
    """Whether a crawl follows a URL: no skipped part; wikis only if English Wikipedia or Wikinews; and three
    characters after the last full stop of the whole URL, if that many follow, are a known ending."""
    skipped = F.lit(False)
    for part in SKIPPED_PARTS:
        skipped = skipped | url.contains(part)
    dot = F.locate(".", url)
    foreign = url.contains("wiki") & (~(url.contains("wikipedia") | url.contains("wikinews")) | ((dot > 2) & (F.substring(url, dot - 2, F.lit(2)) != "en")))
    end = F.substring_index(url, ".", -1)
    other = F.contains(url, F.lit(".")) & (F.length(end) >= 3) & ~F.substring(end, 1, 3).isin(*KEPT_ENDS)
    return ~(skipped | foreign | other)


def query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of a query string (what follows the first ``?``): decoded, "" without exactly one value, the last of equal names."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)

    def pair(x: Column) -> Column:
        return let(F.split(x, "="), lambda a: F.struct(decoded(a[0]).alias("k"), F.when((F.size(a) == 2), decoded(F.get(a, F.lit(1)))).otherwise(F.lit("")).alias("v")))

    pairs = F.transform(F.split(F.substring(url, F.locate("?", url) + 1, F.length(url)), "&"), pair)
    last = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"]))
    return F.when(F.contains(url, F.lit("?")), let(pairs, last)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
