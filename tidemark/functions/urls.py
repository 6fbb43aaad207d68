"""Column functions on URLs, links and hosts."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefixes of query parameters that only track.
TRACKING = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref_src", "ref_url")
# Links that are no articles (schemes, file types, framework and site paths, social hosts).
SKIPPED = (
    r"(?i)(mailto:|tel:|javascript:|"
    r"\.(pdf|jpe?g|png|gif|svg|webp|ico|zip|gz|mp[34]|woff2?|ttf|eot|css|js|json|xml|rss)(\?|$)|"
    r"/_next/|/static/|/assets/|/wp-content/|/wp-json/|/cdn-cgi/|"
    r"/tag/|/category/|/author/|/page/\d|/legal/|/privacy|/terms|/cookie|"
    r"twitter\.com|x\.com|linkedin\.com|facebook\.com|youtube\.com|github\.com|"
    r"instagram\.com|t\.co/)"
)
# Paths at which feeds commonly are.
FEED_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/index.xml", "/posts.atom")


def host(url: Column) -> Column:
    """What stands between the first // and the next /, with its port; empty if there is none."""
    return F.when(F.contains(url, F.lit("//")), F.coalesce(F.get(F.split(url, "/"), 2), F.lit(""))).otherwise("")


def _decoded(part: Column) -> Column:
    """A form value decoded; a % that begins no code stands for itself."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    """Decoded as a form value and encoded again."""
    return F.replace(F.replace(F.url_encode(_decoded(part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Without fragment, path parameters, trailing slash, tracking (by the decoded name) and blank parameters; the query encoded anew."""
    bare = F.split(url, "#")[0]
    path = F.regexp_replace(F.split(bare, r"\?")[0], r";[^/]*$", "")
    base = F.regexp_extract(path, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    rest = F.rtrim(F.substring(path, F.length(base) + 1, F.length(path)), F.lit("/"))
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")

    def kept(p: Column) -> Column:
        name = F.lower(_decoded(F.split(p, "=")[0]))
        tracked = name.rlike("^(" + "|".join(TRACKING) + ")")
        return F.contains(p, F.lit("=")) & (F.regexp_replace(p, "^[^=]*=", "") != "") & ~tracked

    pairs = F.transform(
        F.filter(F.split(query, "&"), kept),
        lambda p: F.concat(_encoded(F.regexp_extract(p, "^([^=]*)=", 1)), F.lit("="), _encoded(F.regexp_replace(p, "^[^=]*=", "")))
    )
    joined = F.array_join(pairs, "&")
    lower = F.concat(F.lower(F.regexp_extract(base, "^([^:]*)", 1)), F.regexp_extract(base, "^[^:]*(:.*)$", 1))
    return F.concat(lower, F.when(rest == "", "/").otherwise(rest), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolved(links: pd.Series, base: pd.Series) -> pd.Series:
    """Links as absolute URLs: dots in relative paths have no expression in Spark."""

    def one(base_url: str, link: str) -> str:
        try:
            return urljoin(base_url, link)
        except ValueError:
            return ""

    return pd.Series([None if own is None else [one(b or "", x) for x in own] for own, b in zip(links, base, strict=True)])


def article_links(html: Column, base: Column) -> Column:
    """Links of a page to other pages of its host that may be articles, canonical, each once, in order."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))
    some = F.filter(hrefs, lambda h: ~F.startswith(h, F.lit("#")) & ~h.rlike(SKIPPED))
    urls = F.transform(resolved(some, base), canonical)
    return F.array_distinct(F.filter(urls, lambda u: (host(u) == host(base)) & (F.rtrim(u, F.lit("/")) != F.rtrim(base, F.lit("/")))))


def feed_candidates(html: Column, base: Column) -> Column:
    """Feeds that a page links to, then the common places on its host."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)(<link[^>]+type=["']application/(?:atom|rss)\+xml["'][^>]*>)"""), F.lit(1))
    hrefs = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href=["']([^"']+)["']""", 1)), lambda h: h != "")
    root = F.array_join(F.slice(F.split(base, "/"), 1, 3), "/")
    return F.concat(resolved(hrefs, base), F.array(*[F.concat(root, F.lit(p)) for p in FEED_PATHS]))
