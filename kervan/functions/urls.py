"""URL columns: identity, same-page keys, slugs, link resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, name: str) -> Column:
    """scheme, authority, path, query or fragment; '' where absent (never throws on broken URLs)."""
    index = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[name]
    return F.regexp_extract(F.trim(url), _SPLIT, index)


def canonical_url(url: Column) -> Column:
    """Archive identity: lower scheme and authority, no fragment; path and query keep their case."""
    scheme, authority, path, query = (part(url, p) for p in ("scheme", "authority", "path", "query"))
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), F.lower(authority))).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, "authority")), r"^www\.", "")


def same_site(url: Column, reference: Column) -> Column:
    """Relative URLs count as the same site."""
    return (part(url, "authority") == "") | (bare_host(url) == bare_host(reference))


def canonical_key(url: Column) -> Column:
    """Same-page key: https, no www., no trailing slash, no tracking parameters, sorted query; path case is kept."""
    path = F.regexp_replace(part(url, "path"), "/+$", "")
    pairs = F.filter(F.split(part(url, "query"), "&"), lambda p: p != "")

    def clean(p: Column) -> Column:
        name = F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1)))
        value = F.try_url_decode(F.when(F.instr(p, "=") > 0, F.regexp_extract(p, "=(.*)$", 1)).otherwise(""))
        return F.struct(F.coalesce(name, F.split_part(p, F.lit("="), F.lit(1))).alias("n"), F.coalesce(value, F.regexp_extract(p, "=(.*)$", 1)).alias("v"))

    kept = F.filter(F.transform(pairs, clean), lambda s: ~F.lower(s["n"]).isin(*V.TRACKING_PARAMS))
    query = F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(F.url_encode(s["n"]), F.lit("="), F.url_encode(s["v"]))), "&")
    return F.concat(F.lit("https://"), bare_host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(part(url, "path"), "/"), lambda p: p != "")


def slug(url: Column) -> Column:
    """Last path segment, case kept."""
    return F.try_element_at(path_parts(url), F.lit(-1))


def resolve(link: Column, base: Column) -> Column:
    """Absolute URL of a link on the page `base`; null for empty, #, mailto:, tel: and javascript: links."""
    link = F.trim(link)
    scheme = F.concat(part(base, "scheme"), F.lit(":"))
    root = F.concat(scheme, F.lit("//"), part(base, "authority"))
    folder = F.regexp_replace(part(base, "path"), "[^/]*$", "")
    bare = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    relative = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare))
    folded = F.aggregate(
        F.split(relative, "/"),
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    tail = F.when(bare.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise("")
    skip = link.isNull() | (link == "") | link.startswith("#") | F.lower(link).rlike("^(mailto|tel|javascript):")
    return (
        F.when(skip, F.lit(None).cast("string"))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("?"), F.concat(root, part(base, "path"), link))
        .otherwise(F.concat(root, F.array_join(folded, "/"), tail, rest))
    )
