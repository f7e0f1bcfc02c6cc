"""URL sets: filters, rule matching, ordered dedupe and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import broadcast_small


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order (never the arrival order)."""
    # A minimum is combined before the shuffle; the order columns must be of types that compare, nulls first.
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns])


def dedupe_urls(df: DataFrame, url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """One row per same-page key; the first spelling wins."""
    keyed = df.withColumn("page_key", U.canonical_key(F.col(url_col)))
    return first_by(keyed, ["page_key"], F.col(seq_col), F.col(url_col))


def same_page_pairs(df: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """Representative of each same-page group and its other members (a star, not all pairs)."""
    keyed = df.select(F.col(id_col).alias("id"), U.canonical_key(F.col(url_col)).alias("page_key"))
    heads = keyed.groupBy("page_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(heads, "page_key").filter("id <> first_id").select("first_id", F.col("id").alias("other_id"), "page_key")


def classify_paths(url: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Class of the first rule with a hint in the path, e.g. skip, campaign, product; else null."""
    path = F.lower(U.part(url, "path"))
    hit = lambda hints: reduce(lambda a, b: a | b, [path.contains(h) for h in hints])
    first, *rest = rules
    return reduce(lambda acc, r: acc.when(hit(r[1]), r[0]), rest, F.when(hit(first[1]), first[0]))


def match_site_rules(df: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Detail pages by one rules table (site, prefix, suffix, max_parts, excluded array): an equi-join on the site, the
    path tests after it. The rules table is counted and broadcast if it is small."""
    path = U.part(F.col(url_col), "path")
    joined = df.withColumn("site", U.bare_host(F.col(url_col))).join(broadcast_small(rules), "site")
    rest = F.expr("substr(_path, length(prefix) + 1)")
    joined = joined.withColumn("_path", F.regexp_replace(path, "/+$", "")).withColumn("_rest", rest)
    ok = (
        F.col("_path").startswith(F.col("prefix"))
        & (F.col("_rest") != "")
        & F.col("_path").endswith(F.col("suffix"))
        & (F.size(F.split("_rest", "/")) <= F.col("max_parts"))
        & ~F.array_contains(F.col("excluded"), F.col("_rest"))
    )
    return joined.filter(ok).drop("_path", "_rest")


def filter_sitemap(df: DataFrame, base_url: str, must_contain: str | None = None, url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """Same-site URLs whose path contains a text (case-insensitively), first spelling of each page."""
    kept = df.filter(U.same_site(F.col(url_col), F.lit(base_url)))
    if must_contain:
        kept = kept.filter(F.lower(U.part(F.col(url_col), "path")).contains(must_contain.lower()))
    return dedupe_urls(kept, url_col, seq_col)


def dedupe_by_prefix_rank(df: DataFrame, prefixes: list[str], url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """One row per slug: the lowest prefix rank wins, ties keep the first; ordered by (rank, url)."""
    path = F.lower(U.part(F.col(url_col), "path"))
    rank = F.coalesce(*[F.when(path.contains(p), i) for i, p in enumerate(prefixes)], F.lit(len(prefixes)))
    ranked = df.withColumn("slug", U.slug(F.col(url_col))).filter("slug IS NOT NULL").withColumn("prefix_rank", rank)
    return first_by(ranked, ["slug"], F.col("prefix_rank"), F.col(seq_col), F.col(url_col)).orderBy("prefix_rank", url_col)


def merge_sources(sources: list[DataFrame], url_col: str = "url", seq_col: str = "seq") -> DataFrame:
    """Union of discovery sources keyed by URL; an earlier source wins."""
    tagged = [s.withColumn("source_priority", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_by(union, [url_col], F.col("source_priority"), F.col(seq_col))


def path_label(url: Column, position: int, labels: dict[str, str]) -> Column:
    """Segment or category from one path part (1-based; negative from the end)."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.try_element_at(table, F.try_element_at(U.path_parts(url), F.lit(position)))


def discover_links(nodes: DataFrame, listings: DataFrame, detail: Column | None = None) -> DataFrame:
    """Anchors of listing pages as absolute URLs that pass `detail`, a test on the column link; the first listing wins,
    archive pages come last.

    listings: page_id, url, priority, category, is_archive (one row per listing page).
    """
    anchors = nodes.filter("tag = 'a'").select("page_id", "pre", F.col("attrs")["href"].alias("href"))
    joined = anchors.join(listings.hint("merge"), "page_id").withColumn("link", U.resolve(F.col("href"), F.col("url")))
    if detail is not None:
        joined = joined.filter(detail)
    joined = joined.filter("link IS NOT NULL").withColumn("page_key", U.canonical_key(F.col("link")))
    return first_by(joined, ["page_key"], F.col("is_archive"), F.col("priority"), F.col("page_id"), F.col("pre")).select("page_key", "link", "category", "is_archive", "priority")


def select_listings(listings: DataFrame, wanted: list[str] | None, name_col: str = "category", fallback_all: bool = True) -> DataFrame:
    """Listings by name, case-insensitively; an unknown name selects all of them (or none); archives always stay."""
    if not wanted:
        return listings
    hit = F.lower(F.col(name_col)).isin([w.lower() for w in wanted])
    marked = listings.withColumn("_hit", hit)
    # One row: whether any listing has a wanted name.
    marked = marked.crossJoin(F.broadcast(marked.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_any"))))
    keep = F.col("_hit") | F.col("is_archive")
    if fallback_all:
        keep = keep | ~F.col("_any")
    return marked.filter(keep).drop("_hit", "_any")
