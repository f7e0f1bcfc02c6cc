"""Readers: page archives, sitemaps (plain or gzip), robots files, captured JSON."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import urls as U
from ..functions import vocabulary as V
from ..operators.discovery import dedupe_urls
from ..session import staged


def read_page_archive(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """path, html of every saved page under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


@F.pandas_udf(StringType())
def unpacked_text(contents: pd.Series) -> pd.Series:
    """UTF-8 text of bytes, gunzipped where they start with the gzip magic; broken archives give null."""

    def one(raw):
        if raw is None:
            return None
        raw = bytes(raw)
        if raw[:2] == b"\x1f\x8b":
            try:
                raw = gzip.decompress(raw)
            except (OSError, EOFError, zlib.error):
                return None
        return raw.decode("utf-8", "replace")

    return contents.map(one)


def is_sitemap_index(xml: Column) -> Column:
    return F.lower(F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:[\w.-]+:)?([A-Za-z]+)", 1)) == "sitemapindex"


def sitemap_entries(documents: DataFrame, id_col: str = "path", xml_col: str = "xml") -> DataFrame:
    """id, seq, loc, lastmod, is_index of each url or sitemap element, whatever its namespace prefix. Documents whose
    root element does not close give no row."""
    xml = F.col(xml_col)
    root = F.regexp_extract(xml, r"(?s)<((?:[\w.-]+:)?(?:urlset|sitemapindex))\b", 1)
    whole = (root != "") & xml.contains(F.concat(F.lit("</"), root, F.lit(">")))
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:[\w.-]+:)?(?:url|sitemap)>(.*?)</(?:[\w.-]+:)?(?:url|sitemap)>"), F.lit(1))
    rows = documents.filter(whole).select(id_col, is_sitemap_index(xml).alias("is_index"), F.posexplode(items).alias("seq", "item"))
    field = lambda name: F.trim(F.regexp_extract("item", rf"(?s)<(?:[\w.-]+:)?{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:[\w.-]+:)?{name}>", 1))
    unescaped = F.replace(field("loc"), F.lit("&amp;"), F.lit("&"))
    return rows.select(id_col, "seq", unescaped.alias("loc"), F.nullif(field("lastmod"), F.lit("")).alias("lastmod"), "is_index").filter("loc <> ''")


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every sitemap file under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", unpacked_text(F.col("content")).alias("xml"))
    return sitemap_entries(files)


def expand_sitemaps(files: DataFrame, roots: DataFrame) -> DataFrame:
    """page_key, loc, lastmod, sitemap_key, depth of every page that the root sitemaps lead to, once; the least deep
    sitemap that holds it wins, then the smallest, then the first place.

    files: url, xml (archived sitemaps, plain text; several copies of a URL all count). roots: url. Each file is parsed
    once. Index entries form edges, and a frontier of sitemaps moves along them until it finds none that was not reached
    before, so cycles end. Each round is written. Sitemaps that are not archived lead nowhere.
    """
    entries = sitemap_entries(files.select(U.canonical_key(F.col("url")).alias("sitemap_key"), "xml"), "sitemap_key", "xml")
    entries = staged(entries.withColumn("page_key", U.canonical_key(F.col("loc"))), "sitemap_entries")
    edges = staged(entries.filter("is_index").select(F.col("sitemap_key").alias("_from"), F.col("page_key").alias("sitemap_key")).distinct(), "sitemap_edges")
    frontier = staged(roots.select(U.canonical_key(F.col("url")).alias("sitemap_key")).distinct().withColumn("depth", F.lit(0)), "sitemap_frontier")
    reached = frontier
    while not frontier.isEmpty():
        steps = frontier.select(F.col("sitemap_key").alias("_from"), (F.col("depth") + 1).alias("depth")).join(edges, "_from")
        fresh = steps.select("sitemap_key", "depth").distinct().join(reached.select("sitemap_key"), "sitemap_key", "left_anti")
        frontier = staged(fresh, "sitemap_frontier")
        reached = reached.unionByName(frontier)
    pages = entries.filter("NOT is_index").join(reached, "sitemap_key")
    best = F.min(F.struct("depth", "sitemap_key", "seq", "loc", "lastmod"))
    return pages.groupBy("page_key").agg(best.alias("b")).select("page_key", "b.loc", "b.lastmod", "b.sitemap_key", "b.depth")


def sitemap_lines(robots: DataFrame, text_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """URLs of the Sitemap: lines of robots files, first spelling of each; foreign hosts are allowed."""
    found = robots.select(F.trim(F.regexp_extract(text_col, r"(?i)^\s*sitemap:\s*(\S+)", 1)).alias("url"), seq_col).filter("url <> ''")
    return dedupe_urls(found, "url", seq_col)


def json_shape(df: DataFrame, json_col: str) -> DataFrame:
    """Adds fields (sorted, comma-joined) and n_records of a captured response: the first list under a known key, else
    the document itself; an array counts its elements, an object is one record."""
    body = F.col(json_col)
    lists = [F.when(F.json_array_length(F.get_json_object(body, f"$.{k}")).isNotNull(), F.get_json_object(body, f"$.{k}")) for k in V.LIST_KEYS]
    inner = F.coalesce(*lists, body)
    first = F.coalesce(F.when(F.json_array_length(inner).isNotNull(), F.get_json_object(inner, "$[0]")), inner)
    fields = F.array_join(F.array_sort(F.json_object_keys(first)), ",")
    count = F.coalesce(F.json_array_length(inner), F.when(F.json_object_keys(inner).isNotNull(), F.lit(1)), F.lit(0))
    return df.withColumn("fields", F.coalesce(fields, F.lit(""))).withColumn("n_records", count)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", partition: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format("parquet")
    (writer.partitionBy(*partition) if partition else writer).saveAsTable(name)
