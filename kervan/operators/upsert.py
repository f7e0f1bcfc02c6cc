"""Upserts, lifecycle and sinks. A new version is computed and written beside the old one, never over it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import vocabulary as V
from ..functions.text import fingerprint

KEY = ["bank_code", "external_slug"]
KEPT = ("first_seen_at", "category", "summary_ai")


def last_of_batch(batch: DataFrame, keys: list[str], seq_col: str = "seq") -> DataFrame:
    """Of rows with the same key the last one wins; _n says how many there were."""
    w = Window.partitionBy(*keys)
    ranked = batch.withColumn("_at", F.row_number().over(w.orderBy(F.desc(seq_col)))).withColumn("_n", F.count("*").over(w))
    return ranked.filter("_at = 1").drop("_at")


def upsert(stored: DataFrame, batch: DataFrame, now: Column, keys: list[str] | None = None, kept: tuple[str, ...] = KEPT, seq_col: str = "seq") -> DataFrame:
    """The new table with an `action` column: insert, update or keep. One full outer join on the key.

    Updates overwrite every column of the batch but those in `kept`, and set last_seen_at; inserts set both times.
    """
    keys = keys or KEY
    new = last_of_batch(batch, keys, seq_col).drop(seq_col)
    fields = [c for c in stored.columns if c not in (*keys, "first_seen_at", "last_seen_at")]
    new = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in (*keys, "_n")], F.lit(True).alias("_in_new"), F.col("_n"))
    old = stored.withColumn("_in_old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    has_new, has_old = F.coalesce("_in_new", F.lit(False)), F.coalesce("_in_old", F.lit(False))

    def value(c: str) -> Column:
        if f"_new_{c}" not in new.columns:
            return F.col(c)
        if c in kept:
            return F.when(has_old, F.col(c)).otherwise(F.col(f"_new_{c}"))
        return F.when(has_new, F.col(f"_new_{c}")).otherwise(F.col(c))

    action = F.when(~has_new, "keep").when(has_old, "update").otherwise("insert")
    return joined.select(
        *keys, *[value(c).alias(c) for c in fields], F.when(has_old, F.col("first_seen_at")).otherwise(now).alias("first_seen_at"), F.when(has_new, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), action.alias("action"),
        # A key that comes twice in a run counts as one insert and then updates.
        F.when(has_new, F.col("_n") - F.when(has_old, 0).otherwise(1)).otherwise(0).cast("long").alias("update_count"),
    )


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """Counters of a run; a dry run stops here and writes nothing."""
    return upserted.agg(F.count_if(F.col("action") == "insert").alias("campaigns_new"), F.coalesce(F.sum("update_count"), F.lit(0)).alias("campaigns_updated"))


def force_expired(campaigns: DataFrame, gone: DataFrame) -> DataFrame:
    """Campaigns whose page answered 404 are expired whatever their dates say. gone: bank_code, source_url."""
    marks = gone.select("bank_code", "source_url").distinct().withColumn("_gone", F.lit(True))
    joined = campaigns.join(marks, ["bank_code", "source_url"], "left")
    return joined.withColumn("forced_expired", F.coalesce("_gone", F.lit(False))).withColumn("status", F.when(F.col("_gone"), "expired").otherwise(F.col("status"))).drop("_gone")


def unseen(campaigns: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored campaigns that a run did not see, only for banks of which it saw something; nothing expires by this."""
    ran = seen.select("bank_code").distinct()
    return campaigns.join(ran, "bank_code", "left_semi").join(seen.select(*KEY), KEY, "left_anti")


def fetch_outcome(robots_allowed: Column, soft_404: Column, error: Column, status: Column, has_body: Column) -> Column:
    """success, skipped_robots, skipped_soft_404, gone or error."""
    ok = error.isNull() & status.between(200, 299) & has_body
    return F.when(~robots_allowed, "skipped_robots").when(soft_404, "skipped_soft_404").when(status == 404, "gone").when(ok, "success").otherwise("error")


def retryable(status: Column) -> Column:
    return status.isin(*V.RETRYABLE) | status.between(500, 599)


def limit_discovered(urls: DataFrame, limit: int, seq_col: str = "seq") -> DataFrame:
    """The first `limit` URLs of each bank, with the count before the limit on every row."""
    counts = urls.groupBy("bank_code").agg(F.count("*").alias("urls_discovered"))
    first = urls.withColumn("_at", F.row_number().over(Window.partitionBy("bank_code").orderBy(seq_col))).filter(F.col("_at") <= limit).drop("_at")
    return first.join(counts, "bank_code").select(*urls.columns, "urls_discovered")


def seed_dimension(stored: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Full-outer upsert of a dimension; updated only if some field differs (null-safe)."""
    fields = [c for c in seed.columns if c not in keys]
    s = seed.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in fields], F.lit(True).alias("_in_seed"))
    joined = stored.withColumn("_in_old", F.lit(True)).join(s, keys, "full_outer")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    action = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_seed").isNull() | same, "keep").otherwise("update")
    return joined.select(*keys, *[F.when(F.col("_in_seed"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in fields], action.alias("action"))


def prune_dimension(stored: DataFrame, seed: DataFrame, facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, warnings): rows that left the seed go unless facts still refer to them; those are kept and reported.
    Both results come from one table of marked rows, in which facts are reduced to their keys."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    marked = stored.join(mark(seed, "_in_seed"), key, "left").join(mark(facts, "_used"), key, "left")
    kept = marked.filter("_in_seed OR _used")
    return kept.select(stored.columns), kept.filter("_in_seed IS NULL").select(stored.columns)


def snapshot_rows(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Content-addressed names: hash of the canonical URL and hash of the content."""
    name = F.concat_ws("_", U.short_hash(U.canonical_url(F.col(url_col)), 16), U.short_hash(F.coalesce(F.col(html_col), F.lit("")), 12))
    return pages.withColumn("snapshot", name)


def new_snapshots(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots that are not stored yet: the same content is not written again, changed content is kept beside."""
    return snapshot_rows(pages).dropDuplicates(["snapshot"]).join(stored.select("snapshot"), "snapshot", "left_anti")


def append_snapshots(pages: DataFrame, path: str, partition: str = "bank_code") -> None:
    spark = pages.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], "snapshot string")
    new_snapshots(pages, stored).write.mode("append").partitionBy(partition).parquet(path)


def document_rows(fetches: DataFrame) -> DataFrame:
    """Crawl-log rows, failures included; XML documents have no clean text. fetches: url, doc_type, http_status,
    clean_text, html, robots_allowed, is_soft_404, discovery_method, fetched_at."""
    text = F.when(F.coalesce("doc_type", F.lit("")) == "sitemap", F.lit(None)).otherwise(F.col("clean_text"))
    url = F.col("url")
    return fetches.select(
        "url", U.canonical_url(url).alias("canonical_url"), U.url_hash(url).alias("url_hash"), "doc_type", "http_status", text.alias("clean_text"), fingerprint(text).alias("clean_text_sha256"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("raw_html_sha256"), "robots_allowed", "is_soft_404", "discovery_method", "fetched_at",
    )
