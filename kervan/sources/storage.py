"""Keyed storage: the engine's tables with declared schemas, bucketed and sorted by their natural keys.

Jobs that join a stored table on its whole key (upserts, anti-joins against what is stored) read it without an exchange;
only the batch is shuffled, to the stored table's buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table: natural key, columns.
TABLES = {
    "campaigns": (
        ("bank_code", "external_slug"),
        "bank_code string, external_slug string, title string, description string, conditions_text string, exclusions_text string, bank_category string, "
        "segment string, start_date date, end_date date, date_precision string, status string, participation_method string, sms_keyword string, sms_number string, "
        "coupon_code string, source_url string, is_archived boolean, first_seen_at timestamp, last_seen_at timestamp",
    ),
    "labels": (
        ("campaign_id", "axis", "value"),
        "campaign_id bigint, axis string, value string, confidence decimal(4,3), source string, evidence string",
    ),
    "documents": (
        ("url_hash",),
        "url string, canonical_url string, url_hash string, doc_type string, http_status int, clean_text string, clean_text_sha256 string, raw_html_sha256 string, "
        "robots_allowed boolean, is_soft_404 boolean, discovery_method string, fetched_at timestamp",
    ),
    "rates": (
        ("product_key", "term_months", "variant_key"),
        "product_key string, term_months int, profit_rate_pct decimal(8,4), allocation_fee_pct decimal(8,4), monthly_cost_pct decimal(8,4), annual_cost_pct decimal(8,4), "
        "variant_key string, variant_label string, rate_source string, confidence decimal(4,3), evidence_text string",
    ),
    "runs": (
        ("bank_code", "started_at"),
        "bank_code string, status string, urls_discovered int, urls_fetched int, campaigns_new int, campaigns_updated int, errors_count int, error_log string, "
        "started_at timestamp, finished_at timestamp",
    ),
}
BUCKETS = 64


def conform(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a table's schema, in order and type; columns that df lacks are null. Values that do not fit their
    type are an error."""
    fields = df.sparkSession.createDataFrame([], TABLES[kind][1]).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def save_keyed(df: DataFrame, kind: str, name: str | None = None, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Writes a new table; an existing one of that name is an error, as a version is never written over."""
    keys = list(TABLES[kind][0])
    # One file a bucket: each task holds whole buckets.
    rows = conform(df, kind).repartition(buckets, *keys)
    writer = rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name or kind)


def read_keyed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
