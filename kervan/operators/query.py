"""List queries and dashboard aggregates over campaigns, banks and labels."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("active", "expired", "upcoming", "unknown")


def today(zone: str = "Europe/Istanbul") -> Column:
    return F.to_date(F.from_utc_timestamp(F.current_timestamp(), zone))


def campaign_status(start: Column, end: Column, as_of: Column) -> Column:
    """unknown without dates; expired after the end; upcoming before the start; else active."""
    return F.when(start.isNull() & end.isNull(), "unknown").when(end < as_of, "expired").when(start > as_of, "upcoming").otherwise("active")


@dataclass
class Filters:
    banks: list[str] | None = None
    category: str | None = None
    segment: str | None = None
    target: str | None = None
    status: str | None = None
    text: str | None = None
    start_from: date | None = None
    end_to: date | None = None
    axes: dict[str, list[str]] = field(default_factory=dict)
    sort: str = "title"
    descending: bool = False
    page: int = 1
    size: int = 25


def apply_filters(campaigns: DataFrame, filters: Filters, labels: DataFrame | None = None) -> DataFrame:
    """Predicates that reach the scan, and one semi join per axis (all must hold)."""
    out = campaigns
    if filters.banks:
        out = out.filter(F.col("bank_code").isin(filters.banks))
    for name in ("category", "segment", "target", "status"):
        if getattr(filters, name) is not None:
            out = out.filter(F.col(name) == getattr(filters, name))
    if filters.text and filters.text.strip():
        like = f"%{filters.text.strip()}%"
        out = out.filter(F.col("title").ilike(like) | F.col("description").ilike(like))
    if filters.start_from:
        out = out.filter(F.col("start_date") >= filters.start_from)
    if filters.end_to:
        out = out.filter(F.col("end_date") <= filters.end_to)
    for axis, values in filters.axes.items():
        if values:
            wanted = labels.filter((F.col("axis") == axis) & F.col("value").isin(values)).select("campaign_id")
            out = out.join(wanted.hint("merge"), "campaign_id", "left_semi")
    return out


def apply_sort(campaigns: DataFrame, sort: str = "title", descending: bool = False) -> DataFrame:
    """Dates with nulls last either way; ties by id; an unknown field sorts by title."""
    name = {"title": "title", "start_date": "start_date", "end_date": "end_date", "bank": "bank_name"}.get(sort, "title")
    col = F.col(name)
    order = (col.desc_nulls_last() if descending else col.asc_nulls_last()) if name.endswith("_date") else (col.desc() if descending else col.asc())
    return campaigns.orderBy(order, F.col("campaign_id").asc())


def page_of(df: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    size = max(1, min(100, size))
    return df.offset((max(1, page) - 1) * size).limit(size)


def list_campaigns(campaigns: DataFrame, banks: DataFrame, filters: Filters, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of items with bank and nested labels, one row with total and total_pages)."""
    joined = apply_filters(campaigns.join(banks.select("bank_code", "bank_name"), "bank_code"), filters, labels)
    size = max(1, min(100, filters.size))
    totals = joined.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))
    items = page_of(apply_sort(joined, filters.sort, filters.descending), filters.page, filters.size)
    return (with_labels(items, labels) if labels is not None else items), totals


def with_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Nested labels, empty where there are none; only the labels of these items are gathered."""
    own = labels.join(items.select("campaign_id").hint("merge"), "campaign_id", "left_semi")
    nested = own.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("axis", "value", "confidence"))).alias("labels"))
    return items.join(nested.hint("merge"), "campaign_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast(nested.schema["labels"].dataType)))


def campaign_detail(campaigns: DataFrame, banks: DataFrame, documents: DataFrame, labels: DataFrame, campaign_id: int) -> DataFrame:
    """One campaign with its bank, source document and labels; raises if there is none."""
    one = campaigns.filter(F.col("campaign_id") == campaign_id)
    if one.isEmpty():
        raise LookupError(f"no campaign {campaign_id}")
    return with_labels(one.join(banks, "bank_code", "left").join(documents, "source_url", "left"), labels)


def banks_with_counts(banks: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Every bank with its number of campaigns by name, zeros kept: counted first, so the join moves one row per bank."""
    counts = campaigns.groupBy("bank_code").agg(F.count("*").alias("n"))
    joined = banks.join(counts, "bank_code", "left").withColumn("campaign_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return joined.orderBy("bank_name", "bank_code")


def bank_by_code(banks: DataFrame, campaigns: DataFrame, code: str) -> DataFrame:
    """One bank with its number of campaigns; raises if there is none. The code reaches both scans as a filter."""
    one = banks.filter(F.col("bank_code") == code)
    if one.isEmpty():
        raise LookupError(f"no bank {code}")
    return banks_with_counts(one, campaigns.filter(F.col("bank_code") == code))


def by_bank(banks: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Banks by number of campaigns, then by name, zeros kept."""
    return banks_with_counts(banks, campaigns).orderBy(F.desc("campaign_count"), "bank_name", "bank_code")


def banks_with_data(banks: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row: the number of banks that have a campaign."""
    return banks.join(campaigns.select("bank_code").distinct(), "bank_code", "left_semi").agg(F.count("*").alias("banks_with_data"))


def row_count(campaigns: DataFrame) -> DataFrame:
    return campaigns.agg(F.count("*").alias("campaigns"))


def totals(campaigns: DataFrame) -> DataFrame:
    """All status counts in one pass."""
    return campaigns.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def by_category(campaigns: DataFrame, col: str = "category") -> DataFrame:
    return campaigns.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(col).asc_nulls_last())


def last_run(runs: DataFrame, zone: str = "Europe/Istanbul") -> DataFrame:
    return runs.agg(F.from_utc_timestamp(F.max("finished_at"), zone).alias("last_run"))


def bar_shares(counts: DataFrame, col: str = "n", floor: float = 2.0) -> DataFrame:
    """Percent of the largest count, at least `floor` where there is anything."""
    most = counts.agg(F.max(col).alias("_most"))
    joined = counts.crossJoin(F.broadcast(most))  # one row
    share = F.when(F.col(col) <= 0, 0.0).otherwise(F.greatest(F.col(col) * 100.0 / F.col("_most"), F.lit(floor)))
    return joined.withColumn("share", share).drop("_most")


def run_summary(log: DataFrame) -> DataFrame:
    """Per bank: counters, the first 50 messages and the run's status. log: bank_code, seq, action (discovered, fetched,
    new, updated, error), message."""
    n = lambda a: F.count_if(F.col("action") == a)
    grouped = log.groupBy("bank_code").agg(
        n("discovered").alias("urls_discovered"),
        n("fetched").alias("urls_fetched"),
        n("new").alias("campaigns_new"),
        n("updated").alias("campaigns_updated"),
        n("error").alias("errors_count"),
    )
    # Only errors are ranked, and a task passes on no more than 50 of a bank.
    first = log.filter("action = 'error'").withColumn("_e", F.row_number().over(Window.partitionBy("bank_code").orderBy("seq"))).filter("_e <= 50")
    messages = first.groupBy("bank_code").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("_m"))
    grouped = grouped.join(messages, "bank_code", "left")
    status = F.when((F.col("urls_fetched") == 0) & (F.col("errors_count") > 0), "failed").when(F.col("errors_count") > 0, "partial").otherwise("success")
    return grouped.withColumn("status", status).withColumn("error_log", F.coalesce(F.array_join(F.transform("_m", lambda s: s["message"]), "\n"), F.lit(""))).drop("_m")
