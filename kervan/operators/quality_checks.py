"""Constraint checks as jobs: each gives rule, n (violations) or the violating keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enum_rule(col: str, allowed: list) -> tuple[str, Column]:
    return f"enum:{col}", F.col(col).isNotNull() & ~F.col(col).isin(allowed)


def order_rule(low: str, high: str) -> tuple[str, Column]:
    return f"order:{low}<={high}", F.col(low) > F.col(high)


def range_rule(col: str, low: float | None = None, high: float | None = None) -> tuple[str, Column]:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(col) < low)
    if high is not None:
        bad = bad | (F.col(col) > high)
    return f"range:{col}", bad


def violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """All rules in one pass; nulls pass, as in SQL CHECK."""
    counted = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}") for i, (_, bad) in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, (name, _) in enumerate(rules)])
    return counted.select(F.explode(cells).alias("c")).select("c.rule", "c.n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice; keys with a null part never clash."""
    whole = df
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str) -> DataFrame:
    return facts.filter(F.col(key).isNotNull()).join(dimension.select(F.col(dim_key).alias(key)), key, "left_anti")


def totals_reconcile(campaigns: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    counts = [F.count_if(F.col("status") == s) for s in statuses]
    return campaigns.agg(F.count("*").alias("total"), sum(counts[1:], counts[0]).alias("by_status")).withColumn("reconciles", F.col("total") == F.col("by_status"))
