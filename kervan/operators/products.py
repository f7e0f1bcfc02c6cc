"""Product hierarchy: variants under a parent product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def with_parents(products: DataFrame, inherited: tuple[str, ...], id_col: str = "product_id", parent_col: str = "parent_product_id") -> DataFrame:
    """Products with is_variant, parent_found, and the `inherited` fields of their parent where they have none of their own
    (inherited_fields names those). One level: a parent's own parent is not asked, and a product is no parent of itself.

    Ids are unique. The parents are joined as a table of ids that are referred to, so a product with many variants is
    one row there; its variants are split by AQE if they are skewed.
    """
    variants = products.filter(F.col(parent_col).isNotNull() & (F.col(parent_col) != F.col(id_col))).select(F.col(parent_col).alias("_parent")).distinct()
    parents = products.join(variants, products[id_col] == variants["_parent"], "left_semi").select(F.col(id_col).alias("_parent"), F.lit(True).alias("_found"), *[F.col(c).alias(f"_parent_{c}") for c in inherited])
    own = products.withColumn("_parent", F.when(F.col(parent_col) != F.col(id_col), F.col(parent_col)))
    # Products without a parent stay out of the join, where their null keys would meet in one task.
    joined = own.filter("_parent IS NOT NULL").join(parents.hint("merge"), "_parent", "left")
    joined = joined.unionByName(own.filter("_parent IS NULL"), allowMissingColumns=True)
    taken = F.filter(F.array(*[F.when(F.col(c).isNull() & F.col(f"_parent_{c}").isNotNull(), F.lit(c)) for c in inherited]), lambda x: x.isNotNull())
    rest = [c for c in products.columns if c not in inherited]
    return joined.select(
        *rest, *[F.coalesce(c, f"_parent_{c}").alias(c) for c in inherited], F.col("_parent").isNotNull().alias("is_variant"), F.coalesce("_found", F.lit(False)).alias("parent_found"), taken.alias("inherited_fields")
    )


def variant_counts(products: DataFrame, id_col: str = "product_id", parent_col: str = "parent_product_id") -> DataFrame:
    """product id, variants: how many variants each product has, products without any included."""
    counts = products.groupBy(F.col(parent_col).alias("_parent")).agg(F.count("*").alias("_n"))
    joined = products.join(counts.hint("merge"), products[id_col] == counts["_parent"], "left")
    return joined.select(id_col, F.coalesce("_n", F.lit(0)).alias("variants"))


def known_variant(dimension_col: str = "variant_dimension", key_col: str = "variant_key"):
    """Whether a variant's key belongs to its dimension; products without a variant do."""
    pairs = F.array(*[F.lit(f"{d}/{k}") for d, keys in V.VARIANTS.items() for k in keys])
    return F.col(key_col).isNull() | F.array_contains(pairs, F.concat_ws("/", dimension_col, key_col))
