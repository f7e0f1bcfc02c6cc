"""Multi-label taxonomy: evidence-ranked labels from rule tables.

The rule words are folded once on the driver. A text is scanned once: one regular expression with a look-ahead captures,
at every word start, the longest rule word there; a small broadcast table maps a captured word to every rule whose word
is a prefix of it. Texts without any rule word drop out before the join, so cost does not grow with the rules.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import vocabulary as V
from ..functions.text import ascii_fold, fold_literal, let, lower_tr, normalize_text, tidy
from ..session import remove_folder

RULE_SCHEMA = "axis string, value string, source string, confidence decimal(4,3), scope string, priority int, word string"
LABEL_SCHEMA = ["campaign_id", "axis", "value", "source", "confidence", "evidence", "seq"]


def default_rules() -> list[tuple]:
    """(axis, value, source, confidence, scope, priority, word); scope head: title and description, all: and conditions."""
    rules, n = [], 0
    for sector, names in V.MERCHANTS.items():
        for name in names:
            conf = Decimal(V.SOURCE_CONFIDENCE["merchant"]) - (Decimal(V.AMBIGUOUS_PENALTY) if name in V.AMBIGUOUS_MERCHANTS else 0)
            rules.append(("sector", sector, "merchant", conf, "head", n, name))
            n += 1
    for axis, scope, table in (("product_type", "head", V.PRODUCT_KEYWORDS), ("sector", "head", V.SECTOR_KEYWORDS), ("audience", "all", V.AUDIENCE_KEYWORDS), ("benefit", "all", V.BENEFIT_KEYWORDS)):
        for value, words in table.items():
            for word in words:
                rules.append((axis, value, "keyword", Decimal(V.SOURCE_CONFIDENCE["keyword"]), scope, n, word))
                n += 1
    return rules


def _own_category(campaigns: DataFrame) -> DataFrame:
    """Labels from the site's own category: the first known URL path part, then the label on the page."""
    spark = campaigns.sparkSession
    known = [(fold_literal(k), "sector", v) for k, v in V.OWN_CATEGORY_SECTOR.items()] + [(fold_literal(k), "product_type", v) for k, v in V.OWN_CATEGORY_PRODUCT.items()]
    table = spark.createDataFrame(known, "word string, axis string, value string")
    raw_names = F.array(*[F.lit(k) for k in [*V.OWN_CATEGORY_SECTOR, *V.OWN_CATEGORY_PRODUCT]])
    part = F.try_element_at(F.filter(U.path_parts(F.coalesce("source_url", F.lit(""))), lambda p: F.array_contains(raw_names, p)), F.lit(1))
    given = F.array(F.struct(F.lit("url").alias("source"), part.alias("raw"), F.lit(0).alias("seq")), F.struct(F.lit("bank_category").alias("source"), F.nullif(F.col("bank_category"), F.lit("")).alias("raw"), F.lit(1).alias("seq")))
    rows = campaigns.select("campaign_id", F.explode(given).alias("g")).filter("g.raw IS NOT NULL").select("campaign_id", "g.*")
    rows = rows.withColumn("word", ascii_fold(lower_tr(tidy(F.col("raw")))))
    return rows.join(F.broadcast(table), "word").select("campaign_id", "axis", "value", "source", F.lit("1.000").cast("decimal(4,3)").alias("confidence"), F.substring(tidy(F.col("raw")), 1, V.EVIDENCE_MAX).alias("evidence"), "seq")


def _longest_of(words: list[str]) -> str:
    """A pattern of the longest of the words that begins at a place: words with a common beginning share it, so that a text is
    looked at letter by letter, not word by word."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def below(node: dict) -> str:
        branches = [re.escape(c).replace(r"\ ", " ") + below(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        inside = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return inside + "?" if "" in node else inside

    return below(tree)


def _rule_hits(campaigns: DataFrame, rules: list[tuple], composed: bool) -> DataFrame:
    spark = campaigns.sparkSession
    folded = [(*r[:6], fold_literal(r[6])) for r in rules]
    words = sorted({r[6] for r in folded}, key=lambda w: (-len(w), w))
    pattern = rf"(?<![a-z0-9])(?=({_longest_of(words)}))"
    expanded = [(w, *r, rf"(?<![a-z0-9]){re.escape(r[6])}") for w in words for r in folded if w.startswith(r[6])]
    table = F.broadcast(spark.createDataFrame(expanded, f"captured string, {RULE_SCHEMA}, at_start string"))
    norm = (lambda c: tidy(c)) if composed else normalize_text
    head = F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("description"), F.lit("")))
    whole = F.concat_ws(" ", head, F.nullif(F.col("conditions_text"), F.lit("")))
    key = lambda c: ascii_fold(lower_tr(c))
    more = F.coalesce(F.col("conditions_text"), F.lit("")) != ""
    texts = campaigns.select("campaign_id", norm(head).alias("head"), F.when(more, norm(whole)).alias("more"))

    def scanned(x: Column) -> Column:
        captured = F.array_distinct(F.regexp_extract_all(x["all_key"], F.lit(pattern), F.lit(1)))
        return F.struct(*[x[c].alias(c) for c in ("head", "all", "head_key", "all_key")], captured.alias("captured"))

    # Texts are long: each form of one is bound, to be worked out once for a text and not for each of its hits.
    both = F.struct(F.col("head").alias("head"), key(F.col("head")).alias("head_key"), F.col("more").alias("more"))
    keys = let(both, lambda x: F.struct(x["head"].alias("head"), x["head_key"].alias("head_key"), F.coalesce(x["more"], x["head"]).alias("all"), F.coalesce(key(x["more"]), x["head_key"]).alias("all_key")))
    bound = texts.select("campaign_id", let(keys, scanned).alias("t"))
    keyed = bound.select("campaign_id", "t", F.explode("t.captured").alias("captured"))
    # The head starts the whole text, so its words are among those found there; only hits of head rules look again.
    of = lambda c: F.when(F.col("scope") == "head", F.col("t")[c[0]]).otherwise(F.col("t")[c[1]])
    hits = keyed.join(table, "captured").withColumn("text", of(("head", "all"))).withColumn("key", of(("head_key", "all_key"))).filter("scope = 'all' OR key RLIKE at_start")
    place = F.expr("locate(word, key)")
    begin = F.greatest(place - 40, F.lit(1))
    evidence = F.substring(F.substring(F.col("text"), begin, place + F.length("word") + 60 - begin), 1, V.EVIDENCE_MAX)
    # The first rule word of a value (merchants: of a sector) in dictionary order.
    first = hits.groupBy("campaign_id", "axis", "value", "source").agg(F.min_by(F.struct("confidence", evidence.alias("evidence")), "priority").alias("hit"), F.min("priority").alias("priority"))
    return first.select("campaign_id", "axis", "value", "source", "hit.confidence", "hit.evidence", (F.col("priority") + 2).alias("seq"))


def strongest(labels: DataFrame) -> DataFrame:
    """One row per (campaign, axis, value): the highest confidence, ties keep the earlier source."""
    best = Window.partitionBy("campaign_id", "axis", "value").orderBy(F.desc("confidence"), "seq")
    return labels.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def with_fallback(labels: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns without a sector get the general one with low confidence. All get it beside their labels, and a window on
    the campaign drops it again where there is a sector, so that the labels are made once."""
    fallback = campaigns.select(
        "campaign_id", F.lit("sector").alias("axis"), F.lit(V.FALLBACK_SECTOR).alias("value"), F.lit("keyword").alias("source"), F.lit(V.FALLBACK_CONFIDENCE).cast("decimal(4,3)").alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.lit(10**6).alias("seq")
    )
    both = labels.withColumn("_bare", F.lit(False)).unionByName(fallback.withColumn("_bare", F.lit(True)))
    known = F.coalesce(F.bool_or((F.col("axis") == "sector") & ~F.col("_bare")).over(Window.partitionBy("campaign_id")), F.lit(False))
    return both.withColumn("_known", known & F.col("campaign_id").isNotNull()).filter("NOT (_bare AND _known)").drop("_bare", "_known")


def categorise(campaigns: DataFrame, rules: list[tuple] | None = None, composed: bool = False) -> DataFrame:
    """campaign_id, axis, value, confidence, source, evidence for campaigns(campaign_id, title, description,
    conditions_text, source_url, bank_category)."""
    labels = _own_category(campaigns).unionByName(_rule_hits(campaigns, rules or default_rules(), composed))
    return with_fallback(strongest(labels), campaigns).select("campaign_id", "axis", "value", "confidence", "source", "evidence")


def write_labels(labels: DataFrame, path: str, partition: str = "bank_code") -> None:
    """Replace-all per partition: words that left the rules leave the labels."""
    labels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _stored_partitions(spark: SparkSession, path: str) -> DataFrame:
    """bank_code, folder of each stored partition, from the names of its files."""
    try:
        stored = spark.read.schema("value string, bank_code string").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "bank_code string, folder string")
    return stored.select("bank_code", F.regexp_replace("_metadata.file_path", "/[^/]+$", "").alias("folder")).distinct()


def relabel(campaigns: DataFrame, path: str, bank_code: str | None = None, rules: list[tuple] | None = None, composed: bool = False) -> DataFrame:
    """Labels the campaigns (with bank_code) anew, all or those of one bank, and replaces what is stored under path; returns
    the new labels. Labels of rules that are gone go, those of banks that have no campaign any more too; other banks' files
    stay as they are."""
    spark = campaigns.sparkSession
    if bank_code is not None:
        campaigns = campaigns.filter(F.col("bank_code") == bank_code)
    named = campaigns.select(F.col("campaign_id").alias("_id"), "bank_code")
    labels = categorise(campaigns, rules, composed)
    labels = labels.join(named.hint("merge"), labels["campaign_id"] == named["_id"]).drop("_id")
    write_labels(labels, path)
    asked = _stored_partitions(spark, path).filter(F.lit(True) if bank_code is None else F.col("bank_code") == bank_code)
    # A dynamic overwrite leaves partitions without new rows, so those of the banks asked for are removed by name.
    left = campaigns.select(F.col("bank_code").alias("_bank")).distinct()
    for row in asked.join(left.hint("merge"), F.col("bank_code").eqNullSafe(F.col("_bank")), "left_anti").collect():
        remove_folder(spark, row["folder"])
    return spark.read.schema(labels.schema).parquet(path).filter(F.lit(True) if bank_code is None else F.col("bank_code") == bank_code)


def label_summary(labels: DataFrame) -> DataFrame:
    """section, key, n: counts by axis, source and axis/value in one pass of grouping sets."""
    grouped = labels.groupingSets([["axis"], ["source"], ["axis", "value"]], "axis", "source", "value").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "axis").when(F.col("g") == 5, "source").otherwise("value")
    key = F.when(F.col("g") == 3, F.col("axis")).when(F.col("g") == 5, F.col("source")).otherwise(F.concat_ws("/", "axis", "value"))
    return grouped.select(section.alias("section"), key.alias("key"), "n")


def quality_gate(labels: DataFrame, limit: float = 0.40) -> DataFrame:
    """One row: campaigns, fallback_only, ratio, missing_product_type, passed."""
    fallback = (F.col("axis") == "sector") & (F.col("value") == V.FALLBACK_SECTOR) & (F.col("confidence") <= Decimal(V.FALLBACK_CONFIDENCE))
    per = labels.groupBy("campaign_id").agg(F.max(fallback.cast("int")).alias("f"), F.max((F.col("axis") == "product_type").cast("int")).alias("p"))
    total = per.agg(F.count("*").alias("campaigns"), F.coalesce(F.sum("f"), F.lit(0)).alias("fallback_only"), F.coalesce(F.sum(1 - F.col("p")), F.lit(0)).alias("missing_product_type"))
    ratio = F.when(F.col("campaigns") > 0, F.col("fallback_only") / F.col("campaigns")).otherwise(0.0)
    return total.withColumn("ratio", ratio).withColumn("passed", F.col("ratio") < limit)


def invalid_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the axes' vocabulary."""
    valid = labels.sparkSession.createDataFrame([(a, v) for a, vs in V.AXES.items() for v in vs], "axis string, value string")
    return labels.join(F.broadcast(valid), ["axis", "value"], "left_anti")


def invalid_variants(variants: DataFrame) -> DataFrame:
    """Rows whose (dimension, variant_key) is not in the vocabulary; a key of another dimension is not."""
    valid = variants.sparkSession.createDataFrame([(d, k) for d, keys in V.VARIANTS.items() for k in keys], "dimension string, variant_key string")
    return variants.join(F.broadcast(valid), ["dimension", "variant_key"], "left_anti")


def rate_provenance(rates: DataFrame, source_col: str = "rate_source") -> DataFrame:
    """Adds confidence (0 for unknown sources) and comparable."""
    table = rates.sparkSession.createDataFrame([(s, Decimal(c)) for s, c in V.RATE_CONFIDENCE], "_source string, _conf decimal(4,3)")
    joined = rates.join(F.broadcast(table), F.col(source_col) == F.col("_source"), "left")
    return joined.withColumn("confidence", F.coalesce("_conf", F.lit(0).cast("decimal(4,3)"))).withColumn("comparable", ~F.coalesce(F.col(source_col), F.lit("none")).isin(*V.NOT_COMPARABLE)).drop("_source", "_conf")


def backfill_category(campaigns: DataFrame, found: DataFrame) -> DataFrame:
    """Campaigns whose stored category differs from the first label found for their slug, with the new one."""
    first = found.groupBy("external_slug").agg(F.min_by("label", "seq").alias("new_category"))
    return campaigns.join(first, "external_slug").filter(~F.col("bank_category").eqNullSafe(F.col("new_category")))


def display_labels(labels: DataFrame, most: int = 3, weak: float = 0.5) -> DataFrame:
    """The first labels of each campaign, a weak flag, and how many more there are."""
    order = Window.partitionBy("campaign_id").orderBy("axis", F.desc("confidence"), "value")
    all_rows = Window.partitionBy("campaign_id")
    ranked = labels.withColumn("position", F.row_number().over(order)).withColumn("overflow", F.greatest(F.count("*").over(all_rows) - most, F.lit(0)))
    return ranked.filter(F.col("position") <= most).withColumn("weak", F.col("confidence") < weak)
