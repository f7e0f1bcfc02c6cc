"""Calculator forms on the node table: controls, options, variants, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.extract import decimal_tr
from ..functions.text import ascii_fold, lower_tr, match_key, tidy


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _control_kind() -> Column:
    return F.when(F.col("tag") == "select", "select").when(F.col("tag") == "textarea", "text").otherwise(F.lower(F.coalesce(F.col("attrs")["type"], F.lit("text"))))


def _control_name() -> Column:
    a = F.col("attrs")
    return F.coalesce(F.nullif(a["name"], F.lit("")), F.nullif(F.col("id"), F.lit("")), F.nullif(a["data-name"], F.lit("")))


def form_controls(nodes: DataFrame) -> DataFrame:
    """page_id, name, kind, pre, node_id, label, min, max, step: one row per named control, each radio
    button being one."""
    a, name, kind = F.col("attrs"), _control_name(), _control_kind()
    controls = nodes.filter("tag IN ('select', 'input', 'textarea')").select(
        "page_id", "pre", "post", "node_id", "parent_id", F.col("id").alias("html_id"), name.alias("name"), kind.alias("kind"), decimal_tr(a["min"]).alias("min"), decimal_tr(a["max"]).alias("max"), decimal_tr(a["step"]).alias("step"), a["value"].alias("value")
    )
    return controls.filter(F.col("name").isNotNull() & ~F.col("kind").isin(*V.IGNORED_INPUTS))


def control_labels(nodes: DataFrame, controls: DataFrame) -> DataFrame:
    """Adds label: the label element for the control's id, else the label around it."""
    labels = nodes.filter("tag = 'label'").select("page_id", F.col("attrs")["for"].alias("for"), F.col("pre").alias("lpre"), F.col("post").alias("lpost"), tidy(F.col("text")).alias("ltext"))
    named = labels.filter("for <> ''").groupBy("page_id", F.col("for").alias("html_id")).agg(F.min_by("ltext", "lpre").alias("named"))
    around = labels.groupBy("page_id").agg(F.collect_list(F.struct("lpre", "lpost", "ltext")).alias("around"))
    inside = F.filter("around", lambda s: (s["lpre"] < F.col("pre")) & (F.col("pre") <= s["lpost"]))
    nearest = F.array_max(F.transform(inside, lambda s: F.struct(s["lpre"].alias("at"), s["ltext"].alias("text"))))["text"]
    joined = controls.join(named.hint("merge"), ["page_id", "html_id"], "left").join(around.hint("merge"), "page_id", "left")
    return joined.withColumn("label", F.coalesce("named", nearest)).drop("named", "around")


def _form_rows(nodes: DataFrame) -> DataFrame:
    """Controls and options with, for options, the select around them: selects do not nest, so it is the last one that began,
    if it has not ended. One window per page."""
    a = F.col("attrs")
    rows = nodes.filter("tag IN ('select', 'input', 'textarea', 'option')").select(
        "page_id", "pre", "post", "tag", _control_name().alias("name"), _control_kind().alias("kind"), a["value"].alias("value"), tidy(F.col("text")).alias("label"), a["min"].alias("min"), a["max"].alias("max")
    )
    begun = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("tag") == "select", F.struct("post", "name")), ignorenulls=True).over(begun)
    option = F.col("tag") == "option"
    rows = rows.withColumn("_owner", owner).withColumn("name", F.when(option, F.when(F.col("_owner.post") >= F.col("pre"), F.col("_owner.name"))).otherwise(F.col("name")))
    filled = F.col("value").isNull() | (F.trim("value") != "")
    return rows.filter(F.col("name").isNotNull() & F.when(option, filled).otherwise(~F.col("kind").isin(*V.IGNORED_INPUTS))).withColumn("kind", F.when(option, "option").otherwise(F.col("kind")))


def form_options(nodes: DataFrame) -> DataFrame:
    """page_id, name, pre, value, label of the options of each select; placeholders with an empty value are dropped."""
    return _form_rows(nodes).filter("kind = 'option'").select("page_id", "name", "pre", F.coalesce("value", "label").alias("value"), "label")


def form_summary(nodes: DataFrame) -> DataFrame:
    """page_id, combinations, amount_min, amount_max, allowed_terms of pages with any control or option, in one pass: one
    exchange by page, on which the window over options and both aggregates run.

    combinations: product of the option and radio counts of each name, a continuous control counting as four points, a
    checkbox as two; null without any. Amounts: of the first range or number control whose name hints at one. Terms: sorted
    distinct numbers of the first term-named select that gives any.
    """
    kind, ranged = F.col("kind"), F.col("kind").isin("range", "number")
    number = F.regexp_extract(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("value")), r"\d+", 0).try_cast("int")
    rows = _form_rows(nodes).withColumn("number", F.when(kind == "option", number))
    names = rows.groupBy("page_id", "name").agg(
        F.count_if(kind == "option").alias("options"), F.count_if(kind == "radio").alias("radios"), F.bool_or(ranged).alias("ranged"), F.bool_or(kind == "checkbox").alias("checked"),
        F.min(F.when(F.col("number").isNotNull(), F.col("pre"))).alias("first_term"), F.array_sort(F.collect_set("number")).alias("terms"),
        F.min(F.when(ranged, F.struct("pre", "min", "max"))).alias("range"),
    )
    factor = lambda c: F.greatest(F.col(c), F.lit(1))
    points = factor("options") * factor("radios") * F.when(F.col("ranged"), V.GRID_POINTS).otherwise(1) * F.when(F.col("checked"), 2).otherwise(1)
    counted = (F.col("options") > 0) | (F.col("radios") > 0) | F.col("ranged") | F.col("checked")
    product = F.aggregate(F.collect_list(F.when(counted, points)), F.lit(1).cast("decimal(38,0)"), lambda x, n: (x * n).cast("decimal(38,0)"))
    term = _hinted(F.col("name"), V.TERM_HINTS) & F.col("first_term").isNotNull()
    amount = _hinted(F.col("name"), V.AMOUNT_HINTS) & F.col("range").isNotNull()
    pages = names.groupBy("page_id").agg(
        F.when(F.bool_or(counted), product).alias("combinations"), F.min(F.when(amount, F.col("range"))).alias("amount"), F.min_by("terms", F.when(term, F.col("first_term"))).alias("allowed_terms")
    )
    return pages.select("page_id", "combinations", decimal_tr(F.col("amount.min")).alias("amount_min"), decimal_tr(F.col("amount.max")).alias("amount_max"), "allowed_terms")


def _worded() -> Column:
    return ~F.col("label").rlike(r"^[\d\s.,%]+$")


def variant_fields(options: DataFrame) -> DataFrame:
    """page_id, name of the select with most options among those with at least two labels that are not numbers."""
    sizes = options.groupBy("page_id", "name").agg(F.count("*").alias("n"), F.count_if(_worded()).alias("words"), F.min("pre").alias("first"))
    return sizes.filter("words >= 2").groupBy("page_id").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("name"))


def variant_key(label: Column, composed: bool = True) -> Column:
    """struct(dimension, key): the first rule with a pattern in the folded label, else a vocabulary key equal to its slug."""
    key = match_key(label, composed)
    rules = [F.when(_contains_any(key, words), F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key"))) for d, k, words in V.VARIANT_RULES]
    slug = F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    own = [F.when(slug == k, F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key"))) for d, keys in V.VARIANTS.items() for k in keys]
    return F.coalesce(*rules, *own)


def variant_candidates(options: DataFrame, composed: bool = True) -> DataFrame:
    """Options of the variant field (see variant_fields) with their variant key; labels that match nothing stay null. The
    field is found by windows on the page's options, so that these are made once."""
    rows = options.withColumn("_worded", _worded())
    field, page = Window.partitionBy("page_id", "name"), Window.partitionBy("page_id")
    size = F.when(F.count_if("_worded").over(field) >= 2, F.struct(F.count("*").over(field).alias("n"), (-F.min("pre").over(field)).alias("first"), "name"))
    chosen = rows.withColumn("_size", size).withColumn("_best", F.max("_size").over(page)).filter(F.col("name") == F.col("_best.name"))
    return chosen.withColumn("v", variant_key(F.col("label"), composed)).select("page_id", "name", "pre", "label", "value", F.col("v.dimension").alias("dimension"), F.col("v.key").alias("variant_key"))


def combination_counts(nodes: DataFrame) -> DataFrame:
    """page_id, combinations of pages with any; see form_summary."""
    return form_summary(nodes).filter("combinations IS NOT NULL").select("page_id", "combinations")


def sampling_decision(combinations: Column, mechanism: Column) -> Column:
    n = F.coalesce(combinations, F.lit(0))
    skip = F.coalesce(mechanism, F.lit("unknown")).isin("unknown", "none") | (n <= 0)
    return F.when(skip, "skip").when(n <= V.FULL_LIMIT, "full").when(n <= V.GRID_LIMIT, "grid").otherwise("pilot_only")


def _hinted(name: Column, hints: tuple[str, ...]) -> Column:
    return _contains_any(ascii_fold(lower_tr(name)), hints)


def amount_bounds(nodes: DataFrame) -> DataFrame:
    """page_id, amount_min, amount_max of pages with an amount control; see form_summary."""
    return form_summary(nodes).filter("amount_min IS NOT NULL OR amount_max IS NOT NULL").select("page_id", "amount_min", "amount_max")


def allowed_terms(nodes: DataFrame) -> DataFrame:
    """page_id, allowed_terms of pages with any; see form_summary."""
    return form_summary(nodes).filter("allowed_terms IS NOT NULL").select("page_id", "allowed_terms")


def legal_notice(text: Column, composed: bool = True) -> Column:
    """The first sentence with a hint that the figures do not bind."""
    sentences = F.split(tidy(text), r"(?<=[.!?])\s+")
    return F.try_element_at(F.filter(sentences, lambda s: _contains_any(ascii_fold(lower_tr(s)), V.NOTICE_HINTS)), F.lit(1))


def mechanisms(requests: DataFrame, controls: DataFrame) -> DataFrame:
    """page_id, mechanism from a request log (page_id, phase in load/input, is_data) and the pages' tried flag."""
    calls = requests.filter("is_data").groupBy("page_id").agg(F.count_if(F.col("phase") == "input").alias("n_input"), F.count_if(F.col("phase") == "load").alias("n_load"))
    n = controls.groupBy("page_id", "tried").agg(F.count("name").alias("n_controls"))
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    kind = F.when(~F.col("tried"), "unknown").when(c("n_input") > 0, "api").when(c("n_load") > 0, "js_with_rate_fetch").when(F.col("n_controls") > 0, "js_client_side").otherwise("none")
    return n.join(calls.hint("merge"), "page_id", "left").select("page_id", kind.alias("mechanism"))
