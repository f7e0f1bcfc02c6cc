"""Registered queries on campaigns: labels, lists, aggregates, upserts, checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import fold_literal
from ..operators import query as Q
from ..operators import quality_checks as C
from ..operators import taxonomy as X
from ..operators import upsert as U
from ..session import table
from .roles import AS_OF, SQL_CAMPAIGNS, SQL_LABELS, banks, campaigns, labels

#: Rules for the invented part names; priorities follow the order.
RULES = [
    ("sector", "metal", "merchant", Decimal("0.900"), "head", 0, "bolt"),
    ("sector", "metal", "merchant", Decimal("0.700"), "head", 1, "ring"),
    ("sector", "device", "keyword", Decimal("0.700"), "head", 2, "widget"),
    ("product_type", "coloured", "keyword", Decimal("0.700"), "head", 3, "red"),
    ("product_type", "coloured", "keyword", Decimal("0.700"), "head", 4, "blue"),
    ("audience", "bulk", "keyword", Decimal("0.700"), "all", 5, "economy"),
    ("audience", "bulk", "keyword", Decimal("0.700"), "all", 6, "econo"),
    ("benefit", "small", "keyword", Decimal("0.700"), "all", 7, "small"),
]


def _part_campaigns(s, d):
    return table(s, d, "part").select(
        F.col("p_partkey").alias("campaign_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.col("p_type").alias("conditions_text"),
        F.when(F.col("p_brand") == "Brand#2", F.lit("https://x.example/kart/a")).otherwise(F.lit("https://x.example/a")).alias("source_url"),
        F.when(F.col("p_brand") == "Brand#4", "E-Ticaret").alias("bank_category"),
    )


def _labels(s, d):
    return X.categorise(_part_campaigns(s, d), RULES, composed=True)


def labels_long(s, d):
    return _labels(s, d).select("campaign_id", "axis", "value", F.col("confidence").cast("double").alias("confidence"), "source")


def label_summary(s, d):
    return X.label_summary(_labels(s, d))


def label_gate(s, d):
    g = X.quality_gate(_labels(s, d))
    return g.select("campaigns", "fallback_only", "missing_product_type", F.round("ratio", 6).alias("ratio"), "passed")


def invalid_labels(s, d):
    return X.invalid_labels(_labels(s, d)).groupBy("axis", "value").agg(F.count("*").alias("n"))


def display_labels(s, d):
    return X.display_labels(_labels(s, d)).select("campaign_id", "position", "axis", "value", "overflow", "weak")


def default_labels(s, d):
    """The full rule tables over every document's text."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("campaign_id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("conditions_text"), F.lit("").alias("source_url"), F.lit(None).cast("string").alias("bank_category"))
    return X.categorise(docs, composed=True).groupBy("axis", "value", "source").agg(F.count("*").alias("n"))


def _rule_text_columns():
    """Title and conditions of a part that hold one word of the default rules each, the title in upper case."""
    words = F.array(*[F.lit(r[-1]) for r in X.default_rules()])
    at = lambda n: F.element_at(words, (F.col("p_partkey") * n % F.size(words) + 1).cast("int"))
    upper = F.upper(F.translate(at(1), "iı", "İI"))
    return F.concat(F.lit("Fırsat: "), upper, F.lit(" için teklif "), "p_name"), F.concat(F.lit("Koşul ("), at(7), F.lit("da) geçerlidir"))


def default_rule_labels(s, d):
    """The full rule tables, with evidence, over texts that hold their words."""
    title, conditions = _rule_text_columns()
    none = F.lit(None).cast("string")
    rows = table(s, d, "part").select(F.col("p_partkey").alias("campaign_id"), title.alias("title"), none.alias("description"), conditions.alias("conditions_text"), none.alias("source_url"), none.alias("bank_category"))
    return X.categorise(rows, composed=True).withColumn("confidence", F.col("confidence").cast("double"))


def invalid_variants(s, d):
    """Parts with a dimension by brand and a key by type."""
    dimension = F.when(F.col("p_brand") == "Brand#1", "sigorta").when(F.col("p_brand") == "Brand#2", "arac_durumu").otherwise("konut_durumu")
    key = F.when(F.col("p_type") == "ECONOMY", "sigortali").when(F.col("p_type") == "SMALL", "sifir_arac").when(F.col("p_type") == "LARGE", "toki").otherwise("bilinmeyen")
    return X.invalid_variants(table(s, d, "part").select("p_partkey", dimension.alias("dimension"), key.alias("variant_key"))).select("p_partkey", "dimension", "variant_key")


def rate_provenance(s, d):
    src = F.when(F.col("l_returnflag") == "A", "html_table").when(F.col("l_returnflag") == "N", "js_default").otherwise("guess")
    r = X.rate_provenance(table(s, d, "lineitem").select(src.alias("rate_source"), "l_tax"))
    return r.groupBy("rate_source", F.col("confidence").cast("double").alias("confidence"), "comparable").agg(F.count("*").alias("n"))


def category_backfill(s, d):
    """Stored category: the order's priority; found on listings: the return flag of the first line."""
    stored = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("external_slug"), F.substring("o_orderstatus", 1, 1).alias("bank_category"))
    found = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("external_slug"), F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "A", "F").otherwise("P").alias("label"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return X.backfill_category(stored, found).groupBy("bank_category", "new_category").agg(F.count("*").alias("n"))


def status_by_asof(s, d):
    return campaigns(s, d).select("campaign_id", "status")


def stats_totals(s, d):
    return Q.totals(campaigns(s, d))


def banks_with_counts(s, d):
    return Q.banks_with_counts(banks(s, d), campaigns(s, d))


def campaigns_by_bank(s, d):
    return Q.by_bank(banks(s, d), campaigns(s, d))


def banks_with_data(s, d):
    return Q.banks_with_data(banks(s, d), campaigns(s, d))


def bank_lookup(s, d):
    return Q.bank_by_code(banks(s, d), campaigns(s, d), "NATION_7")


def campaign_count(s, d):
    return Q.row_count(campaigns(s, d))


def campaign_lookup(s, d):
    """The detail of one campaign with its source document and labels."""
    documents = table(s, d, "orders").select(F.concat(F.lit("https://bank.example/kampanya/"), F.col("o_orderkey").cast("string")).alias("source_url"), F.col("o_orderstatus").alias("doc_status"))
    one = Q.campaign_detail(campaigns(s, d), banks(s, d), documents, labels(s, d), 7)
    return one.select("campaign_id", "bank_name", "title", "doc_status", F.array_join(F.transform("labels", lambda x: F.concat_ws("=", x["axis"], x["value"])), ",").alias("labels"))


def inventory_upsert(s, d):
    """Calculator pages by (bank, page): stored are those of suppliers up to nation 14, found those from nation 10 on."""
    t0 = F.lit("2026-01-01").cast("timestamp")
    sup = table(s, d, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("bank_code"), F.col("s_name").alias("page_url"), F.round(F.col("s_acctbal")).cast("long").alias("controls"), "s_nationkey")
    stored = sup.filter("s_nationkey <= 14").select("bank_code", "page_url", "controls", t0.alias("first_seen_at"), t0.alias("last_seen_at"))
    found = sup.filter("s_nationkey >= 10").select("bank_code", "page_url", (F.col("controls") + 1).alias("controls"), F.lit(1).alias("seq"))
    done = U.upsert(stored, found, F.lit("2026-02-01").cast("timestamp"), ["bank_code", "page_url"], kept=("first_seen_at",))
    return done.select("bank_code", "page_url", "controls", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"), "action")


def campaigns_by_category(s, d):
    return Q.by_category(campaigns(s, d))


def list_filtered_page(s, d):
    f = Q.Filters(banks=["NATION_1", "NATION_2", "NATION_7"], status="active", sort="end_date", descending=True, page=2, size=25)
    items, _ = Q.list_campaigns(campaigns(s, d), banks(s, d), f)
    return items.select("campaign_id", "bank_name", "title", "end_date")


def list_total(s, d):
    f = Q.Filters(banks=["NATION_1", "NATION_2", "NATION_7"], status="active", segment="BUILDING")
    return Q.list_campaigns(campaigns(s, d), banks(s, d), f)[1]


def axis_exists(s, d):
    f = Q.Filters(axes={"flag": ["A"], "line": ["O"]})
    return Q.apply_filters(campaigns(s, d), f, labels(s, d)).select("campaign_id", "bank_code")


def text_search(s, d):
    return Q.apply_filters(campaigns(s, d), Q.Filters(text=" build%f ")).select("campaign_id")


def date_bounds(s, d):
    import datetime

    f = Q.Filters(start_from=datetime.date(1997, 1, 1), end_to=datetime.date(1998, 1, 1))
    return Q.apply_filters(campaigns(s, d), f).select("campaign_id", "start_date", "end_date")


def nested_labels(s, d):
    """A sorted page with its labels nested."""
    f = Q.Filters(status="unknown", sort="bank", page=1, size=100)
    items, _ = Q.list_campaigns(campaigns(s, d), banks(s, d), f, labels(s, d))
    return items.select("campaign_id", F.array_join(F.transform("labels", lambda x: F.concat_ws("=", x["axis"], x["value"])), ",").alias("labels"))


def campaign_details(s, d):
    """Every campaign with its bank, as a detail page joins it."""
    c = campaigns(s, d).join(banks(s, d), "bank_code", "left")
    return c.groupBy("bank_name", "status").agg(F.count("*").alias("n"), F.max("end_date").alias("last_end"))


def bar_shares(s, d):
    counts = campaigns(s, d).groupBy("bank_code").agg(F.count("*").alias("n"))
    return Q.bar_shares(counts).select("bank_code", "n", F.round("share", 6).alias("share"))


def last_run(s, d):
    runs = table(s, d, "events").filter("event_type = 'signup'").select(F.col("ts").alias("finished_at"))
    return Q.last_run(runs).select(F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


def run_summary(s, d):
    """Events as a run log: users are banks."""
    e = F.col("event_type")
    action = F.when(e == "view", "discovered").when(e == "click", "fetched").when(e == "signup", "new").when(e == "purchase", "updated").otherwise("error")
    log = table(s, d, "events").select(F.col("user_id").cast("string").alias("bank_code"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("message"))
    return Q.run_summary(log)


def fetch_outcomes(s, d):
    e = table(s, d, "events")
    t, v = F.col("event_type"), F.col("value")
    status = F.when(t == "error", F.when(v > 60, 404).when(v > 30, 503).otherwise(429)).otherwise(200)
    out = U.fetch_outcome(t != "signup", (t == "purchase") & (v > 50), F.when(t == "error", "x"), status, v > 1)
    return e.select(out.alias("outcome"), U.retryable(status).alias("retry")).groupBy("outcome", "retry").agg(F.count("*").alias("n"))


def discovery_limit(s, d):
    urls = campaigns(s, d).select("bank_code", F.col("campaign_id").alias("seq"))
    return U.limit_discovered(urls, 10)


def _versions(s, d):
    """Stored: campaigns that are not urgent; second run: those that are not low, shifted by a day, urgent ones twice."""
    c = campaigns(s, d)
    t0 = F.lit("2026-01-01").cast("timestamp")
    stored = c.filter(~F.col("title").startswith("1-URGENT")).select("bank_code", "external_slug", "title", "category", "end_date", t0.alias("first_seen_at"), t0.alias("last_seen_at"))
    run = c.filter(~F.col("title").startswith("5-LOW"))
    again = run.filter(F.col("title").startswith("1-URGENT")).withColumn("end_date", F.date_add("end_date", 2)).withColumn("seq", F.lit(2))
    both = run.withColumn("end_date", F.date_add("end_date", 1)).withColumn("seq", F.lit(1)).unionByName(again)
    return stored, both.select("bank_code", "external_slug", "title", F.lit("new").alias("category"), "end_date", "seq")


def upsert_second_run(s, d):
    stored, run = _versions(s, d)
    out = U.upsert(stored, run, F.lit("2026-02-01").cast("timestamp"))
    return out.select("bank_code", "external_slug", "category", "end_date", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"), "action")


def upsert_counters(s, d):
    stored, run = _versions(s, d)
    return U.upsert_counts(U.upsert(stored, run, F.lit("2026-02-01").cast("timestamp")))


def unseen_campaigns(s, d):
    """A run that saw only some banks: banks it did not reach report nothing."""
    c = campaigns(s, d)
    seen = c.filter(F.col("bank_code").isin("NATION_1", "NATION_3") & (F.col("segment") != "BUILDING"))
    return U.unseen(c, seen).groupBy("bank_code").agg(F.count("*").alias("n"))


def forced_expired(s, d):
    c = campaigns(s, d)
    gone = c.filter("segment = 'MACHINERY' AND status <> 'expired'").select("bank_code", "source_url")
    return U.force_expired(c, gone).groupBy("status", "forced_expired").agg(F.count("*").alias("n"))


def seed_dimension(s, d):
    """Suppliers as the stored dimension, a seed without the richest and with one field changed."""
    sup = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    seed = table(s, d, "supplier").filter("s_acctbal < 9000").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") < 0, 99).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return U.seed_dimension(sup.filter("s_nationkey <> 3"), seed, ["s_suppkey"]).select("s_suppkey", "s_nationkey", "action")


def prune_dimension(s, d):
    """Customers outside the seed go unless they have orders."""
    c = table(s, d, "customer").select("c_custkey")
    kept, held = U.prune_dimension(c, table(s, d, "customer").filter("c_acctbal > 5000").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return kept.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


def dq_violations(s, d):
    rules = [C.enum_rule("l_returnflag", ["A", "N"]), C.order_rule("l_tax", "l_discount"), C.range_rule("l_quantity", 1, 45), C.range_rule("l_discount", 0.0, None)]
    return C.violations(table(s, d, "lineitem"), rules)


def dq_duplicate_keys(s, d):
    return C.duplicate_keys(table(s, d, "lineitem").withColumn("k", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))), ["l_orderkey", "k"])


def dq_orphans(s, d):
    big = table(s, d, "customer").filter("c_acctbal > 0")
    return C.orphans(table(s, d, "orders").select("o_orderkey", "o_custkey"), big, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def totals_reconcile(s, d):
    return C.totals_reconcile(campaigns(s, d), Q.STATUSES)


FUNCTIONS = [campaigns_by_bank, banks_with_data, bank_lookup, campaign_count, campaign_lookup, inventory_upsert, labels_long, label_summary, label_gate, invalid_labels, display_labels, default_labels, default_rule_labels, invalid_variants, rate_provenance, category_backfill, status_by_asof, stats_totals, banks_with_counts, campaigns_by_category, list_filtered_page, list_total, axis_exists, text_search, date_bounds, nested_labels, campaign_details, bar_shares, last_run, run_summary, fetch_outcomes, discovery_limit, upsert_second_run, upsert_counters, unseen_campaigns, forced_expired, seed_dimension, prune_dimension, dq_violations, dq_duplicate_keys, dq_orphans, totals_reconcile]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_HIT = "regexp_matches(h, '(^|[^a-z0-9]){}')"
_LAB = f"""r AS (SELECT * FROM (VALUES ('sector', 'metal', 'merchant', 0.9, 'bolt', 0, 0), ('sector', 'metal', 'merchant', 0.7, 'ring', 1, 0), ('sector', 'device', 'keyword', 0.7, 'widget', 2, 0),
    ('product_type', 'coloured', 'keyword', 0.7, 'red', 3, 0), ('product_type', 'coloured', 'keyword', 0.7, 'blue', 4, 0), ('audience', 'bulk', 'keyword', 0.7, 'economy', 5, 1), ('audience', 'bulk', 'keyword', 0.7, 'econo', 6, 1), ('benefit', 'small', 'keyword', 0.7, 'small', 7, 1)) t(axis, value, source, confidence, word, prio, scope)),
p AS (SELECT p_partkey AS campaign_id, lower(p_name) AS h, lower(p_name || ' ' || p_type) AS a, p_brand FROM part),
hits AS (SELECT campaign_id, axis, value, source, confidence, prio FROM p JOIN r ON regexp_matches(CASE WHEN scope = 0 THEN h ELSE a END, '(^|[^a-z0-9])' || word) QUALIFY row_number() OVER (PARTITION BY campaign_id, axis, value, source ORDER BY prio) = 1),
own AS (SELECT campaign_id, 'product_type' AS axis, 'kart' AS value, 'url' AS source, 1.0 AS confidence, -2 AS prio FROM p WHERE p_brand = 'Brand#2' UNION ALL SELECT campaign_id, 'sector', 'eticaret_pazaryeri', 'bank_category', 1.0, -1 FROM p WHERE p_brand = 'Brand#4'),
best AS (SELECT * FROM (SELECT * FROM hits UNION ALL SELECT * FROM own) QUALIFY row_number() OVER (PARTITION BY campaign_id, axis, value ORDER BY confidence DESC, prio) = 1),
lab AS (SELECT campaign_id, axis, value, CAST(confidence AS DOUBLE) AS confidence, source FROM best UNION ALL SELECT campaign_id, 'sector', 'genel', 0.3, 'keyword' FROM p WHERE campaign_id NOT IN (SELECT campaign_id FROM best WHERE axis = 'sector'))"""
_q = lambda text: text.replace("'", "''")
_FOLD = f"translate(lower(translate({{}}, 'İI', 'iı')), '{V.FOLD_FROM}', '{V.FOLD_TO}')"
_RULE_ROWS = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}, '{r[4]}', {r[5]}, '{_q(fold_literal(r[6]))}')" for r in X.default_rules())
_WORDS = "[" + ", ".join(f"'{_q(r[6])}'" for r in X.default_rules()) + "]"
#: The default rules over c(campaign_id, h, a): title, and title with conditions.
_DEFAULTS = f"""dr AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(axis, value, source, confidence, scope, prio, word)),
dk AS (SELECT campaign_id, h, a, {_FOLD.format('h')} AS hk, {_FOLD.format('a')} AS ak FROM c),
dt AS (SELECT campaign_id, 'head' AS scope, h AS t, hk AS k FROM dk UNION ALL SELECT campaign_id, 'all', a, ak FROM dk),
dh AS (SELECT *, strpos(k, word) AS place FROM dt JOIN dr USING (scope) WHERE contains(k, word) AND regexp_matches(k, '(^|[^a-z0-9])' || regexp_replace(word, '([+.''-])', '[\\1]', 'g')) QUALIFY row_number() OVER (PARTITION BY campaign_id, axis, value, source ORDER BY prio) = 1),
db AS (SELECT * FROM dh QUALIFY row_number() OVER (PARTITION BY campaign_id, axis, value ORDER BY confidence DESC, prio) = 1),
dl AS (SELECT campaign_id, axis, value, CAST(confidence AS DOUBLE) AS confidence, source, substring(substring(t, greatest(place - 40, 1), place + length(word) + 60 - greatest(place - 40, 1)), 1, 160) AS evidence FROM db
    UNION ALL SELECT campaign_id, 'sector', 'genel', 0.3, 'keyword', NULL FROM c WHERE campaign_id NOT IN (SELECT campaign_id FROM db WHERE axis = 'sector'))"""
_C = f"WITH {SQL_CAMPAIGNS}"
_RUN = """, stored AS (SELECT * FROM campaigns WHERE NOT starts_with(title, '1-URGENT')),
run AS (SELECT *, 1 AS n, end_date + 1 AS new_end FROM campaigns WHERE NOT starts_with(title, '5-LOW') AND NOT starts_with(title, '1-URGENT') UNION ALL SELECT *, 2, end_date + 2 FROM campaigns WHERE starts_with(title, '1-URGENT'))"""

ORACLE = {
    "campaigns_by_bank": f"{_C} SELECT n_name AS bank_code, 'Bank of ' || n_name AS bank_name, count(campaign_id) AS campaign_count FROM nation LEFT JOIN campaigns ON n_name = bank_code GROUP BY 1, 2",
    "banks_with_data": f"{_C} SELECT count(DISTINCT bank_code) AS banks_with_data FROM campaigns",
    "bank_lookup": f"{_C} SELECT 'NATION_7' AS bank_code, 'Bank of NATION_7' AS bank_name, count(*) AS campaign_count FROM campaigns WHERE bank_code = 'NATION_7'",
    "campaign_count": f"{_C} SELECT count(*) AS campaigns FROM campaigns",
    "campaign_lookup": f"{_C}, {SQL_LABELS} SELECT campaign_id, 'Bank of ' || bank_code AS bank_name, title, (SELECT o_orderstatus FROM orders WHERE o_orderkey = campaign_id) AS doc_status, coalesce((SELECT string_agg(axis || '=' || value, ',' ORDER BY axis, value) FROM labels_ l WHERE l.campaign_id = c.campaign_id), '') AS labels FROM campaigns c WHERE campaign_id = 7",
    "inventory_upsert": "SELECT 'NATION_' || s_nationkey AS bank_code, s_name AS page_url, CAST(round(s_acctbal) AS BIGINT) + CASE WHEN s_nationkey >= 10 THEN 1 ELSE 0 END AS controls, CASE WHEN s_nationkey <= 14 THEN DATE '2026-01-01' ELSE DATE '2026-02-01' END AS first_seen, CASE WHEN s_nationkey >= 10 THEN DATE '2026-02-01' ELSE DATE '2026-01-01' END AS last_seen, CASE WHEN s_nationkey < 10 THEN 'keep' WHEN s_nationkey <= 14 THEN 'update' ELSE 'insert' END AS action FROM supplier",
    "default_labels": f"WITH c AS (SELECT doc_id AS campaign_id, text AS h, text AS a FROM documents), {_DEFAULTS} SELECT axis, value, source, count(*) AS n FROM dl GROUP BY ALL",
    "default_rule_labels": f"WITH w AS (SELECT {_WORDS} AS words), p AS (SELECT p_partkey AS campaign_id, 'Fırsat: ' || upper(translate(words[p_partkey % len(words) + 1], 'iı', 'İI')) || ' için teklif ' || p_name AS h, 'Koşul (' || words[p_partkey * 7 % len(words) + 1] || 'da) geçerlidir' AS conditions FROM part, w), c AS (SELECT campaign_id, replace(h, '  ', ' ') AS h, replace(h || ' ' || conditions, '  ', ' ') AS a FROM p), {_DEFAULTS} SELECT * FROM dl",
    "invalid_variants": "SELECT * FROM (SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'sigorta' WHEN 'Brand#2' THEN 'arac_durumu' ELSE 'konut_durumu' END AS dimension, CASE p_type WHEN 'ECONOMY' THEN 'sigortali' WHEN 'SMALL' THEN 'sifir_arac' WHEN 'LARGE' THEN 'toki' ELSE 'bilinmeyen' END AS variant_key FROM part) WHERE (dimension, variant_key) NOT IN (('sigorta', 'sigortali'), ('arac_durumu', 'sifir_arac'), ('konut_durumu', 'toki'))",
    "labels_long": f"WITH {_LAB} SELECT * FROM lab",
    "label_summary": f"WITH {_LAB} SELECT 'axis' AS section, axis AS key, count(*) AS n FROM lab GROUP BY axis UNION ALL SELECT 'source', source, count(*) FROM lab GROUP BY source UNION ALL SELECT 'value', axis || '/' || value, count(*) FROM lab GROUP BY axis, value",
    "label_gate": f"WITH {_LAB}, g AS (SELECT campaign_id, max(CASE WHEN axis = 'sector' AND value = 'genel' AND confidence <= 0.3 THEN 1 ELSE 0 END) AS f, max(CASE WHEN axis = 'product_type' THEN 1 ELSE 0 END) AS p FROM lab GROUP BY 1) SELECT count(*) AS campaigns, CAST(sum(f) AS BIGINT) AS fallback_only, CAST(sum(1 - p) AS BIGINT) AS missing_product_type, round(sum(f) / count(*), 6) AS ratio, sum(f) / count(*) < 0.4 AS passed FROM g",
    "invalid_labels": f"WITH {_LAB} SELECT axis, value, count(*) AS n FROM lab WHERE value IN ('metal', 'device', 'coloured', 'bulk', 'small') GROUP BY 1, 2",
    "display_labels": f"WITH {_LAB}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY campaign_id ORDER BY axis, confidence DESC, value) AS INTEGER) AS position, greatest(count(*) OVER (PARTITION BY campaign_id) - 3, 0) AS overflow FROM lab) SELECT campaign_id, position, axis, value, overflow, confidence < 0.5 AS weak FROM n WHERE position <= 3",
    "rate_provenance": "SELECT CASE l_returnflag WHEN 'A' THEN 'html_table' WHEN 'N' THEN 'js_default' ELSE 'guess' END AS rate_source, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END AS confidence, l_returnflag <> 'N' AS comparable, count(*) AS n FROM lineitem GROUP BY ALL",
    "category_backfill": "WITH f AS (SELECT l_orderkey, arg_min(CASE l_returnflag WHEN 'N' THEN 'O' WHEN 'A' THEN 'F' ELSE 'P' END, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice}) AS label FROM lineitem GROUP BY 1) SELECT o_orderstatus AS bank_category, label AS new_category, count(*) AS n FROM orders JOIN f ON o_orderkey = l_orderkey WHERE o_orderstatus <> label GROUP BY ALL",
    "status_by_asof": f"{_C} SELECT campaign_id, status FROM campaigns",
    "stats_totals": f"{_C} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'expired') AS expired, count(*) FILTER (status = 'upcoming') AS upcoming, count(*) FILTER (status = 'unknown') AS unknown FROM campaigns",
    "banks_with_counts": f"{_C} SELECT n_name AS bank_code, 'Bank of ' || n_name AS bank_name, count(campaign_id) AS campaign_count FROM nation LEFT JOIN campaigns ON n_name = bank_code GROUP BY 1, 2",
    "campaigns_by_category": f"{_C} SELECT category, count(*) AS n FROM campaigns GROUP BY 1",
    "list_filtered_page": f"{_C} SELECT campaign_id, 'Bank of ' || bank_code AS bank_name, title, end_date FROM campaigns WHERE bank_code IN ('NATION_1', 'NATION_2', 'NATION_7') AND status = 'active' ORDER BY end_date DESC NULLS LAST, campaign_id LIMIT 25 OFFSET 25",
    "list_total": f"{_C} SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM campaigns WHERE bank_code IN ('NATION_1', 'NATION_2', 'NATION_7') AND status = 'active' AND segment = 'BUILDING'",
    "axis_exists": f"{_C}, {SQL_LABELS} SELECT campaign_id, bank_code FROM campaigns c WHERE EXISTS (SELECT 1 FROM labels_ l WHERE l.campaign_id = c.campaign_id AND axis = 'flag' AND value = 'A') AND EXISTS (SELECT 1 FROM labels_ l WHERE l.campaign_id = c.campaign_id AND axis = 'line' AND value = 'O')",
    "text_search": f"{_C} SELECT campaign_id FROM campaigns WHERE title ILIKE '%build%f%' OR description ILIKE '%build%f%'",
    "date_bounds": f"{_C} SELECT campaign_id, start_date, end_date FROM campaigns WHERE start_date >= DATE '1997-01-01' AND end_date <= DATE '1998-01-01'",
    "nested_labels": f"{_C}, {SQL_LABELS}, i AS (SELECT campaign_id FROM campaigns WHERE status = 'unknown' ORDER BY 'Bank of ' || bank_code, campaign_id LIMIT 100) SELECT i.campaign_id, coalesce(string_agg(axis || '=' || value, ',' ORDER BY axis, value), '') AS labels FROM i LEFT JOIN labels_ l ON l.campaign_id = i.campaign_id GROUP BY 1",
    "campaign_details": f"{_C} SELECT 'Bank of ' || bank_code AS bank_name, status, count(*) AS n, max(end_date) AS last_end FROM campaigns GROUP BY 1, 2",
    "bar_shares": f"{_C}, c AS (SELECT bank_code, count(*) AS n FROM campaigns GROUP BY 1) SELECT bank_code, n, round(greatest(n * 100.0 / (SELECT max(n) FROM c), 2.0), 6) AS share FROM c",
    "last_run": "SELECT strftime(max(ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS last_run FROM events WHERE event_type = 'signup'",
    "run_summary": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS k FROM events) SELECT CAST(user_id AS VARCHAR) AS bank_code, count(*) FILTER (event_type = 'view') AS urls_discovered, count(*) FILTER (event_type = 'click') AS urls_fetched, count(*) FILTER (event_type = 'signup') AS campaigns_new, count(*) FILTER (event_type = 'purchase') AS campaigns_updated, count(*) FILTER (event_type = 'error') AS errors_count, CASE WHEN count(*) FILTER (event_type = 'click') = 0 AND count(*) FILTER (event_type = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'success' END AS status, coalesce(string_agg('e' || event_id, chr(10) ORDER BY event_id) FILTER (event_type = 'error' AND k <= 50), '') AS error_log FROM e GROUP BY 1",
    "fetch_outcomes": "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN value > 60 THEN 404 WHEN value > 30 THEN 503 ELSE 429 END ELSE 200 END AS st FROM events) SELECT CASE WHEN event_type = 'signup' THEN 'skipped_robots' WHEN event_type = 'purchase' AND value > 50 THEN 'skipped_soft_404' WHEN st = 404 THEN 'gone' WHEN event_type <> 'error' AND value > 1 THEN 'success' ELSE 'error' END AS outcome, st IN (408, 425, 429, 493) OR st BETWEEN 500 AND 599 AS retry, count(*) AS n FROM e GROUP BY ALL",
    "discovery_limit": f"{_C} SELECT bank_code, campaign_id AS seq, count(*) OVER (PARTITION BY bank_code) AS urls_discovered FROM campaigns QUALIFY row_number() OVER (PARTITION BY bank_code ORDER BY campaign_id) <= 10",
    "upsert_second_run": f"{_C}{_RUN} SELECT coalesce(s.bank_code, r.bank_code) AS bank_code, coalesce(s.external_slug, r.external_slug) AS external_slug, CASE WHEN s.campaign_id IS NULL THEN 'new' ELSE s.category END AS category, CASE WHEN r.campaign_id IS NULL THEN s.end_date ELSE r.new_end END AS end_date, CASE WHEN s.campaign_id IS NULL THEN DATE '2026-02-01' ELSE DATE '2026-01-01' END AS first_seen, CASE WHEN r.campaign_id IS NULL THEN DATE '2026-01-01' ELSE DATE '2026-02-01' END AS last_seen, CASE WHEN r.campaign_id IS NULL THEN 'keep' WHEN s.campaign_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM stored s FULL JOIN run r ON s.bank_code = r.bank_code AND s.external_slug = r.external_slug",
    "upsert_counters": f"{_C}{_RUN} SELECT count(*) FILTER (s.campaign_id IS NULL) AS campaigns_new, CAST(sum(CASE WHEN r.campaign_id IS NULL THEN 0 WHEN s.campaign_id IS NULL THEN r.n - 1 ELSE r.n END) AS BIGINT) AS campaigns_updated FROM stored s FULL JOIN run r ON s.bank_code = r.bank_code AND s.external_slug = r.external_slug",
    "unseen_campaigns": f"{_C} SELECT bank_code, count(*) AS n FROM campaigns WHERE bank_code IN ('NATION_1', 'NATION_3') AND segment = 'BUILDING' GROUP BY 1",
    "forced_expired": f"{_C} SELECT CASE WHEN segment = 'MACHINERY' THEN 'expired' ELSE status END AS status, segment = 'MACHINERY' AND status <> 'expired' AS forced_expired, count(*) AS n FROM campaigns GROUP BY ALL",
    "seed_dimension": "WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 99 ELSE s_nationkey END AS k FROM supplier WHERE s_acctbal < 9000), o AS (SELECT * FROM supplier WHERE s_nationkey <> 3) SELECT coalesce(o.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(s.k, o.s_nationkey) AS s_nationkey, CASE WHEN o.s_suppkey IS NULL THEN 'insert' WHEN s.s_suppkey IS NULL OR s.k = o.s_nationkey THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN s ON o.s_suppkey = s.s_suppkey",
    "prune_dimension": "WITH c AS (SELECT c_custkey, c_acctbal > 5000 AS inside, c_custkey IN (SELECT o_custkey FROM orders) AS used FROM customer) SELECT c_custkey, false AS held FROM c WHERE inside OR used UNION ALL SELECT c_custkey, true FROM c WHERE NOT inside AND used",
    "dq_violations": "SELECT 'enum:l_returnflag' AS rule, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS n FROM lineitem UNION ALL SELECT 'order:l_tax<=l_discount', count(*) FILTER (l_tax > l_discount) FROM lineitem UNION ALL SELECT 'range:l_quantity', count(*) FILTER (l_quantity < 1 OR l_quantity > 45) FROM lineitem UNION ALL SELECT 'range:l_discount', count(*) FILTER (l_discount < 0) FROM lineitem",
    "dq_duplicate_keys": "SELECT l_orderkey, l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2 HAVING count(*) > 1",
    "dq_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "totals_reconcile": "SELECT count(*) AS total, count(*) AS by_status, true AS reconciles FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
}
