"""Registered queries of whole jobs: sitemap trees, sites with rules of their own, evidence, relabelling, incremental merges,
keyed tables, product variants."""

from __future__ import annotations

import gzip
import uuid
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import extract as E
from ..functions import urls as U
from ..functions.evidence import evidence
from ..operators import pages as P
from ..operators import products as R
from ..operators import taxonomy as X
from ..operators.upsert import upsert
from ..session import shared_folder, ship_package, spread, staged, table
from ..sources import archives as A
from ..sources import storage
from ..streaming import incremental
from .offers import RULES
from .roles import SQL_CAMPAIGNS, campaigns, tr_date, tr_number
from .web import _U

FILE_PAGES = 50_000
SITEMAP = '<?xml version="1.0"?><{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{1}</{0}>'


@F.pandas_udf(BinaryType())
def _gzipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode(), mtime=0))


def _listed(kind: str, item: str, urls) -> F.Column:
    """A sitemap document of the given URLs."""
    head, tail = SITEMAP.split("{1}")
    entries = F.array_join(F.transform(F.array_sort(urls), lambda u: F.concat(F.lit(f"<{item}><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{item}>"))), "")
    return F.concat(F.lit(head.format(kind)), entries, F.lit(tail.format(kind)))


def sitemap_index_leaves(s, d):
    """Sitemaps of three levels per site, rendered from its pages: a root index of languages, that names itself too; an index
    per language, that names the root; gzipped files of at most 50 000 pages. The root does not list Spanish."""
    ship_package(s)
    url = F.col("url")
    pages = table(s, d, "pages").select(
        F.concat(F.lit("https://"), U.bare_host(url)).alias("site"), F.try_element_at(U.path_parts(url), F.lit(1)).alias("section"), F.floor(F.col("page_id") / FILE_PAGES).cast("string").alias("file"), "url"
    )
    root, index = F.concat("site", F.lit("/sitemap.xml")), F.concat("site", F.lit("/maps/"), "section", F.lit(".xml"))
    leaf = F.concat("site", F.lit("/maps/"), "section", F.lit("-"), "file", F.lit(".xml.gz"))
    parts = pages.select("site", "section", "file").distinct()
    leaves = pages.groupBy("site", "section", "file").agg(F.collect_list("url").alias("urls")).select(leaf.alias("url"), _gzipped(_listed("urlset", "url", F.col("urls"))).alias("content"))
    plain = lambda df, at: df.select(at.alias("url"), _listed("sitemapindex", "sitemap", F.col("urls")).cast("binary").alias("content"))
    indexes = plain(parts.groupBy("site", "section").agg(F.array_append(F.collect_set(leaf), F.first(root)).alias("urls")), index)
    roots = plain(parts.filter("section <> 'es'").groupBy("site").agg(F.array_append(F.collect_set(index), F.first(root)).alias("urls")), root)
    files = leaves.unionByName(indexes).unionByName(roots).select("url", A.unpacked_text(F.col("content")).alias("xml"))
    found = A.expand_sitemaps(files, parts.select(root.alias("url")).distinct())
    return found.select("page_key", "loc", "sitemap_key", "depth")


SITES = 3


def _site_pages(s, d):
    """Pages of three sites, which name and order their sections differently, one per supplier."""
    sup = spread(table(s, d, "supplier"), "s_suppkey")
    key, n = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % SITES
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int"))
    span = F.concat(tr_date(day), F.lit(" - "), tr_date(F.date_add(day, 20)), F.lit(" tarihleri arasında"))
    other = F.concat(F.lit("Son gün: "), tr_date(F.date_add(day, 40)))
    section = lambda tag, title, text: F.concat(F.lit(f"<{tag}>{title}</{tag}><p>"), text, F.lit("</p>"))
    body = (
        F.when(n == 0, F.concat(section("h2", "Kampanya Dönemi", span), section("h2", "Kampanya Koşulları", F.concat(F.lit("Koşul "), key, F.lit(". "), other)), section("h2", "Kapsam Dışı", F.concat(F.lit("Hariç "), key))))
        .when(n == 1, F.concat(section("h3", "Katılım Koşulları", F.lit("kısa")), section("h3", "Kampanya Detayları", F.concat(F.lit("Detaylı koşul metni "), key, F.lit(". "), other)), section("h3", "Kampanya Dönemi", span)))
        .otherwise(F.concat(F.lit("<div><strong>Kimler katılabilir?</strong></div><p>Yalnız üyeler "), key, F.lit("</p>"), section("h2", "İstisnalar", F.concat(F.lit("Ticari kart "), key)), section("h2", "Notlar", other)))
    )
    intro = F.concat(F.lit("Bu satır yalnızca kırk karakterden uzun "), key, F.lit("</p><p>Bu satır altmış karakterden de uzun olduğu için her sitede açıklama sayılır "), key)
    html = F.concat(F.lit("<html><body><main><h1>Site Adı</h1><h1>Teklif "), key, F.lit("</h1><p>"), intro, F.lit("</p>"), body, F.lit("<p>PUAN yazıp 5555'e gönderin</p></main></body></html>"))
    return sup.select(
        F.col("s_suppkey").alias("page_id"), F.concat(F.lit("site"), n.cast("string")).alias("site"), F.concat(F.lit("https://site.example/bireysel/teklif-"), key).alias("url"),
        F.lit(None).cast("string").alias("segment_hint"), F.lit(None).cast("boolean").alias("archive_hint"), F.lit("campaign").alias("doc_type"), html.alias("html"),
    )


SITE_RULES = [
    ("site0", "conditions", ["kampanya koşul", "koşullar"], None), ("site0", "exclusions", ["kapsam dışı"], None), ("site0", "period", ["kampanya dönemi"], None),
    ("site1", "conditions", ["katılım koşul", "kampanya detay"], 10), ("site1", "period", ["kampanya dönemi"], None),
    ("site2", "conditions", ["kimler katıl"], None), ("site2", "exclusions", ["istisna"], None), ("site2", "description", [], 60),
]
SITE_ORDER = [("site0", "period", 1), ("site0", "conditions", 2), ("site0", "body", 3), ("site1", "conditions", 1), ("site1", "period", 2), ("site2", "conditions", 1), ("site2", "body", 2)]


def site_campaign_rows(s, d):
    """Campaigns of three sites with different headings, thresholds and orders of the sources of their dates."""
    ship_package(s)
    pages = _site_pages(s, d)
    nodes = staged(P.page_nodes(pages), "nodes")
    rules, order = s.createDataFrame(SITE_RULES, P.SITE_RULES), s.createDataFrame(SITE_ORDER, P.SOURCE_ORDER)
    rows = P.site_campaign_rows(pages.drop("html"), nodes, rules, order, F.lit("personal"), ignored_titles=("site adi",))
    return rows.drop("source_url")


#: A text of a line takes less than a page does.
ORDERS_PER_TASK = 50_000


def evidence_spans(s, d):
    """Evidence of every field in texts that name each price twice."""
    o = spread(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), "o_orderkey", ORDERS_PER_TASK)
    start = F.to_date("o_orderdate")
    price, n = tr_number(F.col("o_totalprice")), (F.col("o_orderkey") % 36 + 1).cast("string")
    rate = tr_number(F.col("o_orderkey") % 500 / 100)
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(price, F.lit(" TL ve "), price, F.lit(" TL, %"), rate, F.lit(" ve %"), rate))
        .when(F.col("o_orderstatus") == "O", F.concat(n, F.lit(" ay vade, sonra "), n, F.lit(" ay vade; "), F.date_format(start, "d.M.yyyy"), F.lit(" ile "), tr_date(F.date_add(start, 20))))
        .otherwise(F.concat(F.lit("Peşin fiyatına "), n, F.lit(" taksit; ekspertiz değerinin %"), n, F.lit("'ine kadar, "), n, F.lit(" yaşına kadar araç")))
    )
    texts = o.select("o_orderkey", E.prepare(text, composed=True).alias("text"), F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string")).alias("url"))
    rows = evidence(texts, "o_orderkey", "text", "url")
    return rows.withColumn("confidence", F.col("confidence").cast("double"))


def relabelled(s, d):
    """Labels of all brands, then those of one brand anew after a word left the rules and parts of another are gone: what is
    stored in the end, by brand."""
    parts = table(s, d, "part").select(
        F.col("p_partkey").alias("campaign_id"), F.col("p_brand").alias("bank_code"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"),
        F.col("p_type").alias("conditions_text"), F.lit("").alias("source_url"), F.lit(None).cast("string").alias("bank_category"),
    )
    path = f"{shared_folder(s)}/kervan/labels-{uuid.uuid4().hex}"
    X.relabel(parts, path, rules=RULES, composed=True)
    X.relabel(parts, path, "Brand#1", [r for r in RULES if r[-1] != "widget"], composed=True)
    X.relabel(parts.filter("bank_code <> 'Brand#3'"), path, "Brand#3", RULES, composed=True)
    stored = s.read.parquet(path)
    return stored.groupBy("bank_code", "axis", "value", F.col("confidence").cast("double").alias("confidence")).agg(F.count("*").alias("n"))


def incremental_versions(s, d):
    """Three batches merged as versions: all orders, one in a hundred again with another price, new ones."""
    o = table(s, d, "orders").select(F.lit("b").alias("bank_code"), F.col("o_orderkey").cast("string").alias("external_slug"), F.col("o_totalprice").alias("price"), "o_orderkey", F.lit(1).alias("seq"))
    empty = s.createDataFrame([], "bank_code string, external_slug string, price double, first_seen_at timestamp, last_seen_at timestamp")
    root = f"{shared_folder(s)}/kervan/versions-{uuid.uuid4().hex}"
    keys = ["bank_code", "external_slug"]
    first = o.filter("o_orderkey % 10 <> 3")
    again = o.filter("o_orderkey % 100 = 7").withColumn("price", F.col("price") + 1)
    late = o.filter("o_orderkey % 10 = 3").unionByName(again.withColumn("price", F.col("price") * 2).filter("o_orderkey % 200 = 7"))
    for n, batch in enumerate((first, again, late)):
        incremental.merge_batch(batch.drop("o_orderkey"), n, root, lambda b: b, empty, keys)
    return incremental.current_version(s, root, empty, keys).select("external_slug", "price", (F.col("first_seen_at") < F.col("last_seen_at")).alias("updated"))


def keyed_upsert(s, d):
    """Campaigns of half the banks saved as a keyed table and read back, then merged with a run of all that are active."""
    c = campaigns(s, d)
    t0 = F.lit("2026-01-01").cast("timestamp")
    name = f"campaigns_{uuid.uuid4().hex}"
    stored = c.filter("campaign_id % 2 = 0").withColumn("first_seen_at", t0).withColumn("last_seen_at", t0)
    storage.save_keyed(stored, "campaigns", name, buckets=8, path=f"{shared_folder(s)}/kervan/{name}")
    run = c.filter("status = 'active'").select("bank_code", "external_slug", F.concat("title", F.lit("!")).alias("title"), "end_date", F.lit(1).alias("seq"))
    done = upsert(storage.read_keyed(s, name), run, F.lit("2026-02-01").cast("timestamp"), ["bank_code", "external_slug"])
    return done.select("bank_code", "external_slug", "title", "segment", "end_date", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"), "action")


def product_variants(s, d):
    """Parts as products: every tenth is a parent, the others variants of the one before; fields are missing by brand."""
    p = table(s, d, "part")
    key = F.col("p_partkey")
    products = p.select(
        key.alias("product_id"), F.when(key % 10 != 0, key - key % 10).alias("parent_product_id"), F.when(F.col("p_brand") != "Brand#1", F.col("p_retailprice")).alias("amount_max"),
        F.when((key % 10 == 0) | (F.col("p_size") > 25), F.col("p_size")).alias("term_months_max"), F.when(key % 10 == 0, F.col("p_type")).alias("currency"),
    )
    rows = R.with_parents(products, ("amount_max", "term_months_max", "currency"))
    counts = R.variant_counts(products).withColumnRenamed("product_id", "_id")
    joined = rows.join(counts.hint("merge"), rows["product_id"] == counts["_id"]).drop("_id")
    return joined.withColumn("inherited_fields", F.array_join("inherited_fields", ","))


FUNCTIONS = [sitemap_index_leaves, site_campaign_rows, evidence_spans, relabelled, incremental_versions, keyed_upsert, product_variants]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_TR = "(day(x) || ' ' || ['ocak', 'şubat', 'mart', 'nisan', 'mayıs', 'haziran', 'temmuz', 'ağustos', 'eylül', 'ekim', 'kasım', 'aralık'][month(x)] || ' ' || year(x))"
_tr = lambda x: _TR.replace("x", f"({x})")
_num = lambda c: f"translate(format('{{:,.2f}}', {c}), ',.', '.,')"
_plain = lambda c: f"rtrim(rtrim(printf('%.2f', {c}), '0'), '.')"

ORACLE = {
    "sitemap_index_leaves": f"""WITH {_U} SELECT page_key, url AS loc, 'https://' || host || '/maps/' || parts[1] || '-' || (page_id // {FILE_PAGES}) || '.xml.gz' AS sitemap_key, 2 AS depth
        FROM keyed WHERE parts[1] <> 'es' QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY CAST(page_id // {FILE_PAGES} AS VARCHAR), url) = 1""",
    "site_campaign_rows": f"""
        WITH p AS (SELECT s_suppkey AS k, s_suppkey % 3 AS n, DATE '2026-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS day FROM supplier),
        t AS (SELECT *, 'Son gün: ' || {_tr('day + 40')} AS other FROM p)
        SELECT k AS page_id, 'site' || n AS site, 'teklif-' || k AS external_slug, 'Teklif ' || k AS title,
            CASE WHEN n = 2 THEN 'Bu satır altmış karakterden de uzun olduğu için her sitede açıklama sayılır ' || k ELSE 'Bu satır yalnızca kırk karakterden uzun ' || k END AS description,
            CASE n WHEN 0 THEN 'Koşul ' || k || '. ' || other WHEN 1 THEN 'Detaylı koşul metni ' || k || '. ' || other ELSE 'Yalnız üyeler ' || k END AS conditions_text,
            CASE n WHEN 0 THEN 'Hariç ' || k || chr(10) || 'PUAN yazıp 5555''e gönderin' WHEN 2 THEN 'Ticari kart ' || k END AS exclusions, 'personal' AS segment,
            CASE WHEN n = 0 THEN day END AS start_date, CASE WHEN n = 0 THEN day + 20 ELSE day + 40 END AS end_date, CASE WHEN n = 0 THEN 'exact' ELSE 'partial' END AS date_precision,
            'sms' AS participation_method, 'PUAN' AS sms_keyword, '5555' AS sms_number, CAST(NULL AS VARCHAR) AS coupon_code, false AS is_archived,
            CASE n WHEN 0 THEN 'period' WHEN 1 THEN 'conditions' ELSE 'body' END AS window_source FROM t""",
    "evidence_spans": f"""
        WITH o AS (SELECT o_orderkey, o_orderstatus AS st, {_num('o_totalprice')} AS price, o_totalprice, CAST(o_orderkey % 36 + 1 AS VARCHAR) AS n, {_num('(o_orderkey % 500) / 100.0')} AS rate, (o_orderkey % 500) / 100.0 AS r, CAST(o_orderdate AS DATE) AS day FROM orders),
        b AS (SELECT o_orderkey, 'amount' AS field_name, price || ' tl' AS raw, {_plain('o_totalprice')} AS value, 'TRY' AS unit, 0.75 AS confidence, '' AS b1, ' ve ' AS b2, 2 AS times FROM o WHERE st = 'F'
            UNION ALL SELECT o_orderkey, 'rate_pct', rate, {_plain('r')}, 'percent', 0.75, price || ' tl ve ' || price || ' tl, %', ' ve %', 2 FROM o WHERE st = 'F'
            UNION ALL SELECT o_orderkey, 'term_months', n || ' ay', n || '-' || n, 'month', 0.75, '', ' vade, sonra ', 2 FROM o WHERE st = 'O'
            UNION ALL SELECT o_orderkey, 'date', strftime(day, '%-d.%-m.%Y'), CAST(day AS VARCHAR), 'date', 0.75, n || ' ay vade, sonra ' || n || ' ay vade; ', '', 1 FROM o WHERE st = 'O'
            UNION ALL SELECT o_orderkey, 'date', lower({_tr('day + 20')}), CAST(day + 20 AS VARCHAR), 'date', 0.75, n || ' ay vade, sonra ' || n || ' ay vade; ' || strftime(day, '%-d.%-m.%Y') || ' ile ', '', 1 FROM o WHERE st = 'O'
            UNION ALL SELECT o_orderkey, 'rate_pct', n, n, 'percent', 0.75, 'peşin fiyatına ' || n || ' taksit; ekspertiz değerinin %', '', 1 FROM o WHERE st = 'P'
            UNION ALL SELECT o_orderkey, 'instalments', n || ' taksit', n, 'count', 0.75, 'peşin fiyatına ', '', 1 FROM o WHERE st = 'P'
            UNION ALL SELECT o_orderkey, 'ltv_pct', 'ekspertiz değerinin %' || n, n, 'percent', 0.75, 'peşin fiyatına ' || n || ' taksit; ', '', 1 FROM o WHERE st = 'P'
            UNION ALL SELECT o_orderkey, 'vehicle_age', n || ' yaşına kadar', '-' || n, 'year', 0.5, 'peşin fiyatına ' || n || ' taksit; ekspertiz değerinin %' || n || '''ine kadar, ', '', 1 FROM o WHERE st = 'P'),
        x AS (SELECT o_orderkey, CASE st WHEN 'F' THEN price || ' tl ve ' || price || ' tl, %' || rate || ' ve %' || rate
                  WHEN 'O' THEN n || ' ay vade, sonra ' || n || ' ay vade; ' || strftime(day, '%-d.%-m.%Y') || ' ile ' || lower({_tr('day + 20')})
                  ELSE 'peşin fiyatına ' || n || ' taksit; ekspertiz değerinin %' || n || '''ine kadar, ' || n || ' yaşına kadar araç' END AS text FROM o),
        e AS (SELECT *, CAST(unnest(range(times)) AS INTEGER) AS k FROM b),
        p AS (SELECT *, CAST(length(b1) + 1 + CASE k WHEN 1 THEN length(raw) + length(b2) ELSE 0 END AS INTEGER) AS s FROM e)
        SELECT o_orderkey, field_name, CAST(row_number() OVER (PARTITION BY o_orderkey, field_name ORDER BY s) - 1 AS INTEGER) AS seq, raw AS value_raw, value AS value_normalized, unit,
            substring(text, greatest(s - 40, 1), s + length(raw) + 40 - greatest(s - 40, 1)) AS evidence_text, s AS evidence_char_start, CAST(s + length(raw) AS INTEGER) AS evidence_char_end,
            'https://x.example/' || o_orderkey AS evidence_source_url, confidence, 'rule' AS extraction_method FROM p JOIN x USING (o_orderkey)""",
    "relabelled": """
        WITH r AS (SELECT * FROM (VALUES ('sector', 'metal', 0.9, 'bolt', 0, 0), ('sector', 'metal', 0.7, 'ring', 1, 0), ('sector', 'device', 0.7, 'widget', 2, 0), ('product_type', 'coloured', 0.7, 'red', 3, 0), ('product_type', 'coloured', 0.7, 'blue', 4, 0),
                ('audience', 'bulk', 0.7, 'economy', 5, 1), ('audience', 'bulk', 0.7, 'econo', 6, 1), ('benefit', 'small', 0.7, 'small', 7, 1)) t(axis, value, confidence, word, prio, scope)),
        p AS (SELECT p_partkey, p_brand AS bank_code, lower(p_name) AS h, lower(p_name || ' ' || p_type) AS a FROM part WHERE p_brand <> 'Brand#3'),
        l AS (SELECT p_partkey, bank_code, axis, value, max(confidence) AS confidence FROM p JOIN r ON regexp_matches(CASE WHEN scope = 0 THEN h ELSE a END, '(^|[^a-z0-9])' || word) WHERE NOT (bank_code = 'Brand#1' AND word = 'widget') GROUP BY ALL),
        f AS (SELECT * FROM l UNION ALL SELECT p_partkey, bank_code, 'sector', 'genel', 0.3 FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM l WHERE axis = 'sector'))
        SELECT bank_code, axis, value, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM f GROUP BY ALL""",
    "incremental_versions": """SELECT CAST(o_orderkey AS VARCHAR) AS external_slug, CASE WHEN o_orderkey % 200 = 7 THEN (o_totalprice + 1) * 2 WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
        o_orderkey % 100 = 7 AS updated FROM orders""",
    "keyed_upsert": f"""WITH {SQL_CAMPAIGNS} SELECT bank_code, external_slug, CASE WHEN status = 'active' THEN title || '!' ELSE title END AS title, CASE WHEN campaign_id % 2 = 0 THEN segment END AS segment, end_date,
        CASE WHEN campaign_id % 2 = 0 THEN DATE '2026-01-01' ELSE DATE '2026-02-01' END AS first_seen, CASE WHEN status = 'active' THEN DATE '2026-02-01' ELSE DATE '2026-01-01' END AS last_seen,
        CASE WHEN status <> 'active' THEN 'keep' WHEN campaign_id % 2 = 0 THEN 'update' ELSE 'insert' END AS action FROM campaigns WHERE campaign_id % 2 = 0 OR status = 'active'""",
    "product_variants": """
        WITH p AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END AS parent_product_id, CASE WHEN p_brand <> 'Brand#1' THEN p_retailprice END AS amount_max,
            CASE WHEN p_partkey % 10 = 0 OR p_size > 25 THEN p_size END AS term_months_max, CASE WHEN p_partkey % 10 = 0 THEN p_type END AS currency FROM part),
        n AS (SELECT parent_product_id, count(*) AS n FROM p GROUP BY 1)
        SELECT p.product_id, p.parent_product_id, coalesce(p.amount_max, q.amount_max) AS amount_max, coalesce(p.term_months_max, q.term_months_max) AS term_months_max, coalesce(p.currency, q.currency) AS currency,
            p.parent_product_id IS NOT NULL AS is_variant, q.product_id IS NOT NULL AS parent_found,
            concat_ws(',', CASE WHEN p.amount_max IS NULL AND q.amount_max IS NOT NULL THEN 'amount_max' END, CASE WHEN p.term_months_max IS NULL AND q.term_months_max IS NOT NULL THEN 'term_months_max' END, CASE WHEN p.currency IS NULL AND q.currency IS NOT NULL THEN 'currency' END) AS inherited_fields,
            coalesce(n.n, 0) AS variants
        FROM p LEFT JOIN p q ON p.parent_product_id = q.product_id LEFT JOIN n ON n.parent_product_id = p.product_id""",
}
