"""Registered queries on pages, URLs and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import vocabulary as V
from ..operators import discovery as D
from ..operators import pages as P
from ..operators import upsert as X
from ..session import ship_package, table
from ..sources import archives as A

PATH_RULES = [("skip", ("/es/",)), ("campaign", ("/en/",)), ("product", ("/fr/", "/de/"))]
PREFIXES = ["/en/", "/de/", "/fr/"]
#: One line for each default pattern, in their order.
BOILERPLATE_LINES = (
    "ÇEREZ POLİTİKASI hakkında", "Cookie  Policy", "KVKK kapsamında", "Aydınlatma Metni için tıklayın", "Gizlilik bildirimi", "Tüm hakları saklıdır.", "Bilgi Toplumu Hizmetleri",
    "Müşteri Hizmetleri: 0850 000 00 00", "Sosyal medya hesaplarımız", "Mobil uygulamayı indirin", "App Store'dan edinin", "Sitede gezinmeye devam ederek kabul edersiniz", "Tarayıcı ayarlarınızı kontrol edin",
)
LICENCE = (r"licensed\s+under", r"all\s+rights\s+reserved")


def _pages(s, d):
    return table(s, d, "pages")


def site_overview(s, d):
    p = _pages(s, d).select(U.bare_host(F.col("url")).alias("host"), U.canonical_key(F.col("url")).alias("k"), T.fingerprint(F.trim(F.regexp_replace(T.strip_tags(F.col("html")), r"\s+", " "))).alias("print"))
    per = p.groupBy("host", "k", "print").agg(F.count("*").alias("n"))
    return per.groupBy("host").agg(F.sum("n").alias("pages"), F.countDistinct("k").alias("distinct_pages"), F.countDistinct("print").alias("distinct_contents"))


def url_canonical(s, d):
    u = F.col("url")
    return _pages(s, d).select("page_id", U.canonical_url(u).alias("canonical_url"), U.url_hash(u).alias("url_hash"), U.bare_host(u).alias("host"))


def url_key_dedupe(s, d):
    return D.dedupe_urls(_pages(s, d).select("page_id", "url"), "url", "page_id").select("page_id", "url", "page_key")


def url_slug(s, d):
    return _pages(s, d).select("page_id", U.slug(F.col("url")).alias("slug"), F.try_element_at(U.path_parts(F.col("url")), F.lit(1)).alias("section"))


def url_same_page_pairs(s, d):
    return D.same_page_pairs(_pages(s, d), "page_id")


def url_classes(s, d):
    return _pages(s, d).select("page_id", D.classify_paths(F.col("url"), PATH_RULES).alias("class"), U.same_site(F.col("url"), F.lit("https://www.blog.tionsh.example.net/")).alias("own_site"))


def url_site_rules(s, d):
    hosts = ["blog.tionsh.example.net", "thther.example.org", "blog.ththan.example.net"]
    rules = s.createDataFrame([(h, "/en/", "", 1, ["home"]) for h in hosts], "site string, prefix string, suffix string, max_parts int, excluded array<string>")
    return D.match_site_rules(_pages(s, d).select("page_id", "url"), rules).select("page_id", "site")


def discovery_merge(s, d):
    p = _pages(s, d).select(U.canonical_key(F.col("url")).alias("k"), "page_id", "url")
    secure, plain = p.filter(F.col("url").startswith("https:")), p.filter(~F.col("url").startswith("https:"))
    return D.merge_sources([plain, secure], "k", "page_id").select("k", "page_id", "source_priority")


def prefix_rank_dedupe(s, d):
    return D.dedupe_by_prefix_rank(_pages(s, d).select("page_id", "url"), PREFIXES, "url", "page_id").select("slug", "page_id", "prefix_rank")


def sitemap_filter(s, d):
    return D.filter_sitemap(_pages(s, d).select("page_id", "url"), "https://blog.tionsh.example.net/", "/en/", "url", "page_id").select("page_id", "page_key")


def sitemap_roundtrip(s, d):
    """Sitemaps rendered per site and 50 000 pages, with an index of each site's files, read back."""
    p = _pages(s, d).select(U.bare_host(F.col("url")).alias("site"), F.floor(F.col("page_id") / 50_000).alias("file"), "page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda x: F.concat(F.lit("<url><loc> "), x["u"], F.lit(" </loc></url>"))), "")
    files = p.groupBy("site", "file").agg(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="s">'), body, F.lit("</urlset>")).alias("xml"))
    path = F.concat("site", F.lit("/"), F.col("file").cast("string"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<n:sitemap><n:loc>https://"), path, F.lit("</n:loc><n:lastmod>2026-01-01</n:lastmod></n:sitemap>")))), "")
    indexes = p.select("site", "file").distinct().groupBy("site").agg(F.concat(F.lit('<!-- x --><n:sitemapindex xmlns:n="s">'), listed, F.lit("</n:sitemapindex>")).alias("xml"))
    documents = files.select(path.alias("path"), "xml").unionByName(indexes.select(F.col("site").alias("path"), "xml"))
    return A.sitemap_entries(documents, "path", "xml").select("path", "seq", "loc", "lastmod", "is_index")


def robots_sitemaps(s, d):
    """Robots files rendered from pages; the first spelling of each sitemap stays."""
    p = _pages(s, d).select("page_id", F.concat(F.lit("SiteMap: "), "url").alias("value"))
    return A.sitemap_lines(p, "value", "page_id").select("page_key", "page_id")


def link_discovery(s, d):
    ship_package(s)
    pages = _pages(s, d)
    listings = pages.select("page_id", "url", F.col("page_id").alias("priority"), F.lit("all").alias("category"), F.lit(False).alias("is_archive"))
    return D.discover_links(P.page_nodes(pages), listings).select("page_key", "link", "priority")


def listing_links(s, d):
    """Links of pages of two languages as listings, those in Spanish as the archive; only words of plain letters lead to details."""
    ship_package(s)
    section = F.try_element_at(U.path_parts(F.col("url")), F.lit(1))
    listings = _pages(s, d).select("page_id", "url", F.col("page_id").alias("priority"), section.alias("category"), (section == "es").alias("is_archive")).filter("category IN ('en', 'es')")
    return D.discover_links(P.page_nodes(_pages(s, d)), listings, F.col("link").rlike("/[A-Za-z]+$")).select("link", "category", "is_archive", "priority")


def page_nodes_count(s, d):
    ship_package(s)
    n = P.page_nodes(_pages(s, d), columns=("page_id", "tag"))
    return n.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "li").alias("items"), F.count_if(F.col("tag") == "h1").alias("headings"))


def page_titles(s, d):
    ship_package(s)
    return P.page_titles(P.page_nodes(_pages(s, d), tags=("h1", "h2", "meta", "title"), columns=("page_id", "pre", "tag", "attrs", "text")))


def page_clean_text(s, d):
    """Noise-free main text per page and its fingerprint."""
    ship_package(s)
    clean = P.clean_text(P.main_content(P.without_noise(P.page_nodes(_pages(s, d)))))
    return clean.select("page_id", F.length("clean_text").alias("length"), T.fingerprint(F.col("clean_text")).alias("clean_text_sha256"))


def soft_404_pages(s, d):
    raw = P.same_title_prefilter(F.col("html"))
    body = F.trim(F.regexp_replace(T.strip_tags(F.regexp_replace("html", "(?s)<title>.*?</title>", "")), r"\s+", " "))
    return _pages(s, d).select("page_id", P.soft_404(body, raw, raw).alias("is_soft_404"))


def catch_all_pages(s, d):
    """Pages with the content of their site's first page, which stands for its home page."""
    p = _pages(s, d).select(U.bare_host(F.col("url")).alias("site"), "page_id", F.trim(F.regexp_replace(T.strip_tags(F.regexp_replace("html", "(?s)<script>.*?</script>|<!--.*?-->", "")), r"\s+", " ")).alias("clean_text"))
    homes = p.groupBy("site").agg(F.min_by("clean_text", "page_id").alias("clean_text"))
    return P.catch_all_pages(p, homes).groupBy("site").agg(F.count("*").alias("n"))


def text_match_key(s, d):
    ship_package(s)
    return table(s, d, "documents").select("doc_id", F.sha2(T.match_key(F.col("text")), 256).alias("key_hash"))


def duplicate_content(s, d):
    t = table(s, d, "documents").select(T.fingerprint(F.col("text")).alias("print"), "doc_id")
    return t.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def boilerplate_lines(s, d):
    t = table(s, d, "documents").select("doc_id", T.strip_boilerplate(F.col("text"), composed=True, patterns=LICENCE).alias("t"))
    return t.select("doc_id", F.size(F.split("t", "\n")).cast("long").alias("n_lines"), F.length("t").cast("long").alias("n_kept"))


def boilerplate_defaults(s, d):
    """Texts of three lines whose second is one kind of boilerplate, or none: the default patterns find every kind."""
    line = F.try_element_at(F.array(*[F.lit(x) for x in BOILERPLATE_LINES]), (F.col("p_partkey") % (len(BOILERPLATE_LINES) + 2) + 1).cast("int"))
    t = F.concat(F.lit("Teklif "), "p_name", F.lit("\n"), F.coalesce(line, F.lit("Çerez sevenlere indirim")), F.lit("\nSon satır"))
    return table(s, d, "part").select("p_partkey", T.strip_boilerplate(t, composed=True).alias("kept"))


def first_lines(s, d):
    return table(s, d, "documents").select("doc_id", T.first_line(T.tidy(F.col("text"))).alias("line"))


def first_paragraphs(s, d):
    """Title: the text's first line."""
    found = T.let(T.tidy(F.col("text")), lambda t: T.first_paragraph(t, F.try_element_at(F.split(t, "\n"), F.lit(1))))
    return table(s, d, "documents").select("doc_id", found.alias("paragraph"))


def slugs(s, d):
    return table(s, d, "part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_name", "p_brand", "p_type"), composed=True).alias("slug"))


def json_shape(s, d):
    return A.json_shape(table(s, d, "events").select("event_id", "props"), "props").groupBy("fields").agg(F.count("*").alias("n"), F.sum("n_records").alias("records"))


def snapshot_names(s, d):
    return X.snapshot_rows(_pages(s, d)).select("page_id", "snapshot")


def new_snapshots(s, d):
    """Pages over http as the stored archive, all pages as the new crawl."""
    p = _pages(s, d)
    stored = X.snapshot_rows(p.filter(F.col("url").startswith("http:")))
    return X.new_snapshots(p, stored).select("snapshot")


def crawl_log(s, d):
    p = _pages(s, d).select("url", F.lit("campaign").alias("doc_type"), F.lit(200).alias("http_status"), F.col("html").alias("clean_text"), "html", F.lit(True).alias("robots_allowed"), F.lit(False).alias("is_soft_404"), F.lit("sitemap").alias("discovery_method"), F.lit("2026-01-01").cast("timestamp").alias("fetched_at"))
    return X.document_rows(p).groupBy("clean_text_sha256").agg(F.count("*").alias("n"), F.countDistinct("url_hash").alias("urls"))


def listing_selection(s, d):
    """Sections of the pages as listings: a known name selects one, an unknown one all."""
    listings = _pages(s, d).select(F.try_element_at(U.path_parts(F.col("url")), F.lit(1)).alias("category")).distinct().withColumn("is_archive", F.col("category") == "es")
    known = D.select_listings(listings, ["EN"]).withColumn("asked", F.lit("known"))
    return known.unionByName(D.select_listings(listings, ["nothing"]).withColumn("asked", F.lit("unknown")))


def url_segments(s, d):
    names = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}
    return _pages(s, d).select("page_id", D.path_label(F.col("url"), 1, names).alias("segment"))


FUNCTIONS = [site_overview, url_canonical, url_key_dedupe, url_slug, url_same_page_pairs, url_classes, url_site_rules, discovery_merge, prefix_rank_dedupe, sitemap_filter, sitemap_roundtrip, robots_sitemaps, link_discovery, listing_links, page_nodes_count, page_titles, page_clean_text, soft_404_pages, catch_all_pages, text_match_key, duplicate_content, boilerplate_lines, boilerplate_defaults, first_lines, first_paragraphs, slugs, json_shape, snapshot_names, new_snapshots, crawl_log, listing_selection, url_segments]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_PARAMS = ", ".join(f"'{p}'" for p in V.TRACKING_PARAMS)
_U = f"""u AS (SELECT page_id, url, html,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages),
k AS (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains([{_PARAMS}], lower(split_part(p, '=', 1))))), '&') AS q FROM u),
keyed AS (SELECT *, 'https://' || host || rtrim(path, '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS page_key FROM k)"""
_CANON = "lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1)"
_BARE = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0B]+', ' ', 'g'), '[^\\S\\n]*\\n[^\\S\\n]*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g')"

# Text of a heading or title with its entities read, as the parser reads it: HTML ends these also without a semicolon.
_HEAD = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<{0}[^>]*>(.*?)</{0}>', 1, 's'), '&quot;?', '\"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"
_ANCHORS = f"""{_U}, a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS n FROM pages),
l AS (SELECT page_id, n, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href AS link, 'https://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') || rtrim(href, '/') AS page_key, regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([^/?#]*)', 1) AS category FROM a)"""

ORACLE = {
    "page_titles": f"WITH t AS (SELECT page_id, {_HEAD.format('h1')} AS h, {_HEAD.format('title')} AS t FROM pages), c AS (SELECT page_id, CASE WHEN length(h) >= 3 AND NOT regexp_matches(h, '{V.TITLE_PLACEHOLDER.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(lower(translate(h, 'İI', 'iı')), '{V.SECTION_HEADING}') THEN h ELSE nullif(t, '') END AS title FROM t) SELECT page_id, title FROM c WHERE title IS NOT NULL",
    "link_discovery": f"WITH {_ANCHORS} SELECT page_key, link, page_id AS priority FROM l QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY page_id, n) = 1",
    "listing_links": f"WITH {_ANCHORS} SELECT link, category, category = 'es' AS is_archive, page_id AS priority FROM l WHERE category IN ('en', 'es') AND regexp_matches(link, '/[A-Za-z]+$') QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY category = 'es', page_id, n) = 1",
    "boilerplate_defaults": f"SELECT p_partkey, 'Teklif ' || p_name || chr(10) || CASE WHEN p_partkey % {len(BOILERPLATE_LINES) + 2} >= {len(BOILERPLATE_LINES)} THEN 'Çerez sevenlere indirim' || chr(10) ELSE '' END || 'Son satır' AS kept FROM part",
    "first_paragraphs": f"WITH t AS (SELECT doc_id, string_split({_TIDY}, chr(10)) AS lines FROM documents), r AS (SELECT doc_id, list_reduce(lines, lambda s, l: CASE WHEN starts_with(s, chr(1)) THEN s WHEN l = '' OR l = lines[1] THEN '' WHEN length(trim(s || ' ' || l)) >= 80 THEN chr(1) || trim(s || ' ' || l) ELSE trim(s || ' ' || l) END, '') AS s FROM t) SELECT doc_id, CASE WHEN starts_with(s, chr(1)) THEN substring(s, 2, 500) END AS paragraph FROM r",
    "site_overview": f"WITH {_U} SELECT host, count(*) AS pages, count(DISTINCT page_key) AS distinct_pages, count(DISTINCT {_BARE.format('html')}) AS distinct_contents FROM keyed GROUP BY host",
    "url_canonical": f"WITH {_U} SELECT page_id, {_CANON} AS canonical_url, sha256({_CANON}) AS url_hash, host FROM u",
    "url_key_dedupe": f"WITH {_U} SELECT page_id, url, page_key FROM keyed QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY page_id) = 1",
    "url_slug": f"WITH {_U} SELECT page_id, parts[-1] AS slug, parts[1] AS section FROM k",
    "url_same_page_pairs": f"WITH {_U}, f AS (SELECT page_key, min(page_id) AS first_id FROM keyed GROUP BY page_key) SELECT first_id, page_id AS other_id, page_key FROM keyed JOIN f USING (page_key) WHERE page_id <> first_id",
    "url_classes": f"WITH {_U} SELECT page_id, CASE WHEN contains(lower(path), '/es/') THEN 'skip' WHEN contains(lower(path), '/en/') THEN 'campaign' WHEN contains(lower(path), '/fr/') OR contains(lower(path), '/de/') THEN 'product' END AS class, host = 'blog.tionsh.example.net' AS own_site FROM u",
    "url_site_rules": f"WITH {_U} SELECT page_id, host AS site FROM k WHERE host IN ('blog.tionsh.example.net', 'thther.example.org', 'blog.ththan.example.net') AND starts_with(path, '/en/') AND len(parts) = 2 AND parts[2] <> 'home'",
    "discovery_merge": f"WITH {_U}, b AS (SELECT page_key AS k, page_id, CASE WHEN starts_with(url, 'https:') THEN 1 ELSE 0 END AS source_priority FROM keyed) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_priority, page_id) = 1",
    "prefix_rank_dedupe": f"WITH {_U}, r AS (SELECT parts[-1] AS slug, page_id, CASE WHEN contains(lower(path), '/en/') THEN 0 WHEN contains(lower(path), '/de/') THEN 1 WHEN contains(lower(path), '/fr/') THEN 2 ELSE 3 END AS prefix_rank FROM k WHERE len(parts) > 0) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY slug ORDER BY prefix_rank, page_id) = 1",
    "sitemap_filter": f"WITH {_U} SELECT page_id, page_key FROM keyed WHERE host = 'blog.tionsh.example.net' AND contains(lower(path), '/en/') QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY page_id) = 1",
    "sitemap_roundtrip": f"WITH {_U}, f AS (SELECT *, host || '/' || (page_id // 50000) AS fp FROM u) SELECT fp AS path, CAST(row_number() OVER (PARTITION BY fp ORDER BY page_id) - 1 AS INTEGER) AS seq, url AS loc, CAST(NULL AS VARCHAR) AS lastmod, false AS is_index FROM f UNION ALL SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY fp) - 1 AS INTEGER), 'https://' || fp, '2026-01-01', true FROM (SELECT DISTINCT host, fp FROM f)",
    "robots_sitemaps": f"WITH {_U} SELECT page_key, page_id FROM keyed QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY page_id) = 1",
    "page_nodes_count": "SELECT page_id, CAST(len(regexp_extract_all(h, '<a[ >]')) AS BIGINT) AS links, CAST(len(regexp_extract_all(h, '<li[ >]')) AS BIGINT) AS items, CAST(len(regexp_extract_all(h, '<h1[ >]')) AS BIGINT) AS headings FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages)",
    "soft_404_pages": "WITH t AS (SELECT page_id, lower(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, " + _BARE.format("regexp_replace(html, '<title>.*?</title>', '', 'gs')") + " AS body FROM pages) SELECT page_id, body = '' OR regexp_matches(title, '\\b404\\b|sayfa bulunamadı|page not found') OR regexp_matches(lower(substring(body, 1, 2000)), 'aradığınız sayfa.{0,30}(bulunamadı|yok)|sayfa bulunamadı|böyle bir sayfa (yok|bulunmuyor)|aradığınız içeriğe ulaşılamadı|page not found|error 404') AS is_soft_404 FROM t",
    "catch_all_pages": f"WITH {_U}, t AS (SELECT host AS site, page_id, " + _BARE.format("regexp_replace(html, '<script>.*?</script>|<!--.*?-->', '', 'gs')") + " AS c FROM u), h AS (SELECT site, arg_min(c, page_id) AS c FROM t GROUP BY site) SELECT site, count(*) AS n FROM t JOIN h USING (site, c) WHERE c <> '' GROUP BY site",
    "text_match_key": f"SELECT doc_id, sha256(translate(lower(translate({_TIDY}, 'İI', 'iı')), '{V.FOLD_FROM}', '{V.FOLD_TO}')) AS key_hash FROM documents",
    "duplicate_content": "SELECT sha256(text) AS print, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "boilerplate_lines": f"WITH t AS (SELECT doc_id, array_to_string(list_filter(string_split({_TIDY}, chr(10)), lambda l: l <> '' AND NOT regexp_matches(lower(l), 'licensed\\s+under|all\\s+rights\\s+reserved')), chr(10)) AS t FROM (SELECT doc_id, CASE WHEN contains(text, '<') AND contains(text, '>') THEN regexp_replace(text, '<[^>]+>', ' ', 'g') ELSE text END AS text FROM documents)) SELECT doc_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, length(t) AS n_kept FROM t",
    "first_lines": f"SELECT doc_id, substring(list_filter(string_split({_TIDY}, chr(10)), lambda l: length(l) >= 40)[1], 1, 500) AS line FROM documents",
    "slugs": "SELECT p_partkey, rtrim(substring(trim(regexp_replace(lower(p_name || ' / ' || p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') AS slug FROM (SELECT p_partkey, replace(p_name, 'I', 'ı') AS p_name, p_brand, p_type FROM part)",
    "json_shape": "SELECT array_to_string(list_sort(json_keys(props)), ',') AS fields, count(*) AS n, count(*) AS records FROM events GROUP BY 1",
    "snapshot_names": f"SELECT page_id, substring(sha256({_CANON}), 1, 16) || '_' || substring(sha256(html), 1, 12) AS snapshot FROM pages",
    "new_snapshots": f"WITH s AS (SELECT substring(sha256({_CANON}), 1, 16) || '_' || substring(sha256(html), 1, 12) AS snapshot, url FROM pages) SELECT DISTINCT snapshot FROM s WHERE snapshot NOT IN (SELECT snapshot FROM s WHERE starts_with(url, 'http:'))",
    "crawl_log": f"SELECT sha256(html) AS clean_text_sha256, count(*) AS n, count(DISTINCT {_CANON}) AS urls FROM pages GROUP BY 1",
    "listing_selection": f"WITH {_U}, l AS (SELECT DISTINCT parts[1] AS category FROM k) SELECT category, category = 'es' AS is_archive, 'known' AS asked FROM l WHERE category IN ('en', 'es') UNION ALL SELECT category, category = 'es', 'unknown' FROM l",
    "url_segments": f"WITH {_U} SELECT page_id, CASE parts[1] WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS segment FROM k",
}
