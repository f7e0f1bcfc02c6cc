"""Registered queries of the extractors: Turkish text and markup rendered from typed columns and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions.text import ascii_fold
from ..operators import discovery as D
from ..operators import forms as M
from ..operators import pages as P
from ..session import ship_package, spread, staged, table
from .roles import tr_date, tr_day_month, tr_number


def _double(c):
    return c.cast("double")


def _orders(s, d):
    o = table(s, d, "orders")
    start = F.to_date("o_orderdate")
    return o.withColumn("start", start).withColumn("end", F.date_add(start, 20))


def _window_texts(s, d):
    """One of five written forms, by the order's priority."""
    o, p = _orders(s, d), F.col("o_orderpriority")
    numeric = lambda c: F.date_format(c, "d.M.yyyy")
    text = (
        F.when(p == "1-URGENT", F.concat(tr_date(F.col("start")), F.lit(" – "), tr_date(F.col("end")), F.lit(" tarihleri arasında")))
        .when(p == "2-HIGH", F.concat(F.lit("Geçerlilik: "), numeric("start"), F.lit(" - "), numeric("end")))
        .when(p == "3-MEDIUM", F.concat(F.lit("Kampanya "), tr_day_month(F.col("start")), F.lit(" - "), tr_date(F.col("end"))))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Duyuru "), tr_date(F.col("start"))))
        .otherwise(F.concat(F.lit("Son gün: "), F.upper(F.translate(tr_date(F.col("end")), "iı", "İI"))))
    )
    return o.withColumn("low", E.prepare(text, composed=True))


def validity_windows(s, d):
    w = E.validity_window(F.col("low"))
    return _window_texts(s, d).select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"), F.col("w.precision").alias("date_precision"))


def first_dates(s, d):
    """An impossible date before the real one is passed over."""
    text = F.concat(F.lit("32.13.2020 değil, "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" günü"))
    return table(s, d, "orders").select("o_orderkey", E.first_date(E.prepare(text, composed=True)).alias("found"))


def window_sources(s, d):
    """Period section, then conditions, then body: the first known window wins."""
    o = _window_texts(s, d)
    none = E.validity_window(F.lit("tarih yok"))
    w = E.first_known_window(none, E.validity_window(F.col("low")), E.validity_window(E.prepare(F.concat(F.lit("bitiş tarihi: "), F.date_format("end", "dd.MM.yyyy")), composed=True)))
    return o.select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.end").alias("end_date"), F.col("w.precision").alias("date_precision"))


def money_roundtrip(s, d):
    text = F.concat(F.lit("Toplam "), tr_number(F.col("l_extendedprice")), F.when(F.col("l_returnflag") == "A", " TL").when(F.col("l_returnflag") == "N", " USD").otherwise(" €"))
    m = E.money(E.prepare(text, composed=True))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_partkey", "l_linenumber", _double(F.col("m.amount")).alias("amount"), F.col("m.currency").alias("currency"))


def money_ranges(s, d):
    price, more = tr_number(F.col("o_totalprice")), tr_number(F.col("o_totalprice") + 1000)
    st, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.concat(price, F.lit(" TL - "), more, F.lit(" TL")))
        .when(p == "2-HIGH", F.concat(price, F.lit(" TL ve üzeri alışverişlerde")))
        .when(p == "3-MEDIUM", F.concat(price, F.lit(" TL'ye varan ödül")))
        .when(p == "4-NOT SPECIFIED", F.lit("Masrafsız"))
        .otherwise(F.concat(F.lit("tutarı "), price, F.lit(" TL")))
    )
    r = E.money_range(E.prepare(text, composed=True))
    return table(s, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", _double(F.col("r.low")).alias("low"), _double(F.col("r.high")).alias("high"))


def decimal_forms(s, d):
    """Turkish, English and plain spellings of the same number."""
    v = F.col("p_retailprice")
    forms = {"turkish": tr_number(v), "english": F.format_number(v, 2), "plain": F.bround(v, 0).cast("int").cast("string")}
    return table(s, d, "part").select("p_partkey", *[_double(E.decimal_tr(c)).alias(k) for k, c in forms.items()])


def rate_ranges(s, d):
    a, b = tr_number(F.col("l_discount") * 100), tr_number(F.col("l_tax") * 100)
    f = F.col("l_returnflag")
    text = F.when(f == "A", F.concat(F.lit("%"), a, F.lit(" - %"), b)).when(f == "N", F.concat(F.lit("yüzde "), a, F.lit(" oranına varan"))).otherwise(F.concat(a, F.lit("% kâr payından başlayan")))
    r = E.rate_range(E.prepare(text, composed=True))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_partkey", "l_linenumber", _double(F.col("r.low")).alias("low"), _double(F.col("r.high")).alias("high"))


def term_months(s, d):
    n, t = F.col("p_size"), F.col("p_type")
    text = (
        F.when(t == "ECONOMY", F.concat(n, F.lit(" ay vade")))
        .when(t == "STANDARD", F.concat(n, F.lit(" yıla kadar")))
        .when(t == "SMALL", F.concat(n, F.lit(" günden başlayan")))
        .when(t == "LARGE", F.concat(n, F.lit(" - "), n + 12, F.lit(" ay")))
        .otherwise(F.lit("süresiz"))
    )
    m = E.term_months(E.prepare(text, composed=True))
    return table(s, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m.low").alias("low"), F.col("m.high").alias("high"))


def instalment_counts(s, d):
    text = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("Taksit sayısı: "), "p_size")).otherwise(F.concat(F.col("p_size"), F.lit(" aya varan taksit")))
    return table(s, d, "part").select("p_partkey", E.instalments(E.prepare(text, composed=True)).alias("n"))


def reward_tiers(s, d):
    a, b = tr_number(F.col("o_totalprice"), 0), tr_number(F.col("o_totalprice") * 2, 0)
    text = F.concat(a, F.lit(" TL ve üzeri alışverişe 50 TL, "), b, F.lit(" TL ve üzerine 120 TL ödül"))
    rows = table(s, d, "orders").select("o_orderkey", F.posexplode(E.tiers(E.prepare(text, composed=True))).alias("tier", "t"))
    return rows.select("o_orderkey", "tier", _double(F.col("t.threshold")).alias("threshold"), _double(F.col("t.reward")).alias("reward"))


def limits_record(s, d):
    price, t = tr_number(F.col("p_retailprice") * 100, 0), F.col("p_type")
    text = (
        F.when(t == "ECONOMY", F.concat(F.lit("Azami "), price, F.lit(" TL, 12, 24 ve 36 ay vade")))
        .when(t == "STANDARD", F.concat(F.lit("En az "), price, F.lit(" TL")))
        .when(t == "SMALL", F.concat(F.lit("ekspertiz değerinin %"), "p_size", F.lit("'ine kadar")))
        .when(t == "LARGE", F.concat(F.lit("Finansman tutarı "), price, F.lit(" TL")))
        .otherwise(F.lit("koşullar için arayın"))
    )
    low = E.prepare(text, composed=True)
    r = table(s, d, "part").withColumn("low", low).select("p_partkey", E.limits(F.col("low"), F.col("low")).alias("r"))
    return r.select("p_partkey", _double(F.col("r.amount_min")).alias("amount_min"), _double(F.col("r.amount_max")).alias("amount_max"), F.array_join("r.allowed_terms", ",").alias("terms"), _double(F.col("r.ltv_max_pct")).alias("ltv"), F.col("r.source").alias("source"))


def vehicle_ages(s, d):
    text = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("0 - "), "p_size", F.lit(" yaş araç"))).when(F.col("p_type") == "SMALL", F.lit("Sıfır km araç")).when(F.col("p_type") == "LARGE", F.concat("p_size", F.lit(" yaşına kadar"))).otherwise(F.lit("İkinci el araç"))
    a = E.vehicle_age(ascii_fold(E.prepare(text, composed=True)))
    return table(s, d, "part").select("p_partkey", a.alias("a")).select("p_partkey", F.col("a.low").alias("low"), F.col("a.high").alias("high"))


def derived_rates(s, d):
    li = table(s, d, "lineitem")
    total = F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", _double(E.derived_monthly_rate(F.col("l_extendedprice"), F.round(total, 2), F.col("l_quantity"))).alias("monthly"))


def participation(s, d):
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("KATIL yazıp "), F.lpad("c_nationkey", 4, "6"), F.lit("'ya gönderin"))).when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("kod"), "c_nationkey", F.lit("x kodunu kullanın"))).otherwise(F.lit("mobil uygulamadan katılın"))
    p = E.participation(text)
    return table(s, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.col("p.method").alias("method"), F.col("p.sms_number").alias("sms_number"), F.col("p.coupon_code").alias("coupon_code"))


def evidence_rows(s, d):
    """Long-form evidence of dates and end markers: raw and normalised value, span, confidence."""
    date = F.regexp_extract("low", r"\d{1,2}[.]\d{1,2}[.]\d{4}", 0)
    sure, weak = F.lit("0.750"), F.lit("0.500")
    fields = {"date": (date, E.first_date(date), sure), "marker": (F.regexp_extract("low", "son gün", 0), F.lit(None), weak)}
    return E.evidence_rows(_window_texts(s, d), "o_orderkey", "low", fields).withColumn("confidence", _double(F.col("confidence")))


# ---- markup ----


FORM_TAGS = ("select", "input", "textarea", "option", "label")


def _nodes(pages, tags=()):
    """The pages' nodes, parsed once and written, for queries that read them several times."""
    return staged(P.page_nodes(pages, tags=tags), "nodes")


def _supplier_pages(s, d):
    """A page per supplier with a rate table of two terms, a table without rates, and a caption by nation."""
    sup = spread(table(s, d, "supplier"), "s_suppkey")
    rate = tr_number(F.col("s_nationkey") / 10 + 1)
    caption = F.when(F.col("s_nationkey") < 8, "Sıfır konut için geçerli oranlar").when(F.col("s_nationkey") < 16, "Sigortasız müşteriler için oranlar").otherwise("Bütün müşteriler için oranlar")
    row = lambda term, r: F.concat(F.lit(f"<tr><td>{term}</td><td>%"), r, F.lit("</td><td>0,50%</td></tr>"))
    html = F.concat(
        F.lit("<html><body><nav>Menü</nav><main><h1>Oranlar "), "s_name", F.lit("</h1><p>"), caption,
        F.lit("</p><table><tr><th>Vade</th><th>Kâr Payı Oranı</th><th>Tahsis Ücreti</th></tr>"), row("12", rate), row("3 yıl", rate), F.lit("<tr><td></td><td>yok</td><td></td></tr></table>"),
        F.lit("<table><tr><th>Şube</th><th>Telefon</th></tr><tr><td>Merkez</td><td>1</td></tr></table>"),
        F.lit("<h2>Kampanya Koşulları</h2><p>Kampanya "), F.col("s_suppkey").cast("string"), F.lit(" numaralı üyeler içindir.</p><h2>Diğer</h2><p>İlgisiz</p></main></body></html>"),
    )
    return sup.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))


def rate_table_rows(s, d):
    ship_package(s)
    r = P.rate_tables(_nodes(_supplier_pages(s, d)), composed=True)
    return r.select("page_id", "row_no", "term_months", _double(F.col("profit_rate_pct")).alias("profit_rate"), _double(F.col("allocation_fee_pct")).alias("fee"), "variant_key", "evidence_text")


def condition_sections(s, d):
    ship_package(s)
    return P.section_texts(_nodes(_supplier_pages(s, d)), ("kampanya koşul", "koşullar"), composed=True)


def table_cells(s, d):
    ship_package(s)
    return P.table_cells(_nodes(_supplier_pages(s, d))).groupBy("page_id", "table_no").agg(F.count("*").alias("cells"), F.max("row_no").alias("rows"))


def _part_pages(s, d):
    """A calculator page per part: variant select, term select, amount range, radios."""
    part = spread(table(s, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    html = F.concat(
        F.lit('<html><body><form><label for="tur">Finansman türü</label><select name="urun" id="tur"><option value="">Seçin</option><option value="1">Sıfır Konut</option><option value="2">2. El Araç</option><option value="3">'), "p_name",
        F.lit('</option></select><label>Vade <select name="vade"><option>12 Ay</option><option>36 Ay</option><option>'), F.col("p_size").cast("string"),
        F.lit(' Ay</option></select></label><input type="range" name="tutar" min="1.000" max="'), F.col("p_partkey").cast("string"), F.lit('"><input type="hidden" name="x"><input type="radio" name="sigorta" value="e"><input type="radio" name="sigorta" value="h"></form><p>Hesaplama. Sonuçlar bilgi amaçlıdır. Son.</p></body></html>'),
    )
    return part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def form_options(s, d):
    ship_package(s)
    return M.form_options(P.page_nodes(_part_pages(s, d), tags=FORM_TAGS)).select("page_id", "name", "value", "label")


def form_controls(s, d):
    ship_package(s)
    n = _nodes(_part_pages(s, d), FORM_TAGS)
    return M.control_labels(n, M.form_controls(n)).select("page_id", "name", "kind", "label", "pre")


def form_variants(s, d):
    ship_package(s)
    return M.variant_candidates(M.form_options(P.page_nodes(_part_pages(s, d), tags=FORM_TAGS)), composed=True).select("page_id", "label", "variant_key", "dimension")


def form_sampling(s, d):
    ship_package(s)
    c = M.form_summary(P.page_nodes(_part_pages(s, d), tags=FORM_TAGS))
    return c.select("page_id", F.col("combinations").cast("long").alias("combinations"), M.sampling_decision(F.col("combinations"), F.lit("api")).alias("decision"), F.array_join("allowed_terms", ",").alias("terms"), _double(F.col("amount_min")).alias("amount_min"), _double(F.col("amount_max")).alias("amount_max"))


def legal_notices(s, d):
    return _part_pages(s, d).select("page_id", M.legal_notice(F.regexp_replace("html", "<[^>]+>", " "), composed=True).alias("notice"))


def calculator_mechanisms(s, d):
    """Events as a request log per user: clicks after input, views at load."""
    ev = table(s, d, "events")
    log = ev.select(F.col("user_id").alias("page_id"), F.when(F.col("event_type") == "click", "input").otherwise("load").alias("phase"), ((F.col("value") > 50) & F.col("event_type").isin("click", "view")).alias("is_data"))
    controls = ev.groupBy(F.col("user_id").alias("page_id")).agg((F.count_if(F.col("event_type") == "error") < 2).alias("tried"), F.max(F.when(F.col("event_type") == "signup", "f")).alias("name"))
    return M.mechanisms(log, controls)


def card_labels(s, d):
    """A listing per customer of two cards, each with its category beside the link, and a link outside, for which all
    of the main part is a card."""
    ship_package(s)
    c = spread(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    key = F.col("c_custkey").cast("string")
    card = lambda label, at: F.concat(F.lit('<div class="card"><span class="x etiket">'), label, F.lit(f'</span><div><p><a href="/{at}/'), key, F.lit('">git</a></p></div></div>'))
    html = F.concat(F.lit("<html><body><main>"), card(F.col("c_mktsegment"), "a"), card(F.concat(F.lit("Ulus "), F.col("c_nationkey").cast("string")), "b"), F.lit('<a href="/">dışarıda</a></main></body></html>'))
    labels = P.card_labels(P.page_nodes(c.select(F.col("c_custkey").alias("page_id"), html.alias("html"))), "etiket")
    return labels.select("page_id", "pre", "label")


def campaign_page_rows(s, d):
    """Campaign rows of a page per supplier: sections, tables as conditions, segment and archive flag by hint or URL. Pages
    of suppliers of nation 3 are documents of another kind, those of nation 4 have no
    heading, so no title."""
    ship_package(s)
    sup = spread(table(s, d, "supplier"), "s_suppkey")
    n, key = F.col("s_nationkey"), F.col("s_suppkey").cast("string")
    title = F.concat(F.lit("<h1>Teklif "), key, F.lit("</h1>"))
    html = F.concat(
        F.lit("<html><body><main>"), title, F.lit("<p>Teklif metni "), key, F.lit(" burada.</p><h2>Kampanya Koşulları</h2><p>Koşul "), key, F.lit("</p><h2>Kapsam Dışı</h2><p>Hariç "), key,
        F.lit("</p><h2>Tablo</h2><table><tr><td>A</td><td>"), key, F.lit("</td></tr><tr><td>B</td><td>2</td></tr></table></main></body></html>"),
    )
    url = F.concat(F.lit("https://bank.example/"), F.when(n % 2 == 0, "bireysel").otherwise("ticari"), F.lit("/teklif-"), key, F.when(n == 5, "?isArchived=true").otherwise(""))
    pages = sup.select(F.col("s_suppkey").alias("page_id"), url.alias("url"), F.when(n == 4, "<html><body><main><p>Başlıksız sayfa.</p></main></body></html>").otherwise(html).alias("html"), F.when(n == 6, "tarim").alias("segment_hint"), F.when(n == 7, True).alias("archive_hint"), F.when(n == 3, "product").otherwise("campaign").alias("doc_type"))
    nodes = _nodes(pages.select("page_id", "html"))
    conditions = P.with_tables(P.section_texts(nodes, ("koşul",), composed=True), P.table_texts(nodes))
    empty = s.createDataFrame([], "page_id long, section string")
    rows = P.campaign_rows(
        pages, P.page_titles(nodes), P.clean_text(P.main_content(P.without_noise(nodes))), conditions, empty, P.section_texts(nodes, ("kapsam dışı",), composed=True), D.path_label(F.col("url"), 1, {"bireysel": "personal", "ticari": "business"})
    )
    return rows.select("page_id", "external_slug", "title", "conditions_text", "exclusions", "segment", "is_archived")


def _noisy_pages(s, d):
    """A page per customer around two known paragraphs: noise of every kind, a boilerplate line, and a main element that
    is long enough (segment BUILDING), marked by class (FURNITURE), too short (MACHINERY) or missing."""
    c = spread(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    key, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    text = F.concat(F.lit("<h1>Başlık "), key, F.lit("</h1><p>Birinci <b>paragraf</b> metni "), key, F.lit(" burada yer alır.</p><p>İkinci paragraf\n  burada biter.</p><table><tr><td>Vade</td><td>"), key, F.lit("</td></tr></table><p>Tüm hakları saklıdır.</p>"))
    main = F.when(seg == "BUILDING", F.concat(F.lit("<main>"), text, F.lit("</main><div>Dışarıda</div>"))).when(seg == "FURNITURE", F.concat(F.lit('<div class="x campaign-detail">'), text, F.lit("</div><p>Dışarıda</p>"))).when(seg == "MACHINERY", F.concat(F.lit("<main>Kısa</main>"), text)).otherwise(text)
    html = F.concat(
        F.lit('<html><head><title>Site</title><style>p{}</style></head><body><nav>Ana sayfa</nav><header>Logo</header><div class="cookie-bar">Kabul et</div><script>var a = "<p>x</p>";</script><form><select><option>Seç</option></select>'),
        main, F.lit('</form><aside>Yan</aside><div id="site-footer">Alt</div><footer>Son</footer></body></html>'),
    )
    return c.select(F.col("c_custkey").alias("page_id"), html.alias("html"))


def cleaned_texts(s, d):
    """Clean text of the rendered pages: noise out, main content chosen, lines and cells set."""
    ship_package(s)
    return P.clean_text(P.main_content(P.without_noise(P.page_nodes(_noisy_pages(s, d)))))


FUNCTIONS = [validity_windows, first_dates, window_sources, money_roundtrip, money_ranges, decimal_forms, rate_ranges, term_months, instalment_counts, reward_tiers, limits_record, vehicle_ages, derived_rates, participation, evidence_rows, rate_table_rows, condition_sections, table_cells, form_options, form_controls, form_variants, form_sampling, legal_notices, calculator_mechanisms, card_labels, campaign_page_rows, cleaned_texts]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_S, _E = "CAST(o_orderdate AS DATE)", "CAST(o_orderdate AS DATE) + 20"
_P = "o_orderpriority"
ORACLE = {
    "evidence_rows": f"SELECT o_orderkey, 'date' AS field, r AS value_raw, CAST(s AS VARCHAR) AS value_normalized, 13 AS span_start, 13 + CAST(length(r) AS INTEGER) AS span_end, 0.75 AS confidence, 'rule' AS method FROM (SELECT o_orderkey, {_S} AS s, strftime({_S}, '%-d.%-m.%Y') AS r FROM orders WHERE {_P} = '2-HIGH') UNION ALL SELECT o_orderkey, 'marker', 'son gün', NULL, 1, 8, 0.5, 'rule' FROM orders WHERE {_P} = '5-LOW'",
    "form_controls": "SELECT p_partkey AS page_id, c.n AS name, c.k AS kind, c.l AS label, c.p AS pre FROM (SELECT p_partkey, unnest([{'n': 'urun', 'k': 'select', 'l': 'Finansman türü', 'p': 5}, {'n': 'vade', 'k': 'select', 'l': 'Vade 12 Ay 36 Ay ' || p_size || ' Ay', 'p': 16}, {'n': 'tutar', 'k': 'range', 'l': NULL, 'p': 23}, {'n': 'sigorta', 'k': 'radio', 'l': NULL, 'p': 25}, {'n': 'sigorta', 'k': 'radio', 'l': NULL, 'p': 26}]) AS c FROM part)",
    "cleaned_texts": "SELECT c_custkey AS page_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Kısa' || chr(10) ELSE '' END || 'Başlık ' || c_custkey || chr(10) || 'Birinci paragraf metni ' || c_custkey || ' burada yer alır.' || chr(10) || 'İkinci paragraf burada biter.' || chr(10) || 'Vade | ' || c_custkey AS clean_text FROM customer",
    "campaign_page_rows": "SELECT s_suppkey AS page_id, 'teklif-' || s_suppkey AS external_slug, 'Teklif ' || s_suppkey AS title, 'Koşul ' || s_suppkey || chr(10) || chr(10) || 'A | ' || s_suppkey || chr(10) || 'B | 2' AS conditions_text, 'Hariç ' || s_suppkey AS exclusions, CASE WHEN s_nationkey = 6 THEN 'tarim' WHEN s_nationkey % 2 = 0 THEN 'personal' ELSE 'business' END AS segment, s_nationkey IN (5, 7) AS is_archived FROM supplier WHERE s_nationkey NOT IN (3, 4)",
    "validity_windows": f"SELECT o_orderkey, CASE WHEN {_P} IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN {_S} END AS start_date, CASE WHEN {_P} <> '4-NOT SPECIFIED' THEN {_E} END AS end_date, CASE {_P} WHEN '3-MEDIUM' THEN 'inferred' WHEN '4-NOT SPECIFIED' THEN 'unknown' WHEN '5-LOW' THEN 'partial' ELSE 'exact' END AS date_precision FROM orders",
    "first_dates": f"SELECT o_orderkey, {_S} AS found FROM orders",
    "window_sources": f"SELECT o_orderkey, {_E} AS end_date, CASE {_P} WHEN '3-MEDIUM' THEN 'inferred' WHEN '4-NOT SPECIFIED' THEN 'partial' WHEN '5-LOW' THEN 'partial' ELSE 'exact' END AS date_precision FROM orders",
    "money_roundtrip": "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS amount, CASE l_returnflag WHEN 'A' THEN 'TRY' WHEN 'N' THEN 'USD' ELSE 'EUR' END AS currency FROM lineitem",
    "money_ranges": f"SELECT o_orderkey, CASE {_P} WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN 0 ELSE o_totalprice END AS low, CASE {_P} WHEN '1-URGENT' THEN round(o_totalprice + 1000, 2) WHEN '2-HIGH' THEN NULL WHEN '4-NOT SPECIFIED' THEN 0 ELSE o_totalprice END AS high FROM orders",
    "decimal_forms": "SELECT p_partkey, p_retailprice AS turkish, p_retailprice AS english, round_even(p_retailprice, 0) AS plain FROM part",
    "rate_ranges": "SELECT l_orderkey, l_partkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN least(a, b) WHEN 'N' THEN NULL ELSE a END AS low, CASE l_returnflag WHEN 'A' THEN greatest(a, b) WHEN 'N' THEN a END AS high FROM (SELECT *, round(l_discount * 100, 2) AS a, round(l_tax * 100, 2) AS b FROM lineitem)",
    "term_months": "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size WHEN 'SMALL' THEN greatest(1, CAST(round_even(p_size / 30.0, 0) AS INTEGER)) WHEN 'LARGE' THEN p_size END AS low, CASE p_type WHEN 'ECONOMY' THEN p_size WHEN 'STANDARD' THEN p_size * 12 WHEN 'LARGE' THEN p_size + 12 END AS high FROM part",
    "instalment_counts": "SELECT p_partkey, p_size AS n FROM part",
    "reward_tiers": "SELECT o_orderkey, t AS tier, round_even(o_totalprice * (t + 1), 0) AS threshold, CASE t WHEN 0 THEN 50.0 ELSE 120.0 END AS reward FROM orders, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS t)",
    "limits_record": "SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN v END AS amount_min, CASE p_type WHEN 'ECONOMY' THEN v WHEN 'SMALL' THEN p_size END AS amount_max, CASE WHEN p_type = 'ECONOMY' THEN '12,24,36' END AS terms, CASE WHEN p_type = 'SMALL' THEN CAST(p_size AS DOUBLE) END AS ltv, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL') THEN 'text' ELSE 'none' END AS source FROM (SELECT *, round_even(p_retailprice * 100, 0) AS v FROM part)",
    "vehicle_ages": "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 0 WHEN p_type <> 'LARGE' THEN 1 END AS low, CASE WHEN p_type = 'SMALL' THEN 0 WHEN p_type IN ('ECONOMY', 'LARGE') THEN p_size END AS high FROM part",
    "derived_rates": "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN t > p THEN CAST(n // b + CASE WHEN 2 * (n % b) > b OR (2 * (n % b) = b AND (n // b) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10000 END AS monthly FROM (SELECT *, (t - p) * 1000000 AS n, p * CAST(l_quantity AS HUGEINT) AS b FROM (SELECT *, CAST(round(l_extendedprice * 100) AS HUGEINT) AS p, CAST(round(round(l_extendedprice * (1 + l_tax), 2) * 100) AS HUGEINT) AS t FROM lineitem))",
    "participation": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'sms' WHEN 'FURNITURE' THEN 'kod' END AS method, CASE WHEN c_mktsegment = 'BUILDING' THEN lpad(CAST(c_nationkey AS VARCHAR), 4, '6') END AS sms_number, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'kod' || c_nationkey || 'x' END AS coupon_code FROM customer",
    "rate_table_rows": "SELECT s_suppkey AS page_id, r AS row_no, CASE r WHEN 2 THEN 12 ELSE 36 END AS term_months, round(s_nationkey / 10.0 + 1, 2) AS profit_rate, 0.5 AS fee, CASE WHEN s_nationkey < 8 THEN 'sifir_konut' WHEN s_nationkey < 16 THEN 'sigortasiz' END AS variant_key, CASE r WHEN 2 THEN '12' ELSE '3 yıl' END || ' | %' || replace(printf('%.2f', s_nationkey / 10.0 + 1), '.', ',') || ' | 0,50%' AS evidence_text FROM supplier, (SELECT CAST(unnest([2, 3]) AS INTEGER) AS r)",
    "condition_sections": "SELECT s_suppkey AS page_id, 'Kampanya ' || s_suppkey || ' numaralı üyeler içindir.' AS section FROM supplier",
    "table_cells": "SELECT s_suppkey AS page_id, t AS table_no, CASE t WHEN 1 THEN 12 ELSE 4 END AS cells, CASE t WHEN 1 THEN 4 ELSE 2 END AS rows FROM supplier, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS t)",
    "form_options": "SELECT p_partkey AS page_id, o.name AS name, o.value AS value, o.label AS label FROM (SELECT p_partkey, unnest([{'name': 'urun', 'value': '1', 'label': 'Sıfır Konut'}, {'name': 'urun', 'value': '2', 'label': '2. El Araç'}, {'name': 'urun', 'value': '3', 'label': p_name}, {'name': 'vade', 'value': '12 Ay', 'label': '12 Ay'}, {'name': 'vade', 'value': '36 Ay', 'label': '36 Ay'}, {'name': 'vade', 'value': p_size || ' Ay', 'label': p_size || ' Ay'}]) AS o FROM part)",
    "form_sampling": "SELECT p_partkey AS page_id, CAST(3 * 3 * 4 * 2 AS BIGINT) AS combinations, 'grid' AS decision, array_to_string(list_sort(list_distinct([12, 36, p_size])), ',') AS terms, 1000.0 AS amount_min, CAST(p_partkey AS DOUBLE) AS amount_max FROM part",
    "form_variants": "SELECT p_partkey AS page_id, o.l AS label, o.k AS variant_key, o.d AS dimension FROM (SELECT p_partkey, unnest([{'l': 'Sıfır Konut', 'k': 'sifir_konut', 'd': 'konut_durumu'}, {'l': '2. El Araç', 'k': 'ikinci_el_arac', 'd': 'arac_durumu'}, {'l': p_name, 'k': NULL, 'd': NULL}]) AS o FROM part)",
    "legal_notices": "SELECT p_partkey AS page_id, 'Sonuçlar bilgi amaçlıdır.' AS notice FROM part",
    "calculator_mechanisms": "WITH c AS (SELECT user_id AS page_id, count(*) FILTER (event_type = 'error') < 2 AS tried, count(*) FILTER (event_type = 'signup') AS n, count(*) FILTER (event_type = 'click' AND value > 50) AS i, count(*) FILTER (event_type = 'view' AND value > 50) AS l FROM events GROUP BY 1) SELECT page_id, CASE WHEN NOT tried THEN 'unknown' WHEN i > 0 THEN 'api' WHEN l > 0 THEN 'js_with_rate_fetch' WHEN n > 0 THEN 'js_client_side' ELSE 'none' END AS mechanism FROM c",
    "card_labels": "SELECT c_custkey AS page_id, CAST(unnest([8, 15, 17]) AS INTEGER) AS pre, unnest([c_mktsegment, 'Ulus ' || c_nationkey, c_mktsegment]) AS label FROM customer",
}
