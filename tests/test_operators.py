"""Behaviour that the registered queries do not reach: broken input, streaming, sinks, taxonomy and page rules."""

import datetime
import gzip
import os

import pytest
from pyspark.sql import functions as F

from kervan.functions import text as T
from kervan.functions import urls as U
from kervan.operators import discovery as D
from kervan.operators import forms as M
from kervan.operators import pages as P
from kervan.operators import query as Q
from kervan.operators import taxonomy as X
from kervan.operators import upsert as S
from kervan.sources import archives as A
from kervan.streaming import incremental


def nodes(spark, html):
    return P.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))


def urls(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq int, url string")


def test_canonical_key(spark):
    cases = {
        "HTTP://www.Bank.com.tr/Kampanya/?utm_source=x&b=2&a=1#top": "https://bank.com.tr/Kampanya?a=1&b=2",
        "https://bank.com.tr/Kampanya?a=1&b=2": "https://bank.com.tr/Kampanya?a=1&b=2",
        "https://x/y?IsArchived=true": "https://x/y?IsArchived=true",
        "https://x/y?q=": "https://x/y?q=",
        "": "https://",
    }
    got = urls(spark, *cases).select("url", U.canonical_key(F.col("url")).alias("k")).collect()
    assert {r["url"]: r["k"] for r in got} == cases
    assert D.dedupe_urls(urls(spark, "http://a/x/", "https://www.a/x")).count() == 1


def test_resolve(spark):
    base = "https://a.b/c/d.html?x=1"
    cases = {"e": "https://a.b/c/e", "/f?y": "https://a.b/f?y", "../g": "https://a.b/g", "//h/i": "https://h/i", "https://z/": "https://z/", "#t": None, "mailto:x": None, "JavaScript:y": None, "": None, "./k/../l": "https://a.b/c/l"}
    got = urls(spark, *cases).select("url", U.resolve(F.col("url"), F.lit(base)).alias("k")).collect()
    assert {r["url"]: r["k"] for r in got} == cases


def test_noise_and_main(spark):
    html = "<html><body><nav>kısa menü</nav><div class='cookie-box'>çerez</div><main><h1>Başlık</h1><p>Uzun bir kampanya metni burada duruyor.</p><form>Başvuru <input value=x></form></main><footer>alt</footer><script>x()</script></body></html>"
    n = nodes(spark, html)
    clean = P.clean_text(P.main_content(P.without_noise(n))).first()["clean_text"]
    assert clean == "Başlık\nUzun bir kampanya metni burada duruyor.\nBaşvuru"
    big = "<body><nav>" + "uzun menü metni " * 20 + "</nav><p>kısa</p></body>"
    assert "menü" in P.clean_text(P.without_noise(nodes(spark, big))).first()["clean_text"]


def test_titles(spark):
    title = lambda html, **k: (P.page_titles(nodes(spark, html), **k).first() or {"title": None})["title"]
    assert title("<title>Site</title><h1>{{ad}}</h1><h2>Gerçek</h2>") == "Gerçek"
    assert title("<title>Site</title><h1>Kampanya Koşulları</h1>") == "Site"
    assert title("<h1>Banka</h1><h1>Kampanya</h1>", ignored=("banka",)) == "Kampanya"
    assert title("<meta property='og:title' content='Og'><title>T</title><h1>ab</h1>") == "Og"
    assert title("<p>x</p>") is None


def test_broken_html(spark):
    rows = nodes(spark, "<ul><li>a<li>b</ul><p>c<p>d</div><table><tr><td>1<td>2<tr><td>3</table>").collect()
    assert sum(r["tag"] == "li" for r in rows) == 2 and all(r["post"] >= r["pre"] for r in rows)
    cells = P.table_cells(nodes(spark, "<table><tr><td>1<td>2<tr><td>3</table>")).collect()
    assert sorted((r["row_no"], r["col_no"], r["text"]) for r in cells) == [(1, 1, "1"), (1, 2, "2"), (2, 1, "3")]
    assert P.page_nodes(spark.createDataFrame([(1, None)], "page_id long, html string")).count() == 0


def test_inline_section_climbs(spark):
    html = "<body><div><p><strong>Kampanya koşulları</strong></p><p>Birinci koşul.</p></div><h2>Başka</h2><p>ilgisiz</p></body>"
    assert P.section_texts(nodes(spark, html), ("kampanya koşul",)).first()["section"] == "Birinci koşul."


def test_soft_404(spark):
    rows = [("Aradığınız sayfa maalesef bulunamadı", "x", "x"), ("metin", "Hata 404", ""), ("metin", "Tamam", "Sayfa Bulunamadı"), ("metin 404 TL", "Tamam", "Tamam"), ("", "a", "a"), ("metin", None, None)]
    df = spark.createDataFrame(rows, "t string, v string, r string").select(P.soft_404(F.col("t"), F.col("v"), F.col("r")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, True, True, False, True, False]


def test_rate_table_and_caption(spark):
    html = "<body><p>Sigortalı müşterilere uygulanan oranlar</p><table><tr><th>Vade​</th><th>Kâr Payı Oranı</th></tr><tr><td>12</td><td>%2,05</td></tr><tr><td>-</td><td></td></tr></table></body>"
    r = P.rate_tables(nodes(spark, html)).collect()
    assert len(r) == 1 and r[0]["term_months"] == 12 and float(r[0]["profit_rate_pct"]) == 2.05 and r[0]["variant_key"] == "sigortali"


def test_sitemaps(spark, tmp_path):
    good = b"<?xml version='1.0'?><ns:urlset xmlns:ns='s'><ns:url><ns:loc>https://a/b?x=1&amp;y=2</ns:loc><ns:lastmod>2026-01-01</ns:lastmod></ns:url></ns:urlset>"
    index = b"<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>"
    for name, body in {"a.xml": good, "b.xml": gzip.compress(good), "c.xml": index, "d.xml": b"<urlset><url><loc>https://a/z</loc>", "e.xml": b"\x1f\x8bbroken"}.items():
        (tmp_path / name).write_bytes(body)
    got = sorted((r["path"][-5:], r["loc"], r["lastmod"], r["is_index"]) for r in A.read_sitemaps(spark, str(tmp_path)).collect())
    assert got == [("a.xml", "https://a/b?x=1&y=2", "2026-01-01", False), ("b.xml", "https://a/b?x=1&y=2", "2026-01-01", False), ("c.xml", "https://a/s.xml", None, True)]
    assert A.read_page_archive(spark, str(tmp_path), "c.xml").first()["html"] == index.decode()


def test_json_shape(spark):
    rows = [('{"data":[{"b":1,"a":2},{"a":3}]}',), ('{"x":1}',), ("[1,2]",), ("oops",)]
    got = [(r["fields"], r["n_records"]) for r in A.json_shape(spark.createDataFrame(rows, "j string"), "j").collect()]
    assert got == [("a,b", 2), ("x", 1), ("", 2), ("", 0)]


def campaign(spark, **k):
    row = {"campaign_id": 1, "title": None, "description": None, "conditions_text": None, "source_url": "", "bank_category": None} | k
    return spark.createDataFrame([tuple(row.values())], "campaign_id long, title string, description string, conditions_text string, source_url string, bank_category string")


@pytest.mark.parametrize(
    "given,want",
    [
        ({"title": "Migros'ta indirim"}, {("sector", "market_gida", "merchant", "0.900"), ("benefit", "indirim", "keyword", "0.700")}),
        ({"title": "BİM marketlerinde"}, {("sector", "market_gida", "merchant", "0.700")}),
        ({"title": "Kampanya"}, {("sector", "genel", "keyword", "0.300")}),
        ({"title": "x", "bank_category": "Market ve Gıda"}, {("sector", "market_gida", "bank_category", "1.000")}),
        ({"title": "x", "source_url": "https://b/kart-kampanyalari/y"}, {("product_type", "kart", "url", "1.000"), ("sector", "genel", "keyword", "0.300")}),
        ({"title": "x", "conditions_text": "Emekli müşterilere migros"}, {("audience", "emekli", "keyword", "0.700"), ("sector", "genel", "keyword", "0.300")}),
        ({"title": "Sabim"}, {("sector", "genel", "keyword", "0.300")}),
    ],
)
def test_labels(spark, given, want):
    got = X.categorise(campaign(spark, **given)).collect()
    assert {(r["axis"], r["value"], r["source"], str(r["confidence"])) for r in got} == want


def test_relabel_is_stable(spark):
    c = campaign(spark, title="Trendyol ve Migros alışverişine taksit", description="kredi kartı ile")
    rows = lambda: sorted(map(tuple, X.categorise(c.repartition(3)).collect()))
    assert rows() == rows()
    evidence = {r["value"]: r["evidence"] for r in X.categorise(c).collect()}
    assert "Trendyol" in evidence["eticaret_pazaryeri"]


def test_variant_keys(spark):
    labels = {"2. El Konut": "ikinci_el_konut", "Sigortasız": "sigortasiz", "Arsa": "arsa", "Standart": "standart", "Bilinmeyen": None}
    df = spark.createDataFrame([(k,) for k in labels], "l string").select("l", M.variant_key(F.col("l"))["key"].alias("k"))
    assert {r["l"]: r["k"] for r in df.collect()} == labels


def test_sampling(spark):
    df = spark.createDataFrame([(0, "api"), (60, "api"), (61, "api"), (2001, "api"), (5, "none"), (None, "api")], "n int, m string")
    got = [r["d"] for r in df.select(M.sampling_decision(F.col("n"), F.col("m")).alias("d")).collect()]
    assert got == ["skip", "full", "grid", "pilot_only", "skip", "skip"]


def test_list_order_and_bounds(spark):
    d = datetime.date
    c = spark.createDataFrame([(1, "b", None, d(2026, 1, 1)), (2, "a", d(2026, 1, 1), None), (3, "a", d(2026, 2, 1), None)], "campaign_id long, title string, start_date date, end_date date")
    ids = lambda df: [r["campaign_id"] for r in df.collect()]
    assert ids(Q.apply_sort(c, "start_date")) == [2, 3, 1]
    assert ids(Q.apply_sort(c, "start_date", True)) == [3, 2, 1]
    assert ids(Q.apply_sort(c, "nonsense")) == [2, 3, 1]
    assert ids(Q.page_of(Q.apply_sort(c), 2, 2)) == [1]
    with pytest.raises(LookupError):
        Q.campaign_detail(c.withColumn("bank_code", F.lit("x")), c, c, c, 99)


def test_upsert_twice_is_stable(spark):
    now = F.lit("2026-03-01").cast("timestamp")
    stored = spark.createDataFrame([], "bank_code string, external_slug string, title string, category string, first_seen_at timestamp, last_seen_at timestamp")
    batch = spark.createDataFrame([("b", "s", "old", "c", 1), ("b", "s", "new", "c", 2), ("b", "t", "x", None, 3)], "bank_code string, external_slug string, title string, category string, seq int")
    once = S.upsert(stored, batch, now)
    assert tuple(S.upsert_counts(once).first()) == (2, 1)
    assert {(r["external_slug"], r["title"]) for r in once.collect()} == {("s", "new"), ("t", "x")}
    twice = S.upsert(once.drop("action", "update_count"), batch, now)
    assert S.upsert_counts(twice).first()["campaigns_new"] == 0


def test_snapshots_append(spark, tmp_path):
    pages = spark.createDataFrame([("b", "https://a/x#1", "h1"), ("b", "https://a/x#2", "h1"), ("b", "https://a/x", "h2")], "bank_code string, url string, html string")
    for _ in range(2):
        S.append_snapshots(pages, f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 2


def test_labels_replace_partition(spark, tmp_path):
    path = f"{tmp_path}/labels"
    row = lambda b, v: spark.createDataFrame([(b, v)], "bank_code string, value string")
    X.write_labels(row("a", "1").unionByName(row("b", "2")), path)
    X.write_labels(row("a", "3"), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("bank_code", "value").collect()} == {("a", "3"), ("b", "2")}


def test_incremental(spark, tmp_path):
    schema = "bank_code string, external_slug string, title string, seq int"
    src, root = f"{tmp_path}/in", f"{tmp_path}/table"
    empty = spark.createDataFrame([], "bank_code string, external_slug string, title string, first_seen_at timestamp, last_seen_at timestamp")
    for day, rows in enumerate(([("b", "s", "1", 1)], [("b", "s", "2", 1), ("b", "t", "3", 2)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.run_incremental(stream, root, f"{tmp_path}/checkpoint", lambda b: b, empty, ["bank_code", "external_slug"]).awaitTermination()
    now = incremental.current_version(spark, root, empty)
    assert {(r["external_slug"], r["title"]) for r in now.collect()} == {("s", "2"), ("t", "3")}


def test_incremental_retry(spark, tmp_path):
    """A retried batch starts from the version before its own, whatever a failed attempt left."""
    root, keys = f"{tmp_path}/table", ["bank_code", "external_slug"]
    empty = spark.createDataFrame([], "bank_code string, external_slug string, title string, first_seen_at timestamp, last_seen_at timestamp")
    batch = lambda *rows: spark.createDataFrame(rows, "bank_code string, external_slug string, title string, seq int")
    merge = lambda b, n: incremental.merge_batch(b, n, root, lambda x: x, empty, keys)
    merge(batch(("b", "s", "1", 1)), 0)
    # An attempt at batch 1 that ended before its marker: its rows are no version.
    batch(("x", "x", "x", 1)).drop("seq").write.parquet(f"{root}/rows/version={1:012d}")
    assert [r["title"] for r in incremental.current_version(spark, root, empty).collect()] == ["1"]
    merge(batch(("b", "t", "2", 1)), 1)
    first = {r["external_slug"]: tuple(r) for r in incremental.current_version(spark, root, empty).collect()}
    assert set(first) == {"s", "t"}
    merge(batch(("b", "t", "2", 1)), 1)
    assert {r["external_slug"]: tuple(r) for r in incremental.current_version(spark, root, empty).collect()} == first


def test_lookups(spark):
    from kervan.operators import query as Q

    banks = spark.createDataFrame([("b", "Zeta"), ("a", "Alpha")], "bank_code string, bank_name string")
    campaigns = spark.createDataFrame([(1, "b"), (2, "b")], "campaign_id int, bank_code string")
    assert [tuple(r) for r in Q.banks_with_counts(banks, campaigns).collect()] == [("a", "Alpha", 0), ("b", "Zeta", 2)]
    assert [tuple(r) for r in Q.by_bank(banks, campaigns).collect()] == [("b", "Zeta", 2), ("a", "Alpha", 0)]
    assert Q.banks_with_data(banks, campaigns).first()[0] == 1
    assert [tuple(r) for r in Q.bank_by_code(banks, campaigns, "a").collect()] == [("a", "Alpha", 0)]
    with pytest.raises(LookupError):
        Q.bank_by_code(banks, campaigns, "c")


def test_first_paragraph(spark):
    df = spark.createDataFrame([("Başlık\nkısa\n\n" + "a" * 50 + "\n" + "b" * 40, "Başlık"), ("kısa", "x")], "t string, h string")
    got = [r["p"] for r in df.select(T.first_paragraph(F.col("t"), F.col("h")).alias("p")).collect()]
    assert got == ["a" * 50 + " " + "b" * 40, None]


def test_shared_folder_without_setting(monkeypatch):
    """A local session without the setting gets one folder, kept for the application; a cluster's is refused."""
    from types import SimpleNamespace as N

    from kervan.session import shared_folder

    session = lambda master: N(conf=N(get=lambda key, default=None: default), sparkContext=N(master=master, applicationId="app"))
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))


def test_table_roundtrip(spark):
    """Tables are written by name, partitioned, and read back."""
    from kervan.sources.archives import save_table

    rows = [(1, "a"), (2, "b"), (3, None)]
    save_table(spark.createDataFrame(rows, "id int, bank_code string"), "kept_campaigns", partition=["bank_code"])
    assert sorted(tuple(r) for r in spark.table("kept_campaigns").select("id", "bank_code").collect()) == rows
    spark.sql("DROP TABLE kept_campaigns")


def test_today_in_istanbul(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from kervan.operators.query import today

    before = datetime.now(ZoneInfo("Europe/Istanbul")).date()
    found = spark.range(1).select(today().alias("d")).first()["d"]
    assert before <= found <= datetime.now(ZoneInfo("Europe/Istanbul")).date()


def test_entry_without_training_operators(monkeypatch, tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['kervan.llm']=None; sys.modules['corpus_pipeline']=None; sys.path.insert(0,sys.argv[1]); import __spark_entry__ as e; q=e.queries(); assert not any(k.startswith('op') for k in q) and 'site_overview' in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
