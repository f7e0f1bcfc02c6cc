"""Whole jobs: linear page windows, repaired trees, sitemap trees, per-site rules, evidence, relabelling, versions, keyed tables."""

import glob
import gzip
import os
import random
import re
import time

from pyspark.sql import functions as F

from kervan.functions import evidence as V
from kervan.functions import extract as E
from kervan.operators import pages as P
from kervan.operators import products as R
from kervan.operators import taxonomy as X
from kervan.operators.upsert import upsert
from kervan.session import staged
from kervan.sources import archives as A
from kervan.sources import storage
from kervan.streaming import incremental


def nodes_of(spark, *htmls):
    return P.page_nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))


def tree(html):
    parser = P._Tree()
    parser.feed(html)
    return [(r[4], r[5], r[9]) for r in parser.finish()]


def random_page(rng):
    """Nested tags, some of them noise, headings, tables and texts."""

    def inner(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            k = rng.random()
            if k < 0.35 or depth > 5:
                out.append(rng.choice(["kısa", "Yirmi karakterden uzun bir metin", "12,5 %", "koşul metni burada", "1.234.567.890.123.456.789"]))
            elif k < 0.5:
                out.append(f"<h{rng.randint(1, 4)}>{rng.choice(['Kampanya Koşulları', 'Başlık', 'Koşullar'])}</h2>".replace("</h2>", "") + "</h1></h2></h3></h4>")
            elif k < 0.6:
                out.append(f"<{rng.choice(['b', 'span', 'strong'])}>Koşullar</b></span></strong>")
            elif k < 0.75:
                own = f"<caption>{rng.choice(['', 'Kendi başlığı', inner(6)])}</caption>" if rng.random() < 0.4 else ""
                out.append(f"<table>{own}<tr><td>{inner(depth + 1)}</td></tr></table>")
            else:
                tag = rng.choice(["div", "section", "nav", "aside", "script", "p", 'div class="cookie-bar"', "li"])
                out.append(f"<{tag}>{inner(depth + 1)}</{tag.split()[0]}>")
        return "".join(out)

    return f"<html><body>{inner(0)}</body></html>"


def pages_rows(nodes):
    by_page = {}
    for r in nodes.orderBy("page_id", "pre").collect():
        by_page.setdefault(r["page_id"], []).append(r)
    return by_page


def noise_brute(rows):
    from kervan.functions import vocabulary as W

    body = max((r["subtree_len"] for r in rows if r["tag"] == "body"), default=None)
    noise = []
    for r in rows:
        names = " ".join(x for x in (r["cls"], r["id"]) if x is not None)
        if r["tag"] in W.ALWAYS_NOISE or (r["tag"] in W.STRUCTURE_NOISE and r["subtree_len"] <= body * W.STRUCTURE_MAX_RATIO) or (r["tag"] not in ("html", "body") and re.search(W.NOISE_ATTR, names, re.I)):
            noise.append((r["pre"], r["post"]))
    return [r["pre"] for r in rows if not any(a <= r["pre"] <= b for a, b in noise)]


def section_brute(rows, keyword):
    """pre of the anchor to (low, high] of its texts, from the definition."""
    found = {}
    for r in rows:
        heading = re.fullmatch("h[1-6]", r["tag"])
        if not heading and r["tag"] not in ("strong", "b", "dt", "span", "em") or keyword not in (r["text"] or "").replace("İ", "i").replace("I", "ı").lower():
            continue
        stop = min((x["pre"] for x in rows if re.fullmatch("h[1-6]", x["tag"]) and x["pre"] > r["post"]), default=10**9)
        for end in r["ends"][: 1 if heading else 4]:
            texts = [x["pre"] for x in rows if x["tag"] == "#text" and r["post"] < x["pre"] <= end and x["pre"] < stop]
            if texts:
                found[r["pre"]] = texts
                break
    return found


def captions_brute(rows):
    out = []
    for n, t in enumerate((r for r in rows if r["tag"] == "table"), 1):
        own = [r["text"] for r in rows if r["tag"] == "caption" and t["pre"] < r["pre"] <= t["post"] and r["text"]]
        before = [" ".join(r["text"].split()) for r in rows if r["tag"] == "#text" and r["pre"] < t["pre"]][-12:]
        near = [x for x in before if len(x) >= 20 and not re.fullmatch(r"[\d.,%\s]+", x)]
        out.append((n, own[0] if own else near[-1] if near else None))
    return out


def test_windows_of_random_pages(spark):
    rng = random.Random(11)
    nodes = staged(nodes_of(spark, *[random_page(rng) for _ in range(60)]), "test_nodes")
    by_page = pages_rows(nodes)
    quiet = pages_rows(P.without_noise(nodes))
    for page, rows in by_page.items():
        assert [r["pre"] for r in quiet.get(page, [])] == noise_brute(rows)
    anchors = P.section_anchors(nodes, F.col("heading").contains("koşul"))
    got = {}
    for r in anchors.collect():
        texts = [x["pre"] for x in by_page[r["page_id"]] if x["tag"] == "#text" and r["low"] < x["pre"] <= r["high"]]
        got[r["page_id"], r["pre"]] = texts
    want = {(page, pre): texts for page, rows in by_page.items() for pre, texts in section_brute(rows, "koşul").items()}
    assert got == want and len(want) > 20
    caps = {}
    for r in P.table_captions(nodes).orderBy("table_no").collect():
        caps.setdefault(r["page_id"], []).append((r["table_no"], r["caption"]))
    assert caps == {page: c for page, rows in by_page.items() if (c := captions_brute(rows))}


def test_sections_of_long_pages(spark):
    """4 000 paragraphs, some 240 KB of HTML, of which each is a heading's text or stands below one."""
    html = "<html><body><main><h2>Kampanya Koşulları</h2>" + "".join(f"<p>Koşul <b>numara</b> {k} burada yer alır.</p>" for k in range(4_000)) + "</main></body></html>"
    nodes = staged(nodes_of(spark, html), "test_nodes")
    began = time.time()
    section = P.section_texts(nodes, ("kampanya koşul",)).first()["section"]
    assert section.startswith("Koşul numara 0 burada") and section.count("\n") == 3_999
    assert P.table_captions(nodes).count() == 0
    assert P.without_noise(nodes).count() == nodes.count()
    assert time.time() - began < 60


def test_repaired_trees():
    assert tree("<p>a<div>b</div>c") == [(0, "p", None), (1, "#text", "a"), (0, "div", None), (1, "#text", "b"), (0, "#text", "c")]
    # What a table may not hold goes before it.
    assert tree("<table>x<tr><td>1</td></tr></table>") == [(0, "#text", "x"), (0, "table", None), (1, "tr", None), (2, "td", "1"), (3, "#text", "1")]
    # An end tag does not reach out of a cell; an inline one waits for the block inside it.
    assert [t for _, t, _ in tree("<div><table><tr><td>1</div>2</td></tr></table></div>")] == ["div", "table", "tr", "td", "#text", "#text"]
    assert tree("<b>1<p>2</b>3</p>4") == [(0, "b", "1 2 3"), (1, "#text", "1"), (1, "p", None), (2, "#text", "2"), (2, "#text", "3"), (0, "#text", "4")]
    assert [(d, t) for d, t, _ in tree("<ul><li><b>x<li>y</ul>z")] == [(0, "ul"), (1, "li"), (2, "b"), (3, "#text"), (1, "li"), (2, "#text"), (0, "#text")]
    assert [(d, t) for d, t, _ in tree("<table><tr><td>1<tr><td>2</table>")] == [(0, "table"), (1, "tr"), (2, "td"), (3, "#text"), (1, "tr"), (2, "td"), (3, "#text")]
    assert tree("</p></div>") == [] and tree("") == []


def test_pages_of_real_sites(spark):
    """Faults of real pages: content in a large nav, one form around everything, an empty main, template headings."""
    text = "Kampanya, 31.12.2026 tarihine kadar geçerlidir. " * 40
    clean = lambda html: P.clean_text(P.main_content(P.without_noise(nodes_of(spark, html)))).first()["clean_text"]
    assert len(clean(f"<body><nav><div>{text}</div></nav></body>")) > 1000
    small = clean("<body><nav><a href='/'>Ana Sayfa</a></nav><main><p>" + "Kampanya koşulları burada yer alır. " * 20 + "</p></main></body>")
    assert "Ana Sayfa" not in small and "Kampanya koşulları" in small
    assert "1-31 Ağustos 2026" in clean("<body><form runat='server'><article><p>Kampanya 1-31 Ağustos 2026 tarihleri arasında geçerlidir.</p></article></form></body>")
    assert len(clean("<body><main><p>Mobil afiş</p></main><article><p>" + "Kampanya detayları ve koşulları. " * 30 + "</p></article></body>")) > 500
    title = lambda html: P.page_titles(nodes_of(spark, html)).first()["title"]
    assert title('<html><head><title>Site</title></head><body><h1>" + pageTitle + "</h1><h2>Bilet %20 indirim!</h2></body></html>') == "Bilet %20 indirim!"
    assert title("<html><head><title>Yedek Başlık</title></head><body><h2>Kampanya Koşulları</h2></body></html>") == "Yedek Başlık"
    assert title("<html><head><meta property='og:title' content='Akaryakıt'><title>Genel</title></head><body><p>x</p></body></html>") == "Akaryakıt"


def test_card_labels_take_the_nearest_card(spark):
    html = "<div><span class='k'>dış</span><div><div><a>1</a></div><span class='x k'>iç</span></div><p><b><u><s><a>2</a></s></u></b></p></div><a>3</a>"
    got = {r["pre"]: r["label"] for r in P.card_labels(nodes_of(spark, html), "k").collect()}
    assert sorted(got.values()) == ["iç"]
    assert {r["label"] for r in P.card_labels(nodes_of(spark, html), "k", levels=4).collect()} == {"iç"}
    assert sorted(r["label"] for r in P.card_labels(nodes_of(spark, "<div><span class='k'>a</span><p><a>1</a></p></div>"), "k").collect()) == ["a"]


def test_sitemap_tree(spark, tmp_path):
    loc = lambda kind, *urls: f"<{kind}>" + "".join(f"<loc>{u}</loc>" for u in urls) + f"</{kind}>"
    index = lambda *urls: "<sitemapindex>" + "".join(loc("sitemap", u) for u in urls) + "</sitemapindex>"
    leaf = lambda *urls: "<urlset>" + "".join(loc("url", u) for u in urls) + "</urlset>"
    s = "https://s.example/"
    files = [
        (s + "root.xml", index(s + "a.xml", s + "root.xml", "http://www.s.example/b.xml/", s + "missing.xml").encode()),
        (s + "a.xml", index(s + "leaf1.gz", s + "b.xml").encode()),
        (s + "b.xml", index(s + "a.xml", s + "leaf2.xml", s + "broken.gz").encode()),
        (s + "leaf1.gz", gzip.compress(leaf(s + "p1", s + "p2/", s + "p1").encode())),
        (s + "leaf2.xml", leaf(s + "p2", s + "p3?utm_source=x").encode()),
        (s + "broken.gz", b"\x1f\x8b broken"),
        (s + "unlinked.xml", leaf(s + "p9").encode()),
    ]
    frame = spark.createDataFrame(files, "url string, content binary").select("url", A.unpacked_text(F.col("content")).alias("xml"))
    roots = spark.createDataFrame([(s + "root.xml",), (s + "nowhere.xml",)], "url string")
    got = {r["page_key"]: (r["loc"], r["sitemap_key"], r["depth"]) for r in A.expand_sitemaps(frame, roots).collect()}
    assert got == {s + "p1": (s + "p1", s + "leaf1.gz", 2), s + "p2": (s + "p2/", s + "leaf1.gz", 2), s + "p3": (s + "p3?utm_source=x", s + "leaf2.xml", 2)}
    assert A.expand_sitemaps(frame.filter("false"), roots).count() == 0


def test_match_spans(spark):
    texts = ["", "x", "12 ay ve 12 ay, 3 ay", "5 ay", "ay 7 ay ay", "1 ay2 ay"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", V.match_spans(F.col("t"), r"\d+ ay").alias("s")).collect():
        assert [(x["raw"], x["start"], x["end"]) for x in row["s"]] == [(m.group(), m.start() + 1, m.end() + 1) for m in re.finditer(r"\d+ ay", row["t"])]


def test_evidence_of_all_fields(spark):
    text = "1.500 TL harcamaya 50 TL, %2,05 kâr payı, 12 ay vade, 6 taksit, 01.02.2026 ile 3 Mart 2026; konut değerinin %80'i; 5 yaşına kadar"
    rows = [(1, text), (2, None), (3, ""), (4, "hiçbir şey yok")]
    df = spark.createDataFrame(rows, "id int, text string").select("id", E.prepare(F.col("text"), composed=True).alias("low"))
    low = df.first()["low"]
    got = V.evidence(df, "id", "low").collect()
    assert {r["id"] for r in got} == {1}
    assert {(r["field_name"], r["value_normalized"]) for r in got} >= {("amount", "1500"), ("amount", "50"), ("rate_pct", "2.05"), ("term_months", "12-12"), ("instalments", "6"), ("date", "2026-02-01"), ("date", "2026-03-03"), ("vehicle_age", "-5")}
    for r in got:
        assert low[r["evidence_char_start"] - 1 : r["evidence_char_end"] - 1] == r["value_raw"] and r["value_raw"] in r["evidence_text"]


def campaign(i, bank, title):
    return (i, bank, title, None, None, "", None)


CAMPAIGN = "campaign_id long, bank_code string, title string, description string, conditions_text string, source_url string, bank_category string"


def test_relabel(spark, tmp_path):
    path = f"{tmp_path}/labels"
    rules = X.default_rules()
    word, value = next((r[-1], r[1]) for r in rules if r[0] == "sector" and r[2] == "keyword")
    all_rows = spark.createDataFrame([campaign(1, "a", f"{word} kampanyası"), campaign(2, "b", f"{word} kampanyası"), campaign(3, "c", "başka")], CAMPAIGN)
    X.relabel(all_rows, path, rules=rules)
    files = lambda bank: sorted(os.path.basename(f) for f in glob.glob(f"{path}/bank_code={bank}/*.parquet"))
    before = files("b")
    stored = lambda: {(r["bank_code"], r["value"]) for r in spark.read.parquet(path).filter("axis = 'sector'").collect()}
    assert {("a", value), ("b", value)} <= stored()
    # The word leaves the rules, for one bank alone.
    X.relabel(all_rows, path, "a", [r for r in rules if r[1] != value])
    assert ("a", value) not in stored() and ("b", value) in stored() and files("b") == before
    # A bank without campaigns loses its labels.
    X.relabel(all_rows.filter("bank_code <> 'c'"), path, "c", rules)
    assert not files("c") and files("b") == before
    X.relabel(all_rows.filter("bank_code = 'a'"), path, rules=rules)
    assert {b for b, _ in stored()} == {"a"}


def test_versions_hold_what_changed(spark, tmp_path):
    root, keys = f"{tmp_path}/table", ["bank_code", "external_slug"]
    empty = spark.createDataFrame([], "bank_code string, external_slug string, title string, first_seen_at timestamp, last_seen_at timestamp")
    rows = spark.range(10_000).select(F.lit("b").alias("bank_code"), F.col("id").cast("string").alias("external_slug"), F.lit("old").alias("title"), F.lit(1).alias("seq"), "id")
    merge = lambda df, n: incremental.merge_batch(df.drop("id"), n, root, lambda b: b, empty, keys, rebase=3)
    merge(rows, 0)
    for n in (1, 2, 3):
        merge(rows.filter(F.col("id") % 100 == n).withColumn("title", F.lit(f"new{n}")), n)
    held = {n: spark.read.parquet(f"{root}/rows/version={n:012d}").count() for n in range(4)}
    assert held == {0: 10_000, 1: 100, 2: 100, 3: 10_000}  # the third batch after a base is a base again
    assert incremental.newest_version(spark, root) == (3, 3)
    now = incremental.current_version(spark, root, empty, keys)
    assert {(r["title"], r["n"]) for r in now.groupBy("title").agg(F.count("*").alias("n")).collect()} == {("old", 9_700), ("new1", 100), ("new2", 100), ("new3", 100)}
    before = incremental.current_version(spark, root, empty, keys, below=2)
    assert before.filter("title = 'new2'").isEmpty() and before.filter("title = 'new1'").count() == 100


def test_keyed_tables_join_without_an_exchange(spark, tmp_path):
    name = f"keyed_{random.randrange(10**9)}"
    rows = spark.range(500).select((F.col("id") % 5).cast("string").alias("bank_code"), F.col("id").cast("string").alias("external_slug"), F.lit("t").alias("title"))
    storage.save_keyed(rows, "campaigns", name, buckets=4, path=f"{tmp_path}/{name}")
    stored = storage.read_keyed(spark, name)
    assert [f.name for f in stored.schema.fields][:3] == ["bank_code", "external_slug", "title"] and stored.count() == 500
    assert stored.schema["start_date"].dataType.simpleString() == "date"
    batch = rows.limit(20).select("bank_code", "external_slug", F.lit("new").alias("title"), F.lit(1).alias("seq"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = upsert(stored, batch, F.current_timestamp(), ["bank_code", "external_slug"])
        plan = done._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    join = next(k for k, line in enumerate(lines) if "FullOuter" in line)
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line and name in line)
    assert join < scan and not any("Exchange" in line for line in lines[join:scan])
    assert any("Exchange hashpartitioning" in line and ", 4)" in line for line in lines[scan:])  # the batch, to the table's buckets
    assert done.filter("action = 'update'").count() == 20
    storage.save_keyed(spark.createDataFrame([], "bank_code string"), "runs", f"{name}_runs", buckets=2, path=f"{tmp_path}/{name}_runs")
    assert storage.read_keyed(spark, f"{name}_runs").count() == 0


def test_variants(spark):
    rows = [(1, None, 10, None), (2, 1, None, 5), (3, 1, 7, None), (4, 9, None, None), (5, 5, None, 1), (6, 2, None, None)]
    products = spark.createDataFrame(rows, "product_id int, parent_product_id int, amount_max int, term int")
    got = {r["product_id"]: (r["amount_max"], r["term"], r["is_variant"], r["parent_found"], r["inherited_fields"]) for r in R.with_parents(products, ("amount_max", "term")).collect()}
    assert got == {
        1: (10, None, False, False, []), 2: (10, 5, True, True, ["amount_max"]), 3: (7, None, True, True, []), 4: (None, None, True, False, []),
        5: (None, 1, False, False, []), 6: (None, 5, True, True, ["term"]),
    }
    assert {r["product_id"]: r["variants"] for r in R.variant_counts(products).collect()}[1] == 2
