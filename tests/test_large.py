"""What keeps the jobs' cost in proportion to their input: work is dealt over tasks, and done once."""

import re

import duckdb
from pyspark.sql import functions as F

from kervan.functions import evidence as V
from kervan.functions import text as T
from kervan.operators import forms as M
from kervan.operators import pages as P
from kervan.operators import taxonomy as X
from kervan.plans import extraction, jobs, web
from kervan.session import spread

DATA = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rendered_pages_are_dealt_over_tasks(spark):
    least = spark.sparkContext.defaultParallelism
    for make in (extraction._noisy_pages, extraction._part_pages, extraction._supplier_pages, jobs._site_pages):
        assert make(spark, DATA).rdd.getNumPartitions() >= least
    assert spread(spark.range(10_000), "id", 100).rdd.getNumPartitions() == 100


def test_cards_are_dealt_over_tasks(spark):
    assert "RepartitionByExpression" in _plan(extraction.card_labels(spark, DATA))


def test_pages_are_parsed_once(spark):
    for query in (extraction.cleaned_texts, extraction.form_options, extraction.form_variants, extraction.form_sampling):
        assert _plan(query(spark, DATA)).count("MapInArrow") == 1


def test_nodes_of_asked_tags_and_columns(spark):
    pages = spark.createDataFrame([(1, "<ul><li class='x'>a<li>b</ul><p><a href='/u?a=1&amp;b' title>c</a>"), (2, "<p>x")], "page_id long, html string")
    whole = P.page_nodes(pages)
    some = P.page_nodes(pages, tags=("li", "a"), columns=("page_id", "pre", "attrs", "ends"))
    assert some.columns == ["page_id", "pre", "attrs", "ends"]
    assert some.collect() == whole.filter("tag IN ('li', 'a')").select(some.columns).collect()
    assert [r["attrs"] for r in some.collect()][2] == {"href": "/u?a=1&b", "title": ""}


def test_batches_of_nodes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "NODES_AT_ONCE", 10)
    pages = spark.createDataFrame([(k, "<p>a</p>" * 3) for k in range(40)], "page_id long, html string")
    assert P.page_nodes(pages).count() == 240


def test_trees_leave_no_cycles():
    parser = P._Tree()
    parser.feed("<div><p>a</p></div>")
    parser.finish()
    work = [parser.root]
    while work:
        node = work.pop()
        assert node.parent is None
        work += node.children


def test_variant_field_ties_and_small_fields(spark):
    rows = [(1, "a", 1, "x", "x"), (1, "a", 2, "y", "y"), (1, "b", 3, "u", "u"), (1, "b", 4, "v", "v"), (1, "c", 5, "1", "1"), (1, "c", 6, "2", "2"), (1, "c", 7, "3", "3"), (2, "d", 1, "z", "z")]
    options = spark.createDataFrame(rows, "page_id long, name string, pre int, value string, label string")
    got = M.variant_candidates(options)
    assert [(r["page_id"], r["name"], r["pre"]) for r in got.orderBy("pre").collect()] == [(1, "a", 1), (1, "a", 2)]
    assert "Join" not in _plan(got)


def test_titles_read_entities_without_semicolon_as_the_sql_does(spark, tmp_path):
    pages = [(1, "<h1>Ders &amp&amp; &quotx&quot; &amp</h1>"), (2, "<title>BAŞVURU &copy 1</title><h1>BAŞVURU</h1>"), (3, "<title>Kitap</title><h1>NASIL KATILINIR</h1>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in web.page_titles(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(web.ORACLE["page_titles"]).fetchall()) == {1: 'Ders && "x" &', 2: "BAŞVURU © 1", 3: "Kitap"}


def test_labels_are_made_once(spark):
    assert _plan(web.table(spark, DATA, "documents").transform(_labelled)).count("regexp_extract_all") == 1


def _labelled(docs):
    none = F.lit(None).cast("string")
    return X.categorise(docs.select(F.col("doc_id").alias("campaign_id"), F.col("text").alias("title"), none.alias("description"), none.alias("conditions_text"), none.alias("source_url"), none.alias("bank_category")), composed=True)


def test_longest_rule_word_of_the_tree():
    words = ["bar", "barista", "ba", "kredi karti", "c++", "c"]
    pattern = re.compile(rf"(?<![a-z0-9])(?=({X._longest_of(words)}))")
    assert pattern.findall("baristalar bari baz kredi kartina kredi c++ cam abar") == ["barista", "bar", "ba", "kredi karti", "c++", "c"]


def test_a_title_is_worked_out_once_for_a_text(spark):
    title = F.regexp_extract("t", "^[^\n]*", 0)
    plan = _plan(spark.createDataFrame([("a\nb",)], "t string").select(T.first_paragraph(F.col("t"), title)))
    body = plan[plan.index("aggregate(") :]
    depth = 0
    for end, letter in enumerate(body):
        depth += {"(": 1, ")": -1}.get(letter, 0)
        if letter == ")" and not depth:
            break
    assert "regexp_extract" not in body[:end]


def test_evidence_values_are_worked_out_once(spark):
    rows = V.evidence(spark.createDataFrame([(1, "abc 12 ab 7")], "id long, t string"), "id", "t", fields={"n": V.Field(r"\d+", lambda m: F.when(m != "12", F.reverse(m)), lambda m: F.lit("u"))})
    assert [(r["seq"], r["value_normalized"], r["evidence_char_start"]) for r in rows.collect()] == [(1, "7", 11)]
    assert _plan(rows).count("reverse(") == 1


def test_orders_are_dealt_over_tasks(spark):
    assert "RepartitionByExpression" in _plan(jobs.evidence_spans(spark, DATA))
