"""Every registered query with reference SQL, on the smallest data, against DuckDB."""

import datetime
import decimal
import hashlib
import html
import os
import re

import duckdb
import pytest

from kervan.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(rows, names):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(found.fetchall(), names)


def test_page_clean_text(spark):
    """The one query without reference SQL, against texts cut out of the flat markup of these pages by hand: the article
    alone where it holds at least 30 % of the body's text, and no word of navigation or scripts anywhere."""
    from kervan.operators import pages as P

    assert set(QUERIES) - set(ORACLE) == {"page_clean_text"}
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    clean = {r["page_id"]: r["clean_text"] for r in P.clean_text(P.main_content(P.without_noise(P.page_nodes(pages)))).collect()}
    found = {r["page_id"]: (r["length"], r["clean_text_sha256"]) for r in QUERIES["page_clean_text"](spark, SF).collect()}
    assert {k: (len(v), hashlib.sha256(v.encode()).hexdigest() if v else "") for k, v in clean.items()} == found
    words = lambda markup: html.unescape(re.sub("<[^>]+>", " ", markup)).split()
    for row in pages.collect():
        body = re.search("<body>(.*?)(?:</body>|$)", row["html"], re.S).group(1)
        article = re.search("<article>(.*)</article>", body, re.S).group(1)
        whole = words(re.sub("<!--.*?-->", "", body, flags=re.S))
        size = lambda w: len(" ".join(w))
        share = size(words(article)) / size(whole)
        if share > 0.35:
            assert clean[row["page_id"]].split() == words(article)
        elif share < 0.25:  # the whole body, less its noise; a footer of over 40 % of it is none
            assert " ".join(words(article)) in " ".join(clean[row["page_id"]].split()) and "track(" not in clean[row["page_id"]]
