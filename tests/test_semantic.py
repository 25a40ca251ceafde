"""Semantic domains over whole texts."""

import duckdb

from sparkassay.operators import basic, semantic
from sparkassay.plans import catalogue


def test_natural_language_of_whole_texts(spark):
    odd_head = "x" * 100 + " and then come many words of plain prose that go on for a while " * 10
    odd_rest = "these are plain words of prose " * 4 + "y" * 5000
    rows = basic.prepared(spark.createDataFrame([(odd_head,), (odd_rest,), (odd_rest,)], "t string"))
    assert semantic.natural_language(rows, "t").first().matched == 2
    assert semantic.natural_language(rows, "t", crop=None).first().matched == 1


def test_blank_texts_are_no_natural_language(spark, tmp_path):
    texts = ["", " \n\t", " " * 100 + "plain words of prose", "plain words of prose", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.nl_domain(spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert tuple(got) == con.execute(catalogue.SQL["nl_domain"]).fetchone() == (5, 1)
    rows = basic.prepared(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert semantic.natural_language(rows, "text", crop=None).first()[1:3] == (4, 2)
