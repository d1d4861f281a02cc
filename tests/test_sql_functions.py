"""Functions and table functions of SQL beside the Columns and operators that they stand for."""

import pytest
from pyspark.sql import functions as F

from umbra.functions import scalars as S
from umbra.functions.register import register
from umbra.operators import mask as M
from umbra.plans.queries import ADDRESSES, ENTITIES, WORDS, _corpus

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "the  Netherlands", "Middle  East/Africa", "France/Nowhere", "/", "a, b, Perth WA 6000", ",", "1 X, uk 12345", "\u2003Taiwan\x1c", "Asia", "singapore", "Singapored", "x, ASIA / europe 9999"]


def test_addresses(spark):
    register(spark)
    rows = spark.createDataFrame([(x.replace("{n}", "12345"),) for x in ADDRESSES + ODD], "x string")
    made = rows.selectExpr("x", "country_of(x) as c", "region_of(x) as r", "collapse_address(x) as a")
    want = rows.select("x", S.country(F.col("x")).alias("c"), S.region(F.col("x")).alias("r"), S.collapse_address(F.col("x")).alias("a"))
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty() and made.where("c is not null").count() > 3 and made.where("r is not null").count() > 3


def _list(entities):
    return "array(" + ", ".join(f"named_struct('value', '{v}', 'category', '{c}')" for v, c in entities) + ")"


@pytest.fixture(scope="module")
def corpus(spark):
    odd = ["A\u0301lvaro 2504-0018", "x12345678A", "\u0661\u0662\u0663 \u0664\u0665\u0666\u0667", "12 The E\u0301splanade Road Singapore 048624, #01-23", "acme\u2003holdings ACME_ acmeholdings", "34 009 200 686", "\U0001f600 a@b.co", None, ""]
    return _corpus(spark, SF).unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).cache()


@pytest.mark.parametrize("entities", [(), ENTITIES + WORDS + [("(x)", "Entity"), ("E\u0301splanade road", "Client")]])
def test_same_as_claims(spark, corpus, entities):
    """All documents, memos and odd texts; all five categories and a list."""
    register(spark)
    corpus.createOrReplaceTempView("corpus")
    columns = "doc_id, seq, tier, start, end, text, category, source"
    want = M.claims(corpus, list(entities)).selectExpr(*columns.split(", "))
    more = f", {_list(entities)}" if entities else ""
    by_table = spark.sql(f"select {columns} from scan_table(table(corpus) partition by (doc_id), 'doc_id', 'text'{more})")
    by_text = spark.sql(f"select doc_id, s.seq, s.tier, s.start, s.end, s.text, s.category, s.source from corpus, lateral scan_text(text{more}) s")
    assert {r.category for r in want.select("category").distinct().collect()} >= {"Email", "Phone", "UEN", "ABN", "Address"}
    for got in (by_table, by_text):
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_arguments(spark):
    register(spark)
    spark.createDataFrame([("k1", "mail a@b.co"), (None, "x@y.org"), ("k3", None)], "name string, body string").createOrReplaceTempView("named")
    got = spark.sql("select * from scan_table(table(named), 'name', 'body', null)")
    assert got.schema["name"].dataType.simpleString() == "string" and sorted((r.name or "", r.text) for r in got.collect()) == [("", "x@y.org"), ("k1", "a@b.co")]
    for wrong in ("scan_table(table(named), 'name', 'text')", "scan_table(table(named), 'name', 'body', array('x'))", "scan_text(1)"):
        with pytest.raises(Exception, match="columns of the table|entity list is an array|takes a string"):
            spark.sql(f"select * from {wrong}").collect()
