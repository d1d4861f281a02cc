import pytest
from pyspark.sql import functions as F

from umbra.functions import scalars as S
from umbra.operators import mask as M
from umbra.plans.queries import QUERIES


def each(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def texts(spark, text, entities=(), **kw):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.category, r.text) for r in M.claims(docs, list(entities), **kw).orderBy("seq").collect()]


def test_fakes(spark):
    assert each(spark, ["Mark Rober", "John Tan", "JOHN TAN ", "JohnTan"], S.fake_name) == ["Joanna Din", "Juliet Devi", "Juliet Devi", "Joel Dunn"]
    assert each(spark, ["jane.tan@realcompany.com", "a@b.co"], S.fake_email) == ["jocelyn.doherty721@example.com", "janet.davis7753@example.com"]
    assert each(spark, ["+65 8123-4567", "É９a_"], S.hashtags) == ["+## ####-####", "###_"]


def test_letters(spark):
    got = spark.createDataFrame([(i,) for i in (1, 26, 27, 28, 702, 703, 18278, 18279)], "n int").select(S.letters(F.col("n"))).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AB", "ZZ", "AAA", "ZZZ", "AAAA"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("2504-0018", [("Phone", "2504-0018")]), ("PRO-DES-2504-0018", []), ("003300399701002", []), ("2504\n0018", []), ("2025-2026", []), ("34 009 200 686", [("ABN", "34 009 200 686")]),
        ("201912345A T09LL1234A 6738219C", [("UEN", "201912345A"), ("UEN", "T09LL1234A"), ("UEN", "6738219C")]), ("😀 x@y.com", [("Email", "x@y.com")]), ("", []), ("\ufdd0a@b.co\ufdd0 c@d.ef", [("Email", "a@b.co"), ("Email", "c@d.ef")]),
    ],
)
def test_detectors(spark, text, want):
    assert texts(spark, text) == want


def test_entities(spark):
    got = texts(spark, "Bed Rock BedRock BED  ROCK Bedrocking EQ12, Level 10, x", [("Bed Rock", "Client"), ("EQ12, Level 10,", "Address")], use_regex=False)
    assert got == [("Address", "EQ12, Level 10,"), ("Client", "Bed Rock"), ("Client", "BedRock"), ("Client", "BED  ROCK")]  # the longest entity first


def test_replacement(spark):
    df = spark.createDataFrame([("the us customer, us US",)], "t string")
    one = lambda o, p: df.select(M.replace_word(F.col("t"), F.lit(o), F.lit(p))).first()[0]
    assert one("us", r"$1\x") == r"the $1\x customer, $1\x US"
    assert one("a.b", "x") == "the us customer, us US"


def test_longest_first_and_verify(spark):
    docs = spark.createDataFrame([(1, "at Singapore 048424 and Singapore"), (2, "none"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, 0, "Singapore", "Location", "S"), (1, 1, "Singapore 048424", "Location", "Address")], "doc_id long, seq int, text string, category string, placeholder string")
    out = M.apply(docs, items).collect()
    assert [(r.doc_id, r.masked, r.changed, r.any_grey) for r in out] == [(1, "at Address and S", True, True)]
    assert [r.doc_id for r in M.leaks(docs, [("singapore", "x")]).collect()] == [1]


def test_round_trip_leaves_no_leak(spark):
    entities = [("Acme Ltd", "Client"), ("Acme", "=Azure")]
    docs = spark.createDataFrame([(1, "Acme Ltd and Acme, mail a@acme.com"), (2, "ACME ltd")], "doc_id long, text string")
    out = M.apply(docs, M.with_placeholders(M.items(docs, entities))).select("doc_id", F.col("masked").alias("text"))
    assert M.leaks(out, entities).count() == 0


def test_first_category_wins_for_a_group(spark):
    rows = [(1, 0, "x", "Client", "list", "g"), (2, 0, "x", "Entity", "list", "g"), (2, 1, "y", "Client", "list", "h")]
    found = spark.createDataFrame(rows, "doc_id long, seq int, text string, category string, source string, group_key string")
    assert [r.placeholder for r in M.with_placeholders(found).orderBy("doc_id", "seq").collect()] == ["Client A", "Client A", "Client B"]


def test_usable_documents(spark, tmp_path):
    """Whole texts are judged, whatever their ids: control characters that only the tail holds count, few among many do not."""
    rows = [(0, "x" * 30 + "\x01" * 30, False), (3, "\x01\x02\x03" + "x" * 100, True), (6, "\x01\x02\x03" + "x" * 20, False), (9, "plain", True), (1, " \n", False), (2, "\x01" * 3, False)]
    spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.usable for x in QUERIES["usable_documents"](spark, str(tmp_path)).collect()} == {i: u for i, _, u in rows}


def test_own_detectors(spark):
    """A function of the text among the detectors claims after the built-in ones."""
    tickets = lambda t: M.spans(t, F.lit(r"T-\d+|x@y\.com"), F.lit(9), F.lit("Ticket"), "own")
    docs = spark.createDataFrame([(1, "T-1 of x@y.com, T-22")], "doc_id long, text string")
    got = M.claims(docs, detectors=("Email", tickets)).orderBy("seq").collect()
    assert [(r.category, r.text, r.start) for r in got] == [("Email", "x@y.com", 7), ("Ticket", "T-1", 0), ("Ticket", "T-22", 16)]


def test_lines_whose_words_are_parted_otherwise(spark):
    """A pair is looked for by its characters but white space: no line here has an original as it is written."""
    texts = ["of\nthe x", "OFTHE", "of  the", "of　the", "off the", "o f the", None]
    pairs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(p).alias("p")) for o, p in (("of the", "$1"), (" ", "no"), ("de la", "2"))))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.masked_lines(F.col("t"), pairs).alias("m")).collect()
    assert [r.m for r in got] == ["$1 x", "$1", "$1", "$1", "off the", "o f the", None]
