"""The queries that SQL can express, beside it, on the smallest tables; and on tables with null texts, ties of text and long lines."""

import random

import oracle_check
import pytest

from umbra.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_agrees_with_sql(spark, name):
    assert not oracle_check.differ(spark, oracle_check.tables(SF), SF, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_line_dedup", "op6_substring_dedup", "op10_fingerprints"])
def test_agrees_on_odd_texts(spark, tmp_path, name):
    r = random.Random(5)
    say = lambda n: "".join(r.choice(["the", "of", "é", "W1", "#", "x.", "漢"]) + r.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(n))
    texts = [None, "", "\n", *(say(r.choice([3, 12, 60, 200])) for _ in range(40))]
    texts += r.sample(texts, 9) + ["a b c d e f g h i j k l m n o p q r s t " * 8] * 2
    rows = [(3 * i, t, r.choice(["en", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert not oracle_check.differ(spark, oracle_check.tables(str(tmp_path)), str(tmp_path), queries.queries()[name], queries.oracle_sql()[name])
