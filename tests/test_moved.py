"""What is moved, sorted and read again: texts once, and only where they are asked for."""

import datetime

from pyspark.sql import functions as F

from advertide.functions.text import BLANK, sentence_at, squeeze
from advertide.functions.wording import Entry, earliest_match
from advertide.operators.merge import last_per_key
from advertide.plans.inputs import VIEWS, Inputs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def joins_over(plan, column):
    """Joins one of whose sides brings the column."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    brings = any(a.startswith(f"{column}#") for c in children for a in c.output().mkString(" ").split())
    return (plan.nodeName() == "Join" and brings) + sum(joins_over(c, column) for c in children)


def test_who_asks_for_the_hash_alone_sorts_no_text(spark):
    rows = spark.range(6).select(
        (F.col("id") % 2).alias("k"), F.col("id").alias("v"), F.concat(F.lit("long text "), F.col("id").cast("string")).alias("description"),
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"),
    )
    last = last_per_key(rows, ["k"], ["v"])
    assert "description" not in optimized(last.select("k", "content_hash")).toString()
    assert last.columns == ["k", "v", "description", "content_hash"]
    assert sorted(map(tuple, last.collect())) == [(0, 4, "long text 4", "h4"), (1, 5, "long text 5", "h5")]


def test_equal_places_give_hash_and_row_of_one_record(spark):
    rows = spark.createDataFrame([("a", 1, "x", "h1"), ("a", 1, "y", "h2"), ("a", None, "z", "h9")], "k string, v int, t string, content_hash string")
    assert [tuple(r) for r in last_per_key(rows, ["k"], ["v"]).collect()] == [("a", 1, "y", "h2")]


def test_each_text_passes_one_join_on_its_way_to_an_advertisement(spark, tmp_path):
    day = datetime.datetime(2001, 2, 3)
    tables = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [
            (1, "One\nline", "en", "src1", 8), (1, "One\nline", "en", "src1", 8), (2, "Two", "fr", "src2", 3), (3, None, None, None, None), (4, "Other", "de", "src1", 3), (None, "Nobody", "en", "src3", 9),
        ]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double", [(0, "N", 0, 1.0), (1, "A", 0, 2.0), (1, "B", 1, 3.0), (2, "C", 1, 4.0)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "NA", 0), (1, "NB", 0)]),
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "orders": ("o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double", [(1, day, "1-URGENT", 8.0), (2, day, "2-HIGH", 4.0), (2, day, "3-MEDIUM", 4.0)]),
        "labels": ("doc_id long, quality int, toxic int", [(1, 0, 1), (4, 1, 0), (4, 0, 0)]),
        "pages": ("page_id long, url string", [(0, "u0"), (1, "u1")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Inputs(spark, str(tmp_path))
    spelled = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert spelled(t.job) == spelled(t.sql(VIEWS["job"]))
    assert t.job.count() > 6
    assert joins_over(optimized(t.job), "text") == 1


def test_sentence_bounds_are_looked_for_once(spark):
    row = spark.createDataFrame([("One. Two is here! Three",)], "x string")
    found = row.select(sentence_at(F.col("x"), F.lit(9), F.lit(11)).alias("s"))
    assert found.first()["s"] == "Two is here!"
    assert optimized(found.filter("s <> x").select("s")).toString().count("^([^.!?]*)") <= 2


def test_earliest_match_at_the_front_beside_wide_characters_and_empty(spark):
    rows = spark.createDataFrame([("que x",), ("😀é que",), ("none",), ("",), (None,)], "x string")
    by = lambda *patterns: [r["m"] and tuple(r["m"]) for r in rows.select(earliest_match(F.col("x"), Entry("e", "e", "TOOL", patterns)).alias("m")).collect()]
    assert by(r"(?i)\bQUE\b", "x") == [(0, 0, 3), (3, 0, 6), None, None, None]
    assert by("q*") == [(0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), None]


def test_squeeze_leaves_nothing_but_single_spaces(spark):
    texts = ["a b", "a  b", " a ", "a b", "a  b", "é è", "a\n b\t", "a  　 é", "  ", "", "a\u0000 b", "😀 😀  x", "﻿a\x0bb", "a \x7f b"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = F.trim(F.regexp_replace("x", f"[{BLANK}]+", " "))
    assert rows.filter(~squeeze(F.col("x")).eqNullSafe(plain)).collect() == []
