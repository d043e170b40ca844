"""Rules on small inline tables."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import rules as R

POLARITY = [
    ("In our hands the alloy sample had a hardness of 412 after ageing.", "hardness", "412", "positive"),
    ("The second batch never came close to a yield of 61 per cent.", "batch", "61", "negative"),
    ("Without doping the film keeps a mobility of 0.7 at best.", "film", "0.7", "negative"),
    ("Quenching lacks any hold on the grain size, which cannot drop to 8 microns.", "grain size", "8", "negative"),
    ("The glass melts early, but the ceramic withstands 1500 degrees.", "glass", "1500", "contrastive"),
    ("Rather than copper, the wire uses silver with a resistance of 3 ohm.", "copper", "3", "contrastive"),
    ("Sintering might lift the density to 7 grams.", "density", "7", "hypothetical"),
    ("Density is expected to settle near 7.1 grams.", "density", "7.1", "hypothetical"),
    ("合金样品无法承受500兆帕的载荷。", "合金", "500", "negative"),
    ("薄膜很软，然而其寿命为90小时。", "薄膜", "90", "contrastive"),
    ("倘若压力加倍，密度应为7。", "压力", "7", "hypothetical"),
    ("Nothing was lost. No crack was seen. The rod carries a load of 90 kN.", "rod", "90", "positive"),
]


def test_polarity_between_mentions(spark):
    df = spark.createDataFrame(POLARITY, "t string, a string, b string, want string")
    rows = df.select("t", "want", R.polarity(R.between_window("t", "a", "b")).alias("got")).collect()
    assert [r for r in rows if r["want"] != r["got"]] == []


@pytest.mark.parametrize("scope,rule,base", [("same_sentence", False, 1.0), ("same_table_row", False, 0.9), ("same_caption", False, 0.85), ("same_paragraph", False, 0.7), ("same_chunk", False, 0.55), ("elsewhere", False, 0.5), ("same_sentence", True, 0.4)])
def test_confidence_and_eligibility(spark, scope, rule, base):
    for pol, factor in R.PENALTY.items():
        df = spark.createDataFrame([(scope, pol)], "s string, p string").select(R.edge_confidence("s", "p", rule).alias("c"), "p")
        row = df.select("c", R.eligible("c", "p").alias("e")).first()
        assert row["c"] == round(base * factor, 3)
        assert row["e"] == (pol == "positive" and base >= 0.5)


def test_missing_edge_fields_count_as_positive(spark):
    df = spark.createDataFrame([(None, None)], "c double, p string")
    assert df.select(R.eligible("c", "p")).first()[0] is True


def test_valid_points(spark):
    rows = [("ConceptNode", "5G antenna", True), ("ConceptNode", "0.8 mm", False), ("ConceptNode", "[20]", False), ("AttributeNode", "Value", False), ("AttributeNode", "PCE", True), ("ValueNode", "n/a", False), ("UnitNode", "°C", True), ("ConditionNode", "Received 7 January", False), ("PaperNode", "", False), ("TableNode", "x", True), ("ConceptNode", None, False)]
    df = spark.createDataFrame(rows, "t string, c string, want boolean")
    assert [r for r in df.select("t", "c", "want", R.valid_point("t", F.lit(""), "c").alias("got")).collect() if r["want"] != r["got"]] == []


def test_units_take_the_leftmost_alternative(spark):
    df = spark.createDataFrame([("5 mg 3 min 2.4 GHz 7%",)], "t string").select(R.value_units("t").alias("v")).first()["v"]
    assert [x["unit"] for x in df] == ["m", "m", "GHz", "%"]


def test_close_numbers(spark):
    rows = [("101", "100", True), ("103", "100", False), ("0", "0", True), ("x", "x", True), ("x", "1", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", R.close_numbers(F.col("a"), F.col("b")).alias("got")).collect())


def test_qa_reasons(spark):
    rows = [("How?", "x", "atomic", "question_too_short"), ("How large is it?", " ", "atomic", "empty_answer"), ("How large is it?", "see a_c12", "atomic", "leaks_node_id"), ("How large is it?", "无法确定", "atomic", "refusal"), ("How large is it?", "Y", "atomic", "degenerate_answer"), ("How large is it?", "large", "numerical", "numerical_without_number"), ("How large is it?", "5 mm", "numerical", "ok"), (None, None, None, "question_too_short")]
    df = spark.createDataFrame(rows, "q string, a string, t string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", R.qa_reason("q", "a", "t").alias("got")).collect())
