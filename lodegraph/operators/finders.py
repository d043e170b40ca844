"""Question plans from graph templates: eight finders, plan assembly and difficulty.

Each finder gives one row per found subgraph: (place, nodes, path_length), the first ``k`` in the
template's order. A null ``k`` keeps all of them.

Defined results. Order follows node_ord and edge_ord, so ties can't occur. Nodes that fail the
quality gate are not used where the template asks for the gate. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators.graph import adjacency, gate, greedy_walk, present_edges

K = 30


def _first(rows: DataFrame, order: list, k: int | None) -> DataFrame:
    """The first k rows in order, numbered. A top-k stays a top-k; without k nothing is numbered globally."""
    if k is None:
        return rows.withColumn("place", F.lit(None).cast("int"))
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def atomic(nodes: DataFrame, k: int | None = K) -> DataFrame:
    rank = F.when(F.col("node_type") == "ConceptNode", 0).when(F.col("node_type") == "ClaimNode", 1).otherwise(2)
    n = gate(nodes).where(F.col("node_type").isin("ConceptNode", "ClaimNode", "MethodNode")).where("ok").where(F.length(R.text(R.either("normalized_content", "content"))) >= 4)
    return _first(n.withColumn("t", rank), ["t", "node_ord"], k).select("place", F.array("node_id").alias("nodes"), F.lit(0).alias("path_length"))


def numerical(nodes: DataFrame, edges: DataFrame, k: int | None = K) -> DataFrame:
    """(place, attribute, value, unit, concept): values with a unit first."""
    n = gate(nodes).select("node_id", "node_type", "node_ord", "ok")
    e = present_edges(edges, nodes).select("source", "target", "edge_ord")
    attributes = n.where("node_type = 'AttributeNode' and ok").select(F.col("node_id").alias("attribute"), F.col("node_ord").alias("o"))
    values = n.where("node_type = 'ValueNode'").select(F.col("node_id").alias("value"))
    units = n.where("node_type = 'UnitNode'").select(F.col("node_id").alias("unit"))
    concepts = n.where("node_type = 'ConceptNode' and ok").select(F.col("node_id").alias("concept"))
    pairs = e.withColumnsRenamed({"source": "attribute", "target": "value"}).join(attributes, "attribute").join(values, "value", "left_semi")
    unit = e.withColumnsRenamed({"source": "value", "target": "unit"}).join(units, "unit", "left_semi").groupBy("value").agg(F.min_by("unit", "edge_ord").alias("unit"))
    concept = e.withColumnsRenamed({"source": "concept", "target": "attribute"}).join(concepts, "concept", "left_semi").groupBy("attribute").agg(F.min_by("concept", "edge_ord").alias("concept"))
    rows = pairs.join(unit, "value", "left").join(concept, "attribute", "left").withColumn("bare", F.col("unit").isNull().cast("int"))
    return _first(rows, ["bare", "o", "edge_ord"], k).select("place", "attribute", "value", "unit", "concept")


def condition(nodes: DataFrame, edges: DataFrame, k: int | None = K) -> DataFrame:
    """(place, condition, target)."""
    n = gate(nodes).where("node_type = 'ConditionNode'").select(F.col("node_id").alias("source"), "node_ord")
    rows = present_edges(edges, nodes).select("source", "target", "edge_ord").join(n, "source")
    return _first(rows, ["node_ord", "edge_ord"], k).select("place", F.col("source").alias("condition"), "target")


def comparative(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(canonical_id, concepts, attributes): attributes of one identity that several concepts have."""
    n = gate(nodes).select("node_id", "node_type", "canonical_id")
    a = n.where("node_type = 'AttributeNode'").select(F.col("node_id").alias("target"), F.coalesce("canonical_id", "node_id").alias("canonical_id"))
    c = n.where("node_type = 'ConceptNode'").select(F.col("node_id").alias("source"))
    rows = present_edges(edges, nodes).select("source", "target").join(a, "target").join(c, "source", "left_semi")
    return rows.groupBy("canonical_id").agg(F.countDistinct("source").alias("concepts"), F.countDistinct("target").alias("attributes")).where("concepts >= 2")


def media(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, neighbours): figures and tables with their first three neighbours, out before in."""
    n = gate(nodes).where(F.col("node_type").isin("TableNode", "FigureNode")).select(F.col("node_id").alias("node"))
    near = adjacency(edges, nodes).join(n, "node", "left_semi")
    w = Window.partitionBy("node").orderBy("side", "place")
    first = near.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "neighbour"))), lambda x: x["neighbour"]), "|").alias("neighbours"))
    return n.join(first, "node", "left").select(F.col("node").alias("node_id"), F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def formula(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, targets, reference, path_length): equations with up to three targets and the first that refers to them."""
    n = gate(nodes).where("node_type = 'EquationNode'").select(F.col("node_id").alias("node"))
    near = adjacency(edges, nodes).join(n, "node", "left_semi")
    w = Window.partitionBy("node").orderBy("place")
    out = near.where("side = 0").withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("node").agg(F.count("*").alias("targets"))
    into = near.where("side = 1").groupBy("node").agg(F.min_by("neighbour", "place").alias("reference"))
    return n.join(out, "node", "left").join(into, "node", "left").select(F.col("node").alias("node_id"), F.coalesce("targets", F.lit(0)).alias("targets"), "reference", (F.coalesce("targets", F.lit(0)) + 1).alias("path_length"))


def multi_hop(nodes: DataFrame, edges: DataFrame, k: int | None = K) -> DataFrame:
    """(place, nodes, sections): greedy walks from concepts over at least three nodes, cross-section ones first."""
    starts = gate(nodes).where("node_type = 'ConceptNode' and ok").select("node_id", "node_ord")
    walks = greedy_walk(nodes, edges, starts).where(F.size("chain") >= 3)
    section = gate(nodes).select(F.col("node_id").alias("node"), F.coalesce("address.section_path", F.lit("")).alias("section"))
    spread = walks.select("start", F.explode("chain").alias("node")).join(section, "node").groupBy("start").agg(F.countDistinct("section").alias("sections"))
    rows = walks.join(spread, "start").join(starts.withColumnRenamed("node_id", "start"), "start").withColumn("inside", (F.col("sections") < 2).cast("int"))
    return _first(rows, ["inside", "node_ord"], k).select("place", F.col("chain").alias("nodes"), "sections")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, members): sections, by their chunks, with their first five claims or concepts, at least two."""
    n = gate(nodes)
    chunks = n.where("node_type = 'ChunkNode'").select(F.col("node_id").alias("source"), F.col("address.paper_id").alias("paper_id"), F.coalesce("address.section_path", F.lit("")).alias("section"))
    points = n.where(F.col("node_type").isin("ClaimNode", "ConceptNode")).select(F.col("node_id").alias("target"))
    rows = present_edges(edges, nodes).where("edge_type = 'contains'").select("source", "target", "edge_ord").join(chunks, "source").join(points, "target", "left_semi")
    w = Window.partitionBy("paper_id", "section").orderBy("edge_ord")
    first = rows.withColumn("r", F.row_number().over(w)).where("r <= 5")
    return first.groupBy("paper_id", "section").agg(F.count("*").alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "target"))), lambda x: x["target"]), "|").alias("nodes")).where("members >= 2")


def difficulty(plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds evidence, modalities, section distance, constraints, papers and the level L1-L4 to (plan_id, nodes, path_length)."""
    n = gate(nodes).select(F.col("node_id").alias("node"), "node_type", F.coalesce("modality", F.lit("text")).alias("modality"), F.coalesce("address.section_path", F.lit("")).alias("section"), F.coalesce("address.paper_id", F.lit("")).alias("paper"))
    rows = plans.select("plan_id", "path_length", F.explode("nodes").alias("node")).join(n, "node")
    f = rows.groupBy("plan_id").agg(F.first("path_length").alias("path_length"), F.count("*").alias("evidence"), F.countDistinct("modality").alias("modalities"), (F.countDistinct("section") - 1).alias("section_distance"), F.sum(F.col("node_type").isin("UnitNode", "ConditionNode").cast("bigint")).alias("constraints"), (F.countDistinct("paper") > 1).alias("cross_paper"))
    score = F.col("evidence") + F.col("path_length") + F.col("modalities") + 2 * F.col("section_distance") + F.col("constraints") + F.when(F.col("cross_paper"), 3).otherwise(0)
    hard = F.col("cross_paper") | (F.col("section_distance") >= 1) | (F.col("modalities") >= 2) | (score >= 9)
    return f.withColumn("score", score).withColumn("difficulty", F.when(hard, "L4").when(score >= 6, "L3").when(score >= 3, "L2").otherwise("L1"))


def plan_constraints(plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, number, unit, condition, formula, table): contents of a plan's nodes by kind."""
    n = gate(nodes).select(F.col("node_id").alias("node"), "node_type", F.coalesce("content", F.lit("")).alias("content"))
    rows = plans.select("plan_id", F.posexplode("nodes").alias("at", "node")).join(n, "node")

    def kind(t: str, cut: int | None = None):
        c = F.substring("content", 1, cut) if cut else F.col("content")
        picked = F.filter(F.array_sort(F.collect_list(F.when(F.col("node_type") == t, F.struct("at", c.alias("c"))))), lambda x: x.isNotNull())
        return F.array_join(F.transform(picked, lambda x: x["c"]), "|")

    return rows.groupBy("plan_id").agg(kind("ValueNode").alias("number"), kind("UnitNode").alias("unit"), kind("ConditionNode").alias("condition"), kind("EquationNode", 80).alias("formula"), kind("TableNode", 80).alias("table"))
