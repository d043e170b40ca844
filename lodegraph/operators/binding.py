"""How values, units and shared metrics are bound to the things they describe.

Defined results. Only eligible edges (positive, confidence at least the threshold; missing fields
default) carry evidence. Of several candidates the first by edge order wins. Nodes without a binding
give no row, or a null where a row is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators.graph import LEVELS, present_edges, unique_edges, unique_nodes
from lodegraph.session import cut_lineage


def _edges(nodes: DataFrame, edges: DataFrame, kind: str, only_eligible: bool = True) -> DataFrame:
    e = present_edges(edges, nodes).where(F.col("edge_type") == kind)
    return (e.where(R.eligible("confidence", "polarity")) if only_eligible else e).select("source", "target", "edge_ord")


def values_via_attribute(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object, attribute, value): eligible object-attribute-value chains."""
    values = unique_nodes(nodes).where("node_type = 'ValueNode'").select(F.col("node_id").alias("value"))
    a = _edges(nodes, edges, "has_attribute").select(F.col("source").alias("object"), F.col("target").alias("attribute"))
    v = _edges(nodes, edges, "has_value").select(F.col("source").alias("attribute"), F.col("target").alias("value"))
    return a.join(v, "attribute").join(values, "value", "left_semi").select("object", "attribute", "value").distinct()


def value_units(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value, unit_node, unit): the unit node of every value node and its text, its own first, else its column's; null and empty if none."""
    n = unique_nodes(nodes)
    units = n.where("node_type = 'UnitNode'").select(F.col("node_id").alias("target"), F.struct(F.col("node_id").alias("node"), R.text("content").alias("text")).alias("u"))
    own = _edges(nodes, edges, "has_unit").join(units, "target").groupBy(F.col("source").alias("value")).agg(F.min_by("u", "edge_ord").alias("own"))
    column = _edges(nodes, edges, "has_unit", only_eligible=False).join(units, "target").groupBy("source").agg(F.min_by("u", "edge_ord").alias("u"))
    attributes = n.where("node_type = 'AttributeNode'").select(F.col("node_id").alias("source"))
    into = _edges(nodes, edges, "has_value", only_eligible=False).join(attributes, "source", "left_semi").join(column, "source").groupBy(F.col("target").alias("value")).agg(F.min_by("u", "edge_ord").alias("column"))
    values = n.where("node_type = 'ValueNode'").select(F.col("node_id").alias("value"))
    found = F.coalesce("own", "column")
    return values.join(own, "value", "left").join(into, "value", "left").select("value", found["node"].alias("unit_node"), F.coalesce(found["text"], F.lit("")).alias("unit"))


def units_of_few(leveled: DataFrame, ids: DataFrame) -> DataFrame:
    """(value, unit_node): the unit node that value_units gives the few nodes of ``ids`` (node_id), which are sent to every task, over written leveled_edges; no row if none."""
    few = lambda end: F.broadcast(ids.select(F.col("node_id").alias(end)))
    has = leveled.where(f"edge_type = 'has_unit' and lt = {LEVELS['UnitNode']}")  # no other type has its level
    own = has.where(R.eligible("confidence", "polarity")).join(few("source"), "source").groupBy(F.col("source").alias("value")).agg(F.min_by("target", "edge_ord").alias("unit_node"))
    column = has.groupBy("source").agg(F.min_by("target", "edge_ord").alias("unit_node"))
    into = leveled.where("edge_type = 'has_value' and of_attribute").select("source", "target", "edge_ord").join(few("target"), "target").join(column, "source").groupBy(F.col("target").alias("value")).agg(F.min_by("unit_node", "edge_ord").alias("unit_node"))
    found = own.withColumn("rank", F.lit(0)).unionByName(into.withColumn("rank", F.lit(1))).where("unit_node is not null")
    return found.groupBy("value").agg(F.min_by("unit_node", "rank").alias("unit_node"))


def table_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, column, cell, place): the cells that a table row points to, by the attribute whose value they are; a column's first cell counts."""
    attributes = unique_nodes(nodes).where("node_type = 'AttributeNode'").select(F.col("node_id").alias("column"))
    e = present_edges(edges, nodes)
    columns = e.where("edge_type = 'has_value'").select(F.col("source").alias("column"), F.col("target").alias("cell"), F.col("edge_ord").alias("into")).join(attributes, "column", "left_semi").groupBy("cell").agg(F.min_by("column", "into").alias("column"))
    cells = e.select(F.col("source").alias("row"), F.col("target").alias("cell"), F.col("edge_ord").alias("place")).join(columns, "cell")
    return cells.groupBy("row", "column").agg(F.min_by("cell", "place").alias("cell"), F.min("place").alias("place"))


def owning_rows(nodes: DataFrame, edges: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(node_id, row): each node as a table row: itself if it has cells, else the first row that points to it, else itself; ``cells`` are table_rows, if known already."""
    rows = (table_rows(nodes, edges) if cells is None else cells).select(F.col("row")).distinct()
    into = present_edges(edges, nodes).where(F.col("edge_type").isin("compares", "co_occurs_with")).select(F.col("target").alias("node_id"), F.col("source").alias("row"), "edge_ord").join(rows, "row", "left_semi").groupBy("node_id").agg(F.min_by("row", "edge_ord").alias("above"))
    own = rows.select(F.col("row").alias("node_id"), F.lit(True).alias("own"))
    n = unique_nodes(nodes).select("node_id")
    return n.join(own, "node_id", "left").join(into, "node_id", "left").select("node_id", F.when(F.coalesce("own", F.lit(False)), F.col("node_id")).otherwise(F.coalesce("above", "node_id")).alias("row"))


def row_metrics(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, metric, cell_a, cell_b): of each pair of rows the column that both have: ``prefer`` if it is one, else the first of a's with a digit in its cell, else the first."""
    cells = table_rows(nodes, edges)
    text = unique_nodes(nodes).select(F.col("node_id").alias("cell_a"), R.text("content").alias("said"))
    if "prefer" not in pairs.columns:
        pairs = pairs.withColumn("prefer", F.lit(None).cast("string"))
    a = cells.select(F.col("row").alias("a"), F.col("column").alias("metric"), F.col("cell").alias("cell_a"), "place")
    b = cells.select(F.col("row").alias("b"), F.col("column").alias("metric"), F.col("cell").alias("cell_b"))
    both = pairs.select("a", "b", "prefer").distinct().join(a, "a").join(b, ["b", "metric"]).join(text, "cell_a", "left")
    order = F.struct((F.col("metric") != F.coalesce("prefer", F.lit(""))), ~F.coalesce(F.col("said").rlike("[0-9]"), F.lit(False)), F.col("place"), F.col("metric"))
    best = both.groupBy("a", "b").agg(F.min_by(F.struct("metric", "cell_a", "cell_b"), order).alias("m"))
    return best.select("a", "b", "m.metric", "m.cell_a", "m.cell_b")


def shared_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, metric, object, value, objects): the objects of one chunk that have a value for an attribute of the same identity, and how many they are; the pairs are those of one group."""
    chains = values_via_attribute(nodes, edges)
    n = unique_nodes(nodes)
    attribute = n.select(F.col("node_id").alias("attribute"), F.col("canonical_id").alias("metric"), F.col("address.chunk_id").alias("chunk_id"))
    rows = chains.join(attribute, "attribute").where("metric is not null and metric != '' and chunk_id is not null")
    members = rows.groupBy("chunk_id", "metric", "object").agg(F.min_by("value", F.struct("attribute", "value")).alias("value"))
    shared = members.groupBy("chunk_id", "metric").agg(F.count("*").alias("objects")).where("objects > 1")
    return members.join(shared, ["chunk_id", "metric"]).select("chunk_id", "metric", "object", "value", "objects")


def peers(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, peer, other_paper): same-as and aligned nodes, in both directions."""
    both = links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    n = unique_nodes(nodes).select("node_id", F.col("address.paper_id").alias("paper_id"))
    a = n.select(F.col("node_id").alias("source"), F.col("paper_id").alias("pa"))
    b = n.select(F.col("node_id").alias("target"), F.col("paper_id").alias("pb"))
    return both.join(a, "source").join(b, "target").select(F.col("source").alias("node_id"), F.col("target").alias("peer"), (~F.col("pa").eqNullSafe(F.col("pb"))).alias("other_paper"))


def attributes_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object, attribute, place): the attributes that eligible edges give an object, in their order."""
    return _edges(nodes, edges, "has_attribute").select(F.col("source").alias("object"), F.col("target").alias("attribute"), F.col("edge_ord").alias("place"))


def comparable_objects(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """(attribute, object, place): for each attribute the first concepts that have one of its identity, or of more than half of its words.

    The first concepts are found once for each identity and each set of words, not for each attribute: the
    first of a union are among the first of its parts. Sets that share more than half of their union share
    a word of the rarer half of both, so only sets with such a word are compared."""
    n = unique_nodes(nodes)
    names = n.select(F.col("node_id").alias("attribute"), F.nullif("canonical_id", F.lit("")).alias("identity"), F.array_join(F.array_sort(R.token_set("content")), " ").alias("words"))
    concepts = n.where("node_type = 'ConceptNode'").select(F.col("node_id").alias("object"), "node_ord")
    given = unique_edges(edges).where("edge_type = 'has_attribute'").where(R.eligible("confidence", "polarity")).select(F.col("source").alias("object"), F.col("target").alias("attribute"))
    held = given.join(concepts, "object").join(names, "attribute").select("identity", "words", "object", "node_ord")

    def first(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("node_ord", "object")
        ranked = rows.select(key, "object", "node_ord").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
        return ranked.groupBy(key).agg(F.collect_list(F.struct("node_ord", "object")).alias("first"))

    equal = first(held.where("identity is not null"), "identity").withColumnRenamed("first", "equal")
    by_words = cut_lineage(first(held.where("words != ''"), "words"))
    mine = anchors.select("attribute").distinct().join(names, "attribute")
    sets = cut_lineage(mine.select("words", F.lit(True).alias("mine")).unionByName(by_words.select("words", F.lit(False).alias("mine"))).where("words != ''").distinct())
    each = sets.select("mine", "words", F.explode(F.split("words", " ")).alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("n"))
    rare = each.join(often, "w").groupBy("mine", "words").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("by"))
    rare = rare.select("mine", "words", F.explode(F.slice("by", 1, F.ceil(F.size("by") / 2).cast("int"))["w"]).alias("w"))
    x, y = F.split("words", " "), F.split("others", " ")
    pairs = rare.where("mine").select("w", "words").join(rare.where("not mine").select("w", F.col("words").alias("others")), "w").where(F.size(F.array_intersect(x, y)) > 0.5 * F.size(F.array_union(x, y))).select("words", "others").distinct()
    alike = first(pairs.join(by_words.withColumnRenamed("words", "others"), "others").select("words", F.inline("first")), "words").withColumnRenamed("first", "alike")
    none = F.array().cast("array<struct<node_ord:bigint,object:string>>")
    both = mine.join(equal, "identity", "left").join(alike, "words", "left").withColumn("all", F.array_sort(F.array_union(F.coalesce("equal", none), F.coalesce("alike", none))))
    return both.select("attribute", F.posexplode(F.slice("all", 1, limit)).alias("i", "o")).select("attribute", "o.object", (F.col("i") + 1).alias("place"))


def role_pool(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan, node_type, members): the candidates of each plan (plan, node_id) by node type, in their order."""
    rows = members.join(unique_nodes(nodes).select("node_id", "node_type", "node_ord"), "node_id")
    return rows.groupBy("plan", "node_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "node_id"))), lambda x: x["node_id"]).alias("members"))
