"""Graph operators against plain Python."""

import random

from pyspark.sql import functions as F

from lodegraph.operators import binding, graph
from lodegraph.operators.components import connected_components

NODE = "node_id string, node_type string, content string, normalized_content string, canonical_id string, modality string, node_ord bigint, address struct<paper_id:string,section_path:string,chunk_id:string>"
EDGE = "source string, target string, edge_type string, polarity string, confidence double, edge_ord bigint"


def nodes(spark, rows):
    return spark.createDataFrame([(i, t, c, None, None, "text", k, ("p", "S", "c1")) for k, (i, t, c) in enumerate(rows)], NODE)


def edges(spark, rows):
    return spark.createDataFrame([(s, t, e, p, c, k) for k, (s, t, e, p, c) in enumerate(rows)], EDGE)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [("hub", f"n{i}") for i in range(40)] + [("x", "x"), (None, "n1")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows:
        if a and b and a != b:
            parent[find(a)] = find(b)
    least = {}
    for x in list(parent):
        r = find(x)
        least[r] = min(least.get(r, x), x)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert got == {x: least[find(x)] for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_evidence_needs_eligible_edges(spark):
    n = nodes(spark, [("o", "ConceptNode", "device B"), ("a", "AttributeNode", "PCE"), ("v", "ValueNode", "30 percent")])
    for p, c, want in (("negative", 0.25, 0), ("positive", 1.0, 1), ("positive", 0.4, 0), (None, None, 1)):
        e = edges(spark, [("o", "a", "has_attribute", "positive", 1.0), ("a", "v", "has_value", p, c)])
        assert binding.values_via_attribute(n, e).count() == want


def test_units_direct_then_column(spark):
    n = nodes(spark, [("v", "ValueNode", "42"), ("w", "ValueNode", "7"), ("x", "ValueNode", "1"), ("col", "AttributeNode", "PCE"), ("pct", "UnitNode", "%"), ("db", "UnitNode", "dB"), ("ghz", "UnitNode", "GHz")])
    e = edges(spark, [("v", "db", "has_unit", "positive", 1.0), ("col", "v", "has_value", "positive", 1.0), ("col", "w", "has_value", "positive", 1.0), ("col", "pct", "has_unit", None, None)])
    assert {r["value"]: r["unit"] for r in binding.value_units(n, e).collect()} == {"v": "dB", "w": "%", "x": ""}


def test_walks_match_plain_walks(spark, folder):
    n, e = spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet")
    types = {r["node_id"]: r["node_type"] for r in graph.unique_nodes(n).collect()}
    links = sorted({(r["edge_ord"], r["source"], r["target"], r["edge_type"]) for r in graph.present_edges(e, n).collect()})
    out, into = {}, {}
    for _, s, t, k in links:
        out.setdefault(s, []).append((t, k))
        into.setdefault(t, []).append(s)
    lv = lambda x: graph.LEVELS.get(types[x], 5)

    def down(start, depth=4, limit=40):
        order, frontier = [start], [start]
        for _ in range(depth):
            grown = []
            for x in frontier:
                for t, k in out.get(x, []):
                    if t not in order and (k in graph.DOWNWARD or lv(t) >= lv(x)) and len(order) < limit:
                        order.append(t)
                        grown.append(t)
            frontier = grown
        return order

    starts = graph.unique_nodes(n).where("node_type = 'ChunkNode'")
    got = {}
    for r in graph.downward_walk(n, e, starts).orderBy("start", "place").collect():
        got.setdefault(r["start"], []).append(r["node"])
    assert got == {s: down(s) for s, t in types.items() if t == "ChunkNode"}

    def up(start):
        chain = [start]
        for _ in range(6):
            step = next((s for s in into.get(chain[-1], []) if s not in chain and lv(s) <= lv(chain[-1])), None)
            if step is None:
                break
            chain.append(step)
        return chain

    values = graph.unique_nodes(n).where("node_type = 'ValueNode'")
    assert {r["start"]: list(r["chain"]) for r in graph.upward_locate(n, e, values).collect()} == {s: up(s) for s, t in types.items() if t == "ValueNode"}


def test_rule_completion_skips_linked_pairs(spark):
    n = nodes(spark, [("a", "AttributeNode", "PCE"), ("v", "ValueNode", "30"), ("u", "UnitNode", "%")])
    e = edges(spark, [("v", "a", "reaches", "positive", 1.0)])
    assert {(r["source"], r["target"], r["edge_type"]) for r in graph.rule_completion(n, e).collect()} == {("v", "u", "has_unit")}


def test_empty_tables(spark):
    n, e = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    assert graph.downward_walk(n, e, n).count() == 0
    assert graph.greedy_walk(n, e, n).count() == 0
    assert graph.backing_paths(spark.createDataFrame([], "source string, target string"), n, e).count() == 0
    assert graph.same_as(n).count() == 0


def test_backing_path_is_shortest(spark):
    n = nodes(spark, [(x, "ConceptNode", x * 4) for x in "abcdef"])
    e = edges(spark, [("a", "b", "r", None, None), ("c", "b", "r", None, None), ("c", "d", "r", None, None), ("a", "e", "r", None, None), ("e", "d", "r", None, None)])
    pairs = spark.createDataFrame([("a", "d"), ("a", "f")], "source string, target string")
    assert [(r["source"], r["target"], list(r["path"])) for r in graph.backing_paths(pairs, n, e).collect()] == [("a", "d", ["a", "e", "d"])]


def test_duplicate_columns_are_harmless(spark):
    n = nodes(spark, [("a", "AttributeNode", "PCE")]).withColumn("r", F.lit(1)).withColumn("place", F.lit(2)).withColumn("ok", F.lit(None))
    assert graph.chunk_mates(n).count() == 0
    assert graph.gate(n).select("ok").first()[0] is True
