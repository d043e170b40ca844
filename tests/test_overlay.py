"""Comparable objects and overlay plans: equal to direct computation, and bounded work on many alike nodes."""

import random
import time

from pyspark.sql import functions as F

from lodegraph.operators import binding, graph, planner
from lodegraph.sources.tables import table

NODE = "node_id string, node_type string, content string, normalized_content string, address struct<paper_id:string,section_path:string,chunk_id:string,span:string>, modality string, confidence double, domain_schema_tag string, canonical_id string, node_ord bigint, ingested_at timestamp"
EDGE = "source string, target string, edge_type string, confidence double, polarity string, edge_ord bigint, ingested_at timestamp"


def node(key, kind, content, place, canonical=None, chunk="c", paper="p", section="s"):
    return (key, kind, content, content, (paper, section, chunk, "x"), "text", 1.0, "tag", canonical, place, None)


def comparable(spark, nodes, edges):
    n = spark.createDataFrame(nodes, NODE)
    return binding.comparable_objects(n.where("node_type = 'AttributeNode'").select(F.col("node_id").alias("attribute")), n, spark.createDataFrame(edges, EDGE))


def test_comparable_objects_equal_brute_force(spark):
    draw = random.Random(3)
    words = ["load", "peak", "mean", "time", "ratio", "film", "a/b", "Load"]
    names = {f"a{i}": (" ".join(draw.choices(words, k=draw.randint(0, 5))), draw.choice([None, "", "x", "y", "z"])) for i in range(60)}
    concepts = {f"c{i}": draw.randrange(12) for i in range(40)}
    edges = [(c, a, "has_attribute", draw.choice([None, 0.9, 0.2]), draw.choice([None, "positive", "negative"]), i, None) for i, (c, a) in enumerate({(draw.choice(list(concepts)), draw.choice(list(names))) for _ in range(70)})]
    got = {(r["attribute"], r["object"], r["place"]) for r in comparable(spark, [node(a, "AttributeNode", s, 0, i) for a, (s, i) in names.items()] + [node(c, "ConceptNode", c, o) for c, o in concepts.items()], edges + edges[:5]).collect()}
    split = lambda s: set(s.lower().replace("/", " ").split())
    want = set()
    for a, (s, identity) in names.items():
        fit = set()
        for c, b, _, sure, said, _, _ in edges:
            x, y = split(s), split(names[b][0])
            if (sure is None or sure >= 0.5) and said in (None, "positive") and ((identity and names[b][1] == identity) or len(x & y) > 0.5 * len(x | y)):
                fit.add((concepts[c], c))
        want |= {(a, c, i + 1) for i, (_, c) in enumerate(sorted(fit)[:3])}
    assert got == want and len(want) > 60


def test_comparable_objects_of_many_alike_attributes(spark):
    """6,000 attributes of one name: compared one by one that was 36 million pairs at each of three words."""
    n = 6000
    began = time.time()
    got = comparable(spark, [node(f"a{i}", "AttributeNode", "peak load ratio", i) for i in range(n)] + [node(f"c{i}", "ConceptNode", "rod", i) for i in range(n)], [(f"c{i}", f"a{i}", "has_attribute", 1.0, "positive", i, None) for i in range(n)])
    assert got.groupBy("object", "place").count().orderBy("place").collect() == [("c0", 1, n), ("c1", 2, n), ("c2", 3, n)]
    assert time.time() - began < 30


def test_walks_of_few_equal_the_joins(spark):
    draw = random.Random(5)
    kinds = ["ChunkNode", "ConceptNode", "AttributeNode", "ValueNode", "UnitNode", "SectionNode"]
    n = spark.createDataFrame([node(f"n{i:03}", draw.choice(kinds), "x", i) for i in range(150)], NODE)
    pairs = {(f"n{draw.randrange(150):03}", f"n{draw.choice((draw.randrange(150), 7, 8)):03}") for _ in range(600)} | {("n007", f"n{i:03}") for i in range(120)}
    e = spark.createDataFrame([(a, b, draw.choice(["contains", "compares", "has_value"]), 1.0, "positive", draw.choice([None, *range(30)]), None) for a, b in sorted(pairs)], EDGE)
    starts = [f"n{i:03}" for i in range(0, 150, 9)] + ["n007"]
    s = spark.createDataFrame([(x,) for x in starts], "node_id string")
    down, up = graph.walks_of_few(graph.clean(graph.leveled_edges(n, e)), starts)
    want = graph.downward_walk(n, e, s).select("start", "node", "place").collect()
    assert sorted(down) == sorted(map(tuple, want)) and max(p for _, _, p in down) == 40
    assert sorted(up) == sorted((r["start"], x, i) for r in graph.upward_locate(n, e, s).collect() for i, x in enumerate(r["chain"]))


def test_surroundings_hold_what_bindings_ask(spark):
    n, e = (table(spark, "/root/testdata/sf0.001", t) for t in ("nodes", "edges"))
    ids = n.where("node_ord % 40 = 3 and node_type in ('ConceptNode', 'ValueNode', 'AttributeNode')").select("node_id").distinct().cache()
    links = graph.cut_lineage(graph.same_as(n).select("source", "target"))
    asked = ids.select(F.col("node_id").alias("node"))
    near, around = graph.surroundings(n, e, ids, planner.members(n, ids).unionByName(links.select(F.explode(F.array("source", "target")).alias("node_id"))))
    got, want = (planner.binding_facts(*tables, asked, links).collect() for tables in ((near, around), (n, e)))
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 5


def test_plans_bind_over_the_surroundings_of_their_candidates(spark, monkeypatch):
    """Facts were joined over the whole graph, whose size then decided how long twelve plans took."""
    seen, facts = [], planner.binding_facts
    monkeypatch.setattr(planner, "binding_facts", lambda nodes, edges, *more: seen.append((nodes.count(), edges.count())) or facts(nodes, edges, *more))
    n, e = (table(spark, "/root/testdata/sf0.1", t) for t in ("nodes", "edges"))
    assert planner.plan(n, e, "comparative").count() == 12
    assert seen[0][0] < 0.5 * n.count() and seen[0][1] < 0.5 * e.count()


def actions(monkeypatch) -> list[str]:
    """What is run from here on: each is at least one job, whose plans the driver keeps."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []
    for name in ("checkpoint", "collect"):
        real = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, _real=real, _name=name, **k: (seen.append(_name), _real(self, *a, **k))[1])
    return seen


def test_numerical_plans_take_few_jobs(spark, folder, monkeypatch):
    """all facts of all bindings were joined for a type that binds no more than a unit."""
    seen = actions(monkeypatch)
    assert planner.plan(table(spark, folder, "nodes"), table(spark, folder, "edges"), "numerical").collect()
    assert len(seen) <= 12


def test_units_of_few_equal_value_units(spark):
    draw = random.Random(7)
    n = spark.createDataFrame([node(f"n{i:03}", draw.choice(["ConceptNode", "AttributeNode", "ValueNode", "ValueNode", "UnitNode", "OddNode"]), "x", i) for i in range(120)], NODE)
    pairs = sorted({(f"n{draw.randrange(120):03}", f"n{draw.randrange(130):03}") for _ in range(2500)})
    e = spark.createDataFrame([(a, b, draw.choice(["has_unit", "has_value", "contains"]), draw.choice([None, 0.9, 0.2]), draw.choice([None, "positive", "negative"]), o, None) for o, (a, b) in zip(draw.sample(range(9999), len(pairs)), pairs)], EDGE)
    ids = n.where("node_type = 'ValueNode' and node_ord % 3 > 0").select("node_id")
    got = binding.units_of_few(graph.clean(graph.leveled_edges(n, e)), ids).collect()
    want = binding.value_units(n, e).join(ids.withColumnRenamed("node_id", "value"), "value", "left_semi").where("unit_node is not null").select("value", "unit_node").collect()
    assert sorted(got) == sorted(want) and len(want) > 10


def test_plan_completeness_takes_few_jobs(spark, folder, monkeypatch):
    """the averages are those of the numerical plans, in one pass over them."""
    from lodegraph.plans import evidence

    plans = planner.plan(table(spark, folder, "nodes"), table(spark, folder, "edges"), "numerical").toPandas()
    seen = actions(monkeypatch)
    got = {r["metric"]: r["average"] for r in evidence.q_plan_completeness(spark, folder).collect()}
    assert len(seen) <= 12
    assert all(abs(got[c] - plans[c].mean()) < 0.00051 for c in ("utility", "role", "evidence", "constraint", "structure", "noise"))


def test_formula_plans_bind_the_unit_of_their_value_in_few_jobs(spark, monkeypatch):
    """the unit in another chunk, of the value or of its column, is all that a formula's roles ask of the graph."""
    nodes = [node("c", "ChunkNode", "the mean stress of the rod", 0), node("q", "EquationNode", "mean stress = axial load / section area", 1), node("a", "AttributeNode", "mean stress", 2), node("v", "ValueNode", "12.5", 3), node("u", "UnitNode", "MPa", 4, chunk="d"), node("d", "ChunkNode", "units of the tables", 5, chunk="d")]
    links = [("c", "q", "contains"), ("q", "a", "derived_from"), ("q", "v", "derived_from"), ("a", "v", "has_value"), ("a", "u", "has_unit")]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame([(a, b, kind, 1.0, "positive", i, None) for i, (a, b, kind) in enumerate(links)], EDGE)
    seen = actions(monkeypatch)
    (plan,) = planner.plan(n, e, "formula").collect()
    assert plan["roles"].split("|") == ["attribute_or_result=a", "equation=q", "evidence=c", "unit=u", "value=v"]
    assert len(seen) <= 12
