"""Overlay planning: seeds, roles, score-guided subgraphs and gates.

Seeds, candidates, links and gates are relational; only the choice inside one plan is sequential, so
one plan's candidates (bounded by LIMIT) are handed to a grouped map.

Defined results. All seeds of a type's pool are planned in parallel; the first ``per_type`` that pass
are kept, and an id counts the attempts before it. Candidates are ordered by (phase, place), which
replaces set order. A seed without candidates can still be a plan of its own.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators import binding
from lodegraph.operators.graph import chunk_mates, clean, first_of_places, gate, leveled_edges, present_edges, same_as, surroundings, take_nodes, unique_edges, walks_of_few
from lodegraph.operators.overlay import Overlay
from lodegraph.session import cut_lineage

LIMIT = 120
#: So many chunks of a seed's section are candidates.
SECTION_CHUNKS = 6
#: So many nodes of a seed's chunk are candidates, as chunk_mates gives.
MATES = 40
# Seed weights by node type.
SEED_LEVEL = {"ClaimNode": 1.0, "MethodNode": 0.95, "ConceptNode": 0.9, "AttributeNode": 0.7, "SectionNode": 0.6, "EquationNode": 0.55, "FigureNode": 0.5, "TableNode": 0.5, "ConditionNode": 0.45, "ValueNode": 0.3, "UnitNode": 0.1}
# The roles of each question type.
ROLE_SCHEMAS = {
    "comparative": ["object_A", "object_B", "shared_attribute", "value_A", "value_B", "unit", "aligned_condition", "evidence_A", "evidence_B", "comparison_criterion"],
    "mechanism": ["method_or_intervention", "intermediate_mechanism", "target_attribute", "observed_result", "supporting_evidence", "condition", "conclusion"],
    "condition": ["claim", "condition_boundary", "attribute_or_result", "evidence_span", "invalid_generalization_risk"],
    "cross_paper": ["canonical_concept", "paper_A_instance", "paper_B_instance", "aligned_attribute", "condition_A", "condition_B", "result_A", "result_B", "evidence_A", "evidence_B", "cross_paper_relation"],
    "numerical": ["concept", "attribute", "value", "unit", "condition", "evidence"],
    "formula": ["equation", "attribute_or_result", "value", "condition", "evidence"],
    "table": ["text_claim", "figure_or_table", "caption", "value", "evidence"],
    "multi_hop": ["concept", "attribute", "intermediate_node", "evidence", "conclusion"],
    "summary": ["section", "claim", "concept", "evidence"],
    "atomic": ["concept", "evidence"],
}
# The roles without which a plan is incomplete.
MIN_ROLE_SETS = {
    "comparative": ["object_A", "object_B", "shared_attribute", "value_A", "value_B", "evidence_A", "evidence_B"],
    "mechanism": ["method_or_intervention", "intermediate_mechanism", "target_attribute", "observed_result", "supporting_evidence"],
    "condition": ["claim", "condition_boundary", "attribute_or_result", "evidence_span"],
    "cross_paper": ["canonical_concept", "paper_A_instance", "paper_B_instance", "aligned_attribute", "evidence_A", "evidence_B"],
    "numerical": ["attribute", "value", "evidence"],
    "formula": ["equation", "evidence"],
    "table": ["figure_or_table", "evidence"],
    "multi_hop": ["concept", "intermediate_node", "evidence", "conclusion"],
    "summary": ["section", "claim"],
    "atomic": ["concept"],
}
# Node types that may fill a role.
ROLE_NODE_TYPES = {
    "object_A": ["ConceptNode", "MethodNode"],
    "object_B": ["ConceptNode", "MethodNode"],
    "shared_attribute": ["AttributeNode"],
    "aligned_attribute": ["AttributeNode"],
    "target_attribute": ["AttributeNode"],
    "attribute": ["AttributeNode"],
    "attribute_or_result": ["AttributeNode", "ValueNode", "ClaimNode"],
    "value": ["ValueNode"],
    "value_A": ["ValueNode"],
    "value_B": ["ValueNode"],
    "result_A": ["ValueNode", "ClaimNode"],
    "result_B": ["ValueNode", "ClaimNode"],
    "observed_result": ["ClaimNode", "ValueNode", "AttributeNode"],
    "unit": ["UnitNode"],
    "condition": ["ConditionNode"],
    "condition_A": ["ConditionNode"],
    "condition_B": ["ConditionNode"],
    "condition_boundary": ["ConditionNode"],
    "aligned_condition": ["ConditionNode"],
    "claim": ["ClaimNode"],
    "conclusion": ["ClaimNode"],
    "text_claim": ["ClaimNode"],
    "comparison_criterion": ["AttributeNode", "ClaimNode"],
    "method_or_intervention": ["MethodNode"],
    "intermediate_mechanism": ["ClaimNode", "MethodNode", "ConceptNode"],
    "intermediate_node": ["ConceptNode", "AttributeNode", "MethodNode", "ClaimNode"],
    "canonical_concept": ["ConceptNode", "AttributeNode", "ClaimNode"],
    "concept": ["ConceptNode", "MethodNode", "ClaimNode"],
    "paper_A_instance": ["ConceptNode", "AttributeNode", "ValueNode"],
    "paper_B_instance": ["ConceptNode", "AttributeNode", "ValueNode"],
    "equation": ["EquationNode"],
    "figure_or_table": ["FigureNode", "TableNode"],
    "caption": ["CaptionNode"],
    "section": ["SectionNode"],
    "evidence": ["EvidenceNode", "ChunkNode", "FigureNode", "TableNode", "ClaimNode", "ValueNode"],
    "evidence_A": ["EvidenceNode", "ChunkNode", "FigureNode", "TableNode", "ValueNode"],
    "evidence_B": ["EvidenceNode", "ChunkNode", "FigureNode", "TableNode", "ValueNode"],
    "evidence_span": ["EvidenceNode", "ChunkNode", "ClaimNode"],
    "supporting_evidence": ["EvidenceNode", "FigureNode", "TableNode", "ChunkNode", "ClaimNode"],
}
# Roles that no node fills, and the node types that a question type starts from.
ABSTRACT_ROLES = ["invalid_generalization_risk", "risk_of_overgeneralization", "comparison_criterion", "cross_paper_relation", "aligned_condition"]
SEED_TYPES = {
    "numerical": ["AttributeNode", "ValueNode"],
    "condition": ["ClaimNode", "ConditionNode", "AttributeNode"],
    "comparative": ["AttributeNode"],
    "mechanism": ["MethodNode", "ClaimNode"],
    "cross_paper": ["ConceptNode", "AttributeNode"],
    "table": ["FigureNode", "TableNode", "ClaimNode"],
    "formula": ["EquationNode"],
    "multi_hop": ["ConceptNode", "ClaimNode", "MethodNode"],
    "summary": ["SectionNode"],
    "atomic": ["ConceptNode", "ClaimNode", "MethodNode"],
}
GATED = {"ConceptNode", "AttributeNode", "MethodNode", "ClaimNode"}
# Weights, requirements and thresholds of the score.
PLUS = {"semantic": 0.8, "role": 1.5, "evidence": 1.3, "constraint": 1.0, "structure": 0.7, "difficulty": 0.8}
MINUS = {"shortcut": 1.2, "noise": 0.8}
NEEDS = {"L1": (1, 1, 0), "L2": (1, 2, 1), "L3": (2, 3, 2), "L4": (3, 4, 3)}
CONSTRAINED = {"numerical", "formula", "comparative", "table"}
PRIORITY = {"ConditionNode": 0.95, "ValueNode": 0.9, "EvidenceNode": 0.9, "UnitNode": 0.85, "FigureNode": 0.7, "TableNode": 0.7, "ClaimNode": 0.6, "AttributeNode": 0.6}


def seed_scores(nodes: DataFrame, edges: DataFrame, history: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, node_type, node_ord, ok, score) of every node, with the columns ``also``."""
    n = gate(nodes).select(*also, "node_id", "node_type", "node_ord", "ok", "domain_schema_tag", R.text(R.either("normalized_content", "content")).alias("name"))
    ends = unique_edges(edges).select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    n = n.join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEED_LEVEL.items() for x in kv]), F.col("node_type")), F.lit(0.4))
    tagged = F.when(F.coalesce("domain_schema_tag", F.lit("")) != "", 1.0).otherwise(0.3)
    vague = F.when(R.symbolic("name") | R.stopword("name"), 1.0).when(F.length("name") < 4, 0.5).otherwise(0.0)
    score = tagged + F.least(F.lit(1.0), F.col("degree") / 8) + 0.8 * weight - vague
    if history is not None:
        n = n.join(history.select("node_id", "boost"), "node_id", "left")
        score = score + 0.5 * F.coalesce("boost", F.lit(0.0))
    return n.select("node_id", "node_type", "node_ord", "ok", F.round(score, 6).alias("score"), *also)


def ranked_seeds(nodes: DataFrame, edges: DataFrame, kind: str, k: int = 48, history: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, place, score): the best k seeds of a question type, with the columns ``also``."""
    types = SEED_TYPES[kind]
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("node_type"))
    rows = seed_scores(nodes, edges, history, also).where(F.col("node_type").isin(types)).where("ok").withColumn("t", rank)
    order = [F.desc("score"), "t", "node_ord"]
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("node_id", "place", "score", *also)


def members(nodes: DataFrame, of: DataFrame, *within: str) -> DataFrame:
    """(node_id): the nodes in one of the chunks, or of the other places ``within``, of the few nodes ``of`` (node_id), which are sent to every task."""
    places = nodes.select("node_id", "node_type", F.col("address.chunk_id").alias("chunk"), F.col("address.paper_id").alias("paper"), F.col("address.section_path").alias("section"))
    mine = cut_lineage(places.join(F.broadcast(of.select("node_id").distinct()), "node_id", "left_semi"))
    rows = places.join(F.broadcast(mine.select("chunk").where("chunk is not null").distinct()), "chunk", "left_semi").select("node_id")
    if within:
        rows = rows.unionByName(places.where("node_type = 'ChunkNode'").join(F.broadcast(mine.select(*within).dropna().distinct()), list(within), "left_semi").select("node_id"))
    return rows.distinct()


def candidates(nodes: DataFrame, seeds: dict[str, Row | None], leveled: DataFrame) -> list[tuple[str, str, int]]:
    """(seed, node, r): the evidence below, above and beside each of the few seeds (their addresses by id), then the first chunks of its section, at most LIMIT, nearest first.

    Each phase is bounded for each seed, so they are put in order by the driver."""
    down, up = walks_of_few(leveled, sorted(seeds))
    held = {s: a for s, a in seeds.items() if a is not None}
    sections = {s: (a["paper_id"], a["section_path"]) for s, a in held.items() if a["paper_id"] is not None and a["section_path"] is not None}
    mates, first = first_of_places(nodes, {a["chunk_id"] for a in held.values() if a["chunk_id"] is not None}, set(sections.values()), MATES + 1)
    found = [(s, n, (phase, place)) for phase, rows in enumerate((down, up)) for s, n, place in rows]
    for s, a in held.items():
        found += [(s, n, (2, i)) for i, n in enumerate([n for n in mates.get(a["chunk_id"], ()) if n != s][:MATES])]
        found += [(s, n, (3, i)) for i, n in enumerate(first.get(sections.get(s), ())[:SECTION_CHUNKS])]
    best: dict[str, dict[str, tuple[int, int]]] = {s: {} for s in seeds}
    for s, n, at in found:
        best[s][n] = min(at, best[s].get(n, at))
    return [(s, n, r) for s, at in best.items() for r, n in enumerate(sorted(at, key=lambda n: (at[n], n))[:LIMIT], 1)]


def role_share(kind: str, filled: set[str]) -> float:
    least = MIN_ROLE_SETS[kind]
    return sum(r in filled or r in ABSTRACT_ROLES for r in least) / len(least) if least else 1.0


def assign_roles(kind: str, seed: str, seed_type: str, order: list[tuple[str, str, bool]]) -> dict[str, str]:
    """Roles by type: the seed takes its first fitting role, evidence last; each other role the first unused candidate."""
    wanted = [r for r in ROLE_SCHEMAS[kind] if r not in ABSTRACT_ROLES]
    fitting = [r for r in wanted if seed_type in ROLE_NODE_TYPES.get(r, ())]
    own = next((r for r in fitting if "evidence" not in r), fitting[0] if fitting else None)
    out = {own: seed} if own else {}
    free = [(n, t, ok) for n, t, ok in order if n != seed]
    for role in wanted:
        if role in out:
            continue
        at = next((i for i, (_, t, ok) in enumerate(free) if t in ROLE_NODE_TYPES.get(role, ()) and (ok or t not in GATED)), None)
        if at is not None:
            out[role] = free.pop(at)[0]
    return out


class PlanScore:
    """The parts of one plan's score, kept up to date while nodes are added."""

    def __init__(self, kind: str, facts: dict[str, dict], links: dict[str, set[str]], assigned: dict[str, str], theme: str) -> None:
        self.kind, self.facts, self.links, self.assigned = kind, facts, links, assigned
        self.theme = {w for w in theme.lower().replace("/", " ").split() if len(w) > 1}

    def parts(self, nodes: list[str], difficulty: str) -> dict[str, float]:
        f = [self.facts[n] for n in nodes]
        grounded = [bool(x["chunk"] or x["span"] or x["section"]) for x in f]
        kinds = {x["type"] for x in f}
        least = MIN_ROLE_SETS[self.kind]
        key = [r for r in least if r in self.assigned and ("evidence" in r or self.facts[self.assigned[r]]["type"] in ("ValueNode", "EvidenceNode", "FigureNode", "TableNode", "ChunkNode"))] or [r for r in least if r in self.assigned]
        held = [self.facts[self.assigned[r]] for r in key]
        words = {w for x in f for w in x["name"].lower().replace("/", " ").split()}
        chunks = {x["chunk"] for x in f if x["chunk"]}
        need = NEEDS[difficulty]
        ratios = [min(1.0, have / want) if want else 1.0 for have, want in zip((len(chunks), sum(grounded), max(0, len(nodes) - 1)), need)]
        parts = {
            "semantic": len(self.theme & words) / len(self.theme) if self.theme else 0.5,
            "role": role_share(self.kind, set(self.assigned)),
            "evidence": sum(bool(x["chunk"] or x["span"] or x["section"]) for x in held) / len(held) if held else 0.0,
            "constraint": sum(t in kinds for t in ("ValueNode", "UnitNode", "ConditionNode")) / 3,
            "structure": self._largest(nodes) / len(nodes),
            "difficulty": sum(ratios) / 3,
            "shortcut": 1.0 if difficulty in ("L3", "L4") and len(chunks) <= 1 else 0.5 if difficulty == "L2" and not chunks else 0.0,
            "noise": sum(not x["ok"] for x in f) / len(f),
        }
        parts["total"] = round(sum(w * parts[k] for k, w in PLUS.items()) - sum(w * parts[k] for k, w in MINUS.items()), 4)
        return parts

    def _largest(self, nodes: list[str]) -> int:
        inside, best = set(nodes), 0
        while inside:
            todo, size = [inside.pop()], 0
            while todo:
                size += 1
                near = self.links.get(todo.pop(), set()) & inside
                inside -= near
                todo += near
            best = max(best, size)
        return best


def difficulty_cap(chunks: int, path: int) -> str:
    return ("L1" if path <= 1 else "L2") if chunks <= 1 else "L3" if chunks == 2 else "L4"


def difficulty_cap_column(chunks: Column | str, path: Column | str) -> Column:
    c, p = (F.col(x) if isinstance(x, str) else x for x in (chunks, path))
    return F.when((c <= 1) & (p <= 1), "L1").when(c <= 1, "L2").when(c == 2, "L3").otherwise("L4")


def sufficient(parts: dict[str, float], kind: str) -> bool:
    return parts["role"] >= 0.99 and parts["evidence"] >= 0.6 and (kind not in CONSTRAINED or parts["constraint"] >= 0.5) and parts["structure"] >= 0.5 and parts["difficulty"] >= 0.5 and parts["shortcut"] <= 0.5


def dual_multi_hop(difficulty: str, chunks: int, path: int) -> bool:
    return difficulty not in ("L3", "L4") or (chunks >= 2 and path >= (2 if difficulty == "L3" else 3))


def dual_multi_hop_column(difficulty: Column | str, chunks: Column | str, path: Column | str) -> Column:
    d, c, p = (F.col(x) if isinstance(x, str) else x for x in (difficulty, chunks, path))
    return ~d.isin("L3", "L4") | ((c >= 2) & (p >= F.when(d == "L3", 2).otherwise(3)))


PLAN = "seed string, seed_place int, roles string, nodes array<string>, difficulty string, utility double, role double, evidence double, constraint double, structure double, difficulty_match double, shortcut double, noise double, passed boolean, pattern string, overlay string"


#: A node brings at most so many values and cells into a plan.
BOUND = 40


#: Question types whose roles are bound along edges or cells; comparable objects need the same facts.
BINDING = ("comparative", "cross_paper")
#: Those that bind no more than a value's unit. No edge is ever proposed for them (a figure or table among the
#: candidates already is the evidence), so they never ask for a backing path or another fact.
UNIT_BINDING = ("numerical", "formula")


def binding_facts(nodes: DataFrame, edges: DataFrame, ids: DataFrame, same: DataFrame) -> DataFrame:
    """(node, attrs, columns, row, unit, peer, result) of every node of ``ids`` (node): what bindings may bring into a plan, the first BOUND of each. ``same`` are same_as links; nodes and edges may be no more than the surroundings of ``ids``."""
    chains = cut_lineage(binding.values_via_attribute(nodes, edges).join(ids.select(F.col("node").alias("object")), "object", "left_semi"))
    attrs = chains.groupBy(F.col("object").alias("node")).agg(F.slice(F.array_sort(F.collect_set(F.struct("attribute", "value"))), 1, BOUND).alias("attrs"))
    cells = cut_lineage(binding.table_rows(nodes, edges))
    columns = cells.groupBy(F.col("row").alias("node")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "column", "cell"))), 1, BOUND), lambda x: F.struct(x["column"].alias("column"), x["cell"].alias("cell"))).alias("columns"))
    rows = binding.owning_rows(nodes, edges, cells).select(F.col("node_id").alias("node"), "row").where("node != row")
    units = binding.value_units(nodes, edges).where("unit_node is not null").select(F.col("value").alias("node"), F.col("unit_node").alias("unit"))
    n = cut_lineage(gate(nodes).select("node_id", "node_type", "ok", F.coalesce("address.paper_id", F.lit("")).alias("paper")))
    real = n.where(F.col("node_type").isin("ConceptNode", "MethodNode", "ValueNode") & F.col("ok")).select(F.col("node_id").alias("peer"))
    peers = binding.peers(nodes, same).where("other_paper").join(real, "peer", "left_semi").groupBy(F.col("node_id").alias("node")).agg(F.min("peer").alias("peer"))
    papers = n.select(F.col("node_id").alias("node"), "paper")
    own = chains.select(F.col("object").alias("node"), F.col("value").alias("found"), F.lit(0).alias("rank"))
    mates = chunk_mates(nodes, of=ids.select(F.col("node").alias("node_id"))).select(F.col("node_id").alias("node"), F.col("mate").alias("found"), F.col("place").alias("rank"))
    good = n.where(F.col("ok") & F.col("node_type").isin("ValueNode", "ClaimNode")).select(F.col("node_id").alias("found"), F.col("paper").alias("of"))
    results = own.unionByName(mates).join(good, "found").join(papers, "node").where("of = paper").groupBy("node").agg(F.min_by("found", F.struct("rank", "found")).alias("result"))
    out = ids.select("node", F.lit(True).alias("asked"))
    for facts in (attrs, columns, rows, units, peers, results):
        out = out.unionByName(facts, allowMissingColumns=True)
    return out.groupBy("node").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("asked", "attrs", "columns", "row", "unit", "peer", "result")]).where("asked").drop("asked")  # each fact is in one row of a node


def linked_to(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links (source, target) at one of the few nodes of ``ids`` (node)."""
    return links.join(F.broadcast(ids.select(F.col("node").alias("source"))), "source", "left_semi").select("source", "target").unionByName(links.join(F.broadcast(ids.select(F.col("node").alias("target"))), "target", "left_semi").select("source", "target"))


def _local(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows of the driver."""
    return spark.createDataFrame(pa.table({c: pa.array([x[i] for x in rows], kind) for i, (c, kind) in enumerate(columns.items())}))


def node_facts(nodes: DataFrame) -> DataFrame:
    """(node, node_type, ok, name, canonical, chunk, span, section, paper): what a plan knows of a node."""
    return gate(nodes).select(F.col("node_id").alias("node"), "node_type", "ok", R.either("normalized_content", "content").alias("name"), F.coalesce("canonical_id", F.lit("")).alias("canonical"), F.coalesce("address.chunk_id", F.lit("")).alias("chunk"), F.coalesce("address.span", F.lit("")).alias("span"), F.coalesce("address.section_path", F.lit("")).alias("section"), F.coalesce("address.paper_id", F.lit("")).alias("paper"))


def _few_rows(nodes: DataFrame, leveled: DataFrame, base: list[tuple[str, str, int]], place: dict[str, int], units: bool) -> DataFrame:
    """(seed, node, r, place, unit, facts, targets) of the candidates ``base``, of the units of these, and of the chunks of all: at most four nodes for each candidate, so they are listed by the driver and sent to every task."""
    spark = nodes.sparkSession
    ids = {n for _, n, _ in base}
    few = lambda some: F.broadcast(_local(spark, [(n,) for n in sorted(some)], node_id=pa.string()))
    unit = dict(map(tuple, binding.units_of_few(leveled, few(ids)).collect())) if units and ids else {}
    asked = ids | set(unit.values())
    chunk = dict(map(tuple, take_nodes(nodes.select("node_id", "address"), few(asked)).select("node_id", "address.chunk_id").where("chunk_id != ''").collect())) if asked else {}
    own: dict[str, set[str]] = {s: set() for s in place}
    for s, n, _ in base:
        own[s].add(n)
    rows = list(base)
    for s, known in own.items():
        more = known | {unit[n] for n in known if n in unit}
        rows += [(s, n, LIMIT + 1) for n in sorted((more | {chunk[n] for n in more if n in chunk}) - known)]
    listed = _local(spark, [(s, n, r, place[s], unit.get(n)) for s, n, r in rows], seed=pa.string(), node=pa.string(), r=pa.int32(), place=pa.int32(), unit=pa.string())
    facts = node_facts(nodes.join(few({n for _, n, _ in rows}), "node_id", "left_semi"))
    at = lambda end: F.broadcast(listed.select("seed", F.col("node").alias(end)))
    inner = leveled.select("source", "target").join(few({n for _, n, _ in rows}).withColumnRenamed("node_id", "target"), "target", "left_semi")
    near = inner.join(at("source"), "source").join(at("target"), ["seed", "target"], "left_semi").groupBy("seed", F.col("source").alias("node")).agg(F.collect_set("target").alias("targets"))
    return facts.join(F.broadcast(listed), "node").join(near, ["seed", "node"], "left")


def _bound_rows(nodes: DataFrame, leveled: DataFrame, base: list[tuple[str, str, int]], place: dict[str, int], _: bool) -> DataFrame:
    """The rows of _few_rows, with all that bindings may bring into a plan."""
    base = _local(nodes.sparkSession, base, seed=pa.string(), node=pa.string(), r=pa.int32())
    seeds = _local(nodes.sparkSession, list(place.items()), seed=pa.string(), place=pa.int32())
    ids = cut_lineage(base.select("node").distinct())
    links = cut_lineage(same_as(nodes).select("source", "target"))
    other = cut_lineage(linked_to(links, ids).distinct())
    close = clean(take_nodes(nodes.select("node_id", "address"), F.broadcast(other.select(F.explode(F.array("source", "target")).alias("node_id")).distinct())))
    peers = binding.peers(close, other).where("other_paper").select(F.col("node_id").alias("node"), F.col("peer")).join(ids, "node", "left_semi").select(F.col("peer").alias("node"))
    ids = cut_lineage(ids.unionByName(peers).distinct())
    same = cut_lineage(linked_to(links, ids).distinct())
    named = ids.select(F.col("node").alias("node_id"))
    near, around = surroundings(nodes, leveled, named, members(nodes, named).unionByName(same.select(F.explode(F.array("source", "target")).alias("node_id"))))
    bound = cut_lineage(binding_facts(near, around, ids, same))
    chunked = near.select(F.col("address.chunk_id").alias("node_id")).where("node_id is not null").distinct().join(near, "node_id", "left_anti")
    known_nodes = clean(near.unionByName(take_nodes(nodes, chunked)))
    facts = node_facts(known_nodes)
    brought = F.array_compact(F.concat(F.array("row", "unit", "peer", "result"), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("attrs.attribute", "attrs.value", "columns.column", "columns.cell")]))
    one = base.join(bound.select("node", F.explode(brought).alias("other")), "node").select("seed", F.col("other").alias("node"))
    two = one.join(bound.select("node", F.explode(F.array_compact(F.array("result", "unit"))).alias("other")), "node").select("seed", F.col("other").alias("node"))
    known = one.unionByName(two).unionByName(base.select("seed", "node"))
    chunks = known.join(facts.select("node", "chunk"), "node").where("chunk != ''").select("seed", F.col("chunk").alias("node"))
    extra = known.unionByName(chunks).distinct().join(base.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("r", F.lit(LIMIT + 1))
    rows = base.unionByName(extra).join(facts, "node").join(seeds, "seed").join(bound, "node", "left")
    rows = cut_lineage(rows)
    inside = rows.select("node").distinct()
    inner = leveled.select(F.col("source").alias("node"), "target").join(inside, "node", "left_semi")
    near = rows.select("seed", "node").join(inner, "node").join(rows.select("seed", F.col("node").alias("target")), ["seed", "target"], "left_semi").groupBy("seed", "node").agg(F.collect_set("target").alias("targets"))
    return rows.join(near, ["seed", "node"], "left")


def plan(nodes: DataFrame, edges: DataFrame, kind: str, per_type: int = 12, tau: float = 0.0, max_expand: int = 12, history: DataFrame | None = None, score_guided: bool = True, use_binding: bool = True, use_overlay: bool = True, use_dual_multihop: bool = True, use_sufficiency: bool = True, leveled: DataFrame | None = None) -> DataFrame:
    """(plan_id, seed, roles, nodes, difficulty, utility and parts, overlay): the first ``per_type`` plans that pass.

    The five flags leave out score-guided choice, bindings, virtual completion, the multi-hop gate and the sufficiency gate.
    ``leveled`` are clean leveled_edges, if several types are planned over one graph."""
    nodes = nodes.select("node_id", "node_type", "content", "normalized_content", "address", "domain_schema_tag", "canonical_id", "node_ord")  # so much is written
    seeds = ranked_seeds(nodes, edges, kind, 4 * per_type, history, ("address",)).collect()
    leveled = clean(leveled_edges(nodes, edges)) if leveled is None else leveled
    place = {s["node_id"]: s["place"] for s in seeds}
    base = [(s, n, r) for s, n, r in candidates(nodes, {s["node_id"]: s["address"] for s in seeds}, leveled) if s != n] + [(s, s, 0) for s in place]
    bind = _bound_rows if use_binding and kind in BINDING else _few_rows
    rows = bind(nodes, leveled, base, place, use_binding and kind in UNIT_BINDING)
    weights = {**VIRTUAL, **VIRTUAL_BY_TYPE.get(kind, {})}

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["r", "node"])
        listed = lambda x: [dict(y) for y in x] if x is not None and not isinstance(x, float) else []
        text = lambda x: x if isinstance(x, str) else None
        facts, order = {}, []
        for row in g.to_dict("records"):
            facts[row["node"]] = {"type": row["node_type"], "ok": bool(row["ok"]), "attrs": listed(row.get("attrs")), "columns": listed(row.get("columns")), **{k: text(row.get(k)) for k in ("name", "canonical", "chunk", "span", "section", "paper", "row", "unit", "peer", "result")}}
            if row["r"] <= LIMIT:
                order.append(row["node"])
        links: dict[str, set[str]] = {}
        for node, targets in zip(g["node"], g["targets"]):
            for t in targets if targets is not None and not isinstance(targets, float) else ():
                links.setdefault(node, set()).add(t)
                links.setdefault(t, set()).add(node)
        seed = g["seed"].iloc[0]
        assigned = assign_roles(kind, seed, facts[seed]["type"], [(n, facts[n]["type"], facts[n]["ok"]) for n in order])
        overlay = Overlay(kind, facts, links, order, assigned)
        if use_binding:
            overlay.bind()
        missing = [r for r in MIN_ROLE_SETS[kind] if r not in ABSTRACT_ROLES and not assigned.get(r)]
        if use_overlay and missing:
            overlay.complete(missing, weights, COMPATIBLE)
        overlay.ground(seed, MIN_ROLE_SETS[kind], ABSTRACT_ROLES)
        if kind == "cross_paper":
            overlay.fix_papers()
        order = list(dict.fromkeys([*order, *overlay.added]))
        score = PlanScore(kind, facts, links, assigned, facts[seed]["name"][:80])
        chosen = list(dict.fromkeys([seed, *assigned.values()]))
        base, parts = len(chosen), score.parts(chosen, "L1")
        extra = sorted((n for n in order if n not in chosen), key=lambda n: -(PRIORITY.get(facts[n]["type"], 0.4) + 0.05 * bool(facts[n]["chunk"])))
        if not score_guided:
            chosen += extra[:max_expand]
        for n in extra if score_guided else ():
            if len(chosen) >= base + max_expand:
                break
            trial = score.parts([*chosen, n], "L1")
            if trial["total"] - parts["total"] > tau:
                chosen, parts = [*chosen, n], trial
        chunks = len({facts[n]["chunk"] for n in chosen if facts[n]["chunk"]})
        level = difficulty_cap(chunks, len(chosen) - 1)
        parts = score.parts(chosen, level)
        passed = (not use_sufficiency or sufficient(parts, kind)) and (not use_dual_multihop or dual_multi_hop(level, chunks, len(chosen) - 1)) and (kind != "cross_paper" or overlay.two_papers())
        pattern = kind + ":" + "→".join(sorted({facts[n]["type"] for n in chosen}))
        edges = "|".join(f"{e['role']}:{e['intent']}:{e['source']}>{e['target']}:{e['score']}" for e in overlay.edges)
        row = (seed, int(g["place"].iloc[0]), "|".join(f"{r}={n}" for r, n in sorted(assigned.items())), chosen, level, parts["total"], *(float(parts[k]) for k in ("role", "evidence", "constraint", "structure", "difficulty", "shortcut", "noise")), bool(passed), pattern, edges)
        return pd.DataFrame([row], columns=[c.split()[0] for c in PLAN.split(", ")])

    tried = rows.groupBy("seed").applyInPandas(choose, PLAN)
    w = Window.orderBy("seed_place")  # at most 4 * per_type rows
    counted = tried.withColumn("attempt", F.row_number().over(w)).withColumn("success", F.sum(F.col("passed").cast("int")).over(w))
    kept = counted.where("passed").where(F.col("success") <= per_type)
    return kept.select(F.format_string("sp%06d", F.col("attempt")).alias("plan_id"), F.lit(kind).alias("question_type"), "seed", "roles", "nodes", "difficulty", "utility", "role", "evidence", "constraint", "structure", "difficulty_match", "shortcut", "noise", "pattern", "overlay")


def roles_map(plans: DataFrame) -> DataFrame:
    """Plans with ``roles`` as a map from role to node."""
    return plans.withColumn("roles", F.when(F.coalesce("roles", F.lit("")) == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.str_to_map("roles", F.lit(r"\|"), F.lit("="))))


def distinct_plans(plans: DataFrame) -> DataFrame:
    """(plan_id, question_type, copies): plans without those that repeat another's type and node set; the first id stays."""
    key = F.array_sort(F.array_distinct("nodes"))
    return plans.withColumn("key", key).groupBy("question_type", "key").agg(F.min("plan_id").alias("plan_id"), F.count("*").alias("copies")).select("plan_id", "question_type", "copies")


def memory(runs: DataFrame) -> DataFrame:
    """(pattern, tried, succeeded, rate) of (pattern, passed)."""
    return runs.groupBy("pattern").agg(F.count("*").alias("tried"), F.sum(F.col("passed").cast("bigint")).alias("succeeded"), F.avg(F.col("passed").cast("double")).alias("rate"))


def seed_boost(successes: DataFrame) -> DataFrame:
    """(node_id, boost): a seed's successes as a share of the most successful one's."""
    counts = successes.groupBy("node_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0]
    return counts.select("node_id", (F.col("n") / F.lit(most)).alias("boost"))


# Weights of a virtual edge's features, and their changes by question type.
VIRTUAL = {"goal": 1.0, "similarity": 0.8, "schema": 1.0, "backing": 1.2, "diversity": 0.8, "difficulty": 0.6, "condition": 0.7, "shortcut": -1.0, "ambiguity": -1.0}
VIRTUAL_BY_TYPE = {"comparative": {"schema": 1.3, "condition": 1.2}, "mechanism": {"backing": 1.5, "diversity": 1.1}, "condition": {"condition": 1.4}, "cross_paper": {"similarity": 1.1, "diversity": 1.2}}
COMPATIBLE = {"MethodNode": ["ClaimNode", "AttributeNode", "ConceptNode"], "AttributeNode": ["ValueNode", "UnitNode", "ConditionNode", "ConceptNode"], "ConceptNode": ["AttributeNode", "ConceptNode", "ClaimNode"], "ClaimNode": ["ConditionNode", "FigureNode", "TableNode", "EvidenceNode", "ValueNode"]}


def virtual_edges(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str, with_role: bool = True) -> DataFrame:
    """(source, target, similarity, schema, backing, diversity, score): proposed links with their score; only backed ones can be accepted."""
    n = gate(nodes).select("node_id", "node_type", R.either("normalized_content", "content").alias("name"), F.coalesce("address.chunk_id", F.lit("")).alias("chunk"), F.coalesce("address.paper_id", F.lit("")).alias("paper"))
    a = n.select(*[F.col(c).alias(f"a_{c}") for c in n.columns])
    b = n.select(*[F.col(c).alias(f"b_{c}") for c in n.columns])
    direct = present_edges(edges, nodes).select(F.array_sort(F.array("source", "target")).alias("ends")).distinct().withColumn("backed", F.lit(1.0))
    rows = pairs.select("source", "target").distinct().join(a, F.col("source") == F.col("a_node_id")).join(b, F.col("target") == F.col("b_node_id"))
    rows = rows.withColumn("ends", F.array_sort(F.array("source", "target"))).join(direct, "ends", "left")
    one = [F.concat_ws("|", F.lit(x), F.lit(y)) for x, ys in COMPATIBLE.items() for y in ys]
    fits = F.array_contains(F.array(*one), F.concat_ws("|", "a_node_type", "b_node_type")) | F.array_contains(F.array(*one), F.concat_ws("|", "b_node_type", "a_node_type"))
    schema = F.when(fits, 1.0).otherwise(0.3)
    apart = (F.col("a_chunk") == "") | (F.col("b_chunk") == "") | (F.col("a_chunk") != F.col("b_chunk"))
    features = {
        "goal": F.lit(1.0 if with_role else 0.3), "similarity": R.jaccard(F.col("a_name"), F.col("b_name")), "schema": schema, "backing": F.coalesce("backed", F.lit(0.0)),
        "diversity": 0.5 * apart.cast("double") + 0.5 * (F.col("a_paper") != F.col("b_paper")).cast("double"), "condition": ((F.col("a_node_type") == "ConditionNode") | (F.col("b_node_type") == "ConditionNode")).cast("double"), "ambiguity": 1 - schema,
    }
    weights = {**VIRTUAL, **VIRTUAL_BY_TYPE.get(kind, {})}
    total = sum((weights[k] * c for k, c in features.items()), F.lit(0.0))
    return rows.select("source", "target", *[features[k].alias(k) for k in ("similarity", "schema", "backing", "diversity")], F.round(total, 4).alias("score"))
