"""Evidence-graph building and bounded traversal.

Nodes and edges are tables keyed by node id and by (source, target). Order is explicit: ``node_ord``
and ``edge_ord``; a node's neighbours are its out edges by ``edge_ord``, then its in edges by
``edge_ord``. Walks are unrolled joins whose frontier is cut to its allowed size after every hop, so
a hub can't blow up a frontier, and every rank is taken within a key by a window that Spark limits
before the shuffle.

Defined results. Records delivered twice count once. Edges with an end that is no node are dropped.
A missing polarity reads as positive, a missing confidence as 1. Null ids are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.session import cut_lineage

# Level of each node type, and the edge types that lead down.
LEVELS = {"PaperNode": 0, "TitleNode": 1, "SectionNode": 2, "ChunkNode": 3, "ClaimNode": 4, "MethodNode": 4, "ConceptNode": 4, "AttributeNode": 5, "ConditionNode": 6, "FigureNode": 6, "TableNode": 6, "EquationNode": 6, "ValueNode": 7, "CaptionNode": 7, "EvidenceNode": 7, "UnitNode": 8}
DOWNWARD = ["contains", "has_attribute", "has_value", "has_unit", "under_condition", "supports", "describes", "derived_from", "references"]
LEADS_DOWN = f"edge_type in ({', '.join(map(repr, DOWNWARD))}) or lt >= ls"
# Which type pairs make which edge, in their canonical direction.
PAIR_RULES = [("ConceptNode", "AttributeNode", "has_attribute"), ("AttributeNode", "ValueNode", "has_value"), ("ValueNode", "UnitNode", "has_unit"), ("ConditionNode", "ValueNode", "under_condition"), ("ConditionNode", "AttributeNode", "under_condition"), ("TableNode", "ClaimNode", "supports"), ("FigureNode", "ClaimNode", "supports"), ("EquationNode", "AttributeNode", "derived_from"), ("EquationNode", "ValueNode", "derived_from"), ("FigureNode", "ConceptNode", "describes"), ("TableNode", "ConceptNode", "describes"), ("ConceptNode", "ConceptNode", "compares")]


def clean(df: DataFrame) -> DataFrame:
    """Marks written nodes as unique, or written edges as unique and with both ends among the nodes they are used with, so neither is asked again; whatever is derived from ``df`` isn't marked."""
    df = cut_lineage(df)
    df.lodegraph_clean = True
    return df


def is_clean(df: DataFrame) -> bool:
    return getattr(df, "lodegraph_clean", False) is True


def unique_nodes(nodes: DataFrame) -> DataFrame:
    return nodes if is_clean(nodes) else nodes.where("node_id is not null").dropDuplicates(["node_id"])


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges if is_clean(edges) else edges.where("source is not null and target is not null").dropDuplicates(["source", "target"])


def upsert_edges(edges: DataFrame) -> DataFrame:
    """The last written edge of each pair at the pair's first position."""
    last = F.max_by(F.struct("edge_type", "polarity", "confidence"), F.struct("edge_ord", "ingested_at"))
    return edges.where("source is not null and target is not null").groupBy("source", "target").agg(F.min("edge_ord").alias("position"), last.alias("l")).select("source", "target", "position", "l.edge_type", "l.polarity", "l.confidence")


def present_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    if is_clean(edges):
        return edges
    ids = unique_nodes(nodes).select("node_id")
    return unique_edges(edges).join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def level(node_type: Column | str) -> Column:
    t = F.col(node_type) if isinstance(node_type, str) else node_type
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), t), F.lit(5))


def leveled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, edge_type, confidence, polarity, edge_ord, ls, of_attribute, lt): present edges with the levels of both ends and whether they start at an attribute."""
    n = unique_nodes(nodes).select("node_id", level("node_type").alias("level"), (F.col("node_type") == "AttributeNode").alias("attribute"))
    e = unique_edges(edges).select("source", "target", "edge_type", "confidence", "polarity", "edge_ord")
    return e.join(n.select(F.col("node_id").alias("source"), F.col("level").alias("ls"), F.col("attribute").alias("of_attribute")), "source").join(n.select(F.col("node_id").alias("target"), F.col("level").alias("lt")), "target")


def take_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The unique nodes of ``ids`` (node_id); all copies of a node are kept or dropped together, before one is chosen."""
    return unique_nodes(nodes.join(ids, "node_id", "left_semi"))


def surroundings(nodes: DataFrame, edges: DataFrame, ids: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean nodes and edges that hold whatever bindings ask about the few nodes of ``ids`` (node_id), which are sent to every task; ``more`` (node_id) are nodes that are wanted besides.

    These are the edges at a node of ``ids``, those from the ends of these, and the values' edges into what any of them
    leads to: values by attribute, cells of a row and of the row above, the column of a cell, units of values and columns."""
    few = F.broadcast(ids.select("node_id").distinct())
    known = edges.select("source", "target", "edge_type", "confidence", "polarity", "edge_ord")
    at = lambda rows, end, some: rows.join(some.select(F.col("node_id").alias(end)), end, "left_semi").select(*known.columns)
    touching = cut_lineage(at(known, "source", few).unionByName(at(known, "target", few)))
    ends = touching.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    below = cut_lineage(at(known, "source", ends))
    reached = touching.unionByName(below).select(F.col("target").alias("node_id")).distinct()
    rows = touching.unionByName(below).unionByName(at(known.where("edge_type = 'has_value'"), "target", reached))
    rows = cut_lineage(rows.where("source is not null and target is not null").dropDuplicates(["source", "target"]))
    wanted = rows.select(F.explode(F.array("source", "target")).alias("node_id")).unionByName(ids.select("node_id"))
    found = clean(take_nodes(nodes, (wanted if more is None else wanted.unionByName(more.select("node_id"))).distinct()))
    return found, clean(present_edges(rows, found))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, degree): in and out edges of every node."""
    ends = unique_edges(edges).select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return unique_nodes(nodes).select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbour, edge_type, side, place): each edge seen from both ends, in neighbour order."""
    e = present_edges(edges, nodes)
    out = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "edge_type", F.lit(0).alias("side"), F.col("edge_ord").alias("place"))
    into = e.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "edge_type", F.lit(1).alias("side"), F.col("edge_ord").alias("place"))
    return out.unionByName(into)


def canonical_groups(nodes: DataFrame) -> DataFrame:
    """(canonical_id, members, papers, modalities) of every identity shared by at least two nodes."""
    n = unique_nodes(nodes).where("canonical_id is not null and canonical_id != ''")
    return n.groupBy("canonical_id").agg(F.count("*").alias("members"), F.countDistinct("address.paper_id").alias("papers"), F.countDistinct("modality").alias("modalities")).where("members > 1")


def same_as(nodes: DataFrame) -> DataFrame:
    """(source, target): per identity one representative of each paper, chained in node order."""
    n = unique_nodes(nodes).where("canonical_id is not null and canonical_id != '' and address.paper_id is not null").where(F.col("node_type").isin("ConceptNode", "AttributeNode", "MethodNode"))
    first = n.groupBy("canonical_id", F.col("address.paper_id").alias("paper_id")).agg(F.min_by("node_id", "node_ord").alias("node_id"), F.min("node_ord").alias("node_ord"))
    w = Window.partitionBy("canonical_id").orderBy("node_ord")
    return first.withColumn("target", F.lead("node_id").over(w)).where("target is not null").select(F.col("node_id").alias("source"), "target", "canonical_id")


def aligns_with(nodes: DataFrame) -> DataFrame:
    """(source, target): consecutive members of an identity inside a paper that shows it in several modalities."""
    n = unique_nodes(nodes).where("canonical_id is not null and canonical_id != ''").where(F.col("node_type").isin("ConceptNode", "AttributeNode"))
    n = n.select("node_id", "node_ord", "canonical_id", "modality", F.col("address.paper_id").alias("paper_id"))
    wide = n.groupBy("canonical_id", "paper_id").agg(F.countDistinct("modality").alias("m")).where("m > 1").select("canonical_id", "paper_id")
    w = Window.partitionBy("canonical_id", "paper_id").orderBy("node_ord")
    return n.join(wide, ["canonical_id", "paper_id"]).withColumn("target", F.lead("node_id").over(w)).where("target is not null").select(F.col("node_id").alias("source"), "target")


def pair_semantics() -> list[tuple[str, str, str, bool]]:
    """Every rule in both directions: (type a, type b, edge type, whether a and b change places)."""
    return [(a, b, e, False) for a, b, e in PAIR_RULES] + [(b, a, e, True) for a, b, e in PAIR_RULES if a != b]


def rule_completion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, edge_type): pairs of points of one chunk that a rule links and no edge links yet."""
    n = unique_nodes(nodes).where("address.chunk_id is not null").where(~F.col("node_type").isin(R.STRUCTURAL)).select("node_id", "node_type", "node_ord", F.col("address.chunk_id").alias("chunk_id"))
    # the types that a rule links a point to come first, so only pairs that a rule links are ever made
    wanted: dict[str, list[Column]] = {}
    for ta, tb, edge, flip in pair_semantics():
        wanted.setdefault(ta, []).append(F.struct(F.lit(tb).alias("tb"), F.lit(edge).alias("edge_type"), F.lit(flip).alias("flip")))
    rules = F.create_map(*[x for ta, options in wanted.items() for x in (F.lit(ta), F.array(*options))])
    a = n.select("chunk_id", F.col("node_id").alias("a"), F.col("node_ord").alias("oa"), F.explode(F.try_element_at(rules, F.col("node_type"))).alias("r")).select("chunk_id", "a", "oa", "r.tb", "r.edge_type", "r.flip")
    b = n.select("chunk_id", F.col("node_id").alias("b"), F.col("node_type").alias("tb"), F.col("node_ord").alias("ob"))
    pairs = a.join(b, ["chunk_id", "tb"]).where("oa < ob")
    linked = unique_edges(edges).select(F.array_sort(F.array("source", "target")).alias("ends")).distinct()
    fresh = pairs.withColumn("ends", F.array_sort(F.array("a", "b"))).join(linked, "ends", "left_anti")
    return fresh.select(F.when(F.col("flip"), F.col("b")).otherwise(F.col("a")).alias("source"), F.when(F.col("flip"), F.col("a")).otherwise(F.col("b")).alias("target"), "edge_type", "chunk_id")


def cross_modal_references(blocks: DataFrame, kind: str) -> DataFrame:
    """(source, target): text chunks to the figure, table or equation of their paper whose label they name; the last label wins."""
    modality = {"figure": "figure", "table": "table", "equation": "formula"}[kind]
    b = blocks.dropDuplicates(["block_id"])
    texts = b.where("modality = 'text'").select(F.col("address.chunk_id").alias("source"), F.col("address.paper_id").alias("paper_id"), F.explode(F.array_distinct(R.references("content", kind))).alias("label"))
    written = F.struct("created_at", "block_id") if "created_at" in blocks.columns else F.struct("block_id")
    targets = b.where(F.col("modality") == modality).where("extra.label is not null and extra.label != ''").groupBy(F.col("address.paper_id").alias("paper_id"), F.col("extra.label").alias("label")).agg(F.max_by("address.chunk_id", written).alias("target"))
    return texts.join(targets, ["paper_id", "label"]).select("source", "target", "label").distinct()


def structure_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): paper to its section prefixes, sections to their parts, the last section to its chunks."""
    n = unique_nodes(nodes).where(F.col("node_type").isin("ChunkNode", "FigureNode", "TableNode", "EquationNode")).where("address.paper_id is not null")
    parts = F.split(F.when(F.coalesce(F.col("address.section_path"), F.lit("")) == "", "ROOT").otherwise(F.col("address.section_path")), "/")
    rows = n.select("node_id", F.col("address.paper_id").alias("paper"), parts.alias("parts"))
    names = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat("paper", F.lit("::SEC::"), R.slug(F.array_join(F.slice("parts", 1, i), "/"), 60)))
    rows = rows.withColumn("chain", F.concat(F.array(F.concat("paper", F.lit("::PAPER"))), names, F.array("node_id")))
    links = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.col("chain")[i - 1].alias("source"), F.col("chain")[i].alias("target")))
    return rows.select(F.inline(links)).distinct()


def chunk_mates(nodes: DataFrame, limit: int = 40, of: DataFrame | None = None) -> DataFrame:
    """(node_id, mate, place): the first ``limit`` nodes of the same chunk, the chunk itself first; of all nodes or only of those in ``of`` (node_id)."""
    n = unique_nodes(nodes).where("address.chunk_id is not null").select("node_id", "node_ord", F.col("address.chunk_id").alias("chunk_id"))
    first = n.withColumn("is_chunk", (F.col("node_id") == F.col("chunk_id")).cast("int"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("is_chunk"), "node_ord"))).where(F.col("r") <= limit + 1)
    asked = n if of is None else n.join(of, "node_id", "left_semi")
    pairs = asked.select("node_id", "chunk_id").join(ranked.select("chunk_id", F.col("node_id").alias("mate"), F.col("r")), "chunk_id").where("node_id != mate")
    w = Window.partitionBy("node_id").orderBy("r")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("node_id", "mate", "place")


def section_chunks(nodes: DataFrame, limit: int = 6) -> DataFrame:
    """(node_id, mate, place): for figures, tables and equations the first chunks of their section."""
    n = unique_nodes(nodes).select("node_id", "node_type", "node_ord", F.col("address.paper_id").alias("paper_id"), F.col("address.section_path").alias("section_path"))
    chunks = n.where("node_type = 'ChunkNode'").withColumn("place", F.row_number().over(Window.partitionBy("paper_id", "section_path").orderBy("node_ord"))).where(F.col("place") <= limit)
    media = n.where(F.col("node_type").isin("FigureNode", "TableNode", "EquationNode")).select("node_id", "paper_id", "section_path")
    return media.join(chunks.select("paper_id", "section_path", F.col("node_id").alias("mate"), "place"), ["paper_id", "section_path"]).select("node_id", "mate", "place")


def downward_walk(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 4, limit: int = 40) -> DataFrame:
    """(start, node, depth, place): the evidence chain below each start, at most ``limit`` nodes, nearest first."""
    steps = cut_lineage(leveled_edges(nodes, edges).where(LEADS_DOWN).select("source", "target", "edge_ord"))
    first = cut_lineage(starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("place")))
    reached, frontier = first, first
    for d in range(1, depth + 1):
        grown = frontier.join(steps, frontier["node"] == steps["source"]).select("start", F.col("target").alias("node"), F.col("place").alias("parent"), "edge_ord")
        fresh = grown.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        once = fresh.groupBy("start", "node").agg(F.min(F.struct("parent", "edge_ord")).alias("at"))
        counted = reached.groupBy("start").agg(F.max("place").alias("before"))
        w = Window.partitionBy("start").orderBy("at", "node")
        frontier = cut_lineage(once.withColumn("r", F.row_number().over(w)).where(F.col("r") < limit).join(counted, "start").select("start", "node", F.lit(d).alias("depth"), (F.col("before") + F.col("r")).alias("place")).where(F.col("place") <= limit))
        reached = reached.unionByName(frontier)
    return reached


def upward_locate(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 6) -> DataFrame:
    """(start, chain): the greedy way up, by the first inbound edge from a node of the same or a higher level."""
    steps = leveled_edges(nodes, edges).where("ls <= lt").select("source", "target", "edge_ord")
    rows = starts.select(F.col("node_id").alias("start"), F.array("node_id").alias("chain"), F.lit(True).alias("alive"))
    return _greedy(rows, steps, "target", "source", hops)


def _greedy(rows: DataFrame, steps: DataFrame, here: str, there: str, hops: int) -> DataFrame:
    """Extends each chain ``hops`` times by the first step to a node it doesn't hold yet."""
    steps = cut_lineage(steps)
    for _ in range(hops):
        live = rows.where("alive")
        best = (
            live.select("start", "chain", F.element_at("chain", -1).alias(here))
            .join(steps, here)
            .where(~F.array_contains("chain", F.col(there)))
            .groupBy("start")
            .agg(F.min_by(there, F.struct(*[c for c in steps.columns if c not in (here, there)], there)).alias("next"))
        )
        rows = cut_lineage(rows.join(best, "start", "left").select("start", F.when(F.col("next").isNotNull(), F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), F.col("next").isNotNull().alias("alive")))
    return rows.select("start", "chain")


def gate(nodes: DataFrame) -> DataFrame:
    """Unique nodes with ``ok``, the sampling gate, computed once."""
    return unique_nodes(nodes).withColumn("ok", R.valid_point("node_type", R.either("normalized_content", "content"), "content"))


def _first_steps(leveled: DataFrame, below: set[str], above: set[str], most: int) -> tuple[dict[str, list[tuple]], dict[str, list[tuple]]]:
    """The first ``most`` steps down from each of a few nodes and up from each of a few others, as (edge_ord, node) in that order; a null edge_ord is the least."""
    at = [(False, n) for n in sorted(below)] + [(True, n) for n in sorted(above)]
    asked = leveled.sparkSession.createDataFrame(pa.table({"up": pa.array([up for up, _ in at], pa.bool_()), "here": pa.array([n for _, n in at], pa.string())}))
    way = lambda holds, up, here, there: F.when(F.expr(holds), F.struct(F.lit(up).alias("up"), F.col(here).alias("here"), F.col(there).alias("there")))
    steps = leveled.select("edge_ord", F.explode(F.array(way(LEADS_DOWN, False, "source", "target"), way("ls <= lt", True, "target", "source"))).alias("w")).select("edge_ord", "w.*")
    ranked = steps.join(F.broadcast(asked), ["up", "here"]).withColumn("r", F.row_number().over(Window.partitionBy("up", "here").orderBy("edge_ord", "there"))).where(F.col("r") <= most)
    out: tuple[dict[str, list[tuple]], dict[str, list[tuple]]] = ({}, {})
    for up, a, b, o in ranked.select("up", "here", "there", "edge_ord").collect():
        out[up].setdefault(a, []).append(((o is not None, o or 0), b))
    return tuple({a: sorted(found) for a, found in side.items()} for side in out)


def walks_of_few(leveled: DataFrame, starts: list[str], depth: int = 4, limit: int = 40, hops: int = 6) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """(start, node, place) of downward_walk and of upward_locate for a few starts over written leveled_edges: the same rows, stepped by the driver, both ways at once.

    Of a node's steps the first 2 * limit are enough: limit may be known already and limit are taken. A chain refuses at most its own nodes."""
    reached = {s: {s: 1} for s in starts}
    frontier = {s: [s] for s in starts}
    chains, alive = {s: [s] for s in starts}, set(starts)
    for d in range(max(depth, hops)):
        below = {n for found in frontier.values() for n in found} if d < depth else set()
        above = {chains[s][-1] for s in alive} if d < hops else set()
        if not below and not above:
            break
        down, up = _first_steps(leveled, below, above, max(2 * limit, hops + 2))
        for s, known in reached.items() if d < depth else ():
            best: dict[str, tuple] = {}
            for parent in frontier[s]:
                for o, n in down.get(parent, ()):
                    if n not in known and (n not in best or (known[parent], o) < best[n]):
                        best[n] = (known[parent], o)
            frontier[s] = sorted(best, key=lambda n: (best[n], n))[: max(0, min(limit - 1, limit - len(known)))]
            known.update({n: len(known) + i for i, n in enumerate(frontier[s], 1)})
        for s in list(alive) if d < hops else ():
            next_up = next((n for _, n in up.get(chains[s][-1], ()) if n not in chains[s]), None)
            chains[s] += [next_up] if next_up else []
            alive -= set() if next_up else {s}
    return [(s, n, p) for s, known in reached.items() for n, p in known.items()], [(s, n, p) for s, chain in chains.items() for p, n in enumerate(chain)]


def first_of_places(nodes: DataFrame, chunks: set[str], sections: set[tuple[str, str]], most: int) -> tuple[dict[str, list[str]], dict[tuple[str, str], list[str]]]:
    """The first ``most`` nodes of each of a few chunks, the chunk itself first, and the first chunks of each of a few sections (paper, path), in one pass."""
    at = [(True, c, "") for c in sorted(chunks)] + [(False, *s) for s in sorted(sections)]
    asked = nodes.sparkSession.createDataFrame(pa.table({"whole": pa.array([x[0] for x in at], pa.bool_()), "a": pa.array([x[1] for x in at], pa.string()), "b": pa.array([x[2] for x in at], pa.string())}))
    place = lambda whole, a, b: F.struct(F.lit(whole).alias("whole"), a.alias("a"), b.alias("b"))
    both = F.array(place(True, F.col("address.chunk_id"), F.lit("")), F.when(F.col("node_type") == "ChunkNode", place(False, F.col("address.paper_id"), F.col("address.section_path"))))
    n = unique_nodes(nodes.select("node_id", "node_type", "node_ord", "address")).select("node_id", "node_ord", F.explode(both).alias("p")).select("node_id", "node_ord", "p.*")
    w = Window.partitionBy("whole", "a", "b").orderBy(F.desc(F.col("whole") & (F.col("node_id") == F.col("a"))), "node_ord", "node_id")
    ranked = n.join(F.broadcast(asked), ["whole", "a", "b"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    inside: dict[str, list[str]] = {}
    first: dict[tuple[str, str], list[str]] = {}
    for whole, a, b, node, _ in sorted(map(tuple, ranked.select("whole", "a", "b", "node_id", "r").collect()), key=lambda x: x[4]):
        (inside.setdefault(a, []) if whole else first.setdefault((a, b), [])).append(node)
    return inside, first


def passable(n: DataFrame) -> DataFrame:
    """Nodes that a semantic walk may enter."""
    cell = F.col("node_id").contains("::r") & F.element_at(F.split("node_id", "::"), -1).contains("c")
    ok = F.when(cell, False).when(F.col("node_type") == "ValueNode", F.length(R.text("content")) > 6).otherwise(F.col("ok"))
    return n.where(ok).select("node_id")


def greedy_walk(nodes: DataFrame, edges: DataFrame, starts: DataFrame, length: int = 4) -> DataFrame:
    """(start, chain): a simple path by first passable neighbours, at most ``length`` nodes."""
    n = gate(nodes)
    steps = adjacency(edges, nodes).select("node", "neighbour", "side", "place").join(passable(n).withColumnRenamed("node_id", "neighbour"), "neighbour", "left_semi")
    rows = starts.select(F.col("node_id").alias("start"), F.array("node_id").alias("chain"), F.lit(True).alias("alive"))
    return _greedy(rows, steps.select("node", "neighbour", "side", "place"), "node", "neighbour", length - 1)


def backing_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(source, target, path): a shortest undirected path of at most ``hops`` edges, the first in neighbour order.

    Each side walks half of the way from its distinct starts, keeping one best path to each node it
    reaches; no path is lost. A pair is met where the two sides know the same node."""
    near = cut_lineage(adjacency(edges, nodes).select("node", "neighbour", "side", "place"))
    pairs = cut_lineage(pairs.select("source", "target").distinct())

    def half(start: str, k: int) -> DataFrame:
        rows = pairs.select(F.col(start).alias("s")).distinct().select("s", F.col("s").alias("at"), F.array("s").alias("path"), F.array().cast("array<struct<side:int,place:bigint>>").alias("key"))
        every = rows
        for _ in range(k):
            grown = rows.join(near, rows["at"] == near["node"]).where(~F.array_contains("path", F.col("neighbour"))).select("s", F.col("neighbour").alias("at"), F.concat("path", F.array("neighbour")).alias("path"), F.concat("key", F.array(F.struct(F.col("side"), F.col("place")))).alias("key"))
            best = grown.groupBy("s", "at").agg(F.min_by("path", "key").alias("path"), F.min("key").alias("key"))
            rows = cut_lineage(best.join(every.select("s", "at"), ["s", "at"], "left_anti"))  # a node known by a shorter way goes on from there
            every = every.unionByName(rows)
        return every

    a = half("source", hops - hops // 2).select(F.col("s").alias("source"), "at", F.col("path").alias("pa"), F.col("key").alias("ka"))
    b = half("target", hops // 2).select(F.col("s").alias("target"), "at", F.col("path").alias("pb"), F.col("key").alias("kb"))
    met = pairs.join(a, "source").join(b, ["target", "at"])
    whole = F.concat("pa", F.slice(F.reverse("pb"), 2, 99))
    best = met.withColumn("path", whole).groupBy("source", "target").agg(F.min_by("path", F.struct(F.size("path"), "ka", "kb")).alias("path"))
    return best.where(F.size("path") <= hops + 1)


def aligned_across_papers(nodes: DataFrame) -> DataFrame:
    """(canonical_id, papers, first_node): concepts that at least two papers share, by the first node of each paper."""
    u = unique_nodes(nodes).where("canonical_id is not null and canonical_id != '' and address.paper_id is not null and node_type = 'ConceptNode'")
    first = u.groupBy("canonical_id", "address.paper_id").agg(F.min_by("node_id", "node_ord").alias("node_id"))
    return first.groupBy("canonical_id").agg(F.count("*").alias("papers"), F.min("node_id").alias("first_node")).where("papers >= 2")
