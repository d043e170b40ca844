"""Building the evidence graph from blocks: document structure, table grids, extracted points, co-occurrence.

Every builder gives two tables, nodes (node_id, node_type, content, normalized_content, address,
modality, domain_schema_tag, canonical_id) and edges (source, target, edge_type, build_reason,
cooccur_scope, paper_id, section_path, chunk_id, evidence_span, polarity, confidence). All of it is
joins and column expressions on the keys of blocks; nothing walks a document on the driver.

Defined results. Blocks delivered twice count once; blocks without a paper give no structure. A paper
without a title takes its id. An empty section path is the section ROOT. Points that fail the quality
gate are left out with their edges. Of points of one name in a block the last one counts. A pair that
a relation asserts keeps its edge whatever its polarity; one that only a rule suggests must be positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators import ingest
from lodegraph.operators.graph import pair_semantics
from lodegraph.session import cut_lineage

NODE = ["node_id", "node_type", "content", "normalized_content", "address", "modality", "domain_schema_tag", "canonical_id"]
EDGE = ["source", "target", "edge_type", "build_reason", "cooccur_scope", "paper_id", "section_path", "chunk_id", "evidence_span", "polarity", "confidence"]
# Labels of extracted points, how much of a content a container keeps, and of a block an edge.
LABELS = {
    "concept": "ConceptNode",
    "attribute": "AttributeNode",
    "value": "ValueNode",
    "unit": "UnitNode",
    "condition": "ConditionNode",
    "method": "MethodNode",
    "claim": "ClaimNode",
    "equation": "EquationNode",
    "figure": "FigureNode",
    "table": "TableNode",
    "caption": "CaptionNode",
}
CONTENT, SPAN = 500, 200


def _text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else _text(c) for c in NODE])


def _edges(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else (F.lit(None).cast("double").alias(c) if c == "confidence" else _text(c)) for c in EDGE])


def _once(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_id is not null and address.paper_id is not null").dropDuplicates(["block_id"])


def _place(df: DataFrame, like: DataFrame, paper: str, section: str | None = None) -> Column:
    """An address with a paper and, if asked for, a section; nothing else."""
    empty = F.from_json(F.lit("{}"), like.schema["address"].dataType).withField("paper_id", F.col(paper))
    return empty if section is None else empty.withField("section_path", F.col(section))


# ---- structure -------------------------------------------------------------------------------------------------


def titled(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, title): every paper of the blocks with its title, or its id."""
    titles = papers.select("paper_id", "title").dropDuplicates(["paper_id"])
    return _once(blocks).select(F.col("address.paper_id").alias("paper_id")).distinct().join(titles, "paper_id", "left").select("paper_id", F.coalesce("title", "paper_id").alias("title"), (F.coalesce("title", F.lit("")) != "").alias("has_title"))


def structure(blocks: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paper, title, section, chunk, figure, table, equation and caption nodes, and what contains or describes what."""
    b = _once(blocks)
    t = titled(blocks, papers).withColumn("root", F.concat("paper_id", F.lit("::PAPER"))).withColumn("address", _place(blocks, blocks, "paper_id"))
    of_paper = t.select(F.col("root").alias("node_id"), F.lit("PaperNode").alias("node_type"), F.col("title").alias("content"), "address")
    of_title = t.where("has_title").select(F.concat("paper_id", F.lit("::TITLE")).alias("node_id"), F.lit("TitleNode").alias("node_type"), F.col("title").alias("content"), F.col("title").alias("normalized_content"), "address", R.canonical_id(F.lit("TitleNode"), "title").alias("canonical_id"))
    parts = F.filter(F.split(F.coalesce("address.section_path", F.lit("")), "/"), lambda p: p != "")
    parts = F.when(F.size(parts) == 0, F.array(F.lit("ROOT"))).otherwise(parts)
    section = lambda path: F.concat("paper_id", F.lit("::SEC::"), R.slug(path, 60))
    chains = b.select(F.col("address.paper_id").alias("paper_id"), parts.alias("parts"), "block_id", "modality")
    steps = chains.select("paper_id", "parts").distinct().select("paper_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"))
    steps = steps.select("paper_id", F.array_join(F.slice("parts", 1, F.col("i")), "/").alias("path"), F.get("parts", F.col("i") - 1).alias("name"), F.array_join(F.slice("parts", 1, F.col("i") - 1), "/").alias("above")).distinct()
    of_section = steps.withColumn("address", _place(blocks, blocks, "paper_id", "path")).select(section(F.col("path")).alias("node_id"), F.lit("SectionNode").alias("node_type"), F.col("name").alias("content"), "address", R.canonical_id(F.lit("SectionNode"), "name").alias("canonical_id")).dropDuplicates(["node_id"])
    kind = F.create_map(*[F.lit(x) for x in ("text", "ChunkNode", "table", "TableNode", "figure", "FigureNode", "formula", "EquationNode")])
    body = b.where(F.col("modality").isin("text", "table", "figure", "formula") & F.col("address.chunk_id").isNotNull())
    shown = F.when(F.col("modality") == "text", F.coalesce("content", F.lit(""))).otherwise(R.either("caption", "content"))
    of_body = body.select(F.col("address.chunk_id").alias("node_id"), F.element_at(kind, F.col("modality")).alias("node_type"), F.substring(shown, 1, CONTENT).alias("content"), "address", "modality", F.when(F.col("modality") != "text", F.coalesce("extra.label", F.lit(""))).alias("domain_schema_tag"))
    captions = b.where("modality = 'caption'")
    of_caption = captions.select(F.col("block_id").alias("node_id"), F.lit("CaptionNode").alias("node_type"), F.substring(F.coalesce("content", F.lit("")), 1, CONTENT).alias("content"), "address", "modality")
    nodes = _nodes(of_paper)
    for part in (of_title, of_section, of_body, of_caption):
        nodes = nodes.unionByName(_nodes(part))
    link = lambda source, target, edge="contains": [source.alias("source"), target.alias("target"), F.lit(edge).alias("edge_type"), F.lit("document_structure").alias("build_reason")]
    root = F.concat("paper_id", F.lit("::PAPER"))
    to_title = t.where("has_title").select(*link(F.col("root"), F.concat("paper_id", F.lit("::TITLE"))), "paper_id")
    to_section = steps.select(*link(F.when(F.col("above") == "", root).otherwise(section(F.col("above"))), section(F.col("path"))), "paper_id", F.col("path").alias("section_path")).dropDuplicates(["source", "target"])
    leaf = body.select(F.col("address.paper_id").alias("paper_id"), F.array_join(parts, "/").alias("path"), F.col("address.chunk_id").alias("node_id"), "address.section_path", "modality")
    to_body = leaf.select(*link(section(F.col("path")), F.col("node_id")), "paper_id", "section_path", F.when(F.col("modality") == "text", F.col("node_id")).alias("chunk_id"))
    parents = of_body.select(F.col("node_id").alias("parent"))
    to_caption = captions.select("block_id", F.col("extra.parent").alias("parent"), F.col("address.paper_id").alias("paper_id")).join(parents, "parent", "left_semi").select(*link(F.col("parent"), F.col("block_id"), "describes"), "paper_id")
    edges = _edges(to_title)
    for part in (to_section, to_body, to_caption):
        edges = edges.unionByName(_edges(part))
    return nodes, edges


# ---- tables ----------------------------------------------------------------------------------------------------


def _resolved(ta: Column, tb: Column) -> Column:
    """struct<edge, flip> of the rule for two node types, null if there is none."""
    rules = F.create_map(*[x for a, b, edge, flip in pair_semantics() for x in (F.lit(f"{a}|{b}"), F.struct(F.lit(edge).alias("edge"), F.lit(flip).alias("flip")))])
    return F.try_element_at(rules, F.concat_ws("|", ta, tb))


def _linked(rows: DataFrame, a: str, ta: str, b: str, tb: str, fallback: Column) -> DataFrame:
    """Adds source, target and edge_type in the direction that the rule for the two types asks for."""
    rows = rows.withColumn("rule", _resolved(F.col(ta), F.col(tb)))
    flip = F.coalesce(F.col("rule.flip"), F.lit(False))
    return rows.withColumns({"source": F.when(flip, F.col(b)).otherwise(F.col(a)), "target": F.when(flip, F.col(a)).otherwise(F.col(b)), "edge_type": F.coalesce("rule.edge", fallback)})


def table_graph(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column heads as attributes with their units, row labels as concepts, body cells as values or concepts, and their edges."""
    b = _once(blocks).where("modality = 'table' and address.chunk_id is not null")
    cells = cut_lineage(ingest.table_cells(b)).join(b.select("block_id", "address"), "block_id").withColumn("table_id", F.col("address.chunk_id"))
    top = cells.groupBy("block_id").agg(F.collect_set(F.when(F.col("is_header"), F.col("row"))).alias("heads"))
    cells = cut_lineage(cells.join(top, "block_id").withColumn("heads", F.when(F.size("heads") > 0, F.col("heads")).otherwise(F.array(F.lit(0)))))  # the tables are read only once
    first, place = F.array_min("heads"), R.cell_address("address", "row", "col")
    heads = cells.where((F.col("row") == first) & (F.col("col") != 0) & R.meaningful_attribute("text")).select("block_id", "table_id", "col", "text", place.alias("at"), ingest.header_unit("text").alias("unit"), F.concat("table_id", F.lit("::col"), F.col("col")).alias("node_id"), "address").dropDuplicates(["node_id"])
    labels = cells.where((F.col("col") == 0) & ~F.array_contains("heads", F.col("row")) & R.valid_point(F.lit("ConceptNode"), "text", "text")).select("block_id", "table_id", "row", "text", place.alias("at"), F.concat("table_id", F.lit("::row"), F.col("row")).alias("node_id"), "address")
    body = cells.where((F.col("col") != 0) & ~F.array_contains("heads", F.col("row"))).select("block_id", "table_id", "row", "col", "text", place.alias("at"), "address", ingest.numeric_cell("text").alias("numeric"), F.concat("table_id", F.lit("::r"), F.col("row"), F.lit("c"), F.col("col")).alias("node_id"))
    body = body.join(heads.select("block_id", "col", F.col("node_id").alias("head"), F.when(F.col("unit").isNotNull(), F.concat("node_id", F.lit("::unit"))).alias("head_unit")), ["block_id", "col"], "left").join(labels.select("block_id", "row", F.col("node_id").alias("label")), ["block_id", "row"], "left").where("head is not null or label is not null")
    body = cut_lineage(body.withColumn("node_type", F.when(F.col("numeric"), "ValueNode").otherwise("ConceptNode")))  # used five times below

    def node(rows: DataFrame, node_type: Column, named: bool = True, text: str = "text") -> DataFrame:
        return _nodes(rows.select("node_id", node_type.alias("node_type"), F.col(text).alias("content"), F.col(text).alias("normalized_content"), F.col("at").alias("address"), F.lit("table").alias("modality"), (R.canonical_id(node_type, text) if named else F.lit(None).cast("string")).alias("canonical_id")))

    units = heads.where("unit is not null").withColumn("node_id", F.concat("node_id", F.lit("::unit")))
    nodes = node(heads, F.lit("AttributeNode")).unionByName(node(units, F.lit("UnitNode"), text="unit")).unionByName(node(labels, F.lit("ConceptNode"))).unionByName(node(body, F.col("node_type"), named=False))
    about = [F.col("address.paper_id").alias("paper_id"), F.col("address.section_path").alias("section_path"), F.col("address.chunk_id").alias("chunk_id")]
    held = heads.select("table_id", "node_id", "address").unionByName(labels.select("table_id", "node_id", "address")).unionByName(body.select("table_id", "node_id", "address"))
    contains = held.select(F.col("table_id").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("edge_type"), F.lit("document_structure").alias("build_reason"), *about)
    none = F.lit("co_occurs_with")
    by_column = _linked(body.where("head is not null").withColumn("ta", F.lit("AttributeNode")), "head", "ta", "node_id", "node_type", none).withColumn("scope", F.lit("same_table_column"))
    by_unit = _linked(body.where("head_unit is not null and numeric").withColumn("tb", F.lit("UnitNode")), "node_id", "node_type", "head_unit", "tb", none).withColumn("scope", F.lit("same_table_column"))
    by_row = _linked(body.where("label is not null").withColumn("ta", F.lit("ConceptNode")), "label", "ta", "node_id", "node_type", none).withColumn("scope", F.lit("same_table_row"))
    edges = _edges(contains)
    for rows in (by_column, by_unit, by_row):
        edges = edges.unionByName(_edges(rows.select("source", "target", "edge_type", F.lit("physical_cooccurrence").alias("build_reason"), F.col("scope").alias("cooccur_scope"), *about, F.lit("positive").alias("polarity"), R.edge_confidence("scope", F.lit("positive")).alias("confidence"))))
    return nodes, edges


# ---- points and co-occurrence ----------------------------------------------------------------------------------


def extraction_targets(blocks: DataFrame, max_text_blocks: int | None = None) -> DataFrame:
    """The blocks that points are extracted from: texts (at most so many, if asked for) and all captions, with their container."""
    b = _once(blocks).where("modality in ('text', 'caption') and content is not null and trim(content) != ''")
    b = b.withColumn("container", F.when(F.col("modality") == "text", F.col("address.chunk_id")).otherwise(F.col("block_id"))).where("container is not null")
    if max_text_blocks is None:
        return b
    return b.where("modality = 'text'").orderBy("block_id").limit(max_text_blocks).unionByName(b.where("modality = 'caption'"))


def extracted_points(targets: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Point nodes of extraction answers (block_id, text), what contains them, and the asserted relations (block_id, at, source_name, target_name, relation)."""
    parsed = ingest.parse_extraction(responses.select(F.col("block_id").alias("key"), "text")).withColumnRenamed("key", "block_id")
    kinds = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    points = parsed.where("kind = 'point'").select("block_id", "at", F.col("a").alias("name"), F.try_element_at(kinds, F.lower(F.trim("b"))).alias("node_type"), F.col("c").alias("said"))
    points = points.withColumn("i", F.row_number().over(Window.partitionBy("block_id").orderBy("at")) - 1)
    points = points.where("node_type is not null").where(R.valid_point("node_type", "name", "said"))
    rows = points.join(targets.select("block_id", "container", "address", "modality", F.col("extra.sentence_list").alias("sentences")), "block_id")
    rows = rows.withColumn("node_id", F.concat("container", F.lit("::p"), F.col("i"))).withColumn("content", F.col("said"))
    nodes = rows.select("block_id", "node_id", "node_type", "content", F.col("name").alias("normalized_content"), F.col("address").withField("sentence_id", R.locate_sentence("said", F.col("sentences"))).alias("address"), "modality", _text("domain_schema_tag"), R.canonical_id("node_type", "name").alias("canonical_id"), "at")
    nodes = cut_lineage(nodes)  # joined with itself for co-occurrence
    contains = _edges(rows.select(F.col("container").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("edge_type"), F.lit("document_structure").alias("build_reason"), F.col("address.paper_id").alias("paper_id"), F.col("address.chunk_id").alias("chunk_id")))
    relations = parsed.where("kind = 'relation'").select("block_id", "at", F.col("a").alias("source_name"), F.col("b").alias("target_name"), F.col("c").alias("relation"))
    return nodes, contains, relations


def named_points(points: DataFrame) -> DataFrame:
    """(block_id, name, node_id, node_type, content, place): the point that each name of a block stands for, the last one of the name."""
    named = points.withColumn("name", F.lower(F.trim("normalized_content")))
    return named.groupBy("block_id", "name").agg(F.max_by(F.struct("node_id", "node_type", "content"), "at").alias("p"), F.min("at").alias("place")).select("block_id", "name", "p.*", "place")


def cooccurrence(targets: DataFrame, points: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges between the points of a block: asserted ones with their polarity, and those that a rule suggests if they are positive."""
    names = named_points(points)
    a = names.select("block_id", F.col("name").alias("na"), F.col("node_id").alias("a"), F.col("node_type").alias("ta"), F.col("content").alias("ca"), F.col("place").alias("pa"))
    b = names.select("block_id", F.col("name").alias("nb"), F.col("node_id").alias("b"), F.col("node_type").alias("tb"), F.col("content").alias("cb"), F.col("place").alias("pb"))
    body = targets.select("block_id", F.col("content").alias("body"), F.col("extra.sentence_list").alias("sentences"), (F.col("modality") == "caption").alias("in_caption"), F.col("address.paper_id").alias("paper_id"), F.col("address.section_path").alias("section_path"), F.col("address.chunk_id").alias("chunk_id"))
    told = relations.select("block_id", F.lower(F.trim("source_name")).alias("na"), F.lower(F.trim("target_name")).alias("nb"), F.when(F.coalesce(F.trim("relation"), F.lit("")) != "", F.col("relation")).otherwise("co_occurs_with").alias("relation"), "at")
    asserted = told.join(a, ["block_id", "na"]).join(b, ["block_id", "nb"]).where("a != b")
    asserted = cut_lineage(asserted.join(body, "block_id").withColumn("scope", R.cooccur_scope("ca", "cb", F.col("sentences"), F.col("in_caption"))).withColumn("ruled", F.lit(False)))  # its pairs are left out of the ruled ones
    wanted: dict[str, list[str]] = {}
    for ta, tb, *_ in pair_semantics():
        wanted.setdefault(ta, []).append(tb)
    partners = F.create_map(*[x for ta, tbs in wanted.items() for x in (F.lit(ta), F.array(*map(F.lit, tbs)))])
    pairs = a.withColumn("tb", F.explode(F.try_element_at(partners, F.col("ta")))).join(b, ["block_id", "tb"]).where("pa < pb or (pa = pb and a < b)")
    ends = lambda: F.array_sort(F.array("a", "b"))
    fresh = pairs.withColumn("ends", ends()).join(asserted.select(ends().alias("ends")).distinct(), "ends", "left_anti")
    ruled = fresh.join(body, "block_id").withColumn("scope", F.when(F.col("in_caption"), "same_caption").otherwise("same_chunk")).withColumn("ruled", F.lit(True)).withColumn("relation", F.lit("co_occurs_with")).withColumn("at", F.lit(1 << 30))
    columns = ["block_id", "a", "ta", "b", "tb", "ca", "cb", "relation", "at", "scope", "ruled", "body", "paper_id", "section_path", "chunk_id"]
    rows = asserted.select(columns).unionByName(ruled.select(columns)).withColumn("polarity", R.polarity(R.between_window("body", "ca", "cb"))).where("not ruled or polarity = 'positive'")
    rows = _linked(rows, "a", "ta", "b", "tb", F.col("relation"))
    rows = rows.withColumn("confidence", R.edge_confidence("scope", "polarity", F.col("ruled")))
    last = rows.groupBy("source", "target").agg(F.max_by(F.struct("edge_type", F.col("scope").alias("cooccur_scope"), "paper_id", "section_path", "chunk_id", F.substring("body", 1, SPAN).alias("evidence_span"), "polarity", "confidence"), F.struct(~F.col("ruled"), "at")).alias("e"))
    return _edges(last.select("source", "target", "e.*", F.lit("physical_cooccurrence").alias("build_reason")))
