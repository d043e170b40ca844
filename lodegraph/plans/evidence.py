"""Queries over the evidence graph, its texts and its question-answer items, each with its SQL.

Every query runs over its whole tables; limits are only where a top-k is the feature. Columns are flat
and cast alike on both sides. Averages and shares are rounded to six places on both sides, as sums of
doubles depend on their order. Queries without SQL are tested against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators import binding, builder, components, finders, graph, ingest, metrics, planner, qa
from lodegraph.session import cut_lineage
from lodegraph.sources.responses import json_object, without_thoughts
from lodegraph.sources.tables import table
from lodegraph.streaming import limits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


# ---- shared SQL ------------------------------------------------------------------------------------------------

N = "n AS (SELECT * FROM nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ingested_at) = 1)"
E_ALL = "ea AS (SELECT * FROM edges WHERE source IS NOT NULL AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY ingested_at) = 1)"
E = E_ALL + ", e AS (SELECT ea.* FROM ea SEMI JOIN n a ON ea.source = a.node_id SEMI JOIN n b ON ea.target = b.node_id)"
B = "b AS (SELECT * FROM evidence_blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at) = 1)"
Q = "q AS (SELECT * FROM qa_items WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ingested_at) = 1)"
ADJ = "adj AS (SELECT source AS node, target AS neighbour, 0 AS side, edge_ord AS place FROM e UNION ALL SELECT target, source, 1, edge_ord FROM e)"


def _s(x: str) -> str:
    return x.replace("'", "''")


def _trim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


def _list(xs) -> str:
    return ", ".join(f"'{_s(x)}'" for x in xs)


def _symbolic(c: str) -> str:
    s = _trim(c)
    return f"""({s} = '' OR upper({s}) IN ('Y','N','YES','NO','/','-','—','N/A') OR regexp_matches({s}, '^\\[\\s*[0-9]+\\s*(?:[,\\-–]\\s*[0-9]+\\s*)*\\]$')
        OR NOT regexp_matches({s}, '[A-Za-z0-9一-鿿]') OR (regexp_matches({s}, '^\\$.*\\$$') AND length(regexp_replace(regexp_replace({s}, '\\\\[A-Za-z]+', '', 'g'), '[${{}}_^\\\\\\s]', '', 'g')) <= 3)
        OR (length({s}) <= 2 AND NOT regexp_full_match({s}, '{R.NUMBER}')))"""


def _valid(t: str, name: str, content: str) -> str:
    c = _trim(content)
    m = f"coalesce(nullif({_trim(name)}, ''), {c})"
    meta = lambda x: f"regexp_matches(lower({_trim(x)}), '{R.METADATA}')"
    wordy = f"NOT {_symbolic(m)} AND regexp_replace(lower({_trim(m)}), '\\.+$', '') NOT IN ({_list(R.STOPWORDS)}) AND regexp_matches({m}, '[A-Za-z]{{2,}}|[一-鿿]{{2,}}')"
    measure = f"regexp_full_match(regexp_replace({m}, '[$\\\\{{}}^_\\s]', '', 'g'), '[-+]?[0-9]+(?:\\.[0-9]+)?[A-Za-z%°µΩ/·]{{0,5}}')"
    return f"""CASE WHEN {m} = '' AND {c} = '' THEN false WHEN {t} IN ({_list(R.STRUCTURAL)}) THEN true
        WHEN {t} IN ('ConditionNode','ClaimNode','MethodNode','ConceptNode','AttributeNode') AND ({meta(m)} OR {meta(c)}) THEN false
        WHEN {t} = 'ValueNode' THEN regexp_matches({c}, '{R.NUMBER}') OR regexp_matches({m}, '{R.NUMBER}')
        WHEN {t} = 'UnitNode' THEN length({c}) <= 16 AND regexp_matches({c}, '[A-Za-z%°Ω]')
        WHEN {t} = 'ConceptNode' THEN {wordy} AND NOT {measure} WHEN {t} = 'AttributeNode' THEN {wordy}
        WHEN {t} = 'ConditionNode' THEN NOT {_symbolic(m)} ELSE true END"""


NAME = "coalesce(nullif(normalized_content, ''), content, '')"
G = f"g AS (SELECT *, {_valid('node_type', NAME, 'content')} AS ok FROM n)"
ELIGIBLE = "coalesce(polarity, 'positive') = 'positive' AND coalesce(confidence, 1.0) >= 0.5"


def _slug(c: str, n: int) -> str:
    s = f"substring(regexp_replace(regexp_replace(lower({_trim(c)}), '\\s+', '_', 'g'), '[^0-9a-z一-鿿_]+', '', 'g'), 1, {n})"
    return f"CASE WHEN {s} = '' THEN 'x' ELSE {s} END"


def _polarity(w: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({w}), '{_s(R.NEGATIVE)}') OR regexp_matches({w}, '{R.NEGATIVE_ZH}') THEN 'negative'
        WHEN regexp_matches(lower({w}), '{R.CONTRASTIVE}') OR regexp_matches({w}, '{R.CONTRASTIVE_ZH}') THEN 'contrastive'
        WHEN regexp_matches(lower({w}), '{R.HYPOTHETICAL}') OR regexp_matches({w}, '{R.HYPOTHETICAL_ZH}') THEN 'hypothetical' ELSE 'positive' END"""


# ---- texts and rules -------------------------------------------------------------------------------------------


@query(f"WITH {B} SELECT block_id, {_polarity('content')} AS polarity FROM b WHERE modality = 'text'")
def q_polarity(spark, d):
    (b,) = _t(spark, d, "evidence_blocks")
    return b.where("modality = 'text'").dropDuplicates(["block_id"]).select("block_id", R.polarity(F.coalesce("content", F.lit(""))).alias("polarity"))


_CONF = " UNION ALL ".join(f"SELECT '{s}' AS s, '{p}' AS p, {c!r}::DOUBLE AS c" for s, p, c in R.confidence_table())


@query(f"""WITH {E_ALL}, t AS ({_CONF}) SELECT source, target, t.c AS rule_confidence FROM ea
    JOIN t ON t.s = CASE WHEN cooccur_scope IN ({_list(R.SCOPE_CONFIDENCE)}) THEN cooccur_scope ELSE 'other' END AND t.p = CASE WHEN polarity IN ({_list(R.PENALTY)}) THEN polarity ELSE 'positive' END""")
def q_edge_confidence(spark, d):
    (e,) = _t(spark, d, "edges")
    return graph.unique_edges(e).select("source", "target", R.edge_confidence("cooccur_scope", "polarity").alias("rule_confidence"))


@query(f"WITH {E_ALL} SELECT edge_type, count(*)::BIGINT AS edges, sum(CASE WHEN {ELIGIBLE} THEN 1 ELSE 0 END)::BIGINT AS eligible FROM ea GROUP BY edge_type")
def q_eligible_edges(spark, d):
    (e,) = _t(spark, d, "edges")
    return graph.unique_edges(e).groupBy("edge_type").agg(F.count("*").alias("edges"), F.sum(R.eligible("confidence", "polarity").cast("bigint")).alias("eligible"))


@query(f"WITH {N}, {G} SELECT node_id, ok FROM g")
def q_valid_point(spark, d):
    (n,) = _t(spark, d, "nodes")
    return graph.gate(n).select("node_id", "ok")


@query(f"WITH {N} SELECT node_id, {_symbolic('content')} AS symbolic FROM n")
def q_symbolic_name(spark, d):
    (n,) = _t(spark, d, "nodes")
    return graph.unique_nodes(n).select("node_id", R.symbolic("content").alias("symbolic"))


@query(r"""SELECT qid, regexp_matches(lower(regexp_replace(coalesce(question, ''), '^\s+|\s+$', '', 'g') || ' ' || CASE (hash_key % 4) WHEN 0 THEN 'Received 7 May' WHEN 1 THEN 'doi' WHEN 2 THEN 'licences' ELSE 'Vol. 3' END),
    '(^|[^0-9A-Za-z_])(publication|received|accepted|revised|submitted|current version|copyright|doi|issn|isbn|license|licen[cs]ed|ieee|digital object|permission|reprint|all rights reserved|corresponding author|manuscript|page [0-9]+|vol\.|volume [0-9]+)([^0-9A-Za-z_]|$)') AS metadata
    FROM (SELECT DISTINCT qid, question, length(qid) + ascii(right(qid, 1)) AS hash_key FROM qa_items WHERE qid IS NOT NULL)""")
def q_metadata_filter(spark, d):
    """Questions followed by a scrap of front matter: which are metadata."""
    (t,) = _t(spark, d, "qa_items")
    scrap = F.element_at(F.array(*map(F.lit, ("Received 7 May", "doi", "licences", "Vol. 3"))), (F.length("qid") + F.ascii(F.right("qid", F.lit(1)))) % 4 + 1)
    return qa.items(t).select("qid", R.metadata(F.concat(R.text("question"), F.lit(" "), scrap)).alias("metadata"))


@query(f"WITH {N} SELECT node_id, node_type || ':' || ({_slug('content', 40)}) AS canonical_id FROM n WHERE node_type IS NOT NULL")
def q_canonical_id(spark, d):
    (n,) = _t(spark, d, "nodes")
    return graph.unique_nodes(n).where("node_type is not null").select("node_id", R.canonical_id("node_type", "content").alias("canonical_id"))


_VU = rf"({R.NUMBER})\s*({R.UNIT_WORDS})?"


@query(f"""WITH {B}, m AS (SELECT block_id, unnest(regexp_extract_all(coalesce(content, ''), '{_VU}', 2)) AS unit FROM b WHERE modality = 'text')
    SELECT coalesce(unit, '') AS unit, count(*)::BIGINT AS n, count(DISTINCT block_id)::BIGINT AS blocks FROM m GROUP BY 1""")
def q_value_units(spark, d):
    """How often each unit, or none, follows a number."""
    (b,) = _t(spark, d, "evidence_blocks")
    rows = b.where("modality = 'text'").dropDuplicates(["block_id"]).select("block_id", F.explode(R.value_units("content")).alias("m"))
    return rows.groupBy(F.col("m.unit").alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("block_id").alias("blocks"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::BIGINT AS sentences FROM documents""")
def q_sentence_split(spark, d):
    (t,) = _t(spark, d, "documents")
    return t.select("doc_id", F.size(R.sentences("text")).cast("bigint").alias("sentences"))


@query(f"SELECT doc_id, greatest(1, floor(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM documents")
def q_token_count(spark, d):
    (t,) = _t(spark, d, "documents")
    return t.select("doc_id", R.token_count("text").cast("bigint").alias("tokens"))


def _tok(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(replace(lower(coalesce({c}, '')), '/', ' '), '\\s+'), lambda t: t <> ''))"


@query(f"""WITH {N}, {E}, p AS (SELECT e.source, e.target, {_tok('a.content')} AS x, {_tok('b.content')} AS y FROM e JOIN n a ON a.node_id = e.source JOIN n b ON b.node_id = e.target WHERE e.edge_type = 'has_attribute')
    SELECT source, target, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS similarity FROM p""")
def q_token_jaccard(spark, d):
    n, e = _t(spark, d, "nodes", "edges")
    names = graph.unique_nodes(n).select("node_id", "content")
    rows = graph.present_edges(e, n).where("edge_type = 'has_attribute'").select("source", "target")
    rows = rows.join(names.withColumnsRenamed({"node_id": "source", "content": "x"}), "source").join(names.withColumnsRenamed({"node_id": "target", "content": "y"}), "target")
    return rows.select("source", "target", R.jaccard(F.col("x"), F.col("y")).alias("similarity"))


def _reason(names: str) -> str:
    q_, a_ = _trim("question"), _trim("answer")
    return f"""CASE WHEN length({q_}) < 6 THEN 'question_too_short' WHEN {a_} = '' THEN 'empty_answer' WHEN regexp_matches({q_}, '{R.NODE_ID}') OR regexp_matches({a_}, '{R.NODE_ID}') THEN 'leaks_node_id'
        WHEN {a_} IN ({_list(R.KEPT_REFUSALS)}) THEN 'refusal' WHEN {_symbolic('answer')} THEN 'degenerate_answer'
        WHEN length({a_}) <= 6 AND len(list_filter({names}, lambda s: {_trim('s')} <> '' AND lower({_trim('s')}) = lower({a_}))) > 0 THEN 'circular_answer'
        WHEN question_type = 'numerical' AND NOT regexp_matches({a_}, '{R.NUMBER}') THEN 'numerical_without_number' ELSE 'ok' END"""


@query(f"WITH {Q} SELECT qid, {_reason('coalesce(list_transform(evidence_spans, lambda s: s.content), [])')} AS reason FROM q")
def q_qa_filter_reason(spark, d):
    return qa.filter_reasons(*_t(spark, d, "qa_items"))


@query(f"""WITH {Q}, k AS (SELECT qid, question_type, substring(regexp_replace(lower({_trim('answer')}), '\\s+', ' ', 'g'), 1, 80) AS key, {_reason('[]::VARCHAR[]')} AS reason FROM q)
    SELECT min(qid) AS qid, question_type, count(*)::BIGINT AS copies FROM k WHERE reason IN ('ok', 'refusal') GROUP BY question_type, key""")
def q_qa_dedup(spark, d):
    return qa.deduplicated(*_t(spark, d, "qa_items"))


@query(f"""WITH {E}, {N}, m AS (SELECT e.source, e.target, coalesce(e.evidence_span, '') AS t, substring({_trim('a.content')}, 1, 20) AS ha, substring({_trim('b.content')}, 1, 20) AS hb FROM e JOIN n a ON a.node_id = e.source JOIN n b ON b.node_id = e.target WHERE e.edge_type = 'has_value'),
    i AS (SELECT *, CASE WHEN ha = '' THEN 0 ELSE instr(lower(t), lower(ha)) END AS ia, CASE WHEN hb = '' THEN 0 ELSE instr(lower(t), lower(hb)) END AS ib FROM m),
    w AS (SELECT *, least(ia, ib) AS lo, greatest(ia, ib) AS hi FROM i), x AS (SELECT *, length(regexp_extract(substring(t, greatest(1, lo - 30), lo - greatest(1, lo - 30)), '([^.!?;。；]*)$', 1)) AS margin FROM w),
    z AS (SELECT source, target, CASE WHEN ia = 0 OR ib = 0 THEN t ELSE substring(t, lo - margin, hi + greatest(length(ha), length(hb)) + 5 - lo + margin) END AS win FROM x)
    SELECT source, target, {_polarity('win')} AS polarity FROM z""".replace("WITH " + E + ", " + N, "WITH " + N + ", " + E))
def q_edge_polarity(spark, d):
    """Polarity of every has_value edge, read between its two mentions in the evidence."""
    n, e = _t(spark, d, "nodes", "edges")
    names = graph.unique_nodes(n).select("node_id", "content")
    rows = graph.present_edges(e, n).where("edge_type = 'has_value'").select("source", "target", "evidence_span")
    rows = rows.join(names.withColumnsRenamed({"node_id": "source", "content": "x"}), "source").join(names.withColumnsRenamed({"node_id": "target", "content": "y"}), "target")
    return rows.select("source", "target", R.polarity(R.between_window("evidence_span", "x", "y")).alias("polarity"))


# ---- ingest ----------------------------------------------------------------------------------------------------


@query("SELECT modality, count(DISTINCT block_id)::BIGINT AS blocks FROM evidence_blocks GROUP BY modality")
def q_blocks_by_modality(spark, d):
    return metrics.blocks_by_modality(*_t(spark, d, "evidence_blocks"))


@query(f"""WITH {B}, p AS (SELECT address.paper_id AS paper_id, count(*)::BIGINT AS blocks, avg(CASE WHEN length({_trim('content')}) > 0 THEN 1.0 ELSE 0.0 END) AS a, coalesce(avg(CASE WHEN modality IN ('table','figure') THEN CASE WHEN length({_trim('caption')}) > 0 THEN 1.0 ELSE 0.0 END END), 1.0) AS c,
    avg(CASE WHEN coalesce(address.section_path, '') <> '' THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN address.page IS NOT NULL THEN 1.0 ELSE 0.0 END) AS g, avg(CASE WHEN address.bbox IS NOT NULL THEN 1.0 ELSE 0.0 END) AS x FROM b WHERE address.paper_id IS NOT NULL GROUP BY 1)
    SELECT paper_id, blocks, round(round(a, 3)*0.25 + round(c, 3)*0.2 + round(s, 3)*0.2 + round(g, 3)*0.15 + round(x, 3)*0.2, 3) AS score FROM p""")
def q_parse_quality(spark, d):
    return ingest.parse_quality(*_t(spark, d, "evidence_blocks")).select("paper_id", "blocks", "score")


@query()
def q_table_cells(spark, d):
    """Every table's grid by position; tested against hand-made grids with spans."""
    return ingest.table_cells(*_t(spark, d, "evidence_blocks"))


@query()
def q_table_bind(spark, d):
    return ingest.bound_cells(ingest.table_cells(*_t(spark, d, "evidence_blocks")))


_CARRY = """WITH u AS (SELECT coalesce(paper_id, '') AS paper, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"""


@query()
def q_section_carry(spark, d):
    """Each line of each document under the headings before it."""
    (t,) = _t(spark, d, "documents")
    lines = t.where("text is not null").select(F.col("doc_id").cast("string").alias("paper"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    marks = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))
    kind = F.when(marks > 0, "heading").when(~F.col("text").rlike(r"[.。:：|)\]}$`]\s*$") & (F.length("text") < 80) & (F.col("pos") == 0), "heading").otherwise("text")
    rows = lines.select("paper", "pos", kind.alias("kind"), F.when(marks > 0, marks).otherwise(1).alias("level"), F.regexp_replace("text", r"^#{1,6}\s+", "").alias("text"))
    return ingest.section_carry(rows)


@query(f"""WITH {N} SELECT node_id AS key, 'point' AS kind, {_trim('content')} AS a FROM n WHERE node_type IN ('ConceptNode','AttributeNode') AND NOT contains(content, '(') AND NOT contains(content, ')') AND regexp_full_match({_trim('content')}, '[^''" \\n][^\\n]*[^''" \\n]') AND NOT contains(content, '##')""")
def q_parse_extraction(spark, d):
    """Tuples written from the graph's points and parsed again."""
    (n,) = _t(spark, d, "nodes")
    rows = graph.unique_nodes(n).where(F.col("node_type").isin("ConceptNode", "AttributeNode")).where(~F.col("content").contains("(") & ~F.col("content").contains(")") & ~F.col("content").contains("##"))
    rows = rows.where(R.text("content").rlike("^[^'\" \\n][^\\n]*[^'\" \\n]$"))
    answers = rows.select(F.col("node_id").alias("key"), F.concat(F.lit('("point"<|>'), F.col("content"), F.lit("<|>"), F.col("node_type"), F.lit("<|>x)##<|COMPLETE|>")).alias("text"))
    return ingest.parse_extraction(answers).select("key", "kind", "a")


@query("""WITH t(value, source, target) AS (VALUES (500.0, 'MPa', 'kPa'), (25.0, '°C', 'K'), (300.0, 'K', '℃'), (2.0, 'h', 's'), (5.0, 'mm', 'kg'), (12.0, '%', 'wt%'), (3.0, 'eV', 'meV'), (1.0, 'xx', 'xx')), n AS (SELECT count(DISTINCT block_id) AS blocks FROM evidence_blocks)
    SELECT source, target, CASE WHEN source = 'MPa' THEN 500000.0 WHEN source = '°C' THEN 298.15 WHEN source = 'K' THEN 26.85 WHEN source = 'h' THEN 7200.0 WHEN source = '%' THEN 12.0 WHEN source = 'eV' THEN 3000.0 END AS converted, source <> 'mm' AS compatible FROM t, n""")
def q_unit_conversion(spark, d):
    rows = spark.createDataFrame([(500.0, "MPa", "kPa"), (25.0, "°C", "K"), (300.0, "K", "℃"), (2.0, "h", "s"), (5.0, "mm", "kg"), (12.0, "%", "wt%"), (3.0, "eV", "meV"), (1.0, "xx", "xx")], "value double, source string, target string")
    return rows.select("source", "target", F.round(R.converted("value", "source", "target"), 6).alias("converted"), R.compatible("source", "target").alias("compatible"))


@query(f"""WITH {B} SELECT block_id, coalesce(min(CASE WHEN x.s IS NOT NULL THEN x.i END)::VARCHAR, NULL) AS sentence FROM (SELECT block_id, substring({_trim("coalesce(content, '')")}, 1, 20) AS head, unnest(extra.sentence_list) AS s0, generate_subscripts(extra.sentence_list, 1) - 1 AS i0 FROM b WHERE modality = 'text' AND len(extra.sentence_list) > 0) y,
    LATERAL (SELECT CASE WHEN y.head <> '' AND contains(y.s0, y.head) THEN y.s0 END AS s, y.i0 AS i) x GROUP BY block_id""")
def q_sentence_locate(spark, d):
    """In which of its sentences the beginning of each text lies."""
    (b,) = _t(spark, d, "evidence_blocks")
    rows = b.where("modality = 'text' and size(extra.sentence_list) > 0").dropDuplicates(["block_id"])
    return rows.select("block_id", R.locate_sentence("content", F.col("extra.sentence_list")).alias("sentence"))


@query(f"""WITH {Q} SELECT qid, coalesce(array_to_string(list_transform(evidence_spans, lambda s: '[' || coalesce(s.node_id, '') || '] (' || coalesce(s.address.paper_id, '') || '/' || coalesce(s.address.section_path, '') || '/' || coalesce(s.address.chunk_id, '') || ') ' || coalesce(s.content, '')), chr(10)), '') AS evidence FROM q""")
def q_evidence_format(spark, d):
    return qa.items(*_t(spark, d, "qa_items")).select("qid", R.evidence_lines("evidence_spans").alias("evidence"))


def _responses(n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extraction answers written from the points and edges that the tables hold, and the blocks' chunks they belong to."""
    points = graph.unique_nodes(n).where("node_id rlike '::p[0-9]+$' and address.chunk_id is not null").select("node_id", F.col("address.chunk_id").alias("chunk"), F.regexp_extract("node_id", "::p([0-9]+)$", 1).cast("int").alias("i"), F.regexp_replace("node_type", "Node$", "").alias("label"), "content", R.either("normalized_content", "content").alias("name"))
    clean = lambda c: F.regexp_replace(c, r"[()#\n]|<\|>", " ")
    tuples = points.select("chunk", "i", F.concat(F.lit('("point"<|>'), clean(F.col("name")), F.lit("<|>"), F.col("label"), F.lit("<|>"), clean(F.col("content")), F.lit(")")).alias("t"))
    names = points.select("node_id", "chunk", F.col("name"))
    a, b = names.withColumnsRenamed({"node_id": "source", "name": "x"}), names.select(F.col("node_id").alias("target"), F.col("chunk").alias("other"), F.col("name").alias("y"))
    told = graph.unique_edges(e).select("source", "target", "edge_type", "edge_ord").join(a, "source").join(b, "target").where("chunk = other")
    relations = told.select("chunk", F.lit(1 << 20).alias("i"), F.concat(F.lit('("relation"<|>'), clean(F.col("x")), F.lit("<|>"), clean(F.col("y")), F.lit("<|>"), F.col("edge_type"), F.lit(")")).alias("t"))
    lines = tuples.unionByName(relations).groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "##").alias("text"))
    return lines, points


@query()
def q_extracted_points(spark, d):
    """Points of extraction answers, gated, placed in their sentences and named; the answers are written from the graph's own points."""
    n, e, b = _t(spark, d, "nodes", "edges", "evidence_blocks")
    targets = builder.extraction_targets(b)
    answers = _responses(n, e)[0].join(targets.where("modality = 'text'").select("block_id", F.col("address.chunk_id").alias("chunk")), "chunk").select("block_id", "text")
    nodes, _, _ = builder.extracted_points(targets, answers)
    return nodes.select("node_id", "node_type", "content", "normalized_content", "address.sentence_id", "canonical_id")


@query()
def q_cooccur_edges(spark, d):
    """Edges between the points of each block with polarity and confidence: asserted ones, and those a rule adds where the text is positive."""
    n, e, b = _t(spark, d, "nodes", "edges", "evidence_blocks")
    targets = builder.extraction_targets(b)
    answers = _responses(n, e)[0].join(targets.where("modality = 'text'").select("block_id", F.col("address.chunk_id").alias("chunk")), "chunk").select("block_id", "text")
    nodes, _, relations = builder.extracted_points(targets, answers)
    rows = builder.cooccurrence(targets, nodes, relations)
    return rows.select("source", "target", "edge_type", "cooccur_scope", "polarity", "confidence")


@query(f"""WITH {B}, u AS (SELECT * FROM b WHERE block_id IS NOT NULL AND address.paper_id IS NOT NULL), p AS (SELECT DISTINCT address.paper_id AS paper_id FROM u), t AS (SELECT p.paper_id, any_value(papers.title) AS title FROM p LEFT JOIN papers USING (paper_id) GROUP BY 1),
    s AS (SELECT address.paper_id AS paper, CASE WHEN len(list_filter(string_split(coalesce(address.section_path, ''), '/'), lambda x: x <> '')) = 0 THEN ['ROOT'] ELSE list_filter(string_split(coalesce(address.section_path, ''), '/'), lambda x: x <> '') END AS parts FROM u),
    z AS (SELECT DISTINCT paper || '::SEC::' || ({_slug("array_to_string(parts[1:i], '/')", 60)}) AS node_id FROM (SELECT paper, parts, unnest(range(1, len(parts) + 1)) AS i FROM s))
    SELECT paper_id || '::PAPER' AS node_id, 'PaperNode' AS node_type, coalesce(title, paper_id) AS content FROM t UNION ALL SELECT paper_id || '::TITLE', 'TitleNode', title FROM t WHERE title <> '' UNION ALL SELECT node_id, 'SectionNode', NULL FROM z
    UNION ALL SELECT address.chunk_id, CASE modality WHEN 'text' THEN 'ChunkNode' WHEN 'table' THEN 'TableNode' WHEN 'figure' THEN 'FigureNode' ELSE 'EquationNode' END, substring(CASE WHEN modality = 'text' THEN coalesce(content, '') ELSE coalesce(nullif(caption, ''), content, '') END, 1, 500) FROM u WHERE modality IN ('text','table','figure','formula') AND address.chunk_id IS NOT NULL
    UNION ALL SELECT block_id, 'CaptionNode', substring(coalesce(content, ''), 1, 500) FROM u WHERE modality = 'caption'""")
def q_structure_nodes(spark, d):
    """Paper, title, section, chunk, figure, table, equation and caption nodes made from the blocks."""
    rows, _ = builder.structure(*_t(spark, d, "evidence_blocks", "papers"))
    return rows.select("node_id", "node_type", F.when(F.col("node_type") != "SectionNode", F.col("content")).alias("content"))


@query(f"""WITH {B}, u AS (SELECT * FROM b WHERE block_id IS NOT NULL AND address.paper_id IS NOT NULL), m AS (SELECT DISTINCT address.chunk_id AS id FROM u WHERE modality IN ('text','table','figure','formula') AND address.chunk_id IS NOT NULL)
    SELECT extra.parent AS source, block_id AS target FROM u JOIN m ON m.id = extra.parent WHERE modality = 'caption'""")
def q_caption_parents(spark, d):
    """Captions under the figure, table or equation that they describe."""
    _, edges = builder.structure(*_t(spark, d, "evidence_blocks", "papers"))
    return edges.where("edge_type = 'describes'").select("source", "target")


@query()
def q_table_graph(spark, d):
    """Attributes, units, concepts and values of every table with their edges; tested against hand-made tables."""
    nodes, edges = builder.table_graph(*_t(spark, d, "evidence_blocks"))
    n = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("node_type").alias("type"), "content")
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("edge_type").alias("type"), F.col("cooccur_scope").alias("content")))


@query()
def q_table_row_metrics(spark, d):
    """The metric that each two neighbouring rows of a table share, with both cells, over the tables' own graph."""
    nodes, edges = builder.table_graph(*_t(spark, d, "evidence_blocks"))
    nodes = cut_lineage(nodes.withColumns({"node_ord": F.xxhash64("node_id"), "ingested_at": F.lit(None).cast("timestamp")}))
    edges = cut_lineage(edges.withColumns({"edge_ord": F.coalesce(F.regexp_extract("target", r"c(\d+)$", 1).try_cast("bigint"), F.lit(0)), "ingested_at": F.lit(None).cast("timestamp")}))
    rows = binding.table_rows(nodes, edges).select("row").distinct()
    place = F.regexp_extract("row", r"::row(\d+)$", 1).try_cast("int")
    of = Window.partitionBy(F.regexp_replace("row", r"::row\d+$", "")).orderBy(place)
    pairs = rows.where(place.isNotNull()).select(F.col("row").alias("a"), F.lead("row").over(of).alias("b")).where("b is not null")
    return binding.row_metrics(pairs, nodes, edges)


# ---- graph -----------------------------------------------------------------------------------------------------


@query("SELECT source, target, min(edge_ord)::BIGINT AS position, arg_max(edge_type, (edge_ord, ingested_at)) AS edge_type FROM edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY source, target")
def q_edge_upsert(spark, d):
    return graph.upsert_edges(*_t(spark, d, "edges")).select("source", "target", "position", "edge_type")


@query(f"WITH {N}, {E} SELECT edge_type, count(*)::BIGINT AS edges FROM e GROUP BY edge_type")
def q_edge_integrity(spark, d):
    n, e = _t(spark, d, "nodes", "edges")
    return graph.present_edges(e, n).groupBy("edge_type").agg(F.count("*").alias("edges"))


@query(f"""WITH {N}, {E_ALL}, k AS (SELECT node_id, count(*) AS c FROM (SELECT source AS node_id FROM ea UNION ALL SELECT target FROM ea) GROUP BY 1) SELECT n.node_id, coalesce(k.c, 0)::BIGINT AS degree FROM n LEFT JOIN k USING (node_id)""")
def q_degree(spark, d):
    n, e = _t(spark, d, "nodes", "edges")
    return graph.degrees(e, n).select("node_id", F.col("degree").cast("bigint").alias("degree"))


@query()
def q_components(spark, d):
    """Connected parts of the graph, by star steps; tested against union-find."""
    n, e = _t(spark, d, "nodes", "edges")
    return components.connected_components(graph.present_edges(e, n), "source", "target")


@query(f"WITH {N} SELECT canonical_id, count(*)::BIGINT AS members, count(DISTINCT address.paper_id)::BIGINT AS papers FROM n WHERE canonical_id IS NOT NULL AND canonical_id <> '' GROUP BY 1 HAVING count(*) > 1")
def q_canonical_groups(spark, d):
    return graph.canonical_groups(*_t(spark, d, "nodes")).select("canonical_id", "members", "papers")


_SAME = """f AS (SELECT canonical_id, address.paper_id AS paper, arg_min(node_id, node_ord) AS node_id, min(node_ord) AS o FROM n WHERE canonical_id IS NOT NULL AND canonical_id <> '' AND address.paper_id IS NOT NULL AND node_type IN ('ConceptNode','AttributeNode','MethodNode') GROUP BY 1, 2), s AS (SELECT node_id AS source, lead(node_id) OVER (PARTITION BY canonical_id ORDER BY o) AS target, canonical_id FROM f)"""


@query(f"WITH {N}, {_SAME} SELECT source, target, canonical_id FROM s WHERE target IS NOT NULL")
def q_same_as(spark, d):
    return graph.same_as(*_t(spark, d, "nodes"))


@query(f"""WITH {N}, m AS (SELECT * REPLACE (CASE WHEN node_ord % 2 = 0 THEN 'text' ELSE 'caption' END AS modality) FROM n WHERE canonical_id IS NOT NULL AND canonical_id <> '' AND node_type IN ('ConceptNode','AttributeNode')), w AS (SELECT canonical_id, address.paper_id AS p FROM m GROUP BY 1, 2 HAVING count(DISTINCT modality) > 1),
    c AS (SELECT m.node_id AS source, lead(m.node_id) OVER (PARTITION BY m.canonical_id, m.address.paper_id ORDER BY m.node_ord) AS target FROM m JOIN w ON m.canonical_id = w.canonical_id AND m.address.paper_id = w.p) SELECT source, target FROM c WHERE target IS NOT NULL""")
def q_aligns_with(spark, d):
    """Nodes of one identity in one paper, chained across modalities; the tables' own nodes meet in one modality only, so every other one is read as a caption's."""
    (n,) = _t(spark, d, "nodes")
    return graph.aligns_with(n.withColumn("modality", F.when(F.col("node_ord") % 2 == 0, "text").otherwise("caption")))


_RULES = " UNION ALL ".join(f"SELECT '{a}' AS ta, '{b}' AS tb, '{e}' AS edge_type, {str(f).lower()} AS flip" for a, b, e, f in graph.pair_semantics())


@query(f"""WITH {N}, {E_ALL}, r AS ({_RULES}), m AS (SELECT node_id, node_type, node_ord, address.chunk_id AS c FROM n WHERE address.chunk_id IS NOT NULL AND node_type NOT IN ({_list(R.STRUCTURAL)})),
    p AS (SELECT a.node_id AS x, b.node_id AS y, r.edge_type, r.flip FROM m a JOIN m b ON a.c = b.c AND a.node_ord < b.node_ord JOIN r ON r.ta = a.node_type AND r.tb = b.node_type),
    l AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM ea)
    SELECT CASE WHEN flip THEN y ELSE x END AS source, CASE WHEN flip THEN x ELSE y END AS target, edge_type FROM p ANTI JOIN l ON least(x, y) = l.u AND greatest(x, y) = l.v""")
def q_rule_completion(spark, d):
    n, e = _t(spark, d, "nodes", "edges")
    return graph.rule_completion(n, e).select("source", "target", "edge_type")


@query(rf"""WITH {B}, t AS (SELECT DISTINCT 'figure' AS kind, address.chunk_id AS source, address.paper_id AS p, unnest(regexp_extract_all(coalesce(content, ''), '(?i)(?:^|[^0-9A-Za-z_])(?:Fig\.?|Figure)\s*\.?\s*\(?([0-9]+)', 1)) AS label FROM b WHERE modality = 'text'
    UNION SELECT DISTINCT 'table', address.chunk_id, address.paper_id, unnest(regexp_extract_all(coalesce(content, ''), '(?i)(?:^|[^0-9A-Za-z_])(?:Tab\.?|Table)\s*\.?\s*\(?([0-9]+)', 1)) FROM b WHERE modality = 'text'
    UNION SELECT DISTINCT 'equation', address.chunk_id, address.paper_id, unnest(regexp_extract_all(coalesce(content, ''), '(?i)(?:^|[^0-9A-Za-z_])(?:Eq\.?|Equation)\s*\.?\s*\(?([0-9]+)', 1)) FROM b WHERE modality = 'text'),
    f AS (SELECT CASE modality WHEN 'formula' THEN 'equation' ELSE modality END AS kind, address.paper_id AS p, extra.label AS label, arg_max(address.chunk_id, (created_at, block_id)) AS target FROM b WHERE modality IN ('figure', 'table', 'formula') AND coalesce(extra.label, '') <> '' GROUP BY 1, 2, 3)
    SELECT t.kind, source, target, t.label FROM t JOIN f ON t.kind = f.kind AND t.p = f.p AND t.label = f.label""".replace("\\\\", "\\"))
def q_cross_modal_refs(spark, d):
    """Text chunks to the figures, tables and equations that they name; the block written last has the label."""
    (b,) = _t(spark, d, "evidence_blocks")
    rows = None
    for kind in ("figure", "table", "equation"):
        each = graph.cross_modal_references(b, kind).withColumn("kind", F.lit(kind))
        rows = each if rows is None else rows.unionByName(each)
    return rows.select("kind", "source", "target", "label")


@query(f"""WITH {N}, m AS (SELECT node_id, address.paper_id AS p, string_split(CASE WHEN coalesce(address.section_path, '') = '' THEN 'ROOT' ELSE address.section_path END, '/') AS parts FROM n WHERE node_type IN ('ChunkNode','FigureNode','TableNode','EquationNode') AND address.paper_id IS NOT NULL),
    s AS (SELECT node_id, p, len(parts) AS k, i, array_to_string(parts[1:i], '/') AS prefix, array_to_string(parts[1:i-1], '/') AS above FROM m, unnest(range(1, len(parts) + 1)) AS r(i)),
    x AS (SELECT CASE WHEN i = 1 THEN p || '::PAPER' ELSE p || '::SEC::' || ({_slug('above', 60)}) END AS source, p || '::SEC::' || ({_slug('prefix', 60)}) AS target FROM s
    UNION ALL SELECT p || '::SEC::' || ({_slug('prefix', 60)}), node_id FROM s WHERE i = k) SELECT DISTINCT source, target FROM x""")
def q_structure_edges(spark, d):
    return graph.structure_edges(*_t(spark, d, "nodes"))


# ---- traversal and binding -------------------------------------------------------------------------------------


@query(f"""WITH {N}, c AS (SELECT node_id, node_ord, address.chunk_id AS c FROM n WHERE address.chunk_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY (node_id = c)::INT DESC, node_ord) AS r FROM c),
    p AS (SELECT a.node_id, r.node_id AS mate, row_number() OVER (PARTITION BY a.node_id ORDER BY r.r) AS place FROM c a JOIN r ON a.c = r.c AND r.node_id <> a.node_id AND r.r <= 41) SELECT node_id, mate, place::INT AS place FROM p WHERE place <= 40""")
def q_chunk_mates(spark, d):
    return graph.chunk_mates(*_t(spark, d, "nodes"))


@query(f"""WITH {N}, c AS (SELECT node_id, address.paper_id AS p, address.section_path AS s, row_number() OVER (PARTITION BY address.paper_id, address.section_path ORDER BY node_ord) AS place FROM n WHERE node_type = 'ChunkNode')
    SELECT m.node_id, c.node_id AS mate, c.place::INT AS place FROM n m JOIN c ON m.address.paper_id = c.p AND m.address.section_path = c.s WHERE m.node_type IN ('FigureNode','TableNode','EquationNode') AND c.place <= 6""")
def q_section_chunks(spark, d):
    return graph.section_chunks(*_t(spark, d, "nodes"))


@query(f"""WITH {N}, {E}, a AS (SELECT source AS object, target AS attribute FROM e WHERE edge_type = 'has_attribute' AND {ELIGIBLE}), v AS (SELECT source AS attribute, target AS value FROM e WHERE edge_type = 'has_value' AND {ELIGIBLE})
    SELECT DISTINCT object, attribute, value FROM a JOIN v USING (attribute) JOIN n ON n.node_id = value WHERE n.node_type = 'ValueNode'""")
def q_values_via_attribute(spark, d):
    return binding.values_via_attribute(*_t(spark, d, "nodes", "edges"))


@query(f"""WITH {N}, {E}, own AS (SELECT e.source AS value, arg_min((n.node_id, {_trim('n.content')}), edge_ord) AS u FROM e JOIN n ON n.node_id = e.target AND n.node_type = 'UnitNode' WHERE edge_type = 'has_unit' AND coalesce(e.polarity, 'positive') = 'positive' AND coalesce(e.confidence, 1.0) >= 0.5 GROUP BY 1),
    col AS (SELECT e.source, arg_min((n.node_id, {_trim('n.content')}), edge_ord) AS u FROM e JOIN n ON n.node_id = e.target AND n.node_type = 'UnitNode' WHERE edge_type = 'has_unit' GROUP BY 1),
    into_ AS (SELECT e.target AS value, arg_min(col.u, e.edge_ord) AS u FROM e JOIN n ON n.node_id = e.source AND n.node_type = 'AttributeNode' JOIN col ON col.source = e.source WHERE e.edge_type = 'has_value' GROUP BY 1)
    SELECT n.node_id AS value, coalesce(own.u, into_.u)[1] AS unit_node, coalesce(coalesce(own.u, into_.u)[2], '') AS unit FROM n LEFT JOIN own ON own.value = n.node_id LEFT JOIN into_ ON into_.value = n.node_id WHERE n.node_type = 'ValueNode'""")
def q_value_unit_binding(spark, d):
    return binding.value_units(*_t(spark, d, "nodes", "edges"))


@query(f"""WITH {N}, {E}, ch AS (SELECT DISTINCT a.source AS object, a.target AS attribute, v.target AS value FROM e a JOIN e v ON v.source = a.target JOIN n ON n.node_id = v.target AND n.node_type = 'ValueNode' WHERE a.edge_type = 'has_attribute' AND v.edge_type = 'has_value' AND coalesce(a.polarity, 'positive') = 'positive' AND coalesce(a.confidence, 1.0) >= 0.5 AND coalesce(v.polarity, 'positive') = 'positive' AND coalesce(v.confidence, 1.0) >= 0.5),
    m AS (SELECT t.address.chunk_id AS chunk_id, t.canonical_id AS metric, object, arg_min(value, (attribute, value)) AS value FROM ch JOIN n t ON t.node_id = attribute WHERE t.canonical_id <> '' AND t.address.chunk_id IS NOT NULL GROUP BY ALL)
    SELECT chunk_id, metric, object, value, objects FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id, metric) AS objects FROM m) WHERE objects > 1""")
def q_shared_metric(spark, d):
    return binding.shared_metrics(*_t(spark, d, "nodes", "edges"))


@query(f"""WITH {N}, {_SAME}, l AS (SELECT source, target FROM s WHERE target IS NOT NULL), b AS (SELECT source, target FROM l UNION SELECT target, source FROM l)
    SELECT b.source AS node_id, b.target AS peer, (x.address.paper_id IS DISTINCT FROM y.address.paper_id) AS other_paper FROM b JOIN n x ON x.node_id = b.source JOIN n y ON y.node_id = b.target""")
def q_same_as_peers(spark, d):
    (n,) = _t(spark, d, "nodes")
    return binding.peers(n, graph.same_as(n))


@query()
def q_downward_walk(spark, d):
    """The evidence below every chunk; tested against a plain walk."""
    n, e = _t(spark, d, "nodes", "edges")
    return graph.downward_walk(n, e, graph.unique_nodes(n).where("node_type = 'ChunkNode'"))


@query()
def q_upward_locate(spark, d):
    """The way up from every value; tested against a plain walk."""
    n, e = _t(spark, d, "nodes", "edges")
    rows = graph.upward_locate(n, e, graph.unique_nodes(n).where("node_type = 'ValueNode'"))
    return rows.select("start", F.array_join("chain", "|").alias("chain"))


@query()
def q_greedy_walk(spark, d):
    n, e = _t(spark, d, "nodes", "edges")
    rows = graph.greedy_walk(n, e, graph.gate(n).where("node_type = 'ConceptNode' and ok"))
    return rows.select("start", F.array_join("chain", "|").alias("chain"))


@query()
def q_backing_path(spark, d):
    """The shortest backing of every value by a concept of its chunk."""
    n, e = _t(spark, d, "nodes", "edges")
    u = graph.unique_nodes(n).where("address.chunk_id is not null").select("node_id", "node_type", F.col("address.chunk_id").alias("c"))
    pairs = u.where("node_type = 'ConceptNode'").select("c", F.col("node_id").alias("source")).join(u.where("node_type = 'ValueNode'").select("c", F.col("node_id").alias("target")), "c").select("source", "target")
    return graph.backing_paths(pairs, n, e).select("source", "target", F.array_join("path", "|").alias("path"))


@query(f"""WITH {N}, c AS (SELECT canonical_id, address.paper_id AS p, arg_min(node_id, node_ord) AS node_id FROM n WHERE canonical_id IS NOT NULL AND canonical_id <> '' AND address.paper_id IS NOT NULL AND node_type = 'ConceptNode' GROUP BY 1, 2)
    SELECT canonical_id, count(*)::BIGINT AS papers, min(node_id) AS first_node FROM c GROUP BY 1 HAVING count(*) >= 2""")
def q_cross_paper_align(spark, d):
    """Concepts that several papers share, with the number of papers: pairs are left to the chain of q_same_as."""
    return graph.aligned_across_papers(*_t(spark, d, "nodes"))


# ---- finders ---------------------------------------------------------------------------------------------------


@query(f"""WITH {N}, {G}, a AS (SELECT node_id, node_ord, CASE node_type WHEN 'ConceptNode' THEN 0 WHEN 'ClaimNode' THEN 1 ELSE 2 END AS t FROM g WHERE ok AND node_type IN ('ConceptNode','ClaimNode','MethodNode') AND length({_trim(NAME)}) >= 4)
    SELECT row_number() OVER (ORDER BY t, node_ord)::INT AS place, node_id FROM a ORDER BY t, node_ord LIMIT 30""")
def q_atomic(spark, d):
    return finders.atomic(*_t(spark, d, "nodes")).select("place", F.col("nodes")[0].alias("node_id"))


@query(f"""WITH {N}, {G}, {E}, u AS (SELECT e.source AS value, arg_min(e.target, edge_ord) AS unit FROM e JOIN n ON n.node_id = e.target WHERE n.node_type = 'UnitNode' GROUP BY 1), c AS (SELECT e.target AS attribute, arg_min(e.source, edge_ord) AS concept FROM e JOIN g ON g.node_id = e.source WHERE g.node_type = 'ConceptNode' AND g.ok GROUP BY 1),
    p AS (SELECT e.source AS attribute, e.target AS value, a.node_ord AS o, e.edge_ord FROM e JOIN g a ON a.node_id = e.source AND a.node_type = 'AttributeNode' AND a.ok JOIN n v ON v.node_id = e.target AND v.node_type = 'ValueNode'),
    x AS (SELECT p.*, u.unit, c.concept, row_number() OVER (ORDER BY (u.unit IS NULL)::INT, o, edge_ord) AS place FROM p LEFT JOIN u USING (value) LEFT JOIN c USING (attribute)) SELECT place::INT AS place, attribute, value, unit, concept FROM x WHERE place <= 30""")
def q_numerical(spark, d):
    return finders.numerical(*_t(spark, d, "nodes", "edges"))


@query(f"""WITH {N}, {E}, f AS (SELECT CASE WHEN edge_type = 'under_condition' THEN target ELSE source END AS source, CASE WHEN edge_type = 'under_condition' THEN source ELSE target END AS target, edge_ord FROM e),
    x AS (SELECT row_number() OVER (ORDER BY n.node_ord, f.edge_ord) AS place, f.source AS condition, f.target FROM f JOIN n ON n.node_id = f.source WHERE n.node_type = 'ConditionNode') SELECT place::INT AS place, condition, target FROM x WHERE place <= 30""")
def q_condition(spark, d):
    """Conditions with what they bear on; edges that lead to a condition are read from its side, as the tables hold no others."""
    n, e = _t(spark, d, "nodes", "edges")
    to = F.col("edge_type") == "under_condition"
    turned = e.withColumns({"source": F.when(to, F.col("target")).otherwise(F.col("source")), "target": F.when(to, F.col("source")).otherwise(F.col("target"))})
    return finders.condition(n, turned)


@query(f"""WITH {N}, {E} SELECT coalesce(a.canonical_id, a.node_id) AS canonical_id, count(DISTINCT e.source)::BIGINT AS concepts, count(DISTINCT e.target)::BIGINT AS attributes FROM e JOIN n a ON a.node_id = e.target AND a.node_type = 'AttributeNode' JOIN n c ON c.node_id = e.source AND c.node_type = 'ConceptNode' GROUP BY 1 HAVING count(DISTINCT e.source) >= 2""")
def q_comparative(spark, d):
    return finders.comparative(*_t(spark, d, "nodes", "edges"))


@query(f"""WITH {N}, {E}, {ADJ}, r AS (SELECT node, neighbour, row_number() OVER (PARTITION BY node ORDER BY side, place) AS r FROM adj) SELECT n.node_id, coalesce(string_agg(r.neighbour, '|' ORDER BY r.r), '') AS neighbours FROM n LEFT JOIN r ON r.node = n.node_id AND r.r <= 3 WHERE n.node_type IN ('TableNode','FigureNode') GROUP BY 1""")
def q_table_figure(spark, d):
    return finders.media(*_t(spark, d, "nodes", "edges"))


@query(f"""WITH {N}, {E}, o AS (SELECT source, least(count(*), 3) AS c FROM e GROUP BY 1), i AS (SELECT target, arg_min(source, edge_ord) AS reference FROM e GROUP BY 1) SELECT n.node_id, coalesce(o.c, 0)::BIGINT AS targets, i.reference FROM n LEFT JOIN o ON o.source = n.node_id LEFT JOIN i ON i.target = n.node_id WHERE n.node_type = 'EquationNode'""")
def q_formula(spark, d):
    return finders.formula(*_t(spark, d, "nodes", "edges")).select("node_id", F.col("targets").cast("bigint").alias("targets"), "reference")


@query()
def q_multi_hop(spark, d):
    return finders.multi_hop(*_t(spark, d, "nodes", "edges")).select("place", F.array_join("nodes", "|").alias("nodes"), "sections")


@query(f"""WITH {N}, {E}, r AS (SELECT c.address.paper_id AS paper_id, coalesce(c.address.section_path, '') AS section, e.target, row_number() OVER (PARTITION BY c.address.paper_id, coalesce(c.address.section_path, '') ORDER BY e.edge_ord) AS r FROM e JOIN n c ON c.node_id = e.source AND c.node_type = 'ChunkNode' JOIN n p ON p.node_id = e.target AND p.node_type IN ('ClaimNode','ConceptNode') WHERE e.edge_type = 'contains')
    SELECT paper_id, section, count(*)::BIGINT AS members, string_agg(target, '|' ORDER BY r) AS nodes FROM r WHERE r <= 5 GROUP BY 1, 2 HAVING count(*) >= 2""")
def q_summary(spark, d):
    return finders.summary(*_t(spark, d, "nodes", "edges"))


def _qa_plans(t: DataFrame) -> DataFrame:
    return qa.items(t).where(F.size("source_nodes") > 0).select(F.col("qid").alias("plan_id"), F.array_distinct("source_nodes").alias("nodes"), F.coalesce(F.size("evidence_path"), F.lit(0)).alias("path_length"))


_PLANS = f"p AS (SELECT qid AS plan_id, unnest(list_distinct(source_nodes)) AS node, coalesce(len(evidence_path), 0) AS path_length FROM q WHERE len(source_nodes) > 0)"


@query(f"""WITH {N}, {Q}, {_PLANS}, f AS (SELECT plan_id, any_value(path_length) AS path_length, count(*) AS ev, count(DISTINCT coalesce(modality, 'text')) AS m, count(DISTINCT coalesce(address.section_path, '')) - 1 AS s, sum(CASE WHEN node_type IN ('UnitNode','ConditionNode') THEN 1 ELSE 0 END) AS c, count(DISTINCT coalesce(address.paper_id, '')) > 1 AS x FROM p JOIN n ON n.node_id = p.node GROUP BY 1),
    z AS (SELECT *, ev + path_length + m + 2 * s + c + CASE WHEN x THEN 3 ELSE 0 END AS score FROM f) SELECT plan_id, score::BIGINT AS score, CASE WHEN x OR s >= 1 OR m >= 2 OR score >= 9 THEN 'L4' WHEN score >= 6 THEN 'L3' WHEN score >= 3 THEN 'L2' ELSE 'L1' END AS difficulty FROM z""")
def q_difficulty(spark, d):
    t, n = _t(spark, d, "qa_items", "nodes")
    return finders.difficulty(_qa_plans(t), n).select("plan_id", F.col("score").cast("bigint").alias("score"), "difficulty")


@query()
def q_plan_constraints(spark, d):
    t, n = _t(spark, d, "qa_items", "nodes")
    return finders.plan_constraints(_qa_plans(t), n)


# ---- overlay planning ------------------------------------------------------------------------------------------

_WEIGHT = "CASE node_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in planner.SEED_LEVEL.items()) + " ELSE 0.4 END"
_SEED = f"""k AS (SELECT node_id, count(*) AS c FROM (SELECT source AS node_id FROM ea UNION ALL SELECT target FROM ea) GROUP BY 1),
    s AS (SELECT g.node_id, g.node_type, g.node_ord, g.ok, round(CASE WHEN coalesce(domain_schema_tag, '') <> '' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + least(1.0::DOUBLE, coalesce(k.c, 0) / 8.0::DOUBLE) + 0.8::DOUBLE * ({_WEIGHT})::DOUBLE
    - CASE WHEN {_symbolic(NAME)} OR regexp_replace(lower({_trim(NAME)}), '\\.+$', '') IN ({_list(R.STOPWORDS)}) THEN 1.0::DOUBLE WHEN length({_trim(NAME)}) < 4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM g LEFT JOIN k USING (node_id))"""


@query(f"WITH {N}, {G}, {E_ALL}, {_SEED} SELECT node_id, score FROM s")
def q_seed_score(spark, d):
    n, e = _t(spark, d, "nodes", "edges")
    return planner.seed_scores(n, e).select("node_id", "score")


@query(f"""WITH {N}, {G}, {E_ALL}, {_SEED}, r AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, CASE node_type WHEN 'AttributeNode' THEN 1 ELSE 2 END, node_ord) AS place FROM s WHERE ok AND node_type IN ('AttributeNode','ValueNode')) SELECT node_id, place::INT AS place, score FROM r WHERE place <= 48""")
def q_seed_rank(spark, d):
    return planner.ranked_seeds(*_t(spark, d, "nodes", "edges"), "numerical")


@query(f"""WITH {N}, {E}, m AS (SELECT node_id AS attribute, canonical_id AS identity, {_tok('content')} AS words FROM n), a AS (SELECT m.* FROM m JOIN n ON n.node_id = m.attribute WHERE n.node_type = 'AttributeNode'),
    h AS (SELECT e.source AS object, c.node_ord, m.identity AS same, m.words AS others FROM e JOIN m ON m.attribute = e.target JOIN n c ON c.node_id = e.source AND c.node_type = 'ConceptNode' WHERE e.edge_type = 'has_attribute' AND coalesce(e.polarity, 'positive') = 'positive' AND coalesce(e.confidence, 1.0) >= 0.5),
    b AS (SELECT attribute, object, node_ord FROM a JOIN h ON a.identity = h.same WHERE a.identity <> '' UNION SELECT attribute, object, node_ord FROM (SELECT attribute, words, unnest(words) AS w FROM a) x JOIN (SELECT *, unnest(others) AS w FROM h) y ON x.w = y.w WHERE len(list_intersect(words, others)) > 0.5 * (len(words) + len(others) - len(list_intersect(words, others))))
    SELECT attribute, object, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY node_ord, object) AS place FROM b) WHERE place <= 3""")
def q_comparable_objects(spark, d):
    """For every attribute the first three concepts that have a comparable one."""
    n, e = _t(spark, d, "nodes", "edges")
    return binding.comparable_objects(graph.unique_nodes(n).where("node_type = 'AttributeNode'").select(F.col("node_id").alias("attribute")), n, e)


@query()
def q_virtual_edges(spark, d):
    """Scores of links proposed between concepts and values that share a chunk."""
    n, e = _t(spark, d, "nodes", "edges")
    u = graph.unique_nodes(n).where("address.chunk_id is not null").select("node_id", "node_type", F.col("address.chunk_id").alias("c"))
    pairs = u.where("node_type = 'ConceptNode'").select("c", F.col("node_id").alias("source")).join(u.where(F.col("node_type").isin("ValueNode", "ConditionNode")).select("c", F.col("node_id").alias("target")), "c")
    return planner.virtual_edges(pairs, n, e, "comparative")


def _overlay(kind: str):
    def run(spark, d):
        rows = planner.plan(*_t(spark, d, "nodes", "edges"), kind)
        return rows.withColumn("nodes", F.array_join("nodes", "|"))

    run.__name__, run.__doc__ = f"q_overlay_{kind}", f"Score-guided plans for {kind} questions, bound, completed and grounded."
    return run


for _kind in planner.ROLE_SCHEMAS:
    query()(_overlay(_kind))


@query()
def q_plan_completeness(spark, d):
    """How complete and useful the plans for numerical questions are."""
    plans = planner.roles_map(planner.plan(*_t(spark, d, "nodes", "edges"), "numerical"))
    return metrics.completeness(plans, ["role", "evidence", "constraint", "structure", "noise"])


@query()
def q_binding_correctness(spark, d):
    """Whether values, results, instances and units of comparative and numerical plans belong together."""
    n, e = _t(spark, d, "nodes", "edges")
    leveled = graph.clean(graph.leveled_edges(n, e))
    plans = cut_lineage(planner.plan(n, e, "comparative", leveled=leveled).unionByName(planner.plan(n, e, "numerical", leveled=leveled)))
    return metrics.binding_correctness(planner.roles_map(plans), n, leveled)


_CHUNKS = "c AS (SELECT qid, coalesce(len(list_distinct(list_filter(list_transform(evidence_spans, lambda s: s.address.chunk_id), lambda x: x IS NOT NULL))), 0) AS chunks, coalesce(len(evidence_path), 0) AS path, difficulty, question_type FROM q)"


def _with_chunks(t: DataFrame) -> DataFrame:
    chunks = F.size(F.array_distinct(F.filter(F.transform("evidence_spans", lambda s: s["address"]["chunk_id"]), lambda c: c.isNotNull())))
    return qa.items(t).select("qid", F.coalesce(chunks, F.lit(0)).alias("chunks"), F.coalesce(F.size("evidence_path"), F.lit(0)).alias("path"), "difficulty", "question_type")


@query(f"WITH {Q}, {_CHUNKS} SELECT qid, CASE WHEN chunks <= 1 AND path <= 1 THEN 'L1' WHEN chunks <= 1 THEN 'L2' WHEN chunks = 2 THEN 'L3' ELSE 'L4' END AS level FROM c")
def q_difficulty_cap(spark, d):
    return _with_chunks(*_t(spark, d, "qa_items")).select("qid", planner.difficulty_cap_column("chunks", "path").alias("level"))


@query(f"WITH {Q}, {_CHUNKS} SELECT qid, difficulty NOT IN ('L3','L4') OR (chunks >= 2 AND path >= CASE difficulty WHEN 'L3' THEN 2 ELSE 3 END) AS ok FROM c WHERE difficulty IS NOT NULL")
def q_dual_multihop(spark, d):
    rows = _with_chunks(*_t(spark, d, "qa_items")).where("difficulty is not null")
    return rows.select("qid", planner.dual_multi_hop_column("difficulty", "chunks", "path").alias("ok"))


@query(f"WITH {Q} SELECT question_type, min(qid) AS plan_id, count(*)::BIGINT AS copies FROM q WHERE source_nodes IS NOT NULL GROUP BY question_type, list_sort(list_distinct(source_nodes))")
def q_plan_dedup(spark, d):
    (t,) = _t(spark, d, "qa_items")
    plans = qa.items(t).where("source_nodes is not null").select(F.col("qid").alias("plan_id"), "question_type", F.col("source_nodes").alias("nodes"))
    return planner.distinct_plans(plans).select("question_type", "plan_id", "copies")


@query(f"WITH {Q} SELECT question_type AS pattern, count(*)::BIGINT AS tried, sum(CASE WHEN validator_result.pool = 'benchmark' THEN 1 ELSE 0 END)::BIGINT AS succeeded, round(avg(CASE WHEN validator_result.pool = 'benchmark' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM q GROUP BY 1")
def q_memory_rates(spark, d):
    (t,) = _t(spark, d, "qa_items")
    rows = planner.memory(qa.items(t).select(F.col("question_type").alias("pattern"), F.coalesce(F.col("validator_result.pool") == "benchmark", F.lit(False)).alias("passed")))
    return rows.withColumn("rate", F.round("rate", 6))


# ---- verification, corruption, pools ---------------------------------------------------------------------------

_REF = f"regexp_replace(lower({_trim('answer')}), '[。.]+$', '') IN ({_list(R.REFUSALS)})"
_EV = "coalesce(array_to_string(list_transform(evidence_spans, lambda s: coalesce(s.content, '')), ' '), '')"
_NUMS = lambda c: f"regexp_extract_all(coalesce({c}, ''), '({R.NUMBER})', 1)"
_C = f"c AS (SELECT qid, coalesce(answer, '') AS answer, {_EV} AS ev, constraints, source_nodes, evidence_spans FROM q WHERE NOT {_REF})"
_CLOSE = "CASE WHEN y.v = 0 THEN abs(x.v) < 1e-9 ELSE abs(x.v - y.v) / abs(y.v) <= 0.02 END"
_NUMERIC = f"""a AS (SELECT qid, unnest({_NUMS('answer')}) AS num, generate_subscripts({_NUMS('answer')}, 1) AS i FROM c), x AS (SELECT qid, num, i, try_cast(num AS DOUBLE) AS v FROM a),
    y AS (SELECT qid, try_cast(num AS DOUBLE) AS v FROM (SELECT qid, unnest({_NUMS('ev')}) AS num FROM c)), nv AS (SELECT x.qid, x.num FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.qid = x.qid AND {_CLOSE}))"""


@query(f"WITH {Q}, {_C}, {_NUMERIC} SELECT qid, num AS actual FROM nv")
def q_check_numeric(spark, d):
    return qa.check_numeric(*_t(spark, d, "qa_items")).select("qid", "actual")


def _units(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(coalesce({c}, ''), '{_VU}', 2), lambda u: coalesce(u, '') <> ''))"


_DIM = """CASE WHEN u IN ('%', 'wt%', 'wt.%', 'at%', 'at.%') THEN 'ratio' WHEN u IN ('K', '°C', '℃') THEN 'temperature' WHEN u IN ('nm', 'µm', 'um', 'mm', 'cm', 'm') THEN 'length' WHEN u IN ('kg', 'g', 'mg') THEN 'mass'
    WHEN u IN ('Pa', 'kPa', 'MPa', 'GPa') THEN 'pressure' WHEN u IN ('eV', 'meV', 'J') THEN 'energy' WHEN u IN ('mA', 'A') THEN 'current' WHEN u IN ('Hz', 'MHz', 'GHz') THEN 'frequency' WHEN u IN ('s', 'min', 'h') THEN 'time' ELSE u END"""
_UNIT = f"ku AS (SELECT qid, {_units('answer')} AS au, list_transform({_units('ev')}, lambda u: {_DIM}) AS eu FROM c), uv AS (SELECT qid, u AS actual FROM (SELECT qid, unnest(au) AS u, eu FROM ku WHERE len(eu) > 0) WHERE NOT list_contains(eu, {_DIM}))"


@query(f"WITH {Q}, {_C}, {_UNIT} SELECT qid, actual FROM uv")
def q_check_unit(spark, d):
    return qa.check_unit(*_t(spark, d, "qa_items")).select("qid", "actual")


_COND = f"""kc AS (SELECT qid, answer, unnest(constraints['condition']) AS cond FROM c), kk AS (SELECT *, list_filter(string_split(trim(regexp_replace(cond, '[^0-9a-zA-Z一-鿿]+', ' ', 'g')), ' '), lambda k: k <> '') AS keys FROM kc),
    cv AS (SELECT qid, cond AS actual FROM kk WHERE len(keys) > 0 AND len(list_filter(keys, lambda k: length(k) > 1 AND contains(answer, k))) = 0 UNION ALL SELECT DISTINCT qid, 'over-generalized answer' FROM kc WHERE {' OR '.join(f"contains(lower(answer), '{g}')" for g in R.GENERALISERS)})"""


@query(f"WITH {Q}, {_C}, {_COND} SELECT qid, actual FROM cv")
def q_check_condition(spark, d):
    return qa.check_condition(*_t(spark, d, "qa_items")).select("qid", "actual")


_TOKENS = lambda c: f"regexp_extract_all(lower({c}), '([0-9a-zA-Z一-鿿]{{2,}})', 1)"
_EVID = f"""ne AS (SELECT *, coalesce(len(source_nodes), 0) = 0 AND coalesce(len(evidence_spans), 0) = 0 AS none FROM c), ev_ AS (SELECT qid, 'critical' AS severity FROM ne WHERE none UNION ALL SELECT qid, 'major' FROM ne WHERE NOT none AND len({_TOKENS('answer')}) > 0 AND NOT list_has_any({_TOKENS('answer')}, {_TOKENS('ev')}))"""


@query(f"WITH {Q}, {_C}, {_EVID} SELECT qid, severity FROM ev_")
def q_check_evidence(spark, d):
    return qa.check_evidence(*_t(spark, d, "qa_items")).select("qid", "severity")


_ALLV = f"{_C}, {_NUMERIC}, {_UNIT}, {_COND}, {_EVID}, v AS (SELECT qid, 'critical' AS s FROM nv UNION ALL SELECT qid, 'major' FROM uv UNION ALL SELECT qid, 'major' FROM cv UNION ALL SELECT qid, severity FROM ev_), vs AS (SELECT qid, count(*) AS n, sum((s = 'critical')::INT) AS k FROM v GROUP BY 1)"


@query(f"WITH {Q}, {_ALLV} SELECT q.qid, coalesce(n, 0)::BIGINT AS violations, coalesce(k, 0)::BIGINT AS critical, n IS NULL AS passed FROM q LEFT JOIN vs USING (qid)")
def q_verify_summary(spark, d):
    return qa.summary(*_t(spark, d, "qa_items"))


@query(f"WITH {Q}, {_ALLV} SELECT count(*)::BIGINT AS items, sum(coalesce(n, 0))::BIGINT AS violations, round(avg(coalesce(n, 0)), 6) AS density, round(avg((n IS NULL)::INT), 6) AS passed FROM q LEFT JOIN vs USING (qid)")
def q_violation_density(spark, d):
    return metrics.violation_density(*_t(spark, d, "qa_items")).withColumn("density", F.round("density", 6)).withColumn("passed", F.round("passed", 6))


@query(f"WITH {Q}, {_ALLV} SELECT q.qid, CASE WHEN n IS NULL THEN 'benchmark' ELSE 'human_review' END AS pool FROM q LEFT JOIN vs USING (qid) WHERE NOT coalesce(is_corrupted, false)")
def q_pools(spark, d):
    return qa.pools(*_t(spark, d, "qa_items"))


@query()
def q_corrupt(spark, d):
    """Two corruptions of every item, in its own shuffled order."""
    t, n = _t(spark, d, "qa_items", "nodes")
    return qa.corrupt(t, graph.unique_nodes(n).where("node_type = 'ConceptNode'").select("content"))


@query()
def q_preference_pairs(spark, d):
    return qa.preferences(*_t(spark, d, "qa_items"))


@query(f"""WITH {Q} SELECT qid, coalesce(answer, '') || ' [evidence drifted to unrelated span]' AS answer FROM q""")
def q_evidence_drift(spark, d):
    (t,) = _t(spark, d, "qa_items")
    return qa.items(t).withColumn("answer", F.coalesce("answer", F.lit(""))).select("qid", qa.evidence_drift().alias("answer"))


@query(f"""WITH {Q} SELECT qid, question_type, row_number() OVER (PARTITION BY question_type ORDER BY qid)::INT AS turn FROM q""")
def q_interleave(spark, d):
    (t,) = _t(spark, d, "qa_items")
    return qa.interleaved(qa.items(t), "question_type", "qid")


@query()
def q_repair(spark, d):
    """Failing answers replaced by their first evidence, checked again, for two rounds."""
    (t,) = _t(spark, d, "qa_items")
    evidence = F.regexp_extract("prompt", r"(?s)\nEvidence: (.*)$", 1)
    return qa.repair(t, lambda p: p.select("qid", evidence.alias("text")), rounds=2)


@query()
def q_json_salvage(spark, d):
    """JSON objects found in texts, thinking passages aside."""
    (t,) = _t(spark, d, "documents")
    rows = t.select("doc_id", json_object(without_thoughts("text")).alias("found"))
    return rows.where("found is not null")


# ---- metrics ---------------------------------------------------------------------------------------------------


@query(f"WITH {Q} SELECT 'question_type' AS kind, question_type AS name, count(*)::BIGINT AS n FROM q GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*)::BIGINT FROM q GROUP BY 2")
def q_stats(spark, d):
    return metrics.qa_stats(*_t(spark, d, "qa_items"))


@query(f"WITH {Q} SELECT count(DISTINCT question_type)::BIGINT AS types, count(DISTINCT question_type) / 8.0::DOUBLE AS coverage FROM q")
def q_type_coverage(spark, d):
    return metrics.type_coverage(*_t(spark, d, "qa_items"))


@query(f"""WITH {Q} SELECT count(*)::BIGINT AS items, round(avg(coalesce(length(trim(question)) >= 6, false)::INT), 6) AS has_question, round(avg(coalesce(length(trim(answer)) > 0, false)::INT), 6) AS has_answer, round(avg(coalesce(len(evidence_spans) > 0, false)::INT), 6) AS has_evidence, round(avg(coalesce(len(source_nodes) > 0, false)::INT), 6) AS has_nodes FROM q""")
def q_structural_validity(spark, d):
    rows = metrics.structural_validity(*_t(spark, d, "qa_items"))
    return rows.select("items", *[F.round(c, 6).alias(c) for c in rows.columns if c != "items"])


@query(f"WITH {Q}, {_CHUNKS} SELECT difficulty, count(*)::BIGINT AS items, sum((chunks >= 2)::INT)::BIGINT AS multi_chunk FROM c GROUP BY 1")
def q_multihop_authenticity(spark, d):
    return metrics.multi_hop_authenticity(*_t(spark, d, "qa_items"))


@query(f"WITH {Q} SELECT question_type, count(*)::BIGINT AS items, median(coalesce(len(evidence_path), 0))::DOUBLE AS median, min(coalesce(len(evidence_path), 0))::INT AS least, max(coalesce(len(evidence_path), 0))::INT AS most FROM q GROUP BY 1")
def q_plan_quality(spark, d):
    return metrics.plan_quality(*_t(spark, d, "qa_items"))


@query(f"""WITH {Q}, t AS (SELECT question_type, (epoch_us(ingested_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE AS h FROM q) SELECT question_type, count(*)::BIGINT AS n, round(sum(h), 3) AS total, round(avg(h), 3) AS average, round(min(h), 6) AS least, round(max(h), 6) AS most FROM t GROUP BY 1""")
def q_timing_by_type(spark, d):
    (t,) = _t(spark, d, "qa_items")
    first = t.where("qid is not null").groupBy("qid").agg(F.first("question_type").alias("question_type"), F.min("ingested_at").alias("ingested_at"), F.first("created_at").alias("created_at"))
    rows = metrics.delays(first, "question_type")
    return rows.select("question_type", "n", F.round("total", 3).alias("total"), F.round("average", 3).alias("average"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("""WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0::DOUBLE AS y FROM lineitem)
    SELECT g AS l_returnflag, count(*)::BIGINT AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def q_spearman(spark, d):
    (t,) = _t(spark, d, "lineitem")
    return metrics.spearman(t, ["l_returnflag"], "l_quantity", "l_discount").withColumn("rho", F.round("rho", 6))


@query(f"""WITH {Q}, m AS (SELECT difficulty, avg(CASE WHEN validator_result.pool = 'benchmark' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM q GROUP BY 1) SELECT difficulty, round(a, 6) AS accuracy, coalesce(a <= lag(a) OVER (ORDER BY difficulty), true) AS falls FROM m""")
def q_monotonic_accuracy(spark, d):
    (t,) = _t(spark, d, "qa_items")
    rows = qa.items(t).select("difficulty", F.when(F.col("validator_result.pool") == "benchmark", 1.0).otherwise(0.0).alias("hit"))
    return metrics.monotonic(rows, "difficulty", "hit").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_type, round(avg(CASE WHEN value BETWEEN 1 AND 5 THEN value END), 6) AS value FROM events GROUP BY 1")
def q_judge_means(spark, d):
    (t,) = _t(spark, d, "events")
    return metrics.judge_means(t, "event_type", ["value"]).withColumn("value", F.round("value", 6))


@query(f"""WITH {Q}, w AS (SELECT qid, unnest(constraints['number']) AS num, generate_subscripts(constraints['number'], 1) AS i FROM q WHERE len(constraints['number']) > 0), y AS (SELECT qid, unnest({_NUMS('answer')}) AS num FROM q),
    k AS (SELECT w.qid, w.i, max(CASE WHEN y.num IS NULL THEN 0 WHEN try_cast(y.num AS DOUBLE) IS NULL OR try_cast(w.num AS DOUBLE) IS NULL THEN (y.num = w.num)::INT WHEN try_cast(w.num AS DOUBLE) = 0 THEN (abs(try_cast(y.num AS DOUBLE)) < 1e-9)::INT ELSE (abs(try_cast(y.num AS DOUBLE) - try_cast(w.num AS DOUBLE)) / abs(try_cast(w.num AS DOUBLE)) <= 0.02)::INT END) AS hit FROM w LEFT JOIN y ON w.qid = y.qid GROUP BY 1, 2)
    SELECT qid, count(*)::BIGINT AS asked, sum(hit)::BIGINT AS kept FROM k GROUP BY 1""")
def q_cf_check(spark, d):
    """Constraint numbers that answers reproduce."""
    return metrics.number_recall(*_t(spark, d, "qa_items")).select("qid", F.col("asked").cast("bigint").alias("asked"), F.col("kept").cast("bigint").alias("kept"))


@query(f"""WITH {Q}, c AS (SELECT qid, question_type, coalesce(len(constraints['number']), 0) + coalesce(len(constraints['unit']), 0) AS hard, answer, evidence_spans FROM q) SELECT qid FROM c WHERE NOT ({_REF}) AND coalesce(len(evidence_spans), 0) > 0 AND (question_type = 'comparative' OR hard >= 2)""")
def q_cf_subset(spark, d):
    return metrics.probe_items(*_t(spark, d, "qa_items"), "multi").select("qid")


@query()
def q_fidelity(spark, d):
    """How far the answers keep numbers, ranges, units and conditions; tested against hand-made items."""
    return metrics.fidelity(*_t(spark, d, "qa_items"))


@query(f"""WITH {Q}, k AS (SELECT qid, regexp_replace(coalesce(answer, ''), '^\s+|\s+$', '', 'g') IN ({_list(R.KEPT_REFUSALS)}) AS r FROM q) SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN r THEN ['refusal'] ELSE ['evidence_grounded_instruction', 'graph_reasoning_trace', 'rag_grounding'] END) AS kind FROM k) GROUP BY 1""")
def q_corpus_samples(spark, d):
    return qa.corpus_samples(*_t(spark, d, "qa_items")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {Q} SELECT qid, question AS question_asked, coalesce(answer, '') AS answer, coalesce(array_to_string(evidence_path, ' -> '), '') AS trace FROM q WHERE regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') NOT IN ({_list(R.KEPT_REFUSALS)})".replace("\\\\", "\\"))
def q_graph_trace(spark, d):
    rows = qa.corpus_samples(*_t(spark, d, "qa_items")).where("kind = 'graph_reasoning_trace'")
    return rows.select("qid", F.col("instruction").alias("question_asked"), F.col("output").alias("answer"), "trace")


@query()
def q_verifier_samples(spark, d):
    """Good and bad samples by label and error."""
    (t,) = _t(spark, d, "qa_items")
    return metrics.composition(qa.verifier_samples(t, qa.corrupt(t)))


@query()
def q_before_after(spark, d):
    """The figures of clean and of corrupted items side by side."""
    (t,) = _t(spark, d, "qa_items")
    return metrics.before_after(metrics.external(t.where("not coalesce(is_corrupted, false)")), metrics.external(t.where("is_corrupted")))


@query("SELECT date_trunc('minute', ts) AS minute, count(*)::BIGINT AS calls, greatest(0, count(*) - 1)::BIGINT AS over FROM events WHERE ts IS NOT NULL GROUP BY 1")
def q_rpm_window(spark, d):
    return limits.calls_per_minute(*_t(spark, d, "events"))


@query("""WITH m AS (SELECT event_id, date_trunc('minute', ts) AS minute, 100 + (event_id % 50) AS tokens, ts FROM events WHERE ts IS NOT NULL), w AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY minute ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY minute ORDER BY ts, event_id) AS n FROM m)
    SELECT event_id, minute, n = 1 OR before + tokens <= 250 AS admitted FROM w""")
def q_tpm_window(spark, d):
    (t,) = _t(spark, d, "events")
    return limits.admitted(t.withColumn("tokens", F.lit(100) + F.col("event_id") % 50), "tokens", 250)


@query("SELECT paper_id, any_value(parsing_status) AS parsing_status, CASE WHEN any_value(parsing_status) IN ('parsed', 'low_quality') THEN 'done' ELSE 'pending' END AS graph_status FROM papers GROUP BY paper_id")
def q_doc_status(spark, d):
    (p,) = _t(spark, d, "papers")
    rows = p.dropDuplicates(["paper_id"])
    return rows.select("paper_id", "parsing_status", F.when(F.col("parsing_status").isin("parsed", "low_quality"), "done").otherwise("pending").alias("graph_status"))
