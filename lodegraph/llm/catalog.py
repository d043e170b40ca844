"""Queries of the training-data problems tagged llm (1-5 and 7-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import answers, cutoffs, encoding, leaks, lookalikes, markup, neardup, pieces, scans
from lodegraph.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return answers.found_defects(table(spark, folder, "qa_items"))


def p1_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect type that each defective answer triggers."""
    rows = answers.defects(table(spark, folder, "qa_items"))
    return rows.select("qid", F.explode("defects").alias("defect"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.found_pairs(table(spark, folder, "qa_items"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with its group and its number of links."""
    return neardup.groups(table(spark, folder, "qa_items"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of matching classes; a class holds the items with the same set of token pairs."""
    return neardup.class_links(table(spark, folder, "qa_items"))


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every item."""
    return neardup.class_members(table(spark, folder, "qa_items"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.found_terms(table(spark, folder, "nodes"), table(spark, folder, "canonical_terms"))


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every node's one form and the canonical id made from it."""
    return lookalikes.consistent_nodes(table(spark, folder, "nodes"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found_noise(table(spark, folder, "evidence_blocks"), table(spark, folder, "papers"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text block, repaired into continuous paragraphs."""
    return scans.repaired(table(spark, folder, "evidence_blocks"), table(spark, folder, "papers"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.found_cuts(table(spark, folder, "evidence_blocks"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece, with its place in address.span."""
    return pieces.addressed_pieces(table(spark, folder, "evidence_blocks"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.found_markup(table(spark, folder, "evidence_blocks"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every field that held markup."""
    return markup.clean_blocks(table(spark, folder, "evidence_blocks"))


def p7_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    return markup.style_tree(markup.parsed(table(spark, folder, "evidence_blocks")))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.found_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each evaluation item leaked into."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutoffs.found_cut(table(spark, folder, "documents"))


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its texts."""
    return cutoffs.by_source(table(spark, folder, "documents"))


def p10_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The storage limits that the lengths of unfinished texts expose."""
    return cutoffs.hidden_limits(cutoffs.inspected(table(spark, folder, "documents"))[0])


QUERIES = {f.__name__: f for f in (p1_found, p1_defects, p2_found, p2_groups, p2_classes, p2_members, p3_found, p3_forms, p4_found, p4_text, p5_found, p5_pieces, p7_found, p7_clean, p7_style_tree, p8_ids, p9_found, p9_items, p10_found, p10_sources, p10_limits)}

#: The parts of these problems that SQL can state over the same tables.
SQL = {
    "p5_found": """
        SELECT DISTINCT block_id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[\\s。！？；，]+'), lambda x: length(x))) > 1500 THEN 'forced' ELSE 'natural' END AS cut
        FROM evidence_blocks WHERE length(content) > 1500""",
}
