"""Queries of the general training-data problem (6); the others live in ``lodegraph.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.operators import quantities
from lodegraph.session import cut_lineage
from lodegraph.sources.tables import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantities.found_values(table(spark, folder, "nodes"), table(spark, folder, "evidence_blocks"), table(spark, folder, "unit_targets"))


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value node that can be read, with its unit and its value in the common unit."""
    return quantities.convert_values(table(spark, folder, "nodes"), table(spark, folder, "evidence_blocks"))


def p6_unit_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The links between unit labels that sources of one entity use, with the estimated scale and offset."""
    read = cut_lineage(quantities.read_values(table(spark, folder, "nodes"), table(spark, folder, "evidence_blocks")))
    return quantities.unit_links(quantities.label_links(read))


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    """What each label names, as carried through the graph from the unit symbols."""
    return quantities.resolved_labels(p6_unit_graph(spark, folder), quantities.dictionary(spark))


QUERIES = {"p6_found": p6_found, "p6_values": p6_values, "p6_unit_graph": p6_unit_graph, "p6_labels": p6_labels}
SQL: dict[str, str] = {}
