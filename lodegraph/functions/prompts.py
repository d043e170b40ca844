"""Prompts and chat messages as columns. Templates are parameters: text with {names} of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a question of each type is asked to be, how it is answered, and what is never asked.
INSTRUCTIONS = {
    "atomic": "Ask for one fact that the evidence states.",
    "numerical": "Ask for a measured value and give it with its unit.",
    "condition": "Ask under which condition a finding holds and keep that condition in the answer.",
    "comparative": "Compare two objects by the same measure, each with its value and unit.",
    "table": "Ask for what a table or figure shows.",
    "formula": "Ask what a formula says or where it comes from.",
    "multi_hop": "Ask for what follows from several places together.",
    "summary": "Ask for what a section says as a whole.",
    "mechanism": "Ask how a method brings about its result.",
    "cross_paper": "Ask how two papers agree or differ on one subject.",
}
FORMS = {"numerical": "value with unit", "formula": "formula", "comparative": "comparison", "summary": "short paragraph"}
FORBIDDEN = ["identifiers of nodes", "values that the evidence doesn't hold", "findings without their conditions"]


def render(template: str, columns: dict[str, Column]) -> Column:
    """A template with {name} replaced by columns; {{ and }} are braces, nulls are empty."""
    parts: list[Column] = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", template):
        parts.append(F.coalesce(columns[name].cast("string"), F.lit("")) if name else F.lit(literal.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts) if parts else F.lit("")


def _of_type(table: dict[str, str], kind: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind), F.lit(other))


def instruction(kind: Column | str) -> Column:
    return _of_type(INSTRUCTIONS, F.col(kind) if isinstance(kind, str) else kind, INSTRUCTIONS["atomic"])


def answer_form(kind: Column | str) -> Column:
    return _of_type(FORMS, F.col(kind) if isinstance(kind, str) else kind, "short text")


def forbidden() -> Column:
    return F.array(*map(F.lit, FORBIDDEN))


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) of (conv_id, turn, role, text): the history in order; a conversation whose history before the last turn is odd has none."""
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("messages"))
    return rows.where((F.size("messages") - 1) % 2 == 0)
