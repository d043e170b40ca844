"""Stages by name and recipes that run them in order.

Each stage maps named tables to named tables; nothing is written until a sink is asked for. A recipe
lists stages as a name, as {name: {parameters}} or as {stage, params, enabled}.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]
STAGES: dict[str, Callable[..., Tables]] = {}


@dataclass
class Step:
    stage: str
    params: dict = field(default_factory=dict)
    enabled: bool = True


def stage(name: str, force: bool = False):
    """Registers a stage under a name; a name is taken once unless forced."""
    if not isinstance(name, str):
        raise TypeError("a stage is registered under a name")

    def register(f: Callable[..., Tables]) -> Callable[..., Tables]:
        if name in STAGES and not force:
            raise KeyError(f"stage {name!r} is registered already")
        STAGES[name] = f
        return f

    return register


def read_recipe(source: dict) -> list[Step]:
    steps = []
    for entry in source.get("stages", []):
        if isinstance(entry, str):
            steps.append(Step(entry))
        elif isinstance(entry, dict) and "stage" in entry:
            steps.append(Step(entry["stage"], entry.get("params") or {}, entry.get("enabled", True)))
        elif isinstance(entry, dict) and len(entry) == 1:
            name, params = next(iter(entry.items()))
            steps.append(Step(name, params or {}))
        else:
            raise ValueError(f"not a stage: {entry!r}")
    return steps


def load_recipe(path: str) -> list[Step]:
    import yaml  # optional: recipes can also be given as dictionaries

    with open(path, encoding="utf-8") as f:
        return read_recipe(yaml.safe_load(f) or {})


def select(steps: list[Step], only: str | None = None, start: str | None = None, stop: str | None = None, skip: tuple[str, ...] = ()) -> list[Step]:
    names = [s.stage for s in steps]
    for name in (only, start, stop):
        if name is not None and name not in names:
            raise ValueError(f"the recipe has no stage {name!r}")
    if only is not None:
        return [s for s in steps if s.stage == only]
    first = names.index(start) if start else 0
    last = names.index(stop) if stop else len(steps) - 1
    return [s for i, s in enumerate(steps) if first <= i <= last and s.enabled and s.stage not in skip]


def run(steps: list[Step], tables: Tables) -> Tables:
    for s in steps:
        if s.stage not in STAGES:
            raise KeyError(f"no stage {s.stage!r}")
        tables = {**tables, **STAGES[s.stage](tables, **s.params)}
    return tables


@stage("graph")
def _graph(tables: Tables, rule_edges: bool = True) -> Tables:
    from lodegraph.operators import graph as G

    out = {"nodes": G.unique_nodes(tables["nodes"]), "edges": G.present_edges(tables["edges"], tables["nodes"]), "same_as": G.same_as(tables["nodes"]), "aligns_with": G.aligns_with(tables["nodes"])}
    return {**out, "rule_edges": G.rule_completion(tables["nodes"], tables["edges"])} if rule_edges else out


@stage("sample")
def _sample(tables: Tables, per_type: int = 30) -> Tables:
    from lodegraph.operators import finders

    n, e = tables["nodes"], tables["edges"]
    return {"plans_atomic": finders.atomic(n, per_type), "plans_numerical": finders.numerical(n, e, per_type), "plans_condition": finders.condition(n, e, per_type), "plans_multi_hop": finders.multi_hop(n, e, per_type)}


@stage("semantic_plan")
def _semantic(tables: Tables, kinds: tuple[str, ...] = ("numerical", "multi_hop"), per_type: int = 12) -> Tables:
    from lodegraph.operators import planner

    return {f"plan_{k}": planner.plan(tables["nodes"], tables["edges"], k, per_type) for k in kinds}


@stage("corrupt")
def _corrupt(tables: Tables, per_item: int = 2) -> Tables:
    from lodegraph.operators import qa

    return {"corrupted": qa.corrupt(tables["qa_items"], per_item=per_item), "preferences": qa.preferences(tables["qa_items"])}


@stage("verify")
def _verify(tables: Tables, checks: list[str] | None = None) -> Tables:
    from lodegraph.operators import qa

    return {"violations": qa.verify(tables["qa_items"], checks), "verified": qa.summary(tables["qa_items"])}


@stage("output")
def _output(tables: Tables) -> Tables:
    from lodegraph.operators import metrics, qa

    return {"pools": qa.pools(tables["qa_items"]), "stats": metrics.qa_stats(tables["qa_items"])}
