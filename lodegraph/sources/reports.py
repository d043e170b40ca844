"""Small results as documents: Markdown reports, the export of a run with its manifest, graph export, recipe copies.

Everything written here is bounded by its kind (metrics, counts, names), not by the data; tables of the
data's size are written by Spark into their own folders.
"""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.files import export_pools, write_document, write_jsonl

#: A report shows so many rows; a longer table is no report.
REPORT_ROWS = 10_000


def markdown(df: DataFrame) -> str:
    """A small table as Markdown; nulls are dashes."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("a report is for small tables; write this one as a table")
    cell = lambda x: "-" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]) + "\n"


def write_report(title: str, sections: dict[str, DataFrame], path: str) -> None:
    """A Markdown report of several small tables, and the same as JSON beside it."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown(df)}" for name, df in sections.items()), encoding="utf-8")
    write_document({name: [r.asDict(recursive=True) for r in df.limit(REPORT_ROWS).collect()] for name, df in sections.items()}, str(Path(path).with_suffix(".json")))


def snapshot_recipe(source: str, folder: str) -> str:
    """The recipe of a run, copied as it is."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    return shutil.copyfile(source, str(Path(folder) / "recipe_snapshot.yaml"))


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, int]:
    """Nodes and edges as JSON lines; returns how many of each."""
    return {"nodes": write_jsonl(nodes, f"{folder}/nodes"), "edges": write_jsonl(edges, f"{folder}/edges")}


def export_run(pools: DataFrame, items: DataFrame, nodes: DataFrame, edges: DataFrame, folder: str, about: dict | None = None) -> dict:
    """Items by pool, the graph they rest on, and a manifest with the counts."""
    export_pools(pools, items, f"{folder}/pools")
    counts = {r["pool"]: r["n"] for r in pools.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    manifest = {**(about or {}), "pools": counts, "graph": export_graph(nodes, edges, f"{folder}/graph")}
    write_document(manifest, f"{folder}/manifest.json")
    return manifest
