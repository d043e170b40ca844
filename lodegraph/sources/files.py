"""Files that are no parquet tables: JSON lines, documents, graphs, recipes.

Defined results. A missing JSON-lines path reads as an empty table of the given schema; blank lines
are skipped; null fields are left out when written. GraphML writes one file per graph, nested values
as JSON and nulls as empty text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes rows as JSON lines; returns how many, counted while they are written."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").option("ignoreNullFields", "true").json(path)
    return seen.get["n"]


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the matching files, with the paper id made from the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.withColumn("paper_id", paper_id(stem))


def paper_id(stem):
    """The first 40 characters of a file's name, made safe, and eight digits of its hash."""
    return F.concat(F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"), 1, 40), F.lit("_"), F.substring(F.md5(stem), 1, 8))


def read_document(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_document(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def _flat(df: DataFrame) -> DataFrame:
    nested = {c for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    return df.select(*[F.coalesce(F.to_json(c) if c in nested else F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (node_id, ...) and edges (source, target, ...) as one GraphML file, streamed row by row."""
    nodes, edges = _flat(nodes), _flat(edges)
    Path(path).parent.mkdir(parents=True, exist_ok=True)

    def data(row: dict, skip: set[str]) -> Iterator[str]:
        yield from (f"<data key={quoteattr(k)}>{escape(v)}</data>" for k, v in row.items() if k not in skip)

    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for kind, frame in (("node", nodes), ("edge", edges)):
            f.writelines(f'<key id={quoteattr(c)} for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>\n' for c in frame.columns if c not in ("node_id", "source", "target"))
        f.write('<graph edgedefault="directed">\n')
        for r in nodes.toLocalIterator():
            d = r.asDict()
            f.write(f"<node id={quoteattr(d['node_id'])}>{''.join(data(d, {'node_id'}))}</node>\n")
        for r in edges.toLocalIterator():
            d = r.asDict()
            f.write(f"<edge source={quoteattr(d['source'])} target={quoteattr(d['target'])}>{''.join(data(d, {'source', 'target'}))}</edge>\n")
        f.write("</graph>\n</graphml>\n")


def export_pools(pools: DataFrame, items: DataFrame, folder: str) -> None:
    """Items by pool, one folder each, in one write."""
    items.join(pools, "qid").write.mode("overwrite").partitionBy("pool").json(folder)
