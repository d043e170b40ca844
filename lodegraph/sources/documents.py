"""From files to parsed documents: folder scans, a layout parser as a connector, its fallback, and the status of each document.

A parser is any function from a file's bytes to content items; it runs where the file lies, one file
at a time, and a failure is a row, not an exception. Parsed documents are tables of content items
(paper, pos, type, text, text_level, page_idx), from which sections and counters are made by windows.

Defined results. A folder without matching files gives no rows. A document that no parser can read has
status ``failed``; one that only the fallback can read, or whose quality is low, ``low_quality``.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.files import exists, read_files

ITEMS = "paper string, pos int, type string, text string, text_level int, page_idx int, error string"


def scan_documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """One row per PDF of a folder, in the order of its path, not parsed yet."""
    files = read_files(spark, folder, "*.pdf", recursive)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select("paper_id", stem.alias("title"), F.col("path").alias("source_path"), F.lit("pending").alias("parsing_status")).orderBy("source_path")


def scan_parsed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parsed documents of a folder of JSON files, with the file they come from; none if the folder is missing."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{schema}, source_path string")
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("source_path", F.input_file_name())


def parser_available(command: str) -> bool:
    return shutil.which(command) is not None


def command_parser(command: list[str], timeout: float = 3600) -> Callable[[bytes], list[dict]]:
    """A layout parser that reads a file from its input and prints a JSON list of content items."""

    def parse(content: bytes) -> list[dict]:
        done = subprocess.run(command, input=content, capture_output=True, timeout=timeout, check=True)
        return json.loads(done.stdout)

    return parse


def parsed_items(files: DataFrame, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """The content items of each file (paper_id, content); a file that can't be parsed gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ITEMS.split(", ")]
        for b in batches:
            for paper, content in zip(b["paper_id"], b["content"]):
                try:
                    rows = [(paper, i, x.get("type"), x.get("text"), x.get("text_level"), x.get("page_idx"), None) for i, x in enumerate(parse(content))]
                except Exception as failure:  # noqa: BLE001 - a broken file must not end the job
                    rows = [(paper, -1, None, None, None, None, f"{type(failure).__name__}: {failure}")]
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"pos": "Int32", "text_level": "Int32", "page_idx": "Int32"})

    return files.select("paper_id", "content").mapInPandas(run, ITEMS)


def fallback_title(text: Column | str) -> Column:
    """Whether a plain text block reads as a title: short, in one line and in capitals."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.coalesce((F.length(t) < 80) & ~F.contains(t, F.lit("\n")) & (F.upper(t) == t) & (F.lower(t) != t), F.lit(False))


def with_fallback(items: DataFrame) -> DataFrame:
    """Items of plain text blocks, those that read as titles marked as headings of the first level."""
    return items.withColumn("text_level", F.when(fallback_title("text"), F.lit(1)).otherwise(F.col("text_level")))


def orchestrated(files: DataFrame, primary: Callable[[bytes], list[dict]] | None, fallback: Callable[[bytes], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """(items, statuses): every file by the primary parser, by the fallback where that fails, and what became of it."""
    first = parsed_items(files, primary) if primary is not None else files.sparkSession.createDataFrame([], ITEMS)
    good = first.where("error is null").select("paper").distinct()
    rest = files.join(good, files["paper_id"] == good["paper"], "left_anti")
    second = with_fallback(parsed_items(rest, fallback))
    items = first.where("error is null").unionByName(second.where("error is null"))
    marks = good.withColumn("status", F.lit("parsed")).unionByName(second.where("error is null").select("paper").distinct().withColumn("status", F.lit("low_quality")))
    statuses = files.select(F.col("paper_id").alias("paper")).distinct().join(marks, "paper", "left").select("paper", F.coalesce("status", F.lit("failed")).alias("parsing_status"))
    return items, statuses
