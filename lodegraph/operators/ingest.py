"""From parsed pages to addressed blocks: sections, table grids, extracted points, parse quality.

Defined results. Rows with null text are skipped. A document without headings lies in ROOT. Table
cells are placed by an occupancy map, so row and column spans push later cells on; empty cells are
dropped after placement; broken markup gives the cells that could be read. Extraction answers that
fit no tuple give no rows.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R


def section_carry(content: DataFrame) -> DataFrame:
    """Adds ``section_path`` and per-kind counters to (paper, pos, kind, level, text): headings open sections for what follows."""
    w = Window.partitionBy("paper").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = content.where("text is not null and trim(text) != ''")
    heading = F.col("kind") == "heading"
    # the stack of open headings, one entry per level, carried forward; a heading closes the deeper ones
    rows = rows.withColumn("level", F.when(heading, F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))))
    for k in range(1, 7):
        opened = F.last(F.when(heading & (F.col("level") == k), F.struct("pos", "text")), ignorenulls=True).over(w)
        rows = rows.withColumn(f"h{k}", opened)
    for k in range(2, 7):
        above = F.greatest(*[F.coalesce(F.col(f"h{j}.pos"), F.lit(-1)) for j in range(1, k)]) if k > 2 else F.coalesce(F.col("h1.pos"), F.lit(-1))
        rows = rows.withColumn(f"t{k}", F.when(F.coalesce(F.col(f"h{k}.pos"), F.lit(-2)) > above, F.col(f"h{k}.text")))
    path = F.concat_ws("/", F.col("h1.text"), *[F.col(f"t{k}") for k in range(2, 7)])
    number = F.sum(F.lit(1)).over(Window.partitionBy("paper", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("section_path", F.when(path == "", "ROOT").otherwise(path)).withColumn("number", number).select("paper", "pos", "kind", "text", "section_path", "number")


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.taken: set[tuple[int, int]] = set()
        self.row, self.col, self.open, self.head = -1, 0, None, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "thead":
            self.head = True
        elif tag == "tr":
            self.finish()
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self.finish()
            if self.row < 0:
                self.row = 0
            span = {k: int(v) if v and v.isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            while (self.row, self.col) in self.taken:
                self.col += 1
            high, wide = max(1, min(span.get("rowspan", 1), 1000)), max(1, min(span.get("colspan", 1), 1000))
            self.taken |= {(self.row + i, self.col + j) for i in range(high) for j in range(wide)}
            self.open = [self.row, self.col, "", tag == "th" or self.head]
            self.col += wide

    def handle_endtag(self, tag: str) -> None:
        if tag == "thead":
            self.head = False
        if tag in ("td", "th", "tr", "table"):
            self.finish()

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open[2] += data

    def finish(self) -> None:
        if self.open is not None:
            self.open[2] = " ".join(html.unescape(self.open[2]).split())
            if self.open[2]:
                self.cells.append(self.open)
            self.open = None


def grid(source: str | None) -> list[tuple[int, int, str, bool]]:
    """(row, column, text, is_header) of each filled cell of a table."""
    if not source:
        return []
    g = _Grid()
    g.feed(source)
    g.close()
    g.finish()
    return [tuple(c) for c in g.cells]


def table_cells(blocks: DataFrame) -> DataFrame:
    """(block_id, row, col, text, is_header) of every table block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *c) for i, t in zip(b["block_id"], b["content"]) for c in grid(t)]
            yield pd.DataFrame(rows, columns=["block_id", "row", "col", "text", "is_header"])

    tables = blocks.where("modality = 'table' and content is not null").select("block_id", "content").dropDuplicates(["block_id"])
    return tables.mapInPandas(run, "block_id string, row int, col int, text string, is_header boolean")


def header_unit(c: Column | str) -> Column:
    """The unit in brackets at the end of a column head, of one to twelve characters."""
    return F.nullif(F.regexp_extract(F.trim(F.col(c) if isinstance(c, str) else c), r"[(（]([^()（）]{1,12})[)）]\s*$", 1), F.lit(""))


def numeric_cell(c: Column | str) -> Column:
    """A number, a range or a value with tolerance and nothing else."""
    return F.coalesce(F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), ",", "").rlike(r"^[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\s*((~|-|–|±)\s*[0-9]+(\.[0-9]+)?)?\s*%?$"), F.lit(False))


def bound_cells(cells: DataFrame) -> DataFrame:
    """(block_id, row, col, value, row_label, column_head, unit): body cells with the heads they stand under and beside."""
    top = cells.groupBy("block_id").agg(F.coalesce(F.min(F.when(F.col("is_header"), F.col("row"))), F.lit(0)).alias("head_row"))
    rows = cells.join(top, "block_id")
    heads = rows.where("row = head_row").select("block_id", "col", F.col("text").alias("column_head"))
    labels = rows.where("row != head_row and col = 0").select("block_id", "row", F.col("text").alias("row_label"))
    body = rows.where("row != head_row and col != 0").select("block_id", "row", "col", F.col("text").alias("value"))
    both = body.join(heads, ["block_id", "col"], "left").join(labels, ["block_id", "row"], "left").where("column_head is not null or row_label is not null")
    return both.select("block_id", "row", "col", "value", "row_label", "column_head", header_unit("column_head").alias("unit"), numeric_cell("value").alias("numeric"))


def parse_extraction(answers: DataFrame) -> DataFrame:
    """(key, at, kind, a, b, c): points and relations of tuple-formatted answers (key, text)."""
    rows = answers.select("key", F.posexplode(F.split("text", r"##|\n")).alias("at", "record"))
    body = F.regexp_extract("record", r"(?s)\((.*)\)", 1)
    strip = lambda c: F.regexp_replace(c, r"""^[\s"']+|[\s"']+$""", "")
    fields = F.transform(F.split(body, r"<\|>"), strip)
    rows = rows.withColumn("f", fields).where(F.size("f") >= 4)
    return rows.select("key", "at", F.lower(F.get("f", F.lit(0))).alias("kind"), F.get("f", F.lit(1)).alias("a"), F.get("f", F.lit(2)).alias("b"), F.get("f", F.lit(3)).alias("c")).where(F.col("kind").isin("point", "relation"))


def parse_quality(blocks: DataFrame) -> DataFrame:
    """(paper_id, parts and score, level): how completely a paper was parsed, from five ratios."""
    b = blocks.where("address.paper_id is not null").dropDuplicates(["block_id"])
    share = lambda cond: F.avg(cond.cast("double"))
    filled = F.length(R.text("content")) > 0
    media = F.col("modality").isin("table", "figure")
    parts = b.groupBy(F.col("address.paper_id").alias("paper_id")).agg(
        share(filled).alias("text_ratio"),
        F.coalesce(F.avg(F.when(media, (F.length(R.text("caption")) > 0).cast("double"))), F.lit(1.0)).alias("caption_ratio"),
        share(F.coalesce(F.col("address.section_path"), F.lit("")) != "").alias("section_ratio"),
        share(F.col("address.page").isNotNull()).alias("page_ratio"),
        share(F.col("address.bbox").isNotNull()).alias("bbox_ratio"),
        F.count("*").alias("blocks"),
    )
    names = ("text_ratio", "caption_ratio", "section_ratio", "page_ratio", "bbox_ratio")
    parts = parts.withColumns({c: F.round(c, 3) for c in names})  # as they are reported, before they are weighted
    score = F.col("text_ratio") * 0.25 + F.col("caption_ratio") * 0.2 + F.col("section_ratio") * 0.2 + F.col("page_ratio") * 0.15 + F.col("bbox_ratio") * 0.2
    return parts.withColumn("score", F.round(score, 3)).withColumn("level", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium").otherwise("low"))


def normalised_blocks(chunks: DataFrame, media: DataFrame) -> DataFrame:
    """Blocks of text chunks and of tables, figures and formulas with their captions, in a fixed order.

    chunks: (chunk_id, paper_id, text); media: (media_id, paper_id, modality, content, caption).
    """
    cap = media.where("caption is not null and trim(caption) != ''").select(F.concat("media_id", F.lit("_cap")).alias("block_id"), "paper_id", F.lit("caption").alias("modality"), F.col("caption").alias("content"), F.lit(2).alias("part"))
    body = media.select(F.concat("media_id", F.lit("_eb")).alias("block_id"), "paper_id", "modality", "content", F.lit(1).alias("part"))
    text = chunks.where("text is not null and trim(text) != ''").select(F.concat("chunk_id", F.lit("_eb")).alias("block_id"), "paper_id", F.lit("text").alias("modality"), F.col("text").alias("content"), F.lit(0).alias("part"))
    return text.unionByName(body).unionByName(cap)
