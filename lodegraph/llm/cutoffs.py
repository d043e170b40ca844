"""Problem 10: texts cut off by field limits or while being sent.

The length of each text is computed anew as it would have been stored: code points, UTF-8 bytes,
UTF-16 units, with markup entities, with JSON escapes (raw and ASCII) and with CR LF line ends. Per
source, lengths that many unfinished texts share expose a hidden limit. Endings are then inspected:
a text is cut if it ends inside a word, inside a sentence that the corpus's finished sentences don't
end like that, or at a hidden limit without a finished sentence.

Every text is read once: what the endings are judged by is counted in the same pass.

Defined results. Null, empty, blank and odd texts (without two words in a row) are never cut. A text
that ends with a list item, table row, keyword line, reference, formula, code or a closed bracket is
complete. An ellipsis or a broken character inside a sentence is a cut; after a finished sentence it
is not. Each document gives at most one row; equal texts are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import endings as E
from lodegraph.llm.answers import FRAME, summed, with_judgement
from lodegraph.session import cut_lineage

#: A length is a hidden limit of a source if so many unfinished texts have it and they are this share of all texts that have it.
LIMIT_TEXTS, LIMIT_SHARE = 4, 0.6

_WHOLE_LINE = [
    re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S"),  # list item
    re.compile(r"^\s*\|.*\|\s*$"),  # table row
    re.compile(r"^\s*(?:keywords?|key words|tags|index terms|schlagw\w+|mots[- ]cl[ée]s|关键词)\s*[:：]", re.I),
    re.compile(r"^\s*\[\d+\]\s+\S.*\d\s*$"),  # reference
    re.compile(r"(?:\$\$?|\\\]|\\\)|\\end\{\w+\*?\}|```|~~~|`)\s*$"),  # formula, code
    re.compile(r"^\s*[\[{].*[\]}]\s*$"),  # data
    re.compile(r"[)\]}）】>]\s*$"),  # closed bracket
    re.compile(r"^\s*(?:https?://|www\.|doi:)\S+\s*$", re.I),
    re.compile(r"^(?:    |\t)\S"),  # indented code
]
_TWO_WORDS = re.compile(r"[㐀-鿿]{2}|[^\W\d_㐀-鿿]{2,}[\W\d_]+[^\W\d_㐀-鿿]{2,}")
_CONTROL = re.compile(r"[\x00-\x07\x0b\x0e-\x1f]")


def lengths(text: str) -> dict[str, int]:
    """Stored lengths of a text under each encoding."""
    n, wide, utf8 = len(text), 0, len(text)
    if not text.isascii():
        wide = len(text.encode("utf-16-le", "surrogatepass")) // 2 - n
        utf8 = len(text.encode("utf-8", "surrogatepass"))
    odd = n - len(text.encode("ascii", "ignore"))
    lines = text.count("\n") - text.count("\r\n")
    json = n + sum(text.count(c) for c in '"\\\n\r\t\b\f') + 5 * len(_CONTROL.findall(text))
    return {
        "chars": n,
        "utf8": utf8,
        "utf16": n + wide,
        "entities": n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * (text.count('"') + text.count("'")),
        "json": json,
        "json_ascii": json + 5 * odd + 6 * wide,
        "crlf": n + lines,
        "crlf_utf8": utf8 + lines,
    }


def _closes_all(line: str) -> bool:
    """Whether a line's last bracket closes one that the same line opened."""
    depth = 0
    for c in line:
        depth += (c in "([{（【<") - (c in ")]}）】>")
    return depth <= 0


def inspect(text: str | None) -> tuple[str, E.Frame | None]:
    """("complete" | "cut" | "ask" | "odd", frame to be counted)."""
    if not text or not _TWO_WORDS.search(text):
        return "odd", None
    end = E.ending(text)
    if end.state in ("none", "closed"):
        return "complete", None
    if end.state == "marked":
        return "cut", None
    line = text.rstrip().rsplit("\n", 1)[-1]
    for i, pattern in enumerate(_WHOLE_LINE):
        if pattern.search(line) and (i != 6 or _closes_all(line)):
            return "complete", None
    if E.hardly_begun(end.last, text) or E.goes_on_elsewhere(end.last, text):
        return "cut", None
    return "ask", end.frame


def inspected(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, state, frame columns, lengths) of every document, and the frames of all finished sentences with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "source", "state", *FRAME, "lengths", "n"]
        for b in batches:
            counts: E.Counter = E.Counter()
            rows = []
            for doc, source, text in zip(b["doc_id"], b["source"], b["text"]):
                counts.update(E.finished(text))
                state, f = inspect(text)
                kept = lengths(E.unmarked(text)) if state != "odd" else {}
                rows.append((doc, source, state, *(f or (None,) * 5), "|".join(f"{k}:{v}" for k, v in kept.items()), None))
            rows += [(None, None, None, *f, None, n) for f, n in counts.items()]
            yield pd.DataFrame(rows, columns=columns)

    both = documents.select("doc_id", "source", "text").mapInPandas(run, f"doc_id bigint, source string, state string, {', '.join(f'{c} string' for c in FRAME)}, lengths string, n bigint")
    both = cut_lineage(both)  # the texts are read only once
    return both.where("n is null").drop("n"), summed(both.where("n is not null").select(*FRAME, "n"))


def hidden_limits(rows: DataFrame) -> DataFrame:
    """(source, encoding, length, open, texts): lengths at which texts of a source stop unfinished."""
    each = rows.where("lengths != ''").select(F.coalesce("source", F.lit("")).alias("source"), "state", F.explode(F.split("lengths", r"\|")).alias("l"))
    parts = F.split("l", ":")
    sums = each.groupBy("source", parts[0].alias("encoding"), parts[1].cast("bigint").alias("length")).agg(F.sum(F.when(F.col("state") != "complete", 1).otherwise(0)).alias("open"), F.count("*").alias("texts"))
    return sums.where((F.col("open") >= LIMIT_TEXTS) & (F.col("open") >= F.col("texts") * LIMIT_SHARE))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, at_limit) of every document."""
    rows, counts = inspected(documents)
    limits = hidden_limits(rows).select("source", F.concat_ws(":", "encoding", "length").alias("l"))
    open_rows = rows.where("state in ('cut', 'ask')")
    asked = with_judgement(open_rows, counts).select("doc_id", "source", "state", "closer", "lengths", "cut")
    at = asked.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.split("lengths", r"\|")).alias("l")).join(limits, ["source", "l"], "left_semi").select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    both = asked.join(at, "doc_id", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    cut = (F.col("state") == "cut") | F.col("at_limit") | (F.col("closer").isNotNull() & F.col("cut"))
    rest = rows.where("state not in ('cut', 'ask')").select("doc_id", "source", F.lit(False).alias("cut"), F.lit(False).alias("at_limit"))
    return both.select("doc_id", "source", cut.alias("cut"), "at_limit").unionByName(rest)


def found_cut(documents: DataFrame) -> DataFrame:
    return judged(documents).where("cut").select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share, at_limit): how often each source cuts its texts."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("bigint")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"), F.sum(F.col("at_limit").cast("bigint")).alias("at_limit"))
