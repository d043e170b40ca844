"""Problem 5: oversized texts cut into pieces at natural boundaries, with overlap.

Offsets are code points. A text is read as tokens (runs with and without white space or clause
marks); the prefix sums of their lengths are their offsets. The sorted boundary arrays hold every
place where a cut is natural, by kind, so the last boundary at or under the limit is one binary
search. Each piece starts with the last ``overlap`` characters of the piece before, or fewer where that
would begin inside a word. Where no boundary lies in reach the cut is hard.

Defined results. Null and empty texts and texts within the limit give no pieces from ``cut_blocks``
(they need no cut). A run of more than ``limit`` characters without white space and without
。！？；， makes the block ``forced``; any other oversized block is ``natural``. Pieces never lose a
character: dropping each piece's overlap and joining them gives the text back. Delivered twice: one
result per block. Ties between boundary kinds go to the later cut of the better kind.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_500, 150
#: From the best place for a cut to the least good; a cut falls after the match.
KINDS = [re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+|[。！？]\s*|\n"), re.compile(r"[;；:]\s*|(?<=,)\s|，"), re.compile(r"\s+")]
#: A better kind is taken only if it leaves the piece at least this full.
FULL = 0.5
#: The tokens: stretches that offer no place for a natural cut, and what stands between them.
TOKEN = re.compile(r"([^\s。！？；，]+)|[\s。！？；，]+")


def token_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the tokens' ends, which of them are solid)."""
    found = [(m.end() - m.start(), m[1] is not None) for m in TOKEN.finditer(text)]
    sizes = np.array([n for n, _ in found], dtype=np.int64)
    return np.cumsum(sizes), np.array([x for _, x in found], dtype=bool)


def is_forced(text: str, limit: int) -> bool:
    """Whether a token that offers no natural cut is longer than a piece may be."""
    ends, solid = token_offsets(text)
    return bool((np.diff(ends, prepend=0)[solid] > limit).any())


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted cut places of each kind."""
    return [np.fromiter((m.end() for m in kind.finditer(text)), dtype=np.int64) for kind in KINDS]


def _last(places: np.ndarray, low: int, high: int) -> int:
    """The last place in (low, high], or -1."""
    at = int(np.searchsorted(places, high, side="right")) - 1
    return int(places[at]) if at >= 0 and places[at] > low else -1


def _step_back(text: str, cut: int, start: int, overlap: int) -> int:
    """Where the next piece begins: ``overlap`` before the cut, or later to keep a word whole."""
    begin = max(cut - overlap, start + 1)
    if begin <= 0 or not (text[begin - 1].isalnum() and text[begin].isalnum() and text[begin].isascii()):
        return begin
    moved = begin
    while moved < cut and text[moved].isalnum():
        moved += 1
    while moved < cut and text[moved].isspace():
        moved += 1
    return moved if moved < cut else begin


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, False)] if n else []
    places = boundaries(text)
    pieces, start, done = [], 0, 0
    while True:
        if n - start <= limit:
            pieces.append((start, n, False))
            return pieces
        high = start + limit
        cut, hard = -1, False
        for kind in places:
            cut = _last(kind, max(done, start + int(limit * FULL)), high)
            if cut > 0:
                break
        if cut < 0:  # nothing in the fuller half: any boundary that brings the text forward
            cut = max(_last(kind, done, high) for kind in places)
        if cut < 0:
            cut, hard = high, True
        pieces.append((start, cut, hard))
        done = cut
        start = _step_back(text, cut, start, overlap) if overlap else cut


def oversized(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The blocks that need cutting, once each."""
    return blocks.where(F.length("content") > limit).select("block_id", "content", "address").dropDuplicates(["block_id"])


def cut_blocks(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(block_id, address, piece, start, end, content, hard, cut): every piece of every oversized block."""

    @F.pandas_udf("forced boolean, pieces array<struct<start:int,end:int,hard:boolean>>")
    def cuts(texts: pd.Series) -> pd.DataFrame:
        rows = [(is_forced(t, limit), [{"start": s, "end": e, "hard": h} for s, e, h in cut_text(t, limit, overlap)]) for t in texts]
        return pd.DataFrame(rows, columns=["forced", "pieces"])

    each = oversized(blocks, limit).withColumn("c", cuts("content")).select("block_id", "address", "content", "c.forced", F.posexplode("c.pieces").alias("piece", "p"))
    text = F.substring("content", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return each.select("block_id", "address", "piece", "p.start", "p.end", text.alias("content"), "p.hard", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def found_cuts(blocks: DataFrame) -> DataFrame:
    return cut_blocks(blocks).where("piece = 0").select("block_id", "cut")


def addressed_pieces(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces as blocks of their own, with "start-end" in address.span; also of a block without an address."""
    empty = F.from_json(F.lit("{}"), blocks.schema["address"].dataType)
    pieces = cut_blocks(blocks, limit, overlap)
    return pieces.withColumn("address", F.coalesce("address", empty).withField("span", F.concat_ws("-", "start", "end")))
