"""Problem 8: the whole corpus encoded with a public byte-level BPE.

Texts are cut into content-defined chunks: a rolling hash over the last WINDOW characters names the
cut places, so equal passages of different documents give equal chunks wherever they stand. Chunks
that occur more than once in the corpus make a table keyed by their hash; each is encoded once there
and joined back to the documents that hold it. A document's other chunks are encoded where it lies.

A join between two chunks is repaired by encoding a window around it anew. The window begins and ends
at places where the tokenizer's pattern breaks whatever stands further off; it is used only if both
neighbours agree, that is if they have a token boundary there, and is widened to the next such place
until they do, at last to the whole of both chunks.

Defined results. Null and empty texts give an empty list. Strings of special tokens are ordinary
text. Every document gives one row, rows repeated in the input are repeated, also with a null id.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("LODEGRAPH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pre-tokenizer pattern of this vocabulary family (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, MASK, LEAST = 16, 0xFF, 64
#: Where the pattern breaks whatever stands further off: before white space, and where letters, digits and signs meet; not after an apostrophe.
_SURE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def load_encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_places(text: str) -> list[int]:
    """Content-defined cut places, in code points."""
    n = len(text)
    if n < 2 * LEAST:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    mixed = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    total = np.cumsum(mixed)
    rolling = total[WINDOW:] - total[:-WINDOW]  # depends on the last WINDOW characters only
    marks = np.flatnonzero((rolling * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56) == np.uint64(MASK)) + WINDOW + 1
    places, last = [], 0
    for mark in marks.tolist():
        if mark - last >= LEAST and n - mark >= LEAST:
            places.append(mark)
            last = mark
    return places


def chunks(text: str) -> list[str]:
    """A text as its content-defined chunks."""
    places = [0, *cut_places(text), len(text)]
    return [text[a:b] for a, b in zip(places, places[1:])]


def chunk_name(chunk: str) -> tuple[int, int]:
    """The 128-bit name of a chunk."""
    return tuple(np.frombuffer(hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest(), dtype=np.int64).tolist())


class ChunkEncoder:
    """Encodes texts chunk by chunk and repairs the joins."""

    def __init__(self, encoder) -> None:
        self.encode = encoder.encode_ordinary
        ranks = encoder._mergeable_ranks
        self.bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes[rank] = len(token)
        self.widened = 0

    def _tokens(self, ids: list[int], size: int, from_end: bool) -> int | None:
        """How many tokens at the end or the beginning of ``ids`` have exactly ``size`` bytes together, or None."""
        n = 0
        for token in reversed(ids) if from_end else ids:
            if size <= 0:
                break
            size -= int(self.bytes[token])
            n += 1
        return n if size == 0 else None

    def _join(self, ids: list[int], text: str, place: int, right: list[int], end: int) -> list[int]:
        """The ids of text[:end] from those of text[:place] and of text[place:end]."""
        keep, a, reach = 0, 0, 64
        while True:  # to the left
            low = max(0, place - reach)
            found = [m.start() for m in _SURE.finditer(text, low + 1 if low else 1, place) if 0 < m.start() < place]
            done = False
            for a in reversed(found):
                n = self._tokens(ids, len(text[a:place].encode()), True)
                if n is not None:
                    keep, done = len(ids) - n, True
                    break
            if done or not low:
                break
            reach *= 4
            self.widened += 1
        if not done:
            keep, a = 0, 0
        drop, b = len(right), end
        for m in _SURE.finditer(text, place + 1, end):  # to the right
            if m.start() < end:
                n = self._tokens(right, len(text[place : m.start()].encode()), False)
                if n is not None:
                    drop, b = n, m.start()
                    break
                self.widened += 1
        return ids[:keep] + self.encode(text[a:b]) + right[drop:]

    def text(self, text: str | None, known: dict[int, list[int]] | None = None) -> list[int]:
        """The ids of a text; ``known`` are those of some of its chunks, by their number."""
        if not text:
            return []
        out: list[int] = []
        place = 0
        for i, chunk in enumerate(chunks(text)):
            ids = known.get(i) if known else None
            ids = self.encode(chunk) if ids is None else ids
            end = place + len(chunk)
            out = self._join(out, text, place, ids, end) if place else list(ids)
            place = end
        return out


def shared_chunks(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(h1, h2, ids) of every chunk that occurs more than once in the corpus, each encoded once."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, int] = {}
            for text in b["text"]:
                for chunk in chunks(text):
                    counts[chunk] = counts.get(chunk, 0) + 1
            yield pd.DataFrame([(*chunk_name(c), n, c) for c, n in counts.items()], columns=["h1", "h2", "n", "chunk"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(folder, vocabulary)
        for b in batches:
            yield pd.DataFrame({"h1": b["h1"], "h2": b["h2"], "ids": [encoder.encode_ordinary(c) for c in b["chunk"]]})

    named = documents.where("text != ''").select("text").mapInPandas(name, "h1 bigint, h2 bigint, n bigint, chunk string")
    repeated = named.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.first("chunk").alias("chunk")).where("n > 1")
    return repeated.mapInPandas(encode, "h1 bigint, h2 bigint, ids array<int>")


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc, i, *chunk_name(c)) for doc, text in zip(b["doc_id"], b["text"]) for i, c in enumerate(chunks(text))]
            yield pd.DataFrame(out, columns=["doc_id", "i", "h1", "h2"])

    held = rows.where("doc_id is not null and text != ''").mapInPandas(places, "doc_id bigint, i int, h1 bigint, h2 bigint")
    known = held.join(shared_chunks(documents, folder, vocabulary), ["h1", "h2"]).groupBy("doc_id").agg(F.collect_list(F.struct("i", "ids")).alias("known"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            coder = coder or ChunkEncoder(load_encoder(folder, vocabulary))
            known = ({x["i"]: x["ids"] for x in k} if k else None for k in b.column("known").to_pylist())
            ids = [coder.text(t, k) for t, k in zip(b.column("text").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return rows.join(known, "doc_id", "left").mapInArrow(run, "doc_id bigint, ids array<int>")
