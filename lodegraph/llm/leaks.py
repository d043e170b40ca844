"""Problem 9: evaluation texts found inside the corpus.

The held-out items make a BM25 inverted index in sparse form: per term the blocks of items that hold
it with the block's highest impact, and within the blocks the items with their impacts. Every passage
of WORDS words of every document is a query. A passage that an item holds scores, against that item,
at least what the cheapest such stretch of the item scores; that is the item's threshold, so no leak
can fall under it. A passage's word that an item lacks rules the item out, so the pivot of a query is
its rarest term: only the blocks in that term's postings are looked at, those whose summed maxima
stay under the lowest threshold of their items are skipped, the rest are scored item by item, and the
items at or above their threshold are verified: the run of words in question or passage, and how much
of the answer the document holds as well.

The index is built for at most SHARD items at a time, sent to the workers and dropped again; further
items make further shards, each against all documents. An index takes about 40 bytes for each word of
its items.

Defined results. Words are maximal runs of letters and digits, case folded, after compatible forms
are unified and invisible characters dropped. Null and empty texts, and items with fewer than WORDS
words in both question and passage, give no row. A document that holds an item several times gives
one row. An item delivered twice counts once. An item without an answer has a null answer share.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
BLOCK = 16
K1, B = 1.2, 0.75
#: So many items are indexed at a time.
SHARD = 50_000
#: So many pairs of passage and block are scored at a time.
STRIP = 100_000
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


class Postings:
    """Impacts by (term, place): sorted keys, so a pair is found by binary search and a term's places lie together."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, size: int, width: int) -> None:
        key = terms.astype(np.int64) * width + places
        order = np.argsort(key, kind="stable")
        key, impacts = key[order], impacts[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        self.key, self.width = key[first], width
        self.impact = np.maximum.reduceat(impacts, first).astype(np.float32) if len(key) else impacts.astype(np.float32)
        self.place = (self.key % width).astype(np.int32)
        self.start = np.searchsorted(self.key, np.arange(size + 1, dtype=np.int64) * width)

    def score(self, terms: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed impacts of each row of terms at its place, which rows lack no term)."""
        total, alive = np.zeros(len(places), dtype=np.float32), np.arange(len(places))
        for column in range(terms.shape[1]):
            key = terms[alive, column].astype(np.int64) * self.width + places[alive]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            held = self.key[at] == key
            alive = alive[held]
            total[alive] += self.impact[at[held]]
        return total, alive

    def nbytes(self) -> int:
        return self.key.nbytes + self.impact.nbytes + self.place.nbytes + self.start.nbytes


class ItemIndex:
    """BM25 index of (item_id, question, passage, answer); question and passage of an item are documents of the index."""

    def __init__(self, items: list[tuple], n: int = WORDS) -> None:
        self.n = n
        texts = [(i, w) for i, q, p, *_ in items for w in (words(q), words(p)) if len(w) >= n]
        self.answers = {i: words(rest[0]) for i, _, _, *rest in items if rest and rest[0]}
        self.ids = [i for i, _ in texts]
        self.terms: dict[str, int] = {}
        for _, w in texts:
            for x in w:
                self.terms.setdefault(x, len(self.terms))
        self.coded = [np.array([self.terms[x] for x in w], dtype=np.int32) for _, w in texts]
        size, docs = max(1, len(self.terms)), max(1, len(self.coded))
        parts = [np.unique(c, return_counts=True) for c in self.coded]
        empty = np.zeros(0, dtype=np.int64)
        term = np.concatenate([t for t, _ in parts]) if parts else empty
        tf = np.concatenate([c for _, c in parts]) if parts else empty
        doc = np.repeat(np.arange(len(parts)), [len(t) for t, _ in parts]) if parts else empty
        self.df = np.bincount(term, minlength=size)
        idf = np.log1p((docs - self.df + 0.5) / (self.df + 0.5))
        length = np.array([len(c) for c in self.coded] or [1.0])
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        self.items = Postings(term, doc, impact, size, docs)
        self.blocks = Postings(term, doc // BLOCK, impact, size, -(-docs // BLOCK))
        self.least = np.full(docs, np.inf, dtype=np.float32)
        if self.coded:
            flat = np.concatenate(self.coded)
            owner = np.repeat(np.arange(docs), [len(c) for c in self.coded])
            inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            windows = np.lib.stride_tricks.sliding_window_view(flat, n)
            for s in range(0, len(inside), STRIP):
                at = inside[s : s + STRIP]
                np.minimum.at(self.least, owner[at], self.items.score(windows[at], owner[at])[0] * np.float32(1 - 1e-4))
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, docs, BLOCK))

    def candidates(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, text of the index) of all that score at or above the text's threshold."""
        pivot = passages[np.arange(len(passages)), np.argmin(self.df[passages], axis=1)]
        low, high = self.blocks.start[pivot], self.blocks.start[pivot + 1]
        ends = np.cumsum(high - low)
        left, right = [], []
        for s in range(0, int(ends[-1]) if len(ends) else 0, STRIP):
            flat = np.arange(s, min(s + STRIP, int(ends[-1])))
            p = np.searchsorted(ends, flat, side="right")
            block = self.blocks.place[low[p] + flat - (ends[p] - (high - low)[p])].astype(np.int64)
            total, alive = self.blocks.score(passages[p], block)
            alive = alive[total[alive] >= self.block_least[block[alive]]]
            if not len(alive):
                continue
            p = np.repeat(p[alive], BLOCK)
            text = np.minimum((block[alive, None] * BLOCK + np.arange(BLOCK)).ravel(), len(self.least) - 1)
            total, alive = self.items.score(passages[p], text)
            alive = alive[total[alive] >= self.least[text[alive]]]
            left.append(p[alive]), right.append(text[alive])
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)

    def _holds(self, text: int, passage: np.ndarray) -> bool:
        c = self.coded[text]
        starts = np.flatnonzero(c[: len(c) - self.n + 1] == passage[0])
        return any(np.array_equal(c[s : s + self.n], passage) for s in starts)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float | None]]:
        """(position of the text, item_id, share of the answer's words in the text) of every leak."""
        known, unknown = self.terms, len(self.terms)
        coded: list[int] = []
        owner, said = [], {}
        for t, text in enumerate(texts):
            w = words(text)
            if len(w) >= self.n:
                coded += [known.get(x, unknown) for x in w]
                coded.append(unknown)  # no passage reaches into the next text
                owner.append((t, len(w) + 1))
                said[t] = w
        if not coded or not self.ids:
            return []
        c = np.array(coded, dtype=np.int32)
        whose = np.repeat([t for t, _ in owner], [k for _, k in owner])
        strange = np.concatenate([[0], np.cumsum(c == unknown)])
        starts = np.flatnonzero(strange[self.n :] == strange[: -self.n])
        passages = np.lib.stride_tricks.sliding_window_view(c, self.n)[starts]
        found: dict[tuple[int, int], None] = {}
        for p, text in zip(*(x.tolist() for x in self.candidates(passages))):
            key = (int(whose[starts[p]]), self.ids[text])
            if key not in found and self._holds(text, passages[p]):
                found[key] = None
        out = []
        for t, item in sorted(found):
            answer = self.answers.get(item)
            out.append((t, item, sum(w in set(said[t]) for w in answer) / len(answer) if answer else None))
        return out

    def nbytes(self) -> int:
        return self.items.nbytes() + self.blocks.nbytes() + sum(c.nbytes for c in self.coded) + self.least.nbytes


def leaks(documents: DataFrame, items: DataFrame, n: int = WORDS, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, answer_share) of every document that holds ``n`` words in a row of an item's question or passage."""
    spark = documents.sparkSession
    rows = items.where("item_id is not null").select("item_id", "question", "passage", "answer").dropDuplicates(["item_id"])
    shards = max(1, math.ceil(rows.count() / shard))
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")

    def against(part: int) -> DataFrame:
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == part) if shards > 1 else rows
        held = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in mine.collect()], n))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, texts = b["doc_id"].tolist(), b["text"].tolist()
                out = []
                for s in range(0, len(texts), 2_000):
                    out += [(ids[s + t], item, share) for t, item, share in held.value.search(texts[s : s + 2_000])]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "answer_share"])

        return texts.mapInPandas(run, "doc_id bigint, item_id bigint, answer_share double")

    found = against(0)
    for part in range(1, shards):
        found = found.unionByName(against(part))
    return found.groupBy("doc_id", "item_id").agg(F.max("answer_share").alias("answer_share"))


def found_leaks(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id) of every leak."""
    return leaks(documents, items, n).select("doc_id", "item_id")
