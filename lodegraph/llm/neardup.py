"""Problem 2: items that repeat another with small edits, insertions or reordering.

A record is the set of its distinct pairs of neighbouring tokens; two records match if the shared
pairs number at least T of all. Records with equal sets are one class. Each class is a leaf of
binary tries: its path is a sketch of BITS bits, one per hash function (the low bit of the least
hash), so that two sets of similarity s differ in about (1 - s) / 2 of the bits. A trie is joined
with itself: pairs of nodes go down together level by level, a step to unlike children adds one
differing bit, and a pair is dropped as soon as its bits exceed the error budget of its depth (what a
pair of similarity T has there, and DEVIATIONS more). Where both nodes hold one leaf the rest of the
two paths is compared as a whole. What survives is compared exactly.

One trie over everything would have to be walked almost everywhere, so there is one trie per key.
Keys lose no match: with any fixed order of the grams, two matching sets share at least SHARE grams
among the first |x| - ceil(T |x|) + SHARE of each. The order is by frequency as a count-min sketch of
two rows estimates it (an overestimate is as good an order); its width follows the number of grams up
to COUNTERS. A rare gram is a key by itself; of the frequent ones every SHARE of them together are a
key, which covers matches that share no rare one. What counts as rare follows the number of classes,
so the tries per record stay as many while the data grow. A trie that may hold more than LEAVES leaves
is split into blocks, each block pair a trie of its own, so no task holds an unbounded group.

Defined results. A null question or answer counts as empty; records with fewer than two tokens have
no pairs of tokens and match nothing. A record delivered twice counts once. Copies are records of the
same tokens in the same order: of more than COPIES copies (a parameter; None for no such limit) each
is linked to the first, which stands for all of them in every other link; fewer are written out in
full, and so are different texts, whatever their number. ``class_links`` and ``class_members`` give
the same links without any expansion: pairs of classes, and the class of each record.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage

T = 0.7
BITS = 256
DEVIATIONS = 5
SHARE = 2
LEAVES, COUNTERS, COPIES = 8_192, 1 << 21, 64
#: A gram is rare in at most RARE classes, or this share of all of them, up to LEAVES.
RARE, RARE_SHARE = 256, 1 / 400
#: Up to so many candidate pairs their classes are looked up by a broadcast of at most 32 bytes for each, beyond by a shuffle.
SMALL = 300_000
#: Counters travel to the driver in parts of so many.
PART = 1 << 16
#: So many pairs of nodes go down together.
FRONTIER = 1_000_000
_TOKEN = re.compile(r"[a-z0-9]+|[^\x00-\x7f]")
_rng = np.random.default_rng(20_240_607)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64)
WORDS = BITS // 64


def tokens(question: str | None, answer: str | None) -> list[str]:
    return _TOKEN.findall(f"{question or ''} {answer or ''}".lower())


def gram_set(words: list[str]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct neighbouring pairs."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
    return np.sort(np.array([int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little", signed=True) for p in pairs], dtype=np.int64))


def sketch(grams: np.ndarray) -> np.ndarray:
    """BITS bits in 64-bit words."""
    hashed = grams.view(np.uint64)[:, None] * _MULTIPLIERS[None, :] + _SHIFTS[None, :]
    bits = ((hashed.min(axis=0) >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def estimates(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In how many classes each gram is, at least: the lesser of two counters."""
    return np.minimum(*(counts[row, _counter(grams, row, counts.shape[1])] for row in range(2)))


def _counter(grams: np.ndarray, row: int, width: int) -> np.ndarray:
    mixed = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if row else grams.view(np.uint64)
    return ((mixed >> np.uint64(20)) % np.uint64(width)).astype(np.int64)


def prefix_keys(grams: np.ndarray, counts: np.ndarray, rare: int, t: float = T) -> list[tuple[int, int]]:
    """(key, most leaves) of every trie that the record belongs to."""
    n = len(grams)
    estimate = estimates(grams, counts)
    first = min(n, n - math.ceil(t * n - 1e-9) + SHARE)
    order = np.lexsort((grams, estimate))[:first]
    keys = [(int(grams[i]), rare) for i in order if 1 < estimate[i] <= rare]
    frequent = [(int(grams[i]), int(estimate[i])) for i in order if estimate[i] > rare]
    mask = (1 << 64) - 1
    for some in combinations(sorted(frequent), SHARE):
        key = 0x9E3779B97F4A7C15
        for g, _ in some:
            key = ((key ^ (g & mask)) * 0xC2B2AE3D27D4EB4F) & mask
        keys.append((key - (1 << 64) if key >> 63 else key, min(e for _, e in some)))
    return keys


# ---- the trie join ---------------------------------------------------------------------------------------------


def error_budget(t: float = T, bits: int = BITS) -> np.ndarray:
    """The most differing bits that a pair may have at each depth."""
    depth = np.arange(bits + 1)
    rate = (1 - t) / 2
    whole = bits * rate + DEVIATIONS * math.sqrt(bits * rate * (1 - rate))
    return np.minimum(np.floor(depth * rate + DEVIATIONS * np.sqrt(depth * rate * (1 - rate))), math.floor(whole)).astype(np.int32)


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x), dtype=np.int64), x.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(64 - shift) == 0
        out[high] += shift
        x[high] <<= np.uint64(shift)
    return out + (x == 0)


def _branchings(keys: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """At which bit each leaf parts from the one before it, of leaves in order; -1 where a new trie begins."""
    at = np.full(len(keys), -1, dtype=np.int64)
    differs = paths[1:] ^ paths[:-1]
    inner = np.full(len(differs), 64 * paths.shape[1], dtype=np.int64)
    for word in range(paths.shape[1] - 1, -1, -1):
        some = differs[:, word] != 0
        inner[some] = 64 * word + _leading_zeros(differs[some, word])
    same = keys[1:] == keys[:-1]
    at[1:][same] = inner[same]
    return at


def walk(keys: np.ndarray, paths: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Self-join of many binary tries, one per key: all pairs of leaves within the budget at every depth they share a walk to."""
    none = np.zeros(0, dtype=np.int64)
    order = np.lexsort((*paths.T[::-1], keys))
    keys, paths = keys[order], paths[order]
    branch = _branchings(keys, paths)
    by_depth = np.argsort(branch, kind="stable")
    bounds = np.searchsorted(branch[by_depth], np.arange(-1, 64 * paths.shape[1] + 2))
    roots = by_depth[bounds[0] : bounds[1]]
    ends = np.append(roots[1:], len(keys))
    many = ends - roots > 1
    roots, ends = roots[many], ends[many]
    left, right = [none], [none]

    def finish(a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of leaves: the rest of their paths at once."""
        errors = np.zeros(len(a), dtype=np.int32)
        for word in range(paths.shape[1]):
            errors = errors + np.bitwise_count(paths[a, word] ^ paths[b, word])
            alive = errors <= budget[64 * (word + 1)]
            a, b, errors = a[alive], b[alive], errors[alive]
        left.append(order[a]), right.append(order[b])

    def parted(start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Where the right child of each node begins: the left one holds the leaves before."""
        splits = by_depth[bounds[depth + 1] : bounds[depth + 2]]
        at = np.searchsorted(splits, start + 1)
        inside = at < len(splits)
        split = splits[np.minimum(at, len(splits) - 1)] if len(splits) else start
        zero = paths[start, depth // 64] >> np.uint64(63 - depth % 64) & np.uint64(1) == 0
        return np.where(inside & (split < end), split, np.where(zero, end, start))

    stack = [(0, roots, ends, roots, ends, np.zeros(len(roots), dtype=np.int32))]
    while stack:
        depth, a, a_end, b, b_end, errors = stack.pop()
        while len(a):
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack.append((depth, a[half:], a_end[half:], b[half:], b_end[half:], errors[half:]))
                a, a_end, b, b_end, errors = a[:half], a_end[:half], b[:half], b_end[:half], errors[:half]
            if depth == 64 * paths.shape[1]:  # nodes of equal paths
                for s, e, u, v in zip(a, a_end, b, b_end):
                    x, y = np.meshgrid(np.arange(s, e), np.arange(u, v), indexing="ij")
                    ahead = x < y
                    left.append(order[x[ahead]]), right.append(order[y[ahead]])
                break
            p, q, own = parted(a, a_end, depth), parted(b, b_end, depth), a == b
            depth += 1
            steps = [(a, p, b, q, errors, slice(None)), (p, a_end, q, b_end, errors, slice(None)), (a, p, q, b_end, errors + 1, slice(None)), (p, a_end, b, q, errors + 1, ~own)]
            rows = [[x[kept] for x in step] for *step, kept in steps]
            a, a_end, b, b_end, errors = (np.concatenate(x) for x in zip(*rows))
            alive = (a < a_end) & (b < b_end) & (errors <= budget[depth]) & ~((a == b) & (a_end - a == 1))
            leaf = alive & (a_end - a == 1) & (b_end - b == 1)
            finish(a[leaf], b[leaf])
            alive &= ~leaf
            a, a_end, b, b_end, errors = a[alive], a_end[alive], b[alive], b_end[alive], errors[alive]
    return np.concatenate(left), np.concatenate(right)


# ---- records and classes ---------------------------------------------------------------------------------------


def records(items: DataFrame) -> DataFrame:
    """(qid, t1, t2, s1, s2, grams): each delivery of a record with the 128-bit names of its text and of its class."""

    def name(raw: bytes) -> tuple[int, int]:
        return tuple(np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), dtype=np.int64).tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for qid, q, a in zip(b["qid"], b["question"], b["answer"]):
                words = tokens(q, a)
                grams = gram_set(words)
                if len(grams):
                    rows.append((qid, *name(" ".join(words).encode()), *name(grams.tobytes()), grams))
            yield pd.DataFrame(rows, columns=["qid", "t1", "t2", "s1", "s2", "grams"])

    rows = items.where("qid is not null").select("qid", "question", "answer")
    return rows.mapInPandas(run, "qid string, t1 bigint, t2 bigint, s1 bigint, s2 bigint, grams array<bigint>")


def gram_counts(classes: DataFrame, width: int) -> np.ndarray:
    """How many classes hold each gram, at least: two rows of ``width`` counters, whatever the size of the data."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, width), dtype=np.int64)
        for b in batches:
            if len(b):
                grams = np.concatenate(b["grams"].tolist())
                for row in range(2):
                    held[row] += np.bincount(_counter(grams, row, width), minlength=width)
        held = held.ravel()
        at = np.flatnonzero(held)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": held[at]})

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(PART, dtype=np.int32)
        part[g["at"].to_numpy() % PART] = np.minimum(g["n"], np.iinfo(np.int32).max)
        return pd.DataFrame({"part": [int(g["at"].iloc[0]) // PART], "counts": [part.tobytes()]})

    sums = classes.select("grams").mapInPandas(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1")  # nothing is learned from a gram of one class
    packed = sums.groupBy(F.floor(F.col("at") / PART).alias("p")).applyInPandas(pack, "part int, counts binary")
    counts = np.ones(2 * width, dtype=np.int32)
    for r in packed.collect():  # at most 2 * COUNTERS / PART rows of 4 * PART bytes
        at = r["part"] * PART
        counts[at : at + PART] = np.maximum(np.frombuffer(r["counts"], dtype=np.int32), 1)
    return counts.reshape(2, width)


def leaves(classes: DataFrame, counts: np.ndarray, rare: int, t: float = T) -> DataFrame:
    """(key, part, size, s1, s2, w0..): one row per class and trie, or trie block pair."""
    held = classes.sparkSession.sparkContext.broadcast(counts)
    names = ["key", "part", "size", "s1", "s2", *(f"w{i}" for i in range(WORDS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s1, s2, grams in zip(b["s1"], b["s2"], b["grams"]):
                grams = np.asarray(grams, dtype=np.int64)
                path = sketch(grams).view(np.int64).tolist()
                for key, most in prefix_keys(grams, held.value, rare, t):
                    blocks = -(-most // LEAVES)
                    if blocks == 1:
                        rows.append((key, 0, len(grams), s1, s2, *path))
                    else:
                        mine = s2 % blocks
                        for other in range(blocks):
                            low, high = min(mine, other), max(mine, other)
                            rows.append((key, low * blocks + high, len(grams), s1, s2, *path))
            yield pd.DataFrame(rows, columns=names)

    return classes.mapInPandas(run, "key bigint, part int, size int, s1 bigint, s2 bigint, " + ", ".join(f"w{i} bigint" for i in range(WORDS)))


def candidates(rows: DataFrame, t: float = T) -> DataFrame:
    """(a1, a2, b1, b2): class pairs within the error budget in at least one trie."""
    parts = [f"w{i}" for i in range(WORDS)]
    budget = error_budget(t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            last = (b["key"].to_numpy() == b["key"].iloc[-1]) & (b["part"].to_numpy() == b["part"].iloc[-1])
            held, b = b[last], b[~last]
            if len(b):
                yield _join(b)
        if held is not None and len(held):
            yield _join(held)

    def _join(b: pd.DataFrame) -> pd.DataFrame:
        keys = b["key"].to_numpy() * np.int64(1_000_003) + b["part"].to_numpy()
        paths = np.ascontiguousarray(b[parts].to_numpy(dtype=np.int64)).view(np.uint64)
        s1, s2 = b["s1"].to_numpy(), b["s2"].to_numpy()
        i, j = walk(keys, paths, budget)
        size = b["size"].to_numpy().astype(np.int64)
        fit = np.minimum(size[i], size[j]) * 1000 >= np.maximum(size[i], size[j]) * round(t * 1000)  # sets of too unlike sizes can't match
        i, j = i[fit], j[fit]
        swap = (s1[i] > s1[j]) | ((s1[i] == s1[j]) & (s2[i] > s2[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = pd.DataFrame({"a1": s1[i], "a2": s2[i], "b1": s1[j], "b2": s2[j]})
        return out[(out["a1"] != out["b1"]) | (out["a2"] != out["b2"])].drop_duplicates()

    spread = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return spread.mapInPandas(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct()


def class_pairs(classes: DataFrame, t: float = T) -> DataFrame:
    """(a1, a2, b1, b2, similarity) of every pair of different classes that match."""
    size = classes.agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("grams")).first()
    width = min(COUNTERS, max(1 << 16, 1 << math.ceil(math.log2(1 + (size["grams"] or 0)))))
    rare = min(LEAVES, max(RARE, int(size["n"] * RARE_SHARE)))
    found = cut_lineage(candidates(leaves(classes, gram_counts(classes, width), rare, t), t))  # read twice below
    ends = found.select(F.explode(F.array(F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")), F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2")))).alias("e")).select("e.s1", "e.s2").distinct()
    if found.count() <= SMALL:
        ends = F.broadcast(ends)  # so the classes needn't be shuffled to be looked up
    held = cut_lineage(classes.join(ends, ["s1", "s2"], "left_semi"))  # only their grams travel, and only once
    a = held.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("grams").alias("ga"))
    b = held.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    both = found.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a1", "a2", "b1", "b2", shared.alias("shared"), (F.size("ga") + F.size("gb") - shared).alias("whole"))
    return both.where(F.col("shared") * 1000 >= F.col("whole") * round(t * 1000)).select("a1", "a2", "b1", "b2", (F.col("shared") / F.col("whole")).alias("similarity"))


def _prepared(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (qid, t1, t2, s1, s2) and classes (s1, s2, rep, grams)."""
    rows = cut_lineage(records(items))  # read twice: the texts only once
    members = rows.select("qid", "t1", "t2", "s1", "s2").dropDuplicates(["qid"])
    classes = rows.groupBy("s1", "s2").agg(F.min("qid").alias("rep"), F.first("grams").alias("grams"))
    return members, cut_lineage(classes)


def found_pairs(items: DataFrame, t: float = T, copies: int | None = COPIES) -> DataFrame:
    """(qid_a, qid_b), qid_a < qid_b."""
    members, classes = _prepared(items)
    texts = members.groupBy("t1", "t2").agg(F.min("qid").alias("first"), F.count("*").alias("n"))
    sized = members.join(texts, ["t1", "t2"])
    in_full = F.lit(True) if copies is None else F.col("n") <= copies
    shown = cut_lineage(sized.where(in_full | (F.col("qid") == F.col("first"))).select("qid", "s1", "s2"))  # joined four times below
    a = shown.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("qid").alias("x"))
    b = shown.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("qid").alias("y"))
    between = class_pairs(classes, t).join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y")
    shared = shown.groupBy("s1", "s2").agg(F.count("*").alias("k")).where("k > 1").select("s1", "s2")
    few = shown.join(shared, ["s1", "s2"], "left_semi")
    within = few.select("s1", "s2", F.col("qid").alias("x")).join(few.select("s1", "s2", F.col("qid").alias("y")), ["s1", "s2"]).where("x < y").select("x", "y")
    star = sized.where(~in_full & (F.col("qid") != F.col("first"))).select(F.col("first").alias("x"), F.col("qid").alias("y"))
    return between.unionByName(within).unionByName(star).select(F.least("x", "y").alias("qid_a"), F.greatest("x", "y").alias("qid_b"))


def _named_pairs(classes: DataFrame, t: float) -> DataFrame:
    names = classes.select("s1", "s2", "rep")
    return class_pairs(classes, t).join(names.withColumnsRenamed({"s1": "a1", "s2": "a2", "rep": "src"}), ["a1", "a2"]).join(names.withColumnsRenamed({"s1": "b1", "s2": "b2", "rep": "dst"}), ["b1", "b2"]).select("src", "dst", "similarity")


def class_links(items: DataFrame, t: float = T) -> DataFrame:
    """(class_a, class_b, similarity) of every pair of matching classes; a class is named by its least qid."""
    rows = _named_pairs(_prepared(items)[1], t)
    return rows.select(F.least("src", "dst").alias("class_a"), F.greatest("src", "dst").alias("class_b"), "similarity")


def class_members(items: DataFrame) -> DataFrame:
    """(qid, class_id) of every record that has pairs of tokens."""
    members, classes = _prepared(items)
    return members.join(classes.select("s1", "s2", F.col("rep").alias("class_id")), ["s1", "s2"]).select("qid", "class_id")


def groups(items: DataFrame, t: float = T) -> DataFrame:
    """(qid, group_id, links): every item with the least qid of its group and the number of classes its own class links to."""
    from lodegraph.operators.components import connected_components

    members, classes = _prepared(items)
    pairs = cut_lineage(_named_pairs(classes, t).select("src", "dst"))
    label = connected_components(pairs, "src", "dst")
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    rows = members.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return rows.select("qid", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
