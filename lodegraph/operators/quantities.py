"""Problem 6: measured values in many units, brought to the common unit of their quantity.

An entity is one measured attribute of one text or table; the sources that record it are the value
node's own content, its normalised content, the text of its block (after the mention of the
attribute), the head of its table column, and the block's machine-made value list. Where two sources
record an entity under different labels, the labels are linked by the two numbers. Over all links of
two labels a scale is estimated as the median ratio, or, where the ratios don't agree, a scale and an
offset by a median slope (Theil and Sen) and a median rest. The labels make a graph; the published
unit symbols are its roots, a dictionary of spellings is one more source in it. From the roots each
label's conversion is carried along the links and snapped to a known conversion. Every value is read
through the label that the graph resolved; labels that it couldn't resolve name no unit.

Defined results. A value is read from the first of: content, normalised content, the block's text or
table head, the block's value list (only if the text names no unit); a label in the content that is
no unit ends the search. Null or empty content, a value whose unit is nowhere, ranges, shares, counts
and pure numbers give no row. A node delivered twice gives one row. Ties round away from zero. A
label whose links point to several units with less than AGREE of them on one is not resolved.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import units as U
from lodegraph.session import cut_lineage

#: A link between labels needs so many entities, and at least this share of them within SPREAD of the estimate.
MIN_LINKS, AGREE, SPREAD = 3, 0.8, 0.02
#: What a spelling of the dictionary weighs against links found in the data.
DICTIONARY = 50
#: A value stands so many characters after the mention of what it measures.
NEAR = 160
#: Slopes are taken within buckets of about so many links.
BUCKET = 4_096

#: Readings travel as one string, fields parted by US, items by RS: far cheaper between the JVM and Python than arrays of structs.
US, RS = "\x1f", "\x1e"
_HIDDEN = re.compile("[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]")
_ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.S | re.I)
_CELL = re.compile(r"<t[hd][^>]*>(.*?)</t[hd]>", re.S | re.I)


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKC", _HIDDEN.sub("", text))


def number_key(text: str) -> str:
    """The key under which one number is found again, however it was written."""
    try:
        return format(U.number(text).normalize(), "f")
    except ArithmeticError:
        return text


# ---- sources ---------------------------------------------------------------------------------------------------


def text_numbers(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """(plain text in lower case, (place, key, what may be the unit) of its numbers)."""
    plain = _plain(text).replace(US, " ").replace(RS, " ")
    return plain.lower(), [(m.start(), number_key(m["num"].rstrip(".,")), next(iter(U.labels_after(m["tail"])), "")) for m in U.MEASURE.finditer(plain)]


def column_heads(html: str) -> list[list[str]]:
    """What may be the unit in each head of a table's first row, longest first."""
    row = _ROW.search(html)
    heads = _CELL.findall(row[1]) if row else []
    out = []
    for head in heads:
        head = unicodedata.normalize("NFKC", re.sub(r"<[^>]*>", "", head)).strip().rstrip(")]")
        out.append([label for at in range(1, len(head)) if head[at - 1] in "([,/ " and (label := head[at:].strip(" ([,/")) and len(label) <= 40])
    return out


def mentions(text: str, name: str | None) -> list[int]:
    """Where the name of an attribute ends in a text."""
    name = _plain(name or "").lower().strip()
    if len(name) < 2:
        return []
    out, at = [], text.find(name)
    while at >= 0:
        out.append(at + len(name))
        at = text.find(name, at + 1)
    return out


class Reading:
    """One value node with what its sources say; ``block`` and ``numbers`` are what ``read_blocks`` gives."""

    def __init__(self, content, normalized, attribute, span, block, numbers, heads, listed) -> None:
        self.number: str | None = None
        self.candidates: list[tuple[int, str]] = []  # (rank, label)
        self.links: list[tuple[str, str, float, float]] = []  # (label, other label, number, other number)
        first = U.parse_value(content)
        if first is None:
            return
        value, label, ambiguous = first
        table = re.fullmatch(r"r\d+c(\d+)", span or "") if heads else None
        numbers = [(int(p), k, u) for p, k, u in (x.split(US) for x in numbers.split(RS))] if numbers else []
        if ambiguous and numbers:
            other = U.parse_value(content, decimal_comma=True)
            keys = {k for _, k, _ in numbers}
            if other and format(value.normalize(), "f") not in keys and format(other[0].normalize(), "f") in keys:
                value = other[0]
        self.number, key = format(value, "f"), format(value.normalize(), "f")
        second = U.parse_value(normalized)
        own = label or (second[1] if second else "")
        said = next((x for x in (first, second) if x and x[1]), None)
        if label:
            self.candidates.append((0, label))
        elif second and second[1]:
            self.candidates.append((1, second[1]))
        if first[1] and second and second[1]:
            self._link(first[1], second[1], value, second[0])
        named = mentions(block, attribute) if numbers else []
        after = [x for at in named if (x := next((x for x in numbers if x[0] >= at), None)) and x[0] - at <= NEAR]
        equal = [x for x in after if x[1] == key] or [x for x in numbers if x[1] == key]
        if table:
            columns = heads.split(RS)
            found = columns[int(table[1])].split(US) if int(table[1]) < len(columns) else []
        else:
            found = U.beginnings(equal[0][2]) if equal else []
        if not label:
            self.candidates += [(2 + i, x) for i, x in enumerate(found) if x]
            self.candidates += [(99, x) for x in self._listed(listed, key, equal)]
        if said:
            other = equal[0] if equal else after[0] if len(after) == 1 else None
            if table:
                for x in found[:1]:
                    self._link(own, x, said[0], value)
            elif other and re.fullmatch(r"[\d.]+", other[1]):
                self._link(own, other[2], said[0], Decimal(other[1]))  # the whole of what stands there, not its beginnings

    def _link(self, a: str, b: str, x, y) -> None:
        if a and b and x and y and len(a) <= 40 and len(b) <= 40 and U.unit_key(a) != U.unit_key(b):
            self.links.append((U.unit_key(a), U.unit_key(b), float(x), float(y)))

    @staticmethod
    def _listed(listed: str | None, key: str, places: list[tuple[int, str, str]]) -> Iterable[str]:
        """Units that the machine-made list gives for a number; not those taken from the first letters of the next word."""
        for x in (listed or "").split(RS):
            value, *labels = x.split(US)
            if value and number_key(value) == key:
                for label in labels:
                    if label and not any(t.startswith(label) and t[len(label) : len(label) + 1].isalpha() for _, _, t in places):
                        yield label


READ = "node_id string, number string, candidates string, links string"


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(chunk_id, block, numbers, heads, listed): each text or table once, read where it lies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for chunk, modality, content in zip(b["chunk_id"], b["modality"], b["content"]):
                if modality == "table":
                    out.append(("", "", RS.join(US.join(x) for x in column_heads(content or ""))))
                else:
                    text, numbers = text_numbers(content or "")
                    out.append((text, RS.join(f"{p}{US}{k}{US}{u}" for p, k, u in numbers), ""))
            yield pd.DataFrame(out, columns=["block", "numbers", "heads"]).assign(chunk_id=b["chunk_id"].to_numpy(), listed=b["listed"].to_numpy())[["chunk_id", "block", "numbers", "heads", "listed"]]

    stated = F.transform("extra.value_units", lambda x: F.concat_ws(US, F.coalesce(x["value"], F.lit("")), F.coalesce(x["unit"], F.lit("")), F.coalesce(x["normalized_unit"], F.lit(""))))
    texts = blocks.where(F.col("modality").isin("text", "table") & F.col("address.chunk_id").isNotNull()).select(F.col("address.chunk_id").alias("chunk_id"), "modality", "content", F.array_join(stated, RS).alias("listed"))
    return texts.mapInPandas(read, "chunk_id string, block string, numbers string, heads string, listed string").dropDuplicates(["chunk_id"])


def read_values(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node_id, number, candidates, links) of every value node: its number, the labels its sources offer and the links between them."""
    place = [F.col("address.chunk_id").alias("chunk_id"), F.col("address.sentence_id").alias("sentence_id")]
    values = nodes.where("node_type = 'ValueNode'").select("node_id", "content", "normalized_content", *place, F.coalesce("address.span", F.regexp_extract("node_id", r"::(r\d+c\d+)$", 1)).alias("span"))
    named = nodes.where("node_type = 'AttributeNode' and address.chunk_id is not null").select(*place, F.col("content").alias("attribute")).groupBy("chunk_id", "sentence_id").agg(F.min("attribute").alias("attribute"), F.max("attribute").alias("last"))
    named = named.where("attribute = last").drop("last")  # else it is open which one is meant
    rows = values.join(named, ["chunk_id", "sentence_id"], "left").join(read_blocks(blocks), "chunk_id", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, *sources in zip(*(b[c] for c in columns)):
                r = Reading(*(None if x is not None and x != x else x for x in sources))
                if r.number is not None:
                    candidates = RS.join(f"{rank}{US}{U.unit_key(label)}" for rank, label in r.candidates if len(label) <= 40)
                    out.append((node, r.number, candidates, RS.join(f"{a}{US}{c}{US}{x!r}{US}{y!r}" for a, c, x, y in r.links)))
            yield pd.DataFrame(out, columns=["node_id", "number", "candidates", "links"])

    columns = ["node_id", "content", "normalized_content", "attribute", "span", "block", "numbers", "heads", "listed"]
    return rows.select(columns).mapInPandas(read, READ)


# ---- the graph of labels ---------------------------------------------------------------------------------------


def label_links(read: DataFrame) -> DataFrame:
    """(a, b, x, y): one row per entity that two sources record under the labels a and b, as the numbers x and y."""
    rows = read.where("links != ''").select(F.explode(F.split("links", RS)).alias("l")).select(F.split("l", US).alias("f"))
    return rows.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].cast("double").alias("x"), F.col("f")[3].cast("double").alias("y"))


def _slope(g: pd.DataFrame) -> pd.DataFrame:
    """Median slope and rest of one bucket: each link against the one half the bucket further, in the order of x."""
    x, y = g["x"].to_numpy(), g["y"].to_numpy()
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    half = len(x) // 2
    run, rise = x[half:] - x[: len(x) - half], y[half:] - y[: len(x) - half]
    steps = rise[run != 0] / run[run != 0]
    slope = float(np.median(steps)) if half and len(steps) else float("nan")
    return pd.DataFrame({"a": [g["a"].iloc[0]], "b": [g["b"].iloc[0]], "slope": [slope], "rest": [float(np.median(y - slope * x))]})


def unit_links(links: DataFrame) -> DataFrame:
    """(a, b, n, scale, offset, agreeing): y = scale * x + offset for two labels, and the share of the n links that fit."""
    mid = links.groupBy("a", "b").agg(F.count("*").alias("n"), F.percentile_approx(F.col("y") / F.col("x"), 0.5, 1000).alias("scale"))

    def share(estimates: DataFrame) -> DataFrame:
        fits = F.abs(F.col("scale") * F.col("x") + F.col("offset") - F.col("y")) <= SPREAD * F.abs("y")
        return links.join(estimates, ["a", "b"]).groupBy("a", "b", "n", "scale", "offset").agg(F.avg(fits.cast("double")).alias("agreeing"))

    scaled = cut_lineage(share(mid.withColumn("offset", F.lit(0.0))))  # read twice below
    agreed = scaled.where(F.col("agreeing") >= AGREE)
    loose = scaled.where((F.col("agreeing") < AGREE) & (F.col("n") >= MIN_LINKS)).select("a", "b", "n")
    buckets = links.join(loose, ["a", "b"]).withColumn("bucket", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n") / BUCKET)))
    slopes = buckets.groupBy("a", "b", "bucket").applyInPandas(_slope, "a string, b string, slope double, rest double").where("not isnan(slope)")
    affine = slopes.groupBy("a", "b").agg(F.percentile_approx("slope", 0.5).alias("scale"), F.percentile_approx("rest", 0.5).alias("offset")).join(loose, ["a", "b"])
    return agreed.unionByName(share(affine.select("a", "b", "n", "scale", "offset")))


def dictionary(spark: SparkSession, spellings: Iterable[str] | None = None) -> DataFrame:
    """(label, symbol) of the listed spellings, or of some of them; a symbol always names its own unit."""
    kept = {U.unit_key(x) for x in spellings} if spellings is not None else set(U.UNITS)
    kept |= {U.unit_key(s) for s in U.BY_SYMBOL}
    return spark.createDataFrame([(k, u.symbol) for k, u in U.UNITS.items() if k in kept], "label string, symbol string")


def snap(symbol: str, scale: float, offset: float) -> str | None:
    """The known unit to which ``symbol``'s numbers stand as y = scale * x + offset says, or None."""
    base = U.BY_SYMBOL.get(symbol)
    if base is None or not scale or scale != scale:
        return None
    mine, rest = float(base.scale) * scale, float(base.scale) * offset + float(base.offset)
    same = [(s, u) for s, u in U.BY_SYMBOL.items() if u.quantity == base.quantity]
    near = [(s != symbol, abs(float(u.scale) / mine - 1), abs(float(u.offset) - rest), s) for s, u in same]
    near = [x for x in near if x[1] <= SPREAD and x[2] <= SPREAD * max(abs(rest), 100 * abs(mine))]
    return min(near)[3] if near else None  # of units of one size the one linked to


def resolved_labels(graph: DataFrame, listed: DataFrame, rounds: int = 12) -> DataFrame:
    """(label, symbol, n): what each label of the graph names, carried from the roots along the links.

    One round reaches the labels next to the resolved ones; it ends when a round resolves none."""
    good = graph.where((F.col("n") >= MIN_LINKS) & (F.col("agreeing") >= AGREE))
    # both ways: label a in terms of b, and b in terms of a
    ways = good.select(F.col("a").alias("label"), F.col("b").alias("near"), "n", "scale", "offset").unionByName(good.select(F.col("b").alias("label"), F.col("a").alias("near"), "n", (1 / F.col("scale")).alias("scale"), (-F.col("offset") / F.col("scale")).alias("offset")))
    ways = cut_lineage(ways)

    @F.pandas_udf("string")
    def snapped(symbol: pd.Series, scale: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([snap(s, a, o) for s, a, o in zip(symbol, scale, offset)], dtype=object)

    votes = listed.withColumn("n", F.lit(DICTIONARY).cast("bigint"))
    known, before = votes, None
    for _ in range(rounds):
        reached = ways.join(known.select(F.col("label").alias("near"), "symbol"), "near").select("label", snapped("symbol", "scale", "offset").alias("symbol"), "n").where("symbol is not null")
        sums = reached.unionByName(votes).groupBy("label", "symbol").agg(F.sum("n").alias("n"))
        best = sums.groupBy("label").agg(F.max(F.struct("n", "symbol")).alias("best"), F.sum("n").alias("all"))
        known = cut_lineage(best.where(F.col("best.n") >= AGREE * F.col("all")).select("label", "best.symbol", "best.n"))
        state = known.agg(F.count("*"), F.sum(F.xxhash64("label", "symbol").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return known


# ---- values ----------------------------------------------------------------------------------------------------


def convert_values(nodes: DataFrame, blocks: DataFrame, spellings: Iterable[str] | None = None) -> DataFrame:
    """(node_id, quantity, unit, value, value_common, other_unit) of every value node that can be read.

    ``spellings`` are the dictionary's; None takes all that are listed."""
    read = cut_lineage(read_values(nodes, blocks))  # read twice below; the texts need reading only once
    labels = resolved_labels(unit_links(label_links(read)), dictionary(nodes.sparkSession, spellings)).select("label", "symbol")
    parts = F.split("c", US)
    offered = read.where("candidates != ''").select("node_id", "number", F.explode(F.split("candidates", RS)).alias("c")).select("node_id", "number", parts[0].cast("int").alias("rank"), parts[1].alias("label"))
    named = offered.join(labels, "label").groupBy("node_id").agg(F.min(F.struct("rank", "symbol", "number")).alias("m")).select("node_id", "m.symbol", "m.number")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for node, symbol, number in zip(b["node_id"], b["symbol"], b["number"]):
                unit = U.BY_SYMBOL[symbol]
                common = U.to_common(Decimal(number), unit)
                if abs(common) < 2**63:
                    rows.append((node, unit.quantity, symbol, float(number), common, not unit.is_common))
            yield pd.DataFrame(rows, columns=["node_id", "quantity", "unit", "value", "value_common", "other_unit"])

    return named.mapInPandas(convert, "node_id string, quantity string, unit string, value double, value_common bigint, other_unit boolean")


def found_values(nodes: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Values of the target quantities in another unit than the common one."""
    rows = convert_values(nodes, blocks).where("other_unit")
    return rows.join(targets.select("quantity").distinct(), "quantity", "left_semi").select("node_id", "quantity", "value_common")
