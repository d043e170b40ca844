"""Problem 3: text that looks the same brought to one form.

Every letter of a token is read as the set of scripts in which it could be written, by itself or by a
letter that looks alike: the published confusables of Unicode, as the JVM's ICU library holds them,
and a short list of others. The sets are intersected over the token. A token of mixed scripts is
spelled in the script that can write all of it, the one that has most of its letters first. A token
that is consistent in its own script keeps it, unless the other words of the text are in another
script that can write it as well; where there are no other words, both spellings are kept and what
else the table holds decides. What remains is normalised: width, spaces, invisible characters,
composed accents, dashes.

Defined results. Letter case, accents, superscripts and subscripts are kept; a letter by itself is a
symbol of its own script. Null, empty and invisible texts have no form (null) and match nothing. A
node delivered twice gives one row, also with null content. Terms that look alike each match.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage

# Letters of other scripts and the Latin letters they look like.
_ALIKE = {
    "Cyrl": ("аАВсСԁеЕԌһНіІјЈкКӏМоОрРԛԚѕЅТԝԜхХуУѵӀҮү", "aABcCdeEGhHiIjJkKlMoOpPqQsSTwWxXyYvIYy"),
    "Grek": ("αΑΒϲϹεΕΗιΙϳκΚΜνΝοΟρΡΤυΥΧΖγ", "aABcCeEHiIjkKMvNoOpPTuYXZy"),
    "Armn": ("օսոհզցքՕՍՏ", "ounhqgpOUS"),
    "Cher": ("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ", "ABCDEGHiJKLMPRSTVWYZ"),
    "Latx": ("ɑɡıǀ", "agil"),
}
_DASHES = dict.fromkeys(map(ord, "‐‑‒–−﹣－⁃˗"), "-")
_QUOTES = {ord(c): to for c, to in zip("’ʼ‘′＇“”″", ["'"] * 5 + ['"'] * 3)}
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]")
_KEEP = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


@lru_cache(maxsize=4096)
def _compatible(c: str) -> str:
    """Width, ligature, numeral and radical forms undone; superscripts and subscripts kept."""
    form = unicodedata.decomposition(c)
    if form.startswith("<") and not form.startswith(_KEEP):
        return "".join(_compatible(chr(int(x, 16))) for x in form.split()[1:])
    return c


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    """The script of a letter, "" for marks, digits and signs."""
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


class Confusables:
    """Which letter of another script looks like a letter."""

    def __init__(self, prototypes: dict[str, str] | None = None) -> None:
        """``prototypes`` gives what a letter looks like; letters of one prototype look alike."""
        self.spelled: dict[str, dict[str, str]] = {}
        alike: dict[str, list[str]] = {}
        for c, shown in sorted((prototypes or {}).items()):
            alike.setdefault(shown, []).append(c)
        for letters in alike.values():
            for c in letters:
                for d in letters:
                    if d != c and script(d) != script(c):
                        best = self.spelled.setdefault(c, {}).get(script(d))
                        if best is None or (d.isupper() == c.isupper()) > (best.isupper() == c.isupper()):
                            self.spelled[c][script(d)] = d
        self.within: dict[str, str] = {}
        for letters, latin in _ALIKE.values():
            for c, d in zip(letters, latin):
                if script(c) == "LATIN":
                    self.within[c] = d
                else:
                    self.spelled.setdefault(c, {})["LATIN"] = d
                    self.spelled.setdefault(d, {}).setdefault(script(c), c)

    def scripts(self, c: str) -> frozenset[str]:
        """The scripts in which a letter could be written."""
        return frozenset({script(c), *self.spelled.get(c, ())})

    def spell(self, token: str, wanted: str) -> str:
        return "".join(c if not c.isalpha() or script(c) == wanted else self.spelled[c][wanted] for c in token)

    def resolve(self, token: str, around: str | None = None) -> str:
        """The spelling of a token in its consistent script; ``around`` is the script of the text around it."""
        token = "".join(self.within.get(c, c) for c in token) if len(token) > 1 else token
        letters = [c for c in token if c.isalpha()]
        own = Counter(map(script, letters))
        if not letters or len(token) == 1 or own.keys() == {"LATIN"}:
            return token
        common = frozenset.intersection(*map(self.scripts, letters))
        if len(own) == 1:
            return self.spell(token, around) if around in common else token
        if not common:
            return token
        return self.spell(token, max(common, key=lambda s: (s == around, own[s], s == "LATIN", s)))

    def latin(self, token: str) -> str:
        """The Latin spelling of a token that can have one, else the token."""
        token = "".join(self.within.get(c, c) for c in token) if len(token) > 1 else token
        letters = [c for c in token if c.isalpha()]
        return self.spell(token, "LATIN") if len(token) > 1 and letters and all("LATIN" in self.scripts(c) for c in letters) else token


_PARTS = re.compile(r"([\s\-/()]+|[㐀-鿿]+)")


def _normal(text: str) -> str:
    text = _INVISIBLE.sub("", text)
    text = "".join(_compatible(c) for c in text).translate(_DASHES).translate(_QUOTES)
    return unicodedata.normalize("NFD", " ".join(text.split()))


def forms(text: str | None, table: Confusables) -> tuple[str | None, str | None]:
    """(the one form of everything that looks like ``text``, its Latin spelling if only other rows can tell which is meant)."""
    if text is None:
        return None, None
    if text.isascii():
        return " ".join(text.split()) or None, None
    parts = _PARTS.split(_normal(text))
    sure = [Counter(s for c in p if (s := script(c)) and (c.isascii() or not table.spelled.get(c))) for p in parts]
    whole = sum(sure, Counter())
    out, other = [], []
    for part, mine in zip(parts, sure):
        rest = whole - mine
        around = max(rest, key=lambda s: (rest[s], s)) if rest else None
        form = table.resolve(part, around)
        out.append(form)
        other.append(table.latin(part) if around is None else form)
    form, latin = (unicodedata.normalize("NFC", "".join(x)) or None for x in (out, other))
    return form, latin if latin != form else None


def one_form(text: str | None, table: Confusables | None = None) -> str | None:
    """The one form of everything that looks like ``text``, as far as the text itself tells."""
    return forms(text, table or Confusables())[0]


_published: dict[str, dict[str, str]] = {}


def published(spark: SparkSession) -> dict[str, str]:
    """What each letter looks like by Unicode's published confusables; empty where the session has no JVM to ask."""
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except (AttributeError, TypeError):
        return {}
    if spark.version not in _published:
        letters = [c for c in map(chr, range(0x20000)) if c.isalpha() and script(c) not in ("CJK", "HANGUL") and _compatible(c) == c]
        shown = checker.getSkeleton("\n".join(letters)).split("\n")
        _published[spark.version] = {c: s for c, s in zip(letters, shown) if len(s) == 1}
    return _published[spark.version]


def with_form(df: DataFrame, column: str, out: str = "one_form") -> DataFrame:
    """Adds the one form of a text column, and as ``<out>_latin`` the other spelling where only other rows can tell. Plain spelled ASCII never leaves the JVM."""
    prototypes = published(df.sparkSession)

    @F.pandas_udf("form string, latin string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Confusables(prototypes)
        for texts in batches:
            yield pd.DataFrame([forms(t, table) for t in texts], columns=["form", "latin"])

    plain = F.coalesce(F.col(column).rlike(PLAIN), F.lit(False))  # else a null is in neither part
    odd = df.where(~plain).withColumn("__f", both(F.col(column)))
    odd = odd.withColumns({out: F.col("__f.form"), f"{out}_latin": F.col("__f.latin")}).drop("__f")
    return df.where(plain).withColumns({out: F.col(column), f"{out}_latin": F.lit(None).cast("string")}).unionByName(odd)


PLAIN = r"^[\x21-\x7e]+( [\x21-\x7e]+)*$"


def found_terms(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(node_id, term_id): nodes that show a term but are not written like it."""
    odd = nodes.where(F.col("content").isNotNull() & ~F.col("content").rlike(PLAIN)).select("node_id", "content").dropDuplicates(["node_id"])
    shown = with_form(odd, "content", "form").select("node_id", "content", F.explode(F.array("form", "form_latin")).alias("form")).where("form is not null")
    clean = with_form(terms.where("term is not null").select("term_id", "term"), "term", "form")
    return shown.join(clean, "form").where(F.col("content") != F.col("term")).select("node_id", "term_id").distinct()


def consistent_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, one_form, canonical_id) of every node: identifiers made from the one form instead of the raw text.

    A text without other words that could be Latin is Latin if another node is so written."""
    rows = with_form(nodes.where("node_id is not null").select("node_id", "node_type", "content").dropDuplicates(["node_id"]), "content")
    rows = cut_lineage(rows)
    spelled = rows.where("one_form_latin is null and one_form is not null").select(F.col("one_form").alias("one_form_latin")).distinct()
    asked = rows.where("one_form_latin is not null")
    latin = asked.join(spelled, "one_form_latin", "left_semi").withColumn("one_form", F.col("one_form_latin"))
    own = asked.join(spelled, "one_form_latin", "left_anti")
    rows = rows.where("one_form_latin is null").unionByName(latin).unionByName(own)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim("one_form")), r"\s+", "_"), r"[^0-9a-z一-鿿_]+", ""), 1, 40)
    return rows.select("node_id", "one_form", F.concat(F.col("node_type"), F.lit(":"), F.when(F.length(slug) > 0, slug).otherwise(F.lit("x"))).alias("canonical_id"))
