"""Quality, polarity and text rules as columns: everything stays in the JVM.

Regular expressions are written so that Java and RE2 read them alike: word edges are spelled out
instead of \\b, which the two dialects define differently next to accented letters.

Defined results. Every predicate is null-safe: null reads as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_L, EDGE_R = r"(^|[^0-9A-Za-z_])", r"([^0-9A-Za-z_]|$)"
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"

# Names that say nothing, cue words, confidences (they must equal the established ones).
STOPWORDS = ["value", "values", "parameter", "parameters", "param", "params", "no", "num", "number", "item", "items", "index", "id", "symbol", "symbols", "quantity", "unit", "units", "name", "type", "data", "result", "results", "table", "fig", "figure", "ref", "refs", "n/a", "na", "none", "-", "/", "—", "this work", "proposed", "proposed work", "ours", "this paper", "reference", "others"]
METADATA = EDGE_L + r"(publication|received|accepted|revised|submitted|current version|copyright|doi|issn|isbn|license|licen[cs]ed|ieee|digital object|permission|reprint|all rights reserved|corresponding author|manuscript|page [0-9]+|vol\.|volume [0-9]+)" + EDGE_R
NODE_ID = r"[a-zA-Z0-9_]+_[0-9a-f]{8}([^0-9A-Za-z_]|$)|::|_c[0-9]+([^0-9A-Za-z_]|$)|_tab[0-9]+([^0-9A-Za-z_]|$)|r[0-9]+c[0-9]+"
NEGATIVE = EDGE_L + r"(not|no|never|without|cannot|none|neither|nor|fail(s|ed|ing)?\s+to|lack(s|ed|ing)?\s+of|absence\s+of)" + EDGE_R + r"|n['’]t" + EDGE_R
CONTRASTIVE = EDGE_L + r"(unlike|whereas|however|although|though|but|conversely|in\s+contrast|contrary\s+to|rather\s+than|instead\s+of|as\s+opposed\s+to)" + EDGE_R
HYPOTHETICAL = EDGE_L + r"(if|would|could|might|may|suppose|assuming|hypothetically|potentially|expected\s+to|is\s+expected|were\s+to)" + EDGE_R
NEGATIVE_ZH = "没有|并非|并不|无法|未能|不能|不会|不是|不再|未能|未被|未得到|缺乏"
CONTRASTIVE_ZH = "然而|尽管|相反|而非|不同于|与之相反|却"
HYPOTHETICAL_ZH = "假设|如果|若是|倘若|可能会|预计|有望"
SCOPE_CONFIDENCE = {"same_sentence": 1.0, "same_table_row": 0.9, "same_table_column": 0.9, "same_caption": 0.85, "same_paragraph": 0.7, "same_chunk": 0.55}
RULE_CONFIDENCE, OTHER_CONFIDENCE, ELIGIBLE = 0.4, 0.5, 0.5
PENALTY = {"positive": 1.0, "hypothetical": 0.45, "contrastive": 0.35, "negative": 0.25}
STRUCTURAL = ["PaperNode", "TitleNode", "SectionNode", "ChunkNode", "FigureNode", "TableNode", "EquationNode", "CaptionNode"]
UNIT_WORDS = r"%|°C|℃|K|nm|µm|um|mm|cm|m|kg|mg|g|MPa|kPa|Pa|GPa|eV|meV|mol/L|mol|mAh/g|mA|A|V|Hz|GHz|MHz|W|J|s|h|min|wt\.?%|at\.?%"
UNIT_ALIAS = {"℃": "degC", "°C": "degC", "wt%": "percent", "wt.%": "percent", "at%": "percent", "at.%": "percent", "%": "percent", "um": "micrometer", "µm": "micrometer", "mAh/g": "milliampere_hour / gram"}
SENTENCE_END = r"(?<=[.!?。！？])\s+"
REFUSALS = ["文中无法确定", "无法确定", "无法从文中确定", "cannot be determined from the text", "cannot be determined"]
KEPT_REFUSALS = ["文中无法确定", "无法确定", "Cannot be determined from the text"]
GENERALISERS = ["all cases", "all conditions", "regardless", "any material", "所有情况", "所有条件"]


def text(c: Column | str) -> Column:
    """A text without surrounding white space; null reads as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def either(a: Column | str, b: Column | str) -> Column:
    """The first of two texts that is neither null nor empty, else empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def slug(c: Column | str, n: int) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"\s+", "_"), r"[^0-9a-z一-鿿_]+", ""), 1, n)
    return F.when(s == "", "x").otherwise(s)


def canonical_id(node_type: Column | str, content: Column | str) -> Column:
    return F.concat(F.col(node_type) if isinstance(node_type, str) else node_type, F.lit(":"), slug(content, 40))


def symbolic(c: Column | str) -> Column:
    """No content, a yes/no mark, a citation, a bare formula symbol or one or two characters."""
    s = text(c)
    core = F.regexp_replace(F.regexp_replace(s, r"\\[A-Za-z]+", ""), r"[${}_^\\\s]", "")
    return (
        (s == "")
        | F.upper(s).isin("Y", "N", "YES", "NO", "/", "-", "—", "N/A")
        | s.rlike(r"^\[\s*[0-9]+\s*(?:[,\-–]\s*[0-9]+\s*)*\]$")
        | ~s.rlike("[A-Za-z0-9一-鿿]")
        | (s.rlike(r"^\$.*\$$") & (F.length(core) <= 3))
        | ((F.length(s) <= 2) & ~s.rlike(f"^(?:{NUMBER})$"))
    )


def metadata(c: Column | str) -> Column:
    return F.lower(text(c)).rlike(METADATA)


def stopword(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(c)), r"\.+$", "").isin(STOPWORDS)


def measurement(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"[$\\{}^_\s]", "").rlike(r"^[-+]?[0-9]+(?:\.[0-9]+)?[A-Za-z%°µΩ/·]{0,5}$")


def valid_point(node_type: Column | str, name: Column | str, content: Column | str) -> Column:
    """Whether a point carries enough to enter the graph."""
    t = F.col(node_type) if isinstance(node_type, str) else node_type
    content = text(content)
    name = either(text(name), content)
    noise = t.isin("ConditionNode", "ClaimNode", "MethodNode", "ConceptNode", "AttributeNode") & (metadata(name) | metadata(content))
    wordy = ~symbolic(name) & ~stopword(name) & name.rlike("[A-Za-z]{2,}|[一-鿿]{2,}")
    return (
        F.when((name == "") & (content == ""), False)
        .when(t.isin(STRUCTURAL), True)
        .when(noise, False)
        .when(t == "ValueNode", content.rlike(NUMBER) | name.rlike(NUMBER))
        .when(t == "UnitNode", (F.length(content) <= 16) & content.rlike("[A-Za-z%°Ω]"))
        .when(t == "ConceptNode", wordy & ~measurement(name))
        .when(t == "AttributeNode", wordy)
        .when(t == "ConditionNode", ~symbolic(name))
        .otherwise(True)
    )


def between_window(body: Column | str, a: Column | str, b: Column | str) -> Column:
    """The stretch between two mentions with a left margin inside the sentence; the whole text if one isn't found."""
    t = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    ha, hb = F.substring(text(a), 1, 20), F.substring(text(b), 1, 20)
    ia = F.when(ha == "", 0).otherwise(F.instr(F.lower(t), F.lower(ha)))
    ib = F.when(hb == "", 0).otherwise(F.instr(F.lower(t), F.lower(hb)))
    low, high = F.least(ia, ib), F.greatest(ia, ib)
    margin = F.regexp_extract(F.substring(t, F.greatest(F.lit(1), low - 30), low - F.greatest(F.lit(1), low - 30)), "([^.!?;。；]*)$", 1)
    start = low - F.length(margin)
    end = high + F.greatest(F.length(ha), F.length(hb)) + 5
    return F.when((ia == 0) | (ib == 0), t).otherwise(F.substring(t, start, end - start))


def polarity(window: Column | str) -> Column:
    w = F.col(window) if isinstance(window, str) else window
    low = F.lower(w)
    return (
        F.when(low.rlike(NEGATIVE) | w.rlike(NEGATIVE_ZH), "negative")
        .when(low.rlike(CONTRASTIVE) | w.rlike(CONTRASTIVE_ZH), "contrastive")
        .when(low.rlike(HYPOTHETICAL) | w.rlike(HYPOTHETICAL_ZH), "hypothetical")
        .otherwise("positive")
    )


def confidence_table() -> list[tuple[str, str, float]]:
    """(scope, polarity, confidence) of the whole finite domain, with the established rounding."""
    scopes = {**SCOPE_CONFIDENCE, "rule_completion": RULE_CONFIDENCE, "other": OTHER_CONFIDENCE}
    return [(s, p, round(base * factor, 3)) for s, base in scopes.items() for p, factor in PENALTY.items()]


def edge_confidence(scope: Column | str, pol: Column | str, rule_completion: Column | bool = False) -> Column:
    scope, pol = (F.col(x) if isinstance(x, str) else x for x in (scope, pol))
    rule = F.lit(rule_completion) if isinstance(rule_completion, bool) else rule_completion
    key = F.when(rule, "rule_completion").when(scope.isin(list(SCOPE_CONFIDENCE)), scope).otherwise("other")
    pol = F.when(pol.isin(list(PENALTY)), pol).otherwise("positive")
    pairs = [x for s, p, c in confidence_table() for x in (F.lit(f"{s}|{p}"), F.lit(c))]
    return F.element_at(F.create_map(*pairs), F.concat_ws("|", key, pol))


def eligible(confidence: Column | str, pol: Column | str) -> Column:
    """Positive and at least ELIGIBLE; missing fields read as positive and 1."""
    confidence, pol = (F.col(x) if isinstance(x, str) else x for x in (confidence, pol))
    return (F.coalesce(pol, F.lit("positive")) == "positive") & (F.coalesce(confidence, F.lit(1.0)) >= ELIGIBLE)


def qa_reason(question: Column | str, answer: Column | str, question_type: Column | str, source_names: Column | None = None) -> Column:
    """Why a question-answer pair is kept ("ok", "refusal") or dropped."""
    q, a = text(question), text(answer)
    t = F.col(question_type) if isinstance(question_type, str) else question_type
    circular = F.lit(False)
    if source_names is not None:
        circular = F.exists(F.coalesce(source_names, F.array().cast("array<string>")), lambda n: (text(n) != "") & (F.lower(text(n)) == F.lower(a))) & (F.length(a) <= 6)
    return (
        F.when(F.length(q) < 6, "question_too_short")
        .when(a == "", "empty_answer")
        .when(q.rlike(NODE_ID) | a.rlike(NODE_ID), "leaks_node_id")
        .when(a.isin(KEPT_REFUSALS), "refusal")
        .when(symbolic(a), "degenerate_answer")
        .when(circular, "circular_answer")
        .when((t == "numerical") & ~a.rlike(NUMBER), "numerical_without_number")
        .otherwise("ok")
    )


def numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(f"({NUMBER})"), F.lit(1))


def value_units(c: Column | str) -> Column:
    """array<struct<value, unit>>: numbers with the unit that follows, leftmost alternative first."""
    pattern = F.lit(rf"({NUMBER})\s*({UNIT_WORDS})?")
    body = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.arrays_zip(F.regexp_extract_all(body, pattern, F.lit(1)).alias("value"), F.regexp_extract_all(body, pattern, F.lit(2)).alias("unit"))


def units(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.transform(value_units(c), lambda x: x["unit"]), lambda u: u != ""))


def normal_unit(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    alias = F.create_map(*[F.lit(x) for kv in UNIT_ALIAS.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, F.trim(c)), F.trim(c))


def sentences(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.filter(F.transform(F.split(c, SENTENCE_END), text), lambda s: s != "")


def references(c: Column | str, kind: str) -> Column:
    """Numbers of the figures, tables or equations that a text refers to."""
    words = {"figure": r"(?:Fig\.?|Figure)", "table": r"(?:Tab\.?|Table)", "equation": r"(?:Eq\.?|Equation)"}[kind]
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_extract_all(c, F.lit(rf"(?i)(?:^|[^0-9A-Za-z_]){words}\s*\.?\s*\(?([0-9]+)"), F.lit(1))


def token_set(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "/", " "), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    whole = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / whole)


def close_numbers(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNull() | y.isNull(), a == b).when(y == 0, F.abs(x) < 1e-9).otherwise(F.abs(x - y) / F.abs(y) <= tolerance)


def token_count(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def refusal(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[。.]+$", "").isin(REFUSALS)


# Dimension, factor and offset to the base unit of each unit (base = value * factor + offset).
UNIT_DIMENSIONS = {
    "%": ("ratio", 0.01, 0.0), "wt%": ("ratio", 0.01, 0.0), "wt.%": ("ratio", 0.01, 0.0), "at%": ("ratio", 0.01, 0.0), "at.%": ("ratio", 0.01, 0.0),
    "K": ("temperature", 1.0, 0.0), "°C": ("temperature", 1.0, 273.15), "℃": ("temperature", 1.0, 273.15),
    "nm": ("length", 1e-9, 0.0), "µm": ("length", 1e-6, 0.0), "um": ("length", 1e-6, 0.0), "mm": ("length", 1e-3, 0.0), "cm": ("length", 1e-2, 0.0), "m": ("length", 1.0, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 1e-3, 0.0), "mg": ("mass", 1e-6, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "kPa": ("pressure", 1e3, 0.0), "MPa": ("pressure", 1e6, 0.0), "GPa": ("pressure", 1e9, 0.0),
    "eV": ("energy", 1.602176634e-19, 0.0), "meV": ("energy", 1.602176634e-22, 0.0), "J": ("energy", 1.0, 0.0),
    "mol/L": ("concentration", 1e3, 0.0), "mol": ("amount", 1.0, 0.0), "mAh/g": ("specific charge", 3600.0, 0.0),
    "mA": ("current", 1e-3, 0.0), "A": ("current", 1.0, 0.0), "V": ("voltage", 1.0, 0.0), "W": ("power", 1.0, 0.0),
    "Hz": ("frequency", 1.0, 0.0), "MHz": ("frequency", 1e6, 0.0), "GHz": ("frequency", 1e9, 0.0),
    "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0),
}


def _of_unit(c: Column, at: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for unit, facts in UNIT_DIMENSIONS.items() for x in (unit, facts[at])]), F.trim(c))


def dimension(c: Column | str) -> Column:
    """The dimension of a unit, null if it isn't known."""
    return _of_unit(F.col(c) if isinstance(c, str) else c, 0)


def converted(value: Column | str, source: Column | str, target: Column | str) -> Column:
    """A value in another unit of the same dimension, else null."""
    value, source, target = (F.col(x) if isinstance(x, str) else x for x in (value, source, target))
    base = value * _of_unit(source, 1) + _of_unit(source, 2)
    return F.when(dimension(source) == dimension(target), (base - _of_unit(target, 2)) / _of_unit(target, 1))


def compatible(a: Column | str, b: Column | str) -> Column:
    """Whether two units can be converted; units without a known dimension must be the same. An empty one goes only with an empty one."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    return F.when((a == "") | (b == ""), a == b).otherwise(F.coalesce(dimension(a) == dimension(b), normal_unit(a) == normal_unit(b)))


def meaningful_attribute(c: Column | str) -> Column:
    return ~symbolic(c) & ~stopword(c)


def locate_sentence(content: Column | str, sentences_: Column) -> Column:
    """The index, as text, of the first sentence that holds the beginning of a content; null if none does."""
    head = F.substring(text(content), 1, 20)
    at = F.array_position(F.transform(sentences_, lambda s: F.contains(s, head)), F.lit(True))
    return F.when((head != "") & (at > 0), (at - 1).cast("string"))


def cooccur_scope(a: Column | str, b: Column | str, sentences_: Column, in_caption: Column) -> Column:
    """same_caption, same_sentence if one sentence holds the beginnings of both contents, else same_chunk."""
    ha, hb = F.substring(F.coalesce(F.col(a) if isinstance(a, str) else a, F.lit("")), 1, 20), F.substring(F.coalesce(F.col(b) if isinstance(b, str) else b, F.lit("")), 1, 20)
    together = (ha != "") & (hb != "") & F.exists(F.coalesce(sentences_, F.array().cast("array<string>")), lambda s: F.contains(s, ha) & F.contains(s, hb))
    return F.when(in_caption, "same_caption").when(F.coalesce(together, F.lit(False)), "same_sentence").otherwise("same_chunk")


RANGE = r"([-+]?[0-9]+(?:\.[0-9]+)?)\s*[~～\-–—]\s*([-+]?[0-9]+(?:\.[0-9]+)?)"


def number_range(c: Column | str) -> Column:
    """struct<low, high> of a written range, else null."""
    c = F.col(c) if isinstance(c, str) else c
    a, b = (F.regexp_extract(c, RANGE, i).try_cast("double") for i in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def reproduced(gold: Column, said: Column) -> Column:
    """Whether an answer's numbers reproduce a number, or a range: a number in it (2 % margins) or both of its ends."""
    numbers_ = F.filter(F.transform(said, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    r = number_range(gold)
    inside = F.exists(numbers_, lambda x: x.between(r["low"] * 0.98, r["high"] * 1.02))
    near = lambda end: F.exists(numbers_, lambda x: F.when(end == 0, F.abs(x) < 1e-9).otherwise(F.abs(x - end) / F.abs(end) <= 0.02))
    single = F.exists(said, lambda x: F.coalesce(close_numbers(x, gold), F.lit(False)))
    return F.coalesce(F.when(r.isNotNull(), inside | (near(r["low"]) & near(r["high"]))).otherwise(single), F.lit(False))


def evidence_lines(spans: Column | str) -> Column:
    """Evidence as lines "[node] (paper/section/chunk) content"."""
    part = lambda s, k: F.coalesce(s["address"][k], F.lit(""))
    line = lambda s: F.concat(F.lit("["), F.coalesce(s["node_id"], F.lit("")), F.lit("] ("), F.concat_ws("/", part(s, "paper_id"), part(s, "section_path"), part(s, "chunk_id")), F.lit(") "), F.coalesce(s["content"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(F.col(spans) if isinstance(spans, str) else spans, line), "\n"), F.lit(""))


def log_probability(c: Column | str) -> Column:
    """ln of a probability; null unless it is above 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, F.log(c))


def cell_address(address: Column | str, row: Column | str, col: Column | str) -> Column:
    """An address with the place of a table cell as its span."""
    address, row, col = (F.col(x) if isinstance(x, str) else x for x in (address, row, col))
    return address.withField("span", F.concat(F.lit("r"), row.cast("string"), F.lit("c"), col.cast("string")))
