"""Question-answer items: filtering, corruption, verification, repair, pools.

Pseudo-random choices are taken from md5("seed|key|operation"), so that a rerun, another partitioning
and another engine choose alike.

Defined results. Null answers read as empty. Items delivered twice count once (first that arrived).
Checks give one row per violation; an item without evidence fails the evidence check only. Legitimate
refusals pass every check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.session import cut_lineage

SEED = 42
# Units, endings and factors of the corruptions.
UNITS = ["%", "MPa", "kPa", "GPa", "K", "°C", "eV", "nm", "µm", "mm", "V", "A", "Hz"]
GENERAL = [" in all cases", " under all conditions", " regardless of temperature", " for any material", "（适用于所有情况）"]
FACTORS = [0.5, 1.5, 2.0, 10.0, 0.1]
UNSUPPORTED = [" This is the highest value ever reported.", " The mechanism is fully understood.", "（该结论已被所有后续研究证实）"]


def items(qa: DataFrame) -> DataFrame:
    return qa.where("qid is not null").dropDuplicates(["qid"])


def evidence_text() -> Column:
    return F.coalesce(F.array_join(F.transform("evidence_spans", lambda s: F.coalesce(s["content"], F.lit(""))), " "), F.lit(""))


def conditions() -> Column:
    return F.coalesce(F.try_element_at("constraints", F.lit("condition")), F.array().cast("array<string>"))


def choice(key: Column | str, operation: str, n: int, seed: int = SEED) -> Column:
    """A reproducible index below n."""
    h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key) if isinstance(key, str) else key, F.lit(operation))), 1, 8)
    return (F.conv(h, 16, 10).cast("bigint") % n).cast("int")


def filter_reasons(qa: DataFrame) -> DataFrame:
    """(qid, reason): why each item is kept or dropped."""
    names = F.transform("evidence_spans", lambda s: F.coalesce(s["content"], F.lit("")))
    return items(qa).select("qid", R.qa_reason("question", "answer", "question_type", names).alias("reason"))


def deduplicated(qa: DataFrame) -> DataFrame:
    """Kept items whose type and first 80 characters of the answer, case and spacing aside, come first."""
    rows = items(qa).withColumn("reason", R.qa_reason("question", "answer", "question_type")).where(F.col("reason").isin("ok", "refusal"))
    key = F.substring(F.regexp_replace(F.lower(R.text("answer")), r"\s+", " "), 1, 80)
    return rows.withColumn("key", key).groupBy("question_type", "key").agg(F.min("qid").alias("qid"), F.count("*").alias("copies")).select("qid", "question_type", "copies")


# ---- checks ----------------------------------------------------------------------------------------------------


def _violations(rows: DataFrame, layer: str, field: str, severity: str, actual: Column) -> DataFrame:
    return rows.select("qid", F.lit(layer).alias("layer"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), actual.alias("actual"))


def _checked(qa: DataFrame) -> DataFrame:
    return items(qa).where(~R.refusal("answer")).withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("evidence", evidence_text())


def check_numeric(qa: DataFrame) -> DataFrame:
    """Numbers of the answer that no number of the evidence comes within 2 % of."""
    rows = _checked(qa).withColumn("known", R.numbers("evidence"))
    bad = F.filter(R.numbers("answer"), lambda a: ~F.exists("known", lambda e: F.coalesce(R.close_numbers(a, e), F.lit(False))))
    return _violations(rows.withColumn("bad", F.explode(bad)), "constraint", "number", "critical", F.col("bad"))


def check_unit(qa: DataFrame) -> DataFrame:
    """Units of the answer that are compatible with none of the evidence's units."""
    rows = _checked(qa).withColumn("known", R.units("evidence")).where(F.size("known") > 0)
    bad = F.filter(R.units("answer"), lambda u: ~F.exists("known", lambda k: R.compatible(u, k)))
    return _violations(rows.withColumn("bad", F.explode(bad)), "constraint", "unit", "major", F.col("bad"))


def check_condition(qa: DataFrame) -> DataFrame:
    """Conditions that the answer generalises away or doesn't mention."""
    rows = _checked(qa).withColumn("conditions", conditions()).where(F.size("conditions") > 0)
    low = F.lower("answer")
    general = rows.where(F.exists(F.array(*map(F.lit, R.GENERALISERS)), lambda g: F.contains(low, g)))
    keys = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, "[^0-9a-zA-Z一-鿿]+", " ")), " "), lambda k: k != "")
    missing = F.filter("conditions", lambda c: (F.size(keys(c)) > 0) & ~F.exists(keys(c), lambda k: (F.length(k) > 1) & F.contains(F.col("answer"), k)))
    return _violations(general, "constraint", "condition", "major", F.lit("over-generalized answer")).unionByName(_violations(rows.withColumn("bad", F.explode(missing)), "constraint", "condition", "major", F.col("bad")))


def check_evidence(qa: DataFrame) -> DataFrame:
    """Items that cite nothing, or share no word with what they cite."""
    rows = _checked(qa)
    none = (F.coalesce(F.size("source_nodes"), F.lit(0)) <= 0) & (F.coalesce(F.size("evidence_spans"), F.lit(0)) <= 0)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([0-9a-zA-Z一-鿿]{2,})"), F.lit(1)))
    said, known = words(F.col("answer")), words(F.col("evidence"))
    apart = ~none & (F.size(said) > 0) & ~F.arrays_overlap(said, known)
    return _violations(rows.where(none), "evidence", "evidence", "critical", F.lit("no evidence cited")).unionByName(_violations(rows.where(apart), "evidence", "evidence", "major", F.lit("no token overlap with evidence")))


CHECKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"numerical_check": check_numeric, "unit_check": check_unit, "condition_check": check_condition, "evidence_check": check_evidence}


def verify(qa: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Violations of all enabled checks."""
    rows = [check(qa) for name, check in CHECKERS.items() if enabled is None or name in enabled]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def summary(qa: DataFrame) -> DataFrame:
    """(qid, violations, critical, passed) of every item."""
    v = verify(qa).groupBy("qid").agg(F.count("*").alias("violations"), F.sum((F.col("severity") == "critical").cast("bigint")).alias("critical"))
    rows = items(qa).select("qid").join(v, "qid", "left")
    return rows.select("qid", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("critical", F.lit(0)).alias("critical"), F.col("violations").isNull().alias("passed"))


# ---- corruption ------------------------------------------------------------------------------------------------


def replace_first(whole: Column, part: Column, by: Column) -> Column:
    at = F.instr(whole, part)
    return F.when(at == 0, whole).otherwise(F.concat(F.substring(whole, F.lit(1), at - 1), by, F.substring(whole, at + F.length(part), F.length(whole))))


def show_number(x: Column) -> Column:
    """A number as an integer if it is one, else with three significant digits."""
    digits = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-9)))).cast("int"))
    plain = F.when(digits == 0, F.format_string("%.0f", x)).when(digits == 1, F.format_string("%.1f", x)).when(digits == 2, F.format_string("%.2f", x)).when(digits == 3, F.format_string("%.3f", x)).otherwise(F.format_string("%.4f", x))
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def _pick(options: list[str], key: str, operation: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), choice(key, operation, len(options)) + 1)


def wrong_number() -> Column:
    found = F.filter(R.numbers("answer"), lambda n: F.abs(n.try_cast("double")) < 1e15)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("qid"), F.lit("which"))), 1, 8), 16, 10).cast("bigint")
    target = F.get(found, (h % F.greatest(F.size(found), F.lit(1))).cast("int"))
    new = show_number(target.cast("double") * F.element_at(F.array(*map(F.lit, FACTORS)), choice("qid", "factor", len(FACTORS)) + 1))
    out = replace_first(F.col("answer"), target, new)
    return F.when((F.size(found) > 0) & (out != F.col("answer")), out)


def unit_mismatch() -> Column:
    present = F.filter(F.array(*map(F.lit, UNITS)), lambda u: F.contains(F.col("answer"), u))
    others = F.filter(F.array(*map(F.lit, UNITS)), lambda u: u != F.get(present, F.lit(0)))
    return F.when(F.size(present) > 0, replace_first(F.col("answer"), F.get(present, F.lit(0)), F.get(others, choice("qid", "unit", len(UNITS) - 1))))


def over_generalisation() -> Column:
    less = F.aggregate(conditions(), F.col("answer"), lambda acc, c: F.when((c != "") & F.contains(acc, c), R.text(F.replace(acc, c, F.lit("")))).otherwise(acc))
    return F.concat(F.regexp_replace(less, "[.。]+$", ""), _pick(GENERAL, "qid", "general"))


def boundary_violation() -> Column:
    first = F.get(conditions(), F.lit(0))
    target = F.get(R.numbers(first), F.lit(0))
    grown = F.when(F.abs(target.try_cast("double")) < 1e15, target.try_cast("double") * 3)
    new = replace_first(first, target, F.when(grown == F.floor(grown), F.concat(F.format_string("%.0f", grown), F.lit(".0"))).otherwise(grown.cast("string")))
    return F.when(grown.isNotNull(), F.when(F.contains(F.col("answer"), first), replace_first(F.col("answer"), first, new)).otherwise(F.concat("answer", F.lit(" (condition changed to "), new, F.lit(")"))))


def missing_hop() -> Column:
    parts = F.split("answer", R.SENTENCE_END)
    return F.when(F.size("evidence_path") >= 2, F.when(F.size(parts) < 2, F.concat("answer", F.lit(" (missing intermediate reasoning)"))).otherwise(F.get(parts, F.lit(0))))


def unsupported() -> Column:
    return F.concat(F.regexp_replace("answer", r"\s+$", ""), _pick(UNSUPPORTED, "qid", "unsupported"))


def table_misread() -> Column:
    return F.when(F.col("question_type") == "table", F.coalesce(wrong_number(), F.concat("answer", F.lit(" (read from wrong row/column)"))))


def formula_misuse() -> Column:
    return F.when(F.col("question_type") == "formula", F.concat("answer", F.lit(" (derived from a different equation)")))


def evidence_drift() -> Column:
    return F.concat("answer", F.lit(" [evidence drifted to unrelated span]"))


CORRUPTORS: dict[str, Callable[[], Column]] = {"wrong_number": wrong_number, "unit_mismatch": unit_mismatch, "over_generalization": over_generalisation, "boundary_violation": boundary_violation, "missing_hop": missing_hop, "unsupported_answer": unsupported, "table_misread": table_misread, "formula_misuse": formula_misuse, "evidence_drift": evidence_drift}


def corrupt(qa: DataFrame, concepts: DataFrame | None = None, per_item: int = 2) -> DataFrame:
    """(qid, source_qid, error_type, answer): the first ``per_item`` corruptions of each item in its own shuffled order.

    With ``concepts`` (content) swapping an entity for another of the pool is one of the corruptions.
    """
    rows = items(qa).withColumn("answer", F.coalesce("answer", F.lit("")))
    makers = {name: f() for name, f in CORRUPTORS.items()}
    if concepts is not None:
        rows = rows.join(swap_entities(qa, concepts), "qid", "left")
        makers["entity_swap"] = F.col("swapped")
    made = F.array(*[F.struct(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("qid"), F.lit(name))).alias("at"), F.lit(name).alias("error"), answer.alias("answer")) for name, answer in makers.items()])
    kept = F.slice(F.array_sort(F.filter(made, lambda m: m["answer"].isNotNull())), 1, per_item)
    has_number = F.size(F.filter(R.numbers("answer"), lambda n: F.abs(n.try_cast("double")) < 1e15)) > 0
    out = rows.withColumn("numbered", has_number).select("qid", "numbered", F.explode(kept).alias("m"))
    kind = F.when((F.col("m.error") == "table_misread") & F.col("numbered"), "wrong_number").otherwise(F.col("m.error"))
    return out.select(F.concat("qid", F.lit("__"), F.col("m.error")).alias("qid"), F.col("qid").alias("source_qid"), kind.alias("error_type"), F.col("m.answer").alias("answer"))


def swap_entities(qa: DataFrame, concepts: DataFrame) -> DataFrame:
    """(qid, swapped): answers that name a concept of the pool, in one word or several, with another of the pool in its place.

    Names are found by joining on the runs of words of each answer, up to the longest name's; of several the longest is swapped, then the first."""
    names = concepts.where("content is not null and trim(content) != ''").select(F.trim("content").alias("content")).distinct()
    size = names.agg(F.max(F.size(F.split("content", " "))).alias("longest"), F.count("*").alias("n")).first()
    longest, buckets = size["longest"] or 1, max(1, size["n"] // 64)
    w = Window.partitionBy(F.pmod(F.xxhash64("content"), F.lit(buckets))).orderBy("content")
    pool = names.withColumn("other", F.coalesce(F.lead("content").over(w), F.lag("content").over(w))).where("other is not null")
    words = F.split(F.regexp_replace("answer", r"\s+", " "), " ")
    rows = items(qa).where("answer is not null and trim(answer) != ''").select("qid", "answer", words.alias("w"), F.posexplode(words).alias("i", "_"))
    runs = rows.select("qid", "answer", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i"))), lambda n: F.array_join(F.slice("w", F.col("i") + 1, n), " "))).alias("run"))
    runs = runs.select("qid", "answer", F.regexp_replace("run", r"^[(（\"'“]+|[.,;:!?)）\"'”，。；：！？]+$", "").alias("content")).where("content != ''").distinct()
    hit = runs.join(pool, "content").groupBy("qid").agg(F.min_by(F.struct("answer", "content", "other"), F.struct(-F.length("content"), F.col("content"))).alias("h"))
    return hit.select("qid", replace_first(F.col("h.answer"), F.col("h.content"), F.col("h.other")).alias("swapped"))


def preferences(qa: DataFrame) -> DataFrame:
    """(qid, chosen, rejected, error_type): each corruption against the item it was made from."""
    good = items(qa).select(F.col("qid").alias("source_qid"), F.coalesce("answer", F.lit("")).alias("chosen"))
    return corrupt(qa).join(good, "source_qid").select("qid", "chosen", F.col("answer").alias("rejected"), "error_type")


# ---- order, pools, repair --------------------------------------------------------------------------------------


def interleaved(plans: DataFrame, kind: str, key: str, n: int | None = None) -> DataFrame:
    """Round-robin over the kinds: (key, kind, turn), cut to the first n."""
    w = Window.partitionBy(kind).orderBy(key)
    rows = plans.select(key, kind).withColumn("turn", F.row_number().over(w))
    return rows if n is None else rows.orderBy("turn", kind).limit(n)


def pools(qa: DataFrame) -> DataFrame:
    """(qid, pool): corrupted items aside, an item is a benchmark item if it passes, else for human review."""
    clean = items(qa).where(~F.coalesce("is_corrupted", F.lit(False))).select("qid")
    return clean.join(summary(qa), "qid").select("qid", F.when(F.col("passed"), "benchmark").otherwise("human_review").alias("pool"))


def repair(qa: DataFrame, respond: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """(qid, answer, rounds, pool): failing items get a new answer and are checked again, at most ``rounds`` times.

    ``respond`` maps (qid, prompt) to (qid, text). Each round's state is written to the shared checkpoint
    folder, as a response source need not answer alike twice.
    """
    state = cut_lineage(items(qa).withColumn("rounds", F.lit(0)))
    for r in range(1, rounds + 1):
        broken = verify(state).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))
        prompts = state.join(broken, "qid").select("qid", F.concat(F.lit("Repair ("), F.col("fields"), F.lit("): "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")), F.lit("\nEvidence: "), evidence_text()).alias("prompt"))
        answers = respond(prompts).where("text is not null and text != ''").select("qid", "text")
        state = cut_lineage(state.join(answers, "qid", "left").withColumn("rounds", F.when(F.col("text").isNotNull(), r).otherwise(F.col("rounds"))).withColumn("answer", F.coalesce("text", "answer")).drop("text"))
    final = summary(state).select("qid", "passed")
    return state.join(final, "qid").select("qid", "answer", "rounds", F.when(F.col("passed"), "final").otherwise("human_review").alias("pool"))


# ---- samples for training --------------------------------------------------------------------------------------


def corpus_samples(qa: DataFrame) -> DataFrame:
    """(qid, kind, instruction, input, output, trace, contexts): every item as an instruction, a reasoning trace and a retrieval sample; items kept as refusals as refusal samples."""
    rows = items(qa).withColumn("refused", F.coalesce(R.text("answer").isin(R.KEPT_REFUSALS), F.lit(False))).withColumn("evidence", R.evidence_lines("evidence_spans"))
    contexts = F.coalesce(F.transform("evidence_spans", lambda e: F.coalesce(e["content"], F.lit(""))), F.array().cast("array<string>"))
    trace = F.coalesce(F.array_join("evidence_path", " -> "), F.lit(""))
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    sample = lambda kind, text, output, way, parts: F.struct(F.lit(kind).alias("kind"), text.alias("input"), output.alias("output"), way.alias("trace"), parts.alias("contexts"))
    answer = F.coalesce("answer", F.lit(""))
    kept = F.array(sample("evidence_grounded_instruction", F.col("evidence"), answer, none, empty), sample("graph_reasoning_trace", none, answer, trace, empty), sample("rag_grounding", none, answer, none, contexts))
    declined = F.array(sample("refusal", F.col("evidence"), F.when(answer == "", F.lit(R.KEPT_REFUSALS[0])).otherwise(answer), none, empty))
    each = rows.select("qid", F.col("question").alias("instruction"), F.explode(F.when(F.col("refused"), declined).otherwise(kept)).alias("s"))
    return each.select("qid", "s.kind", "instruction", "s.input", "s.output", "s.trace", "s.contexts")


def verifier_samples(qa: DataFrame, corrupted: DataFrame) -> DataFrame:
    """(qid, answer, label, error_type): items as good samples and their corruptions as bad ones."""
    good = items(qa).where(~F.coalesce("is_corrupted", F.lit(False))).select("qid", F.coalesce("answer", F.lit("")).alias("answer"), F.lit("good").alias("label"), F.lit(None).cast("string").alias("error_type"))
    return good.unionByName(corrupted.select("qid", "answer", F.lit("bad").alias("label"), "error_type"))
