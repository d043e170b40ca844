"""Metrics of corpora, plans and answers. Empty inputs give nulls or zeros as stated, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators import qa as Q

TYPES = 8


def blocks_by_modality(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("modality").agg(F.countDistinct("block_id").alias("blocks"))


def qa_stats(qa: DataFrame) -> DataFrame:
    """(kind, name, n): items by question type and by difficulty, in one pass."""
    rows = Q.items(qa).select(F.explode(F.array(F.struct(F.lit("question_type").alias("kind"), F.col("question_type").alias("name")), F.struct(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("name")))).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def type_coverage(qa: DataFrame) -> DataFrame:
    return Q.items(qa).agg(F.countDistinct("question_type").alias("types")).select("types", (F.col("types") / TYPES).alias("coverage"))


def structural_validity(qa: DataFrame) -> DataFrame:
    rows = Q.items(qa)
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return rows.agg(F.count("*").alias("items"), share(F.length(F.trim("question")) >= 6).alias("has_question"), share(F.length(F.trim("answer")) > 0).alias("has_answer"), share(F.size("evidence_spans") > 0).alias("has_evidence"), share(F.size("source_nodes") > 0).alias("has_nodes"))


def violation_density(qa: DataFrame) -> DataFrame:
    """(items, violations, density, passed): violations per item and the share of items without any."""
    s = Q.summary(qa)
    return s.agg(F.count("*").alias("items"), F.sum("violations").alias("violations"), F.avg("violations").alias("density"), F.avg(F.col("passed").cast("double")).alias("passed"))


def violations_by(qa: DataFrame) -> DataFrame:
    return Q.verify(qa).groupBy("layer", "field", "severity").agg(F.count("*").alias("n"))


def grounding(qa: DataFrame) -> DataFrame:
    rows = Q.items(qa)
    return rows.agg(F.avg(F.greatest(F.lit(0), F.coalesce(F.size("evidence_spans"), F.lit(0)))).alias("avg_spans"), F.sum((F.size(F.array_distinct("paper_id_list")) > 1).cast("bigint")).alias("cross_paper"))


def multi_hop_authenticity(qa: DataFrame) -> DataFrame:
    """(difficulty, items, multi_chunk): how many items rest on evidence of at least two chunks."""
    rows = Q.items(qa).select("difficulty", F.size(F.array_distinct(F.filter(F.transform("evidence_spans", lambda s: s["address"]["chunk_id"]), lambda c: c.isNotNull()))).alias("chunks"))
    return rows.groupBy("difficulty").agg(F.count("*").alias("items"), F.coalesce(F.sum((F.col("chunks") >= 2).cast("bigint")), F.lit(0)).alias("multi_chunk"))


def plan_quality(qa: DataFrame) -> DataFrame:
    """(question_type, items, median, least and most path length)."""
    rows = Q.items(qa).select("question_type", F.coalesce(F.size("evidence_path"), F.lit(0)).alias("length"))
    return rows.groupBy("question_type").agg(F.count("*").alias("items"), F.percentile("length", 0.5).alias("median"), F.min("length").alias("least"), F.max("length").alias("most"))


def delays(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n, total, average, least, most) of the hours between making and arrival."""
    hours = (F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3_600_000_000
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum(hours).alias("total"), F.avg(hours).alias("average"), F.min(hours).alias("least"), F.max(hours).alias("most"))


def average_rank(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return rows.withColumn(out, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): null for fewer than three rows or without variance."""
    ranked = average_rank(average_rank(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "__x"), by, y, "__y")
    rho = F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, rho).alias("rho"))


def monotonic(rows: DataFrame, level: str, value: str) -> DataFrame:
    """(level, accuracy, falls): whether the value does not rise from one level to the next."""
    means = rows.groupBy(level).agg(F.avg(value).alias("accuracy"))
    w = Window.orderBy(level)  # one row per level
    return means.select(level, "accuracy", F.coalesce(F.col("accuracy") <= F.lag("accuracy").over(w), F.lit(True)).alias("falls"))


def judge_means(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means of scores between 1 and 5; others are ignored."""
    return rows.groupBy(by).agg(*[F.avg(F.when(F.col(c).between(1, 5), F.col(c))).alias(c) for c in columns])


def _list(key: str) -> Column:
    return F.coalesce(F.try_element_at("constraints", F.lit(key)), F.array().cast("array<string>"))


def probe_items(qa: DataFrame, subset: str = "all", limit: int | None = None) -> DataFrame:
    """Items that can be probed: answered, with evidence; "multi" asks for a comparison or two hard constraints, "numeric" for one."""
    rows = Q.items(qa).where(~R.refusal("answer") & (F.coalesce(F.size("evidence_spans"), F.lit(0)) > 0))
    hard = F.size(_list("number")) + F.size(_list("unit"))
    rows = rows.where({"multi": (F.col("question_type") == "comparative") | (hard >= 2), "numeric": hard >= 1, "all": F.lit(True)}[subset])
    return rows if limit is None else rows.orderBy("qid").limit(limit)


def fidelity(qa: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(qid, cf_hard, cf_unit, cf_all, n_hard, violation): how far answers keep the constraints of their items.

    ``answers`` (qid, said) are the answers to be judged, else each item's own. Numbers are looked for with ranges, units are those of the
    item's own answer, conditions count by a word of theirs. A part without elements is null."""
    rows = Q.items(qa).withColumn("gold", F.coalesce("answer", F.lit("")))
    rows = rows.join(answers.select("qid", "said"), "qid") if answers is not None else rows.withColumn("said", F.col("gold"))
    rows = rows.withColumn("said", F.coalesce("said", F.lit("")))
    rows = rows.select("qid", "said", _list("number").alias("nums"), _list("condition").alias("conds"), F.filter(F.transform(R.value_units("gold"), lambda x: x["unit"]), lambda u: u != "").alias("units"), R.numbers("said").alias("numbers"), R.units("said").alias("said_units"))
    words = lambda c: F.filter(F.split(F.regexp_replace(c, "[^0-9a-zA-Z一-鿿]+", " "), " "), lambda k: F.length(k) > 1)
    kept = {
        "nums": F.transform("nums", lambda g: R.reproduced(g, F.col("numbers"))),
        "units": F.transform("units", lambda u: F.exists("said_units", lambda k: R.compatible(u, k)) | F.contains(F.col("said"), u)),
        "conds": F.transform("conds", lambda c: F.exists(words(c), lambda k: F.contains(F.col("said"), k))),
    }
    for name, flags in kept.items():
        rows = rows.withColumn(f"f_{name}", flags)
    share = lambda flags: F.when(F.size(flags) > 0, F.size(F.filter(flags, lambda x: x)) / F.size(flags))
    rows = rows.withColumns({"cf_hard": share(F.col("f_nums")), "cf_unit": share(F.col("f_units")), "cf_all": share(F.concat("f_nums", "f_units", "f_conds"))})
    return rows.select("qid", "cf_hard", "cf_unit", "cf_all", F.size("nums").alias("n_hard"), F.coalesce(F.col("cf_hard") < 1, F.lit(False)).alias("violation"))


def number_recall(qa: DataFrame) -> DataFrame:
    """(qid, asked, kept, recall): constraint numbers and ranges that the item's own answer reproduces."""
    rows = Q.items(qa).select("qid", _list("number").alias("wanted"), R.numbers("answer").alias("said")).where(F.size("wanted") > 0)
    kept = F.size(F.filter("wanted", lambda w: R.reproduced(w, F.col("said"))))
    return rows.select("qid", F.size("wanted").alias("asked"), kept.alias("kept"), (kept / F.size("wanted")).alias("recall"))


def fidelity_by_model(cells: DataFrame) -> DataFrame:
    """(model, n, means, violation_rate, false_accept_rate) of (model, cf_hard, cf_unit, cf_all, violation, judge_overall, judge_faithfulness): a violation that the judge gives 4 or more is falsely accepted."""
    mean = lambda c: F.round(F.avg(c), 3).alias(f"{c}_mean")
    bad = F.col("violation")
    accepted = bad & (F.coalesce("judge_faithfulness", F.lit(0.0)) >= 4)
    return cells.groupBy("model").agg(F.count("*").alias("n"), mean("cf_hard"), mean("cf_unit"), mean("cf_all"), mean("judge_overall"), F.round(F.avg(bad.cast("double")), 3).alias("violation_rate"), F.round(F.try_divide(F.count_if(accepted), F.count_if(bad)), 3).alias("false_accept_rate"))


def verdict(tests: DataFrame) -> DataFrame:
    """Adds ``signals`` and ``go`` to (t1, t2, t3): a weak link of judge and fidelity, of rank and fidelity, a strong one of rank and false acceptance."""
    hits = F.array(F.when(F.col("t1") <= 0.2, "T1"), F.when(F.col("t2") <= 0.5, "T2"), F.when(F.col("t3") >= 0.3, "T3"))
    return tests.withColumn("signals", F.array_compact(hits)).withColumn("go", F.size("signals") >= 1)


def composition(samples: DataFrame) -> DataFrame:
    """(kind, name, n) of (label, error_type): how many samples have each label and each error."""
    rows = samples.select(F.explode(F.array(F.struct(F.lit("label").alias("kind"), F.coalesce("label", F.lit("")).alias("name")), F.struct(F.lit("error_type").alias("kind"), F.nullif("error_type", F.lit("")).alias("name")))).alias("x")).select("x.*")
    return rows.where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))


def repair_effect(runs: DataFrame) -> DataFrame:
    """(attempts, success_rate, avg_rounds) of (success, steps)."""
    return runs.agg(F.count("*").alias("attempts"), F.round(F.avg(F.coalesce("success", F.lit(False)).cast("double")), 3).alias("success_rate"), F.round(F.avg(F.greatest(F.lit(0), F.coalesce(F.size("steps"), F.lit(0)))), 2).alias("avg_rounds"))


def external(qa: DataFrame) -> DataFrame:
    """(metric, value): the eight figures by which two runs are compared."""
    s, v, g, c = structural_validity(qa), violation_density(qa), grounding(qa), type_coverage(qa)
    one = s.select(F.col("items").cast("double").alias("n_qa"), F.least("has_question", "has_answer").alias("valid_qa_rate"))
    row = {**one.first().asDict(), **{"verify_pass_rate": (x := v.first())["passed"], "violation_density": x["density"]}, **{"avg_evidence_spans": (y := g.first())["avg_spans"], "cross_paper_qa": y["cross_paper"]}, **{"type_coverage": (z := c.first())["coverage"], "n_types": z["types"]}}
    return qa.sparkSession.createDataFrame([(k, None if x is None else round(float(x), 3)) for k, x in row.items()], "metric string, value double")  # eight figures of whole tables


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two (metric, value) tables; a missing side gives a null delta."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full_outer").select("metric", "before", "after", F.round(F.col("after") - F.col("before"), 3).alias("delta"))


def plan_coverage(plans: DataFrame) -> DataFrame:
    """(plans, types, type_coverage, avg_spans, avg_nodes) of (question_type, evidence_spans, required_nodes)."""
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    return plans.agg(F.count("*").alias("plans"), F.countDistinct("question_type").alias("types"), F.round(F.countDistinct("question_type") / TYPES, 3).alias("type_coverage"), F.round(F.avg(size("evidence_spans")), 3).alias("avg_spans"), F.round(F.avg(size("required_nodes")), 3).alias("avg_nodes"))


def completeness(plans: DataFrame, breakdown: list[str]) -> DataFrame:
    """(metric, average) over plans with (question_type, roles map, utility, parts): how many least roles are filled, the utility and its parts."""
    from lodegraph.operators.planner import ABSTRACT_ROLES, MIN_ROLE_SETS

    least = F.create_map(*[x for kind, wanted in MIN_ROLE_SETS.items() for x in (F.lit(kind), F.array(*[F.lit(r) for r in wanted if r not in ABSTRACT_ROLES]))])
    wanted = F.coalesce(F.try_element_at(least, F.col("question_type")), F.array(F.lit("concept")))
    filled = F.filter(wanted, lambda r: F.coalesce(F.try_element_at("roles", r), F.lit("")) != "")
    rows = plans.withColumn("role_completeness", F.size(filled) / F.size(wanted))
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("role_completeness", "utility", *breakdown)])
    return rows.select(F.explode(each).alias("x")).select("x.*").groupBy("metric").agg(F.round(F.avg("value"), 3).alias("average"))


def binding_correctness(plans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, ok, n, rate) of (plan_id, question_type, roles map): values that belong to their objects, results of two papers, real instances, values with their own unit. The plans are few: their nodes are sent to every task."""
    from lodegraph.operators import binding
    from lodegraph.operators.graph import gate, surroundings

    named = plans.select(F.explode(F.map_values("roles")).alias("node_id")).where("node_id != ''").distinct()
    nodes, edges = surroundings(nodes.select("node_id", "node_type", "content", "normalized_content", "address"), edges, named)
    role = lambda r: F.nullif(F.coalesce(F.try_element_at("roles", F.lit(r)), F.lit("")), F.lit(""))
    pairs = plans.where("question_type = 'comparative'").select("plan_id", F.explode(F.array(*[F.struct(role(f"object_{x}").alias("object"), role(f"value_{x}").alias("value")) for x in "AB"])).alias("p")).select("plan_id", "p.*").where("object is not null and value is not null")
    held = binding.values_via_attribute(nodes, edges).select("object", "value").unionByName(binding.table_rows(nodes, edges).select(F.col("row").alias("object"), F.col("cell").alias("value"))).distinct().withColumn("ok", F.lit(1))
    bound = pairs.join(held, ["object", "value"], "left").select(F.lit("comparative_value_object_bind").alias("metric"), F.coalesce("ok", F.lit(0)).alias("ok"))
    n = gate(nodes).select("node_id", "node_type", "ok", F.coalesce("address.paper_id", F.lit("")).alias("paper"))
    cross = plans.where("question_type = 'cross_paper'").select(role("result_A").alias("a"), role("result_B").alias("b"), role("paper_B_instance").alias("instance"))
    a, b = (n.select(F.col("node_id").alias(x), F.col("paper").alias(f"p{x}")) for x in "ab")
    results = cross.where("a is not null and b is not null").join(a, "a", "left").join(b, "b", "left").select(F.lit("cross_paper_result_cross").alias("metric"), ((F.coalesce("pa", F.lit("")) != "") & (F.coalesce("pa", F.lit("")) != F.coalesce("pb", F.lit("")))).cast("int").alias("ok"))
    real = cross.where("instance is not null").join(n.select(F.col("node_id").alias("instance"), "node_type", F.col("ok").alias("good")), "instance", "left").select(F.lit("cross_paper_instance_real").alias("metric"), F.coalesce(F.col("node_type").isin("ConceptNode", "MethodNode", "ValueNode") & F.col("good"), F.lit(False)).cast("int").alias("ok"))
    units = plans.where(F.col("question_type").isin("numerical", "formula", "comparative")).select(role("unit").alias("unit"), F.explode(F.array(role("value"), role("value_A"), role("value_B"))).alias("value")).where("unit is not null and value is not null")
    grounded = units.join(binding.value_units(nodes, edges).select("value", "unit_node"), "value", "left").select(F.lit("unit_grounded").alias("metric"), F.coalesce(F.col("unit_node") == F.col("unit"), F.lit(False)).cast("int").alias("ok"))
    rows = bound.unionByName(results).unionByName(real).unionByName(grounded)
    return rows.groupBy("metric").agg(F.sum("ok").alias("ok"), F.count("*").alias("n"), F.round(F.avg("ok"), 3).alias("rate"))


def by_error_type(corrupted: DataFrame) -> DataFrame:
    return corrupted.groupBy("error_type").agg(F.count("*").alias("n"))


def timing_report(calls: DataFrame) -> DataFrame:
    """(model, question_type, n, total, mean, longest) of (model, question_type, seconds), with a row of all types for each model."""
    return calls.rollup("model", "question_type").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("total"), F.round(F.avg("seconds"), 3).alias("mean"), F.round(F.max("seconds"), 3).alias("longest")).where("model is not null")
