"""Graph building, bindings of table rows, unit checks and the metrics of plans, on small inline tables."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import rules as R
from lodegraph.operators import binding, builder, graph, metrics, qa

BLOCK = "block_id string, modality string, content string, caption string, address struct<paper_id:string,section_path:string,chunk_id:string,sentence_id:string,paragraph_id:string,page:int,span:string,bbox:array<double>>, extra struct<sentence_list:array<string>,label:string,parent:string>, address2 string"


def block(key, modality, content, section="Results", chunk=None, caption=None, label=None, parent=None, sentences=None, paper="p"):
    return (key, modality, content, caption, (paper, section, chunk or key, None, None, 1, None, None), (sentences, label, parent), "extra")


def test_structure(spark):
    rows = [block("c1", "text", "x" * 900, "A/B"), block("c1", "text", "x" * 900, "A/B"), block("f1", "figure", "raw", "", caption="A figure", label="1"), block("f1_cap", "caption", "A figure", "", parent="f1"), block("lost_cap", "caption", "Other", "", parent="nowhere"), block("z", "text", None, None, paper=None)]
    papers = spark.createDataFrame([("p", "On rods", "x"), ("p", "On rods", "x"), ("q", None, "x")], "paper_id string, title string, address string")
    nodes, edges = builder.structure(spark.createDataFrame(rows, BLOCK), papers)
    got = {r["node_id"]: (r["node_type"], r["content"]) for r in nodes.collect()}
    assert got == {"p::PAPER": ("PaperNode", "On rods"), "p::TITLE": ("TitleNode", "On rods"), "p::SEC::a": ("SectionNode", "A"), "p::SEC::ab": ("SectionNode", "B"), "p::SEC::root": ("SectionNode", "ROOT"), "c1": ("ChunkNode", "x" * 500), "f1": ("FigureNode", "A figure"), "f1_cap": ("CaptionNode", "A figure"), "lost_cap": ("CaptionNode", "Other")}
    assert {(r["source"], r["target"], r["edge_type"]) for r in edges.collect()} == {("p::PAPER", "p::TITLE", "contains"), ("p::PAPER", "p::SEC::a", "contains"), ("p::SEC::a", "p::SEC::ab", "contains"), ("p::PAPER", "p::SEC::root", "contains"), ("p::SEC::ab", "c1", "contains"), ("p::SEC::root", "f1", "contains"), ("f1", "f1_cap", "describes")}


TABLE = "<table><tr><th>Sample</th><th>Load (kN)</th><th>Value</th><th>Colour</th></tr><tr><td>rod A</td><td>5.1</td><td>7</td><td>dark red</td></tr><tr><td>rod B</td><td>6.4</td><td></td><td>pale grey</td></tr></table>"


@pytest.fixture(scope="module")
def table(spark):
    nodes, edges = builder.table_graph(spark.createDataFrame([block("t", "table", TABLE), block("t", "table", TABLE), block("u", "table", None), block("v", "table", "<b>no table</b>")], BLOCK))
    nodes = nodes.withColumns({"node_ord": F.xxhash64("node_id"), "ingested_at": F.lit(None).cast("timestamp")})
    edges = edges.withColumns({"edge_ord": F.coalesce(F.regexp_extract("target", r"c(\d+)$", 1).try_cast("bigint"), F.lit(0)), "ingested_at": F.lit(None).cast("timestamp")})
    return nodes.cache(), edges.cache()


def test_table_graph(table):
    nodes, edges = table
    got = {r["node_id"]: (r["node_type"], r["content"], r["address"]["span"]) for r in nodes.collect()}
    assert got == {
        "t::col1": ("AttributeNode", "Load (kN)", "r0c1"), "t::col1::unit": ("UnitNode", "kN", "r0c1"), "t::col3": ("AttributeNode", "Colour", "r0c3"), "t::row1": ("ConceptNode", "rod A", "r1c0"), "t::row2": ("ConceptNode", "rod B", "r2c0"),
        "t::r1c1": ("ValueNode", "5.1", "r1c1"), "t::r2c1": ("ValueNode", "6.4", "r2c1"), "t::r1c2": ("ValueNode", "7", "r1c2"), "t::r1c3": ("ConceptNode", "dark red", "r1c3"), "t::r2c3": ("ConceptNode", "pale grey", "r2c3"),
    }
    kinds = {(r["source"], r["target"]): (r["edge_type"], r["cooccur_scope"], r["confidence"]) for r in edges.collect() if r["edge_type"] != "contains"}
    assert kinds["t::col1", "t::r1c1"] == ("has_value", "same_table_column", 0.9) and kinds["t::r1c1", "t::col1::unit"][0] == "has_unit"
    assert kinds["t::r1c3", "t::col3"][0] == "has_attribute" and ("t::row1", "t::r1c2") in kinds
    assert "t::col1::unit" not in {r["target"] for r in edges.collect() if r["edge_type"] == "contains"}


def test_rows_and_their_shared_metric(spark, table):
    rows = {(r["row"], r["column"]): r["cell"] for r in binding.table_rows(*table).collect()}
    assert rows["t::row1", "t::col1"] == "t::r1c1" and rows["t::row2", "t::col1"] == "t::r2c1"
    pairs = spark.createDataFrame([("t::row1", "t::row2"), ("t::row1", "nobody")], "a string, b string")
    assert [tuple(r) for r in binding.row_metrics(pairs, *table).collect()] == [("t::row1", "t::row2", "t::col1", "t::r1c1", "t::r2c1")]
    own = {r["node_id"]: r["row"] for r in binding.owning_rows(*table).collect()}
    assert own["t::row1"] == "t::row1" and own["t::col1"] == "t::col1"


TUPLES = '("point"<|>rod B<|>Concept<|>rod B)##("point"<|>strength<|>Attribute<|>strength)##("point"<|>30<|>Value<|>30 MPa)##("point"<|>no<|>Attribute<|>no)##("point"<|>x<|>Nonsense<|>x)'


@pytest.mark.parametrize("text,relation,want", [
    ("As against rod A, rod B never shows a strength of 30 MPa.", "", set()),
    ("In this run rod B shows a strength of 30 MPa.", "", {("c::p1", "c::p2", "has_value", "positive", 0.4), ("c::p0", "c::p1", "has_attribute", "positive", 0.4)}),
    ("As against rod A, rod B never shows a strength of 30 MPa.", '##("relation"<|>strength<|>30<|>misses)', {("c::p1", "c::p2", "has_value", "negative", 0.25)}),
])
def test_cooccurrence(spark, text, relation, want):
    targets = builder.extraction_targets(spark.createDataFrame([block("b", "text", text, chunk="c", sentences=[text])], BLOCK))
    answers = spark.createDataFrame([("b", TUPLES + relation)], "block_id string, text string")
    nodes, contains, relations = builder.extracted_points(targets, answers)
    assert {(r["node_id"], r["node_type"]) for r in nodes.collect()} == {("c::p0", "ConceptNode"), ("c::p1", "AttributeNode"), ("c::p2", "ValueNode")}
    assert contains.count() == 3
    got = {(r["source"], r["target"], r["edge_type"], r["polarity"], r["confidence"]) for r in builder.cooccurrence(targets, nodes, relations).collect()}
    assert {g for g in got if g[2] in ("has_value", "has_attribute")} >= want and (want or not any(g[2] == "has_value" for g in got))


def test_empty_blocks(spark):
    none = spark.createDataFrame([], BLOCK)
    papers = spark.createDataFrame([], "paper_id string, title string")
    assert builder.structure(none, papers)[0].isEmpty() and builder.table_graph(none)[1].isEmpty() and builder.extraction_targets(none).isEmpty()


def test_backing_paths_pass_hubs(spark):
    """A hub of 2,500 neighbours, ten times what a bounded search kept, loses no path."""
    names = ["s", "m", "t"] + [f"h{i:04}" for i in range(2500)]
    n = spark.createDataFrame([(x, "ConceptNode", x, None, i) for i, x in enumerate(names)], "node_id string, node_type string, content string, ingested_at timestamp, node_ord bigint")
    e = spark.createDataFrame([("s", h, i) for i, h in enumerate(names[3:])] + [(names[-1], "m", 9000), ("m", "t", 9001)], "source string, target string, edge_ord bigint").withColumns({"edge_type": F.lit("contains"), "polarity": F.lit("positive"), "confidence": F.lit(1.0), "ingested_at": F.lit(None).cast("timestamp")})
    rows = graph.backing_paths(spark.createDataFrame([("s", "t")], "source string, target string"), n, e).collect()
    assert [r["path"] for r in rows] == [["s", names[-1], "m", "t"]]


@pytest.mark.parametrize("a,b,fits", [("MPa", "kPa", True), ("°C", "K", True), ("%", "wt.%", True), ("mm", "kg", False), ("", "", True), ("", "K", False), ("foo", "foo", True), ("foo", "bar", False), (None, None, True)])
def test_compatible_units(spark, a, b, fits):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(R.compatible("a", "b")).first()[0] is fits


@pytest.mark.parametrize("gold,said,hit", [("1.31~ 1.46", ["1.4"], True), ("1.31~1.46", ["1.2"], False), ("2.8-3.4", ["2.75"], True), ("5", ["5.05"], True), ("5", ["6"], False), ("5", [], False)])
def test_reproduced_numbers(spark, gold, said, hit):
    df = spark.createDataFrame([(gold, said)], "g string, s array<string>")
    assert df.select(R.reproduced(F.col("g"), F.col("s"))).first()[0] is hit


QA = "qid string, question string, answer string, question_type string, difficulty string, evidence_spans array<struct<node_id:string,content:string,address:struct<paper_id:string,section_path:string,chunk_id:string>>>, evidence_path array<string>, source_nodes array<string>, constraints map<string,array<string>>, is_corrupted boolean, paper_id_list array<string>, ingested_at timestamp"


def item(qid, answer, constraints=None, spans="It carries 500000 kPa.", kind="numerical"):
    return (qid, "How much does the rod carry?", answer, kind, "L2", [("n", spans, ("p", "s", "c"))] if spans else None, ["a", "b"], ["n"], constraints, False, ["p"], None)


def test_units_of_one_dimension_agree(spark):
    df = spark.createDataFrame([item("a", "It carries 500 MPa."), item("b", "It carries 5 mm.")], QA)
    assert {r["qid"] for r in qa.check_unit(df).collect()} == {"b"}


def test_names_of_several_words_are_swapped(spark):
    df = spark.createDataFrame([item("a", "The old copper rod, as seen, breaks."), item("b", "Nothing here."), item("c", None)], QA)
    pool = spark.createDataFrame([(x,) for x in ("old copper rod", "copper", "tin plate") for _ in range(2)] + [(f"name {i}",) for i in range(600)] + [(None,)], "content string")
    (r,) = qa.swap_entities(df, pool).collect()
    assert r["qid"] == "a" and r["swapped"].startswith("The ") and "old copper rod" not in r["swapped"] and r["swapped"].endswith(", as seen, breaks.")
    kinds = qa.corrupt(df, pool, per_item=2).groupBy("source_qid").count().collect()
    assert all(k["count"] <= 2 for k in kinds)


def test_fidelity_and_verdict(spark):
    df = spark.createDataFrame([item("a", "It carries 5 MPa in argon.", {"number": ["5", "7~9"], "condition": ["in argon"]}), item("b", "x", None)], QA)
    said = spark.createDataFrame([("a", "5.05 kPa, 8 mm in argon"), ("b", None)], "qid string, said string")
    got = {r["qid"]: tuple(r)[1:] for r in metrics.fidelity(df, said).collect()}
    assert got["a"] == (1.0, 1.0, 1.0, 2, False) and got["b"] == (None, None, None, 0, False)
    tests = spark.createDataFrame([(0.1, 0.9, 0.5), (None, None, None), (0.9, 0.9, 0.1)], "t1 double, t2 double, t3 double")
    assert [(r["signals"], r["go"]) for r in metrics.verdict(tests).collect()] == [(["T1", "T3"], True), ([], False), ([], False)]


def test_probe_subsets(spark):
    df = spark.createDataFrame([item("a", "5", {"number": ["5"], "unit": ["MPa"]}), item("b", "5", None, kind="comparative"), item("c", "无法确定", None), item("d", "5", None, spans=None), item("e", "5", {"number": ["5"]})], QA)
    ids = lambda subset: {r["qid"] for r in metrics.probe_items(df, subset).collect()}
    assert ids("all") == {"a", "b", "e"} and ids("numeric") == {"a", "e"} and ids("multi") == {"a", "b"}


def test_comparisons_of_runs(spark):
    df = spark.createDataFrame([item("a", "5 MPa"), item("b", "")], QA)
    rows = {r["metric"]: r for r in metrics.before_after(metrics.external(df), metrics.external(df.where("qid = 'a'"))).collect()}
    assert rows["n_qa"]["delta"] == -1 and rows["valid_qa_rate"]["before"] == 0.5 and len(rows) == 8
    assert metrics.repair_effect(spark.createDataFrame([(True, ["x", "y"]), (False, None)], "success boolean, steps array<string>")).first() == (2, 0.5, 1.0)
    parts = {(r["kind"], r["name"]): r["n"] for r in metrics.composition(spark.createDataFrame([("good", None), ("bad", "wrong_number")], "label string, error_type string")).collect()}
    assert parts == {("label", "good"): 1, ("label", "bad"): 1, ("error_type", "wrong_number"): 1}


def test_samples(spark):
    df = spark.createDataFrame([item("a", "5 MPa"), item("b", "文中无法确定")], QA)
    got = {(r["qid"], r["kind"]): r for r in qa.corpus_samples(df).collect()}
    assert set(got) == {("a", "evidence_grounded_instruction"), ("a", "graph_reasoning_trace"), ("a", "rag_grounding"), ("b", "refusal")}
    assert got["a", "graph_reasoning_trace"]["trace"] == "a -> b" and got["a", "rag_grounding"]["contexts"] == ["It carries 500000 kPa."] and got["b", "refusal"]["input"] == "[n] (p/s/c) It carries 500000 kPa."


def test_documents_and_reports(spark, tmp_path):
    from lodegraph.functions import prompts
    from lodegraph.sources import documents, files, reports

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in (("a.pdf", b"TITLE OF IT|some text"), ("deep/b.pdf", b"broken"), ("deep/c.pdf", b"worse"), ("d.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(content)
    docs = documents.scan_documents(spark, str(tmp_path / "in"))
    assert [r["title"] for r in docs.collect()] == ["a", "b", "c"]

    def primary(content):
        if b"|" not in content:
            raise ValueError("no layout")
        return [{"type": "text", "text": t} for t in content.decode().split("|")]

    def fallback(content):
        return [{"type": "text", "text": {b"broken": "A TITLE"}[content]}]

    items, status = documents.orchestrated(files.read_files(spark, str(tmp_path / "in")), primary, fallback)
    assert sorted((r["text"], r["text_level"]) for r in items.collect()) == [("A TITLE", 1), ("TITLE OF IT", None), ("some text", None)]
    assert sorted(r["parsing_status"] for r in status.collect()) == ["failed", "low_quality", "parsed"]
    assert documents.scan_parsed(spark, str(tmp_path / "none"), "paper string").isEmpty() and not documents.parser_available("no-such-parser")
    df = spark.createDataFrame([("m", 0.5), ("n|o", None)], "metric string, value double")
    reports.write_report("Run", {"Figures": df}, str(tmp_path / "out" / "r.md"))
    assert "| n\\|o | - |" in (tmp_path / "out" / "r.md").read_text() and (tmp_path / "out" / "r.json").exists()
    assert files.write_jsonl(df, str(tmp_path / "rows")) == 2
    pools = spark.createDataFrame([("a", "benchmark"), ("b", "human_review")], "qid string, pool string")
    got = reports.export_run(pools, pools.select("qid"), df, df.limit(1), str(tmp_path / "run"))
    assert got == {"pools": {"benchmark": 1, "human_review": 1}, "graph": {"nodes": 2, "edges": 1}}
    row = df.select(prompts.render("{{x}} {m} is {v}.", {"m": F.col("metric"), "v": F.col("value")}).alias("p"), prompts.instruction(F.lit("nope")).alias("i")).first()
    assert row["p"] == "{x} m is 0.5." and row["i"] == prompts.INSTRUCTIONS["atomic"]
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "c"), (2, 0, "user", "x"), (2, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    assert [[m["text"] for m in r["messages"]] for r in prompts.messages(turns).collect()] == [["a", "b", "c"]]
