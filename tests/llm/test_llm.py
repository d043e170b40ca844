"""Operators for training text, each against brute force, a round trip or hand-made cases."""

import random

import numpy as np
import pytest

from lodegraph.llm import answers, cutoffs, encoding, endings, leaks, lookalikes, markup, neardup, pieces, scans


# ---- 1: answers ------------------------------------------------------------------------------------------------

LONG = "How large is the yield stress of specimen T-pt2y23 when it is held at 1231 K under humid air?"


@pytest.mark.parametrize("answer", [None, "", " ", "​", "Answer:", "答案：", "N/A", "null", "—", "...", "[]", "\t \n", "None", "🙂"])
def test_empty(answer):
    assert answers.is_empty(answer)


@pytest.mark.parametrize("answer", ["0", "5 mm", "7.20THz", "无色", "no change at 5 K"])
def test_not_empty(answer):
    assert not answers.is_empty(answer)


@pytest.mark.parametrize("answer,want", [("Cannot be determined from the text", True), ("文中无法确定。", True), ("I'm sorry, but I can't answer questions about X.", True), ("insufficient evidence", True), ("Leider kann ich diese Frage nicht beantworten.", True), ("Below 1499 cycles it could not be determined by double notch tearing, since the sensor saturated at 45.0 mil.", False), ("It reaches 5 MPa.", False), ("", False), (None, False)])
def test_refusals(answer, want):
    assert answers.is_refusal(LONG, answer) is want


def test_long_refusals():
    polite = "Thank you for the careful question about this specimen. " * 20
    assert answers.is_refusal(LONG, polite + "I'm sorry, but I can't answer it.")
    assert not answers.is_refusal(LONG, polite + "It could not be determined before, but it reaches 5 MPa.") and not answers.is_refusal(LONG, polite)


@pytest.mark.parametrize("answer,want", [(LONG, True), ("Question: " + LONG, True), (LONG.upper().replace(" ", "  "), True), (f"{LONG} {LONG}", True), (LONG[:-1], True), (LONG + " It reaches 85.76 GPa because the porous binder traps of another lot lie along the boundary.", False), ("85.76 GPa", False), (None, False)])
def test_copies(answer, want):
    assert answers.is_copy(LONG, answer) is want


@pytest.mark.parametrize("answer,want", [("Die Messung zeigt, dass die Schüttdichte mit 5 g über dem Sollwert liegt.", True), ("在硅油与480K下，编号X的壁厚稳定在5 mm。", True), ("320 华氏度", False), ("85.76 GPa", False), ("The yield stress of the specimen is 5 MPa at 5 K.", False)])
def test_languages(answer, want):
    assert answers.is_foreign(LONG, answer) is want


def test_defects_are_whole_and_once(spark):
    sound = [(f"s{i}", LONG, f"The yield stress of sample {i} reaches {i} MPa at 300 K under steam, because the phase blocks motion near the seam.") for i in range(60)]
    bad = [("t1", LONG, "The yield stress of sample 7 reaches 7 MPa at 300 K under steam, because the phase blocks motion near"), ("t2", LONG, "The yield stress of sample 7 reaches…"), ("e", LONG, None), ("n", None, "5 MPa"), ("ok", LONG, "The yield stress of sample 9 reaches 9 MPa at 300 K under steam, because the phase blocks motion near the seam"), ("v", LONG, "57.54 volt"), ("e", LONG, None)]
    df = spark.createDataFrame([(*r, None) for r in sound + bad], "qid string, question string, answer string, evidence_spans array<struct<content:string>>")
    assert {tuple(r) for r in answers.found_defects(df).collect()} == {("t1", "truncated_answer"), ("t2", "truncated_answer"), ("e", "empty_answer")}
    assert answers.found_defects(df.limit(0)).count() == 0


def test_evidence_shows_an_early_stop():
    assert answers.stops_early("The band gap of X is 5 eV at 300 K", ["The band gap of X is 5 eV at 300 K under steam."]) is True
    assert answers.stops_early("The band gap of X is 5 eV at 300 K", ["The band gap of X is 5 eV at 300 K."]) is False
    assert answers.stops_early("Another sentence here", ["The band gap."]) is None


@pytest.mark.parametrize("answer,refuses", [
    ("I cannot help, as Table 3 gives only 2 values.", True),
    ("I cannot answer that. " + "The request is noted and will be kept. " * 300, True),
    ("The load could not be determined by creep runs, since the cell froze at 41.", False),
    ("The load could not be determined from the text.", True),
    ("It is not stated for rod A; rod B carries 512 MPa.", False),
])
def test_refusals_of_any_length_and_with_numbers(answer, refuses):
    assert answers.is_refusal("Which load does the rod carry?", answer) is refuses


@pytest.mark.parametrize("answer", ["Legeringen sprack efter glödgning och tappade sin styrka.", "Stop pękł podczas wyżarzania i stracił swoją twardość.", "Alaşım tavlama sırasında çatladı ve sertliğini yitirdi.", "La aleación se agrietó durante el recocido y perdió dureza."])
def test_languages_beyond_the_planted_ones(answer):
    assert answers.is_foreign("Why did the alloy crack during the anneal?", answer, "The alloy cracked during the anneal.")


def test_a_sound_short_answer_is_not_foreign():
    assert not answers.is_foreign("Why did the alloy crack during the anneal?", "Trapped hydrogen gas", "The alloy cracked.")
    assert not answers.is_foreign("Which phase is found at the seam of the alloy?", "brittle columnar laves phase platelets", "Brittle columnar laves phase platelets formed.")


def test_an_open_bracket_before_a_full_stop_is_a_truncation():
    assert answers.features("Why?", "It cracked (see the second run.", [])[1] == "yes"
    assert answers.features("Why?", "It cracked (see the second run).", [])[1] == "no"


def test_a_copied_prefix_is_a_copy():
    q = "Why does the seam of the alloy crack when it is annealed in argon?"
    assert answers.is_copy(q, q[: int(len(q) * 0.9)]) and not answers.is_copy(q, "The seam of the alloy cracks as hydrogen gathers there when it is annealed in argon.")


# ---- 2: near duplicates ----------------------------------------------------------------------------------------


def brute(rows, t=0.7):
    sets = {q: set(neardup.gram_set(neardup.tokens(x, y)).tolist()) for q, x, y in rows}
    ids = sorted(q for q in sets if sets[q])
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) * 1000 >= len(sets[a] | sets[b]) * round(t * 1000)}


def edited(rng, n):
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 40))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((f"q{i:04}", " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])))
    return rows


ITEMS = "qid string, question string, answer string"


def test_pairs_match_brute_force(spark):
    rows = edited(random.Random(3), 240) + [("x1", None, None), ("x2", "a", ""), ("x3", "一 二 三", None), ("x4", "一二三", "")]
    df = spark.createDataFrame(rows + rows[:20], ITEMS)
    assert {tuple(r) for r in neardup.found_pairs(df).collect()} == brute(rows)


def test_frequent_grams_and_blocks_lose_nothing(spark, monkeypatch):
    rows = edited(random.Random(4), 160)
    monkeypatch.setattr(neardup, "LEAVES", 3)
    classes = neardup._prepared(spark.createDataFrame(rows, ITEMS))[1]
    counts = neardup.gram_counts(classes, 1 << 16)
    found = classes.collect()
    keys = {r["rep"]: {k for k, _ in neardup.prefix_keys(np.array(r["grams"], dtype=np.int64), counts, 2)} for r in found}
    grams = {r["rep"]: set(r["grams"]) for r in found}
    for a in keys:
        for b in keys:
            if a < b and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b]):
                assert keys[a] & keys[b]


def test_trie_walk_matches_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    paths = rng.integers(0, 1 << 63, (90, 2), dtype=np.uint64)
    paths[30:60] = paths[:30] ^ (np.uint64(1) << rng.integers(0, 63, (30, 2), dtype=np.uint64))
    paths[60:70, 0] = paths[0, 0]
    paths[70:74] = paths[0]
    keys = rng.integers(0, 3, 90)
    for budget in (0, 2, 33, 64):
        want = {(i, j) for i in range(90) for j in range(i + 1, 90) if keys[i] == keys[j] and int(np.bitwise_count(paths[i] ^ paths[j]).sum()) <= budget}
        for frontier in (7, 1_000_000):
            monkeypatch.setattr(neardup, "FRONTIER", frontier)
            i, j = neardup.walk(keys, paths, np.full(129, budget))
            assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_walk_drops_pairs_above_the_budget_of_their_depth():
    """Two leaves whose first 32 bits all differ are dropped on the way, however alike the rest is."""
    paths = np.array([[0] * 4, [0xFFFFFFFF << 32, 0, 0, 0], [1, 0, 0, 0]], dtype=np.uint64)
    i, j = neardup.walk(np.zeros(3, dtype=np.int64), paths, neardup.error_budget())
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {(0, 2)}


def test_many_copies_are_a_star_and_different_texts_are_not(spark):
    rows = [(f"c{i:02}", "one two three four", "five six") for i in range(12)] + [("z", "one two three four", "five six seven")]
    rows += [(f"d{i:02}", "one two three four five six " * (i + 2), "") for i in range(8)]  # other texts of one class
    df = spark.createDataFrame(rows, ITEMS)
    copies = {r[0] for r in rows[:12]}
    want = {p for p in brute(rows) if not set(p) <= copies and not set(p) & (copies - {"c00"})} | {("c00", f"c{i:02}") for i in range(1, 12)}
    assert {tuple(r) for r in neardup.found_pairs(df, copies=5).collect()} == want
    assert {tuple(r) for r in neardup.found_pairs(df, copies=None).collect()} == brute(rows)
    groups = {r["qid"]: r["group_id"] for r in neardup.groups(df).collect()}
    assert set(groups.values()) == {"c00"} and len(groups) == 21
    names = {r["qid"]: r["class_id"] for r in neardup.class_members(df).collect()}
    links = {(r["class_a"], r["class_b"]) for r in neardup.class_links(df).collect()}
    ids = sorted(names)
    assert {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if names[a] == names[b] or (min(names[a], names[b]), max(names[a], names[b])) in links} == brute(rows)


def test_no_items(spark):
    assert neardup.found_pairs(spark.createDataFrame([], ITEMS)).count() == 0


# ---- 3: look-alikes --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seen,shown", [("steрwіse cаlorimеtry", "stepwise calorimetry"), ("ｏｐｅｎ　ｃｉｒｃｕｉｔ", "open circuit"), ("soak ti‍me", "soak time"), ("Néndkuine", "Néndkuine"), ("爆破压⼒", "爆破压力"), ("class Ⅵ Nourgteate‑53", "class VI Nourgteate-53"), ("ﬁlled resin", "filled resin"), ("soft­ening", "softening"), ("µ-Frixkraite", "μ-Frixkraite")])
def test_one_form(seen, shown):
    assert lookalikes.one_form(seen) == lookalikes.one_form(shown)


@pytest.mark.parametrize("a,b", [("Keldoon₃", "Keldoon3"), ("Lavtreate³", "Lavtreate3"), ("Jäevhool", "Jaevhool"), ("PCE", "pce"), ("β-resin", "B-resin")])
def test_visible_differences_stay(a, b):
    assert lookalikes.one_form(a) != lookalikes.one_form(b)


def test_terms(spark):
    n = spark.createDataFrame([("a", "сuring temperature", "x"), ("b", "curing temperature", "x"), ("c", "curing  temperature", "x"), ("d", None, "x"), ("e", "", "x"), ("f", "​", "x"), ("a", "сuring temperature", "x"), ("g", "Curing temperature", "x")], "node_id string, content string, form string")
    t = spark.createDataFrame([(1, "curing temperature"), (2, None)], "term_id bigint, term string")
    assert {tuple(r) for r in lookalikes.found_terms(n, t).collect()} == {("a", 1), ("c", 1)}


def test_every_node_has_a_row(spark):
    n = spark.createDataFrame([("a", "T", "Keldoon 3"), ("b", "T", "сuring"), ("c", "T", None), ("d", "T", ""), ("c", "T", None)], "node_id string, node_type string, content string")
    assert {tuple(r) for r in lookalikes.consistent_nodes(n).collect()} == {("a", "Keldoon 3", "T:keldoon_3"), ("b", "curing", "T:curing"), ("c", None, "T:x"), ("d", None, "T:x")}


@pytest.mark.parametrize("seen,form", [
    ("cтaль", "сталь"),  # Latin c and a in a Russian word
    ("хор", "хор"), ("оса", "оса"),  # words of their own script, which Latin letters could write
    ("сору of the text", "copy of the text"),  # the words around it are Latin
    ("сору русского текста", "сору русского текста"),
    ("ΑΒΓ δοκιμή", "ΑΒΓ δοκιμή"), ("Aθήνα", "Αθήνα"),  # Latin A in a Greek word
    ("测得РCE的值", "测得PCE的值"),
])
def test_any_script_is_resolved(spark, seen, form):
    table = lookalikes.Confusables(lookalikes.published(spark))
    assert lookalikes.one_form(seen, table) == form
    assert lookalikes.forms("РСE", table)[1] == lookalikes.forms("РСЕ", table)[1] == "PCE"
    assert lookalikes.forms("Тrаlѕоіԁе", table)[1] == "Tralsoide"  # letters that another script writes in another case


def test_other_rows_decide_a_word_without_context(spark):
    n = spark.createDataFrame([("a", "T", "оса"), ("b", "T", "РСЕ"), ("c", "T", "PCE"), ("d", "T", None), ("d", "T", None)], "node_id string, node_type string, content string")
    assert {(r["node_id"], r["one_form"]) for r in lookalikes.consistent_nodes(n).collect()} == {("a", "оса"), ("b", "PCE"), ("c", "PCE"), ("d", None)}


# ---- 4: scans --------------------------------------------------------------------------------------------------


def vocabulary():
    words = {"the": 900, "temperature": 300, "of": 900, "well": 90, "resolved": 80, "well-resolved": 60, "domain": 90, "glass": 200, "settles": 90, "near": 300, "seam": 200, "point": 80, "at": 800, "boundary": 70, "in": 900, "long-term": 40, "load": 50, "bearing": 50}
    return scans.Vocabulary({**words, "": 1000})


MARKS = ("Soak time of amorphous Gaernmiine-55 glass near the core plane", "Brernez Letters on Solids 15", "Rouskolv, T.; Prylveix, A.")


@pytest.mark.parametrize("text,noise", [("the tempera-\nture of glass", {"line_hyphen"}), ("well-\nresolved glass", set()), ("the tempera-\n\n– 328 –\nture", {"line_hyphen", "page_number"}), ("of K-\nqcc676 glass", set()), ("Zuvk-\nroene glass", {"line_hyphen"}), ("the dornain of g1ass", {"misread_chars"}), ("the domain of glass", set()), ("the seam\nBRERNEZ LETTERS ON SOLIDS 15\nof glass", {"running_header"}), ("the seam\nBrernez Letters on Solids 15        252\nof glass", {"running_header", "page_number"}), ("the seam\n81    Soak time of amorphous Gaernmiine-55 gla\nof glass", {"running_header", "page_number"}), ("the seam\nRouskolv et al. / Brernez Letters on Solids 15\nof glass", {"running_header"}), ("the seam\n[p 10]\nof glass", {"page_number"}), ("the seam\nof glass", set()), ("", set()), (None, set()), ("17", set())])
def test_noise(text, noise):
    assert scans.read_block(text, scans.Marks(*MARKS), vocabulary())[0] == noise


def test_repair():
    text = "the dornain of g1ass set-\ntles near\n\nPage 3 of 9\n\nthe bounda-\nry of the load-\nbearing glass."
    assert scans.read_block(text, scans.Marks(*MARKS), vocabulary())[1] == "the domain of glass settles near the boundary of the load-bearing glass."


@pytest.mark.parametrize(
    "text,want,noise",
    [
        ("such in formation of glass", "such information of glass", set()),
        ("the micro structure\nof glass", "the microstructure of glass", set()),
        ("the micro strncture of glass", "the microstructure of glass", {"misread_chars"}),
        ("the microstructureof glass", "the microstructure of glass", set()),
        ("in forma-\ntion of glass", "information of glass", {"line_hyphen"}),
        ("the dor-\nnain of glass", "the domain of glass", {"line_hyphen", "misread_chars"}),
        ("the micro, structure of glass", "the micro, structure of glass", set()),
    ],
)
def test_torn_words_are_decoded_with_their_neighbours(text, want, noise):
    words = {"the": 900, "of": 900, "in": 900, "such": 90, "glass": 200, "information": 90, "microstructure": 80, "domain": 90}
    got, repaired = scans.read_block(text, scans.Marks(*MARKS), scans.Vocabulary({**words, "": 1000}))
    assert (got, repaired) == (noise, want)


@pytest.mark.parametrize("code", ["```\nx-\ny = g1ass\n```", "<pre>x-\ny</pre>", "$$a\n= b$$", "\\begin{equation}\na = b\n\\end{equation}"])
def test_text_around_code_is_repaired(code):
    text = f"the tempera-\nture of g1ass\n{code}\nsettles\nnear the bounda-\nry."
    noise, repaired = scans.read_block(text, scans.Marks(*MARKS), vocabulary())
    assert noise == {"line_hyphen", "misread_chars"} and repaired == f"the temperature of glass\n\n{code}\n\nsettles near the boundary."
    inline = scans.read_block("the g1ass of `g1ass-\u2010` and $$g1ass$$ at <pre>g1ass</pre> near", scans.Marks(*MARKS), vocabulary())[1]
    assert inline == "the glass of `g1ass-\u2010` and $$g1ass$$ at <pre>g1ass</pre> near"


def test_scans_of_nothing(spark):
    b = spark.createDataFrame([], "block_id string, modality string, content string, address struct<paper_id:string>")
    p = spark.createDataFrame([], "paper_id string, title string, venue string, authors string")
    assert scans.found_noise(b, p).count() == 0 and scans.repaired(b, p).count() == 0


def test_misreadings_are_found_without_a_limit_of_forms():
    words = ["".join(random.Random(i).choices("lit", k=30)) for i in range(300)] + ["illlitllitillttlliltllitlltill"]
    v = scans.Vocabulary({w: 500 for w in words} | {"": 1000})
    seen = list(words[-1])
    for at in (3, 11, 19, 27):
        seen[at] = {"l": "1", "t": "f", "i": "!"}[seen[at]]
    assert v.behind("".join(seen)) == (words[-1], 4)


def test_headers_of_any_length_are_looked_at():
    title = "On the long and winding ways of measured things " * 5
    assert scans.line_kinds(f"Some text\n{title}\nmore text", scans.Marks(title, None, None))[1][1] == {"running_header"}


def test_paragraphs_are_the_cheapest_grouping():
    """Against all groupings, and over thousands of lines."""
    rng = random.Random(5)
    pool = ["It ended here.", "a long line of running text that goes on and", "short", "", "# head", "- item of a list", "Another sentence that fills the whole line ends."]
    for _ in range(30):
        lines = rng.choices(pool, k=rng.randint(1, 9))
        got = scans.paragraphs(lines)
        assert [x for g in got for x in g] == [x for x in lines if x]
    many = ["a line of running text that goes on and on and"] * 3000 + ["End."] + ["the next paragraph has lines like this one and"] * 3000
    assert [len(g) for g in scans.paragraphs(many)] == [3001, 3000]


# ---- 5: pieces -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_pieces_keep_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "long" * rng.randint(1, 30), ". ", "\n\n", "，", "字", "; "]) for _ in range(400))
    cuts = pieces.cut_text(text, 100, 10)
    assert all(0 < e - s <= 100 for s, e, _ in cuts)
    assert text == "".join(text[(cuts[i - 1][1] if i else 0) : e] for i, (_, e, _) in enumerate(cuts))
    assert all(b[0] >= a[1] - 10 and b[0] <= a[1] for a, b in zip(cuts, cuts[1:]))


def test_hard_cuts():
    assert pieces.cut_text("x" * 3500, 1500, 150) == [(0, 1500, True), (1350, 2850, True), (2700, 3500, False)]
    assert pieces.cut_text("", 10, 2) == [] and pieces.cut_text("abc", 10, 2) == [(0, 3, False)]
    with pytest.raises(ValueError):
        pieces.cut_text("abc", 2, 2)


def test_cut_kinds(spark):
    rows = [("a", "x" * 1501, None), ("b", "word " * 400, None), ("c", "字" * 1499 + "，" + "字" * 900, None), ("d", None, None), ("e", "x" * 1500, None), ("b", "word " * 400, None)]
    df = spark.createDataFrame(rows, "block_id string, content string, address struct<span:string>")
    assert {tuple(r) for r in pieces.found_cuts(df).collect()} == {("a", "forced"), ("b", "natural"), ("c", "natural")}
    spans = sorted(r["address"]["span"] for r in pieces.addressed_pieces(df.where("block_id = 'a'")).collect())
    assert spans == ["0-1500", "1350-1501"]


# ---- 7: markup -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,kinds", [("a <b>c</b>", {"html"}), ("x&nbsp;y", {"html"}), ("<!-- block 7 -->x", {"html"}), ("p < 0.02 while r > 56 held.", set()), ("R&D lot #5 took ~17 runs.", set()), ("costs $5 per kg and $6", set()), ("peak_hold_2 was read", set()), ("2 * 6 sweeps and 5 * 72 steps", set()), ("agrees with [4] and [21].", set()), ("The label 'set 3' replaced 'set 66'.", set()), ("{6, 67}", set()), ("- 113 -", set()), ("a\n- 113 -\nb", set()), ("while r\n> 24 held.", set()), ("# Title\n\nx", {"markdown"}), ("**bold**", {"markdown"}), ("***x***", {"markdown"}), ("[a](https://x.y/z)", {"markdown"}), ("![p](img/f.png)", {"markdown"}), ("> quoted\n> more", {"markdown"}), ("+ one\n+ two", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("`x`", {"markdown"}), ("```\ncode\n```", {"markdown"}), ("[[link]]", {"wiki"}), ("''x''", {"wiki"}), ("{{convert|5|mm}}", {"wiki"}), ("== Seam ==\nx", {"wiki"}), ("[[Category:Glass]]", {"wiki"}), ("\\emph{x}", {"latex"}), ("$\\pm7\\%$", {"latex"}), ("\\(a < b\\)", {"latex"}), ("{\\it x}", {"latex"}), ("", set()), (None, set())])
def test_markup_kinds(text, kinds):
    assert {k for k, *_ in markup.branches(text)} == kinds


def test_clean_keeps_structure():
    text = "<h3>Seam</h3>\n<ul><li>one</li><li>two &lt; 3</li></ul><pre><code>load(79)\nstep &lt; 346</code></pre> **bold** $E=mc^2$ \\cite{a} [[A|b]] ![p](x.png)"
    got = markup.clean(text, {"markdown image"})
    assert got.split("\n")[0] == "Seam" and "• one" in got and "• two < 3" in got and "load(79)\nstep < 346" in got and "E=mc^2" in got and "bold" in got
    assert not any(x in got for x in ("<", "**", "\\cite", "[[", "![")[1:]) and markup.clean(None) is None and markup.clean("") == ""


def test_style_tree_drops_what_never_changes(spark):
    rows = [("p", f"b{i}", "text", f"Text number {i} of a run.\n[[Category:Glass]]", None) for i in range(6)]
    df = spark.createDataFrame(rows, "paper string, block_id string, modality string, content string, caption string").selectExpr("block_id", "modality", "content", "caption", "named_struct('paper_id', paper) as address")
    assert all("Glass" not in r["clean"] for r in markup.clean_blocks(df).collect())
    assert {tuple(r) for r in markup.found_markup(df).collect()} == {(f"b{i}", "content", "wiki") for i in range(6)}


def test_long_contents_differ_late(spark):
    rows = [("p", f"b{i}", "text", "> " + "word " * 60 + str(i), None) for i in range(4)]
    df = spark.createDataFrame(rows, "paper string, block_id string, modality string, content string, caption string").selectExpr("block_id", "modality", "content", "caption", "named_struct('paper_id', paper) as address")
    assert [(r["branch"], r["fields"], round(r["importance"], 6)) for r in markup.style_tree(markup.parsed(df)).collect()] == [("quote", 4, 1.0)]


def test_html_nodes_nest():
    nodes = {(x.path, x.content) for x in markup.html_nodes('<div class="a">x <p>one<p>two</div><ul><li>3<li>4 <b>5</b></ul><br/>')}
    assert nodes == {("div.a/p", "one"), ("div.a/p", "two"), ("div.a", "x one two"), ("ul/li", "3"), ("ul/li/b", "5"), ("ul/li", "4 5"), ("ul", "3 4 5"), ("br", "")}


def test_repeated_html_blocks_are_dropped(spark):
    body = "<div>Text number {0} holds.</div>\n<div>Printed by the <b>Seam</b> Society</div>\n<p>Sample {0} is a <span>unit</span> cell.</p>\n<h3>Method</h3>\n<div>Notes<ul><li>same</li></ul></div>\n\\begin{{center}}Draft\\end{{center}}"
    rows = [("p", f"b{i}", "text", body.format(i), None) for i in range(6)] + [("q", "c", "text", body.format(9), None)]
    df = spark.createDataFrame(rows, "paper string, block_id string, modality string, content string, caption string").selectExpr("block_id", "modality", "content", "caption", "named_struct('paper_id', paper) as address")
    got = {r["block_id"]: r["clean"] for r in markup.clean_blocks(df).collect()}
    assert all(got[f"b{i}"].split("\n") == [f"Text number {i} holds.", "", f"Sample {i} is a unit cell.", "", "Method", "", "Notes", "• same"] for i in range(6))
    assert "Printed by the Seam Society" in got["c"] and "Draft" in got["c"]


def test_copies_of_a_caption_are_no_repeats(spark):
    rows = [("p", "a", "figure", "<p>Figure 1: A scan.", "<p>Figure 1: A scan."), ("p", "b", "caption", "<p>Figure 1: A scan.", None), ("p", "c", "text", "<p>Other text.", None)]
    df = spark.createDataFrame(rows, "paper string, block_id string, modality string, content string, caption string").selectExpr("block_id", "modality", "content", "caption", "named_struct('paper_id', paper) as address")
    assert sorted(r["clean"] for r in markup.clean_blocks(df).collect()) == ["Figure 1: A scan."] * 3 + ["Other text."]


def test_a_lone_sign_is_markup_only_if_its_source_marks_words(spark):
    schema = "block_id string, modality string, content string, caption string, address struct<paper_id:string>"
    rows = [("a", "text", "Yields of *3* and *4* are given.", None, ("p",)), ("b", "text", "Yields of *3* and *4* are given.", None, ("q",)), ("c", "text", "It is *very* hot.", None, ("q",)), ("d", "text", "A <b>bold</b> 5.", None, None)]
    assert {tuple(r) for r in markup.found_markup(spark.createDataFrame(rows, schema)).collect()} == {("b", "content", "markdown"), ("c", "content", "markdown"), ("d", "content", "html")}


# ---- 8: encoding -----------------------------------------------------------------------------------------------


def test_ids_are_exact():
    enc = encoding.load_encoder()
    coder = encoding.ChunkEncoder(enc)
    rng = random.Random(2)
    alphabet = ["word", " ", "  ", "\n", "字", "é", "123", "'s", "<|endoftext|>", "🙂", "​", "....", "Zuv", "\t", "，", "́"]
    shared = "".join(rng.choice(alphabet) for _ in range(3000))
    for i in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 500))) + (shared if i % 2 else "") + "".join(rng.choice(alphabet) for _ in range(90))
        assert coder.text(text) == enc.encode_ordinary(text)
    assert coder.text(None) == [] and coder.text("") == []
    long = "x" * 30_000 + " " * 3_000 + "字" * 5_000
    assert coder.text(long) == enc.encode_ordinary(long)


def test_shared_chunks_are_encoded_once_and_joined_back(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choices("the it's naïve 字 12 x-ray a.b 'quoted' 5's".split(), k=900))
    rows = [(i, f"{i} {passage[i * 7 :]} {i * i} {passage[: 3000 - i]}") for i in range(12)] + [(90, passage), (90, passage), (None, passage), (91, None), (92, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    shared = encoding.shared_chunks(df).collect()
    assert shared and len(shared) == len({(r["h1"], r["h2"]) for r in shared})
    enc = encoding.load_encoder()
    want = sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoding.encode_documents(df).collect()) == want
    given = {(r["h1"], r["h2"]): list(r["ids"]) for r in shared}
    known = {i: [0] for i, c in enumerate(encoding.chunks(passage)) if encoding.chunk_name(c) in given}
    assert known and encoding.ChunkEncoder(enc).text(passage, known) != enc.encode_ordinary(passage)  # the table's ids are what is used


def test_ids_of_documents(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, ids string")
    assert {r["doc_id"]: list(r["ids"]) for r in encoding.encode_documents(df).collect()} == {1: encoding.load_encoder().encode_ordinary("a b"), 2: [], 3: []}


# ---- 9: leaks --------------------------------------------------------------------------------------------------


def test_leaks_match_brute_force():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 30))), " ".join(rng.choices(words, k=rng.randint(5, 60))) if i % 5 else None) for i in range(40)]
    docs = []
    for _ in range(120):
        w = rng.choices(words, k=rng.randint(0, 80))
        source = leaks.words(rng.choice(items)[1])
        k = rng.randint(8, 16)
        w[5:5] = [x.upper() for x in source[:k]]
        docs.append(", ".join(w))
    docs += [None, "", "short"]
    want = set()
    for i, q, p in items:
        for text in (q, p):
            t = leaks.words(text)
            grams = {tuple(t[k : k + 12]) for k in range(len(t) - 11)}
            for d, doc in enumerate(docs):
                w = leaks.words(doc)
                if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                    want.add((d, i))
    assert {(d, i) for d, i, _ in leaks.ItemIndex(items).search(docs)} == want and want


def test_many_items_take_little_room():
    """50,000 items: the index grows with their words, not with terms times items, and finds what is in it."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=14)), " ".join(rng.choices(vocabulary, k=40)), "w1 w2") for i in range(50_000)]
    index = leaks.ItemIndex(items)
    assert index.nbytes() < 200e6
    docs = ["Before it. " + items[77][2].upper() + " w1", " ".join(items[4][1].split()[1:13]), " ".join(items[4][1].split()[:11]), None]
    assert index.search(docs) == [(0, 77, 0.5), (1, 4, 0.0)]


def test_shards_find_the_same(spark):
    items = spark.createDataFrame([(i, f"q{i} " * 12, None, "a" if i % 2 else None) for i in range(9)], "item_id bigint, question string, passage string, answer string")
    docs = spark.createDataFrame([(1, f"{'q3 ' * 12} and {'q4 ' * 12} a", 0), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, score int")
    want = {(1, 3, 1.0), (1, 4, None)}
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == want == {tuple(r) for r in leaks.leaks(docs, items, shard=2).collect()}


def test_no_items_no_leaks(spark):
    d = spark.createDataFrame([(1, "a " * 40)], "doc_id bigint, text string")
    assert leaks.found_leaks(d, spark.createDataFrame([], "item_id bigint, question string, passage string, answer string")).count() == 0


# ---- 10: cut-offs ----------------------------------------------------------------------------------------------

BODY = "The yield stress of sample {} reaches {} MPa at 300 K under steam. The seam of lot {} stays porous in ring compression. "


def test_cut_texts(spark):
    whole = [(i, (BODY.format(i, i, i) * 3).strip(), "a") for i in range(60)]
    tails = ["- load: 493 N", "| a | 9 |", "Keywords: ring compression, seam", "[12] Some, A. Letters 10 (2011) 74-380", "$$J = a$$", "(see also run 7)", "```\nx\n```", "See Table 7."]
    fine = [(100 + i, BODY.format(7, 7, 7) + "\n\n" + t, "a") for i, t in enumerate(tails)]
    cut = [(200, BODY.format(7, 7, 7) + "The seam of lot 7 stays po", "a"), (201, BODY.format(7, 7, 7) + "The seam of lot 7 stays …", "b"), (202, BODY.format(7, 7, 7) + "The yield stress of sam�", "b"), (203, BODY.format(7, 7, 7) + "The seam of", "b")]
    odd = [(300, None, "a"), (301, "", "a"), (302, " \n", "a"), (303, "!!!???...", "a"), (304, "GBX3V963", None)]
    df = spark.createDataFrame(whole + fine + cut + odd, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in cutoffs.found_cut(df).collect()} == {200, 201, 202, 203}
    shares = {r["source"]: (r["documents"], r["cut"]) for r in cutoffs.by_source(df).collect()}
    assert shares["b"] == (3, 3) and shares["a"][1] == 1 and shares[None] == (1, 0)


def test_lengths():
    got = cutoffs.lengths('é"\n')
    assert got["chars"] == 3 and got["utf8"] == 4 and got["crlf"] == 4 and got["entities"] == 8 and got["json"] == 5


@pytest.mark.parametrize("text", ["plain", 'a "b" <c> & \'d\'\n\te\r\n\x01', "naïve 高 𝄞\n", ""])
def test_lengths_are_those_of_the_encodings(text):
    import html
    import json

    got = cutoffs.lengths(text)
    assert got["utf8"] == len(text.encode()) and got["utf16"] == len(text.encode("utf-16-le")) // 2
    assert got["entities"] == len(html.escape(text)) and got["json"] == len(json.dumps(text, ensure_ascii=False)) - 2 and got["json_ascii"] == len(json.dumps(text)) - 2
    assert got["crlf"] == len(text.replace("\r\n", "\n").replace("\n", "\r\n"))


def test_short_texts_are_judged_too():
    assert cutoffs.inspect("The alloy was anneal")[0] == "ask" and cutoffs.inspect("🙂 5")[0] == "odd"


def test_hidden_limits(spark):
    rows = [(i, (BODY.format(i, i, i) * 9)[:500].strip()[:499], "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = cutoffs.hidden_limits(cutoffs.inspected(df)[0]).collect()
    assert all(r["open"] >= cutoffs.LIMIT_TEXTS for r in found)


def test_abbreviations_do_not_end_a_sentence():
    assert endings.ending("It is shown in Fig.").state == "open"
    assert endings.ending("It is held at 300 K.").state == "closed"


@pytest.mark.parametrize("last,text,want", [("Panel", "It is held. Panel", True), ("Nach 66", "Es hält. Nach 66", True), ("Panel", "Panel", False), ("Seam", "It is held.\nSeam", False), ("It is held at 5 K", "One. It is held at 5 K", False), ("批次", "结束。批次", True)])
def test_hardly_begun(last, text, want):
    assert endings.hardly_begun(last, text) is want
