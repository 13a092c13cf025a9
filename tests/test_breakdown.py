import json

import pytest
from pyspark.sql import functions as F

from dossier import models
from dossier.functions import blocks
from dossier.functions import html as H
from dossier.functions import modeljson as J
from dossier.functions import sections as S
from dossier.functions.sections import UNNAMED
from dossier.operators import numbering as N
from dossier.operators import outline as L
from dossier.plans import breakdown as B
from dossier.plans import reading as R


def candidates(spark, md):
    d = spark.createDataFrame([(1, md)], "doc_id bigint, text string").select("doc_id", "text", N.start_state().alias("entry"), F.lit(False).alias("scope_reset"))
    return [(c.question_id, c.kind) for c in N.with_candidates(N.with_lines(d)).first()["candidates"]]


CASES = {
    "decimal": ("# **IV. Water supply**\n\n## **2. Wells**\n\n2.1 Name the wells of the plant.\n2.2 How deep are they?\n2.5 Regarding 2.2, who measures?\n", ["IV.2.1", "IV.2.2", "IV.2.5"]),
    "implicit": ("| 3. **Pipes and valves of the plant.** |\n\n| * 1. **Material:** List each one. |  |\n| * 1. Who checks them? |  |\n", ["3", "3.1", "3.2"]),
    "romans": (
        "# **III. Cold chain**\n\n## **2. Storage rooms**\n\n### 2.4 Alarms\n\n（5） About the alarm plan, records are kept.\n"
        "| a. A plan is written. (i) People who read it. (ii) Limits of (i) that need care. (iii) Dates. |\n"
        "| c. A note about b (ii) is kept for a year. |\n"
        "| d. A list is kept. (i) Bells for the test of (c) (ii) (ii) Lamps for the repair of (d) |\n",
        ["III.2.2.4.5", "III.2.2.4.5.a", "III.2.2.4.5.a.i", "III.2.2.4.5.a.ii", "III.2.2.4.5.a.iii", "III.2.2.4.5.c", "III.2.2.4.5.d", "III.2.2.4.5.d.i", "III.2.2.4.5.d.ii"],
    ),
    "inline numbers": (
        "# **V. Transport**\n\n## **3. Vehicles**\n\n### 3.1 Cleaning\n\n(4) Washing\n| b. (1)Doors are washed on both sides. (2)Floors are dried. |\n\n"
        "(5) Drivers\n| a. (1) Training is given each year. (2)Records are kept. |\n| b. Gloves are worn. |\n",
        ["V.3.3.1.4", "V.3.3.1.4.b", "V.3.3.1.5", "V.3.3.1.5.a", "V.3.3.1.5.b"],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_candidates(spark, name):
    md, want = CASES[name]
    assert [q for q, _ in candidates(spark, md)] == want


def test_implicit_kinds(spark):
    assert [k for _, k in candidates(spark, CASES["implicit"][0])] == ["parent_requirement"] + ["implicit_list_item"] * 2


class Canned:
    """Answers by what the prompt holds."""

    def __init__(self, **rules):
        self.rules = rules

    def __call__(self, prompts):
        return [next((json.dumps(a) for k, a in self.rules.items() if k in p), "[]") for p in prompts]


def v1(spark, md, **rules):
    d = spark.createDataFrame([(1, md)], "doc_id bigint, text string")
    return [(r.question_id, r.question_text) for r in B.breakdown_v1(d, Canned(**rules))["items"].orderBy("ord").collect()]


HEAD = "# **III. Cold chain**\n\n## **2．Storage rooms**\n\n"
LISTED = "* 1. Walls\n* 2. Doors\n**(3) Locks of doors**\n| b. | Earlier line |\n"


@pytest.mark.parametrize(
    "md, word, said, text, want",
    [
        (HEAD + "### 2-1 Inspection of rooms\n\n(4) Who inspects and how often\n| a.倉庫の順位  a. Ranking of rooms by the central office. |\n",
         "Ranking", "III.7.1.a", "Ranking of rooms by the central office.", "III.2.2.1.4.a"),
        (HEAD + LISTED + "\n### 2-3 Alarm systems\n\n(2) Bells and lamps\n| e. | Steps taken when a bell rings. |\n", "rings", "III.2.2.3.1.e", "Steps taken when a bell rings.", "III.2.2.3.2.e"),
        (HEAD + LISTED + "y" * 6100 + "\n| c. | Spare keys of doors |\n", "Spare", "3.c", "Spare keys of doors", "III.2.2.3.c"),
    ],
)
def test_v1_ids_come_from_the_source(spark, md, word, said, text, want):
    assert v1(spark, md, **{word: [{"question_id": said, "question_text": text}]}) == [(want, text)]


def test_v1_chapter_prefix_and_source_keys(spark):
    md = "# **IV. Water supply**\n\n1. 日本語の設問\n2. Map of all wells\n\n| 1. A list of the wells in use. |\n| 1. Copies of the tests. |\n\n# **V. Transport**\n\n1. Another one\n"
    said = [{"question_id": a, "question_text": b} for a, b in (("1", "Map of all wells"), ("1.1", "A list of the wells in use."), ("1.2", "Copies of the tests."))]
    assert [q for q, _ in v1(spark, md, Map=said)] == ["IV.1", "IV.1.1", "IV.1.2"]
    two = "(4) Cloakroom\nCloakrooms are to be kept tidy and aired every day."
    keyed = [{"source_key": "C001", "role": "question", "question_text": "Cloakroom"}, {"source_key": "C002", "role": "continuation", "question_text": "Cloakrooms are to be kept tidy."}]
    assert v1(spark, two, Cloakroom=keyed) == [("4", "Cloakroom Cloakrooms are to be kept tidy.")]


def test_v1_failures_are_rows(spark):
    d = spark.createDataFrame([(1, "1.1 Some text here"), (2, "1.1 Other text")], "doc_id bigint, text string")
    out = B.breakdown_v1(d, Canned(Some={"not": "a list"}, Other=[{"source_key": "C009", "question_text": "x"}]))
    assert {(r.doc_id, r.error) for r in out["failures"].collect()} == {(1, "answer is not a JSON array of objects"), (2, "unknown source key")}


def test_v1_coverage_and_lost_documents(spark):
    md = "1.1 Wells of the plant\n1.2 Pipes of the plant\n1.3 Valves of the plant\n"
    d = spark.createDataFrame([(1, md), (2, "1.1 Broken one here")], "doc_id bigint, text string")
    keyed = [{"source_key": k, "role": "question", "question_text": "x"} for k in ("C001", "C001", "C003")]
    out = B.breakdown_v1(d, Canned(Wells=keyed, Broken={"not": "a list"}), keep=True)
    assert {(r.doc_id, r.source_key, r.status) for r in out["coverage"].collect() if r.doc_id == 1} == {(1, "C002", "missing"), (1, "C001", "duplicate")}
    assert [r.doc_id for r in out["failed"].collect()] == [2]
    lost = B.breakdown_v2(d, lambda prompts: ["not json"])
    assert sorted(r.doc_id for r in lost["failed"].collect()) == [1, 2]


TABLE = (
    "**4. Water**\n\n**4.2 Wells in use**\n\n**1) By region (last year)**\n\n**5. Staff**\n\n"
    "| Topic | Questions | Detailed questions and request for supporting materials |\n| --- | --- | --- |\n"
    "| Staff | 1 | Show who is in charge. | 1.1 | Give the office address. |\n| 1.2 | Give the laboratory address. |\n"
    "| Staff | 2 | Describe the budget. | 2.1 | Give the last report. |\n"
)


def test_structured_tables_need_no_model(spark):
    def broken(prompts):
        raise AssertionError("the model must not be asked")

    rows = [(1, TABLE), (2, TABLE.replace("| Staff | 1 |", "| Staff | １ |"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = B.breakdown_v1(d, broken)["items"].orderBy("doc_id", "ord").collect()
    want = ["4.2.1", "5.1", "5.1.1.1", "5.1.1.2", "5.2", "5.2.2.1"]
    assert [r.question_id for r in got] == want * 2
    prose = spark.createDataFrame([(1, "**2. A section title**\n\nSome prose.")], "doc_id bigint, text string")
    assert N.structured_questions(prose).count() == 0


def test_table_of_contents(ev):
    body = "**III. COLD CHAIN**\n\nRead the [handbook](https://example.test/handbook) first.\n"
    md = "Form for cold stores\n\n目次\n\n[**1. Rooms** 4](#_Toc4711)\n[**1.1 Doors** 6](#_Toc4712)\n\n" + body
    assert ev(md, N.without_toc) == "Form for cold stores\n\n" + body
    plain = "[**2. A link of its own**](#_Toc99)\n\nText of a question.\n"
    assert ev(plain, N.without_toc) == plain


def test_v2_outline_prefixes_and_retry(spark):
    calls = []

    class Flaky(models.EchoItems):
        def __call__(self, prompts):
            if not calls:
                calls.append(1)
                raise ValueError("once")
            return super().__call__(prompts)

    d = spark.createDataFrame([(1, "Part A\n" + "a line\n\n" * 1200), (2, "short one\ntwo")], "doc_id bigint, text string").coalesce(1)
    out = B.breakdown_v2(d, Flaky(), Canned(Heading=[{"canonical_id": "A", "heading_title": "t", "raw_marker": "Part A"}]), models.KeepItems())
    rows = out["items"].orderBy("doc_id", "ord").collect()
    assert {r.question_id.split(".")[0] for r in rows if r.doc_id == 1} == {"A"}
    assert [r.question_text for r in rows if r.doc_id == 2] == ["short one", "two"]
    bad = B.breakdown_v2(d, lambda prompts: ["not json"])
    assert bad["items"].count() == 0 and {r.doc_id for r in bad["failures"].collect()} == {1, 2}


def test_page_engine(spark):
    p = spark.createDataFrame([(1, 1, "1.1 Foo bar\n(a) baz"), (1, 2, "1.2 Qux")], "doc_id bigint, page int, image string")
    rows = B.breakdown_pages(p, models.ReadPage(), None, models.KeepItems())["items"].orderBy("ord").collect()
    assert [(r.question_id, r.question_text) for r in rows] == [("1.1", "Foo bar"), ("(a)", "baz"), ("1.2", "Qux")]


class Pages:
    def __init__(self, answers):
        self.answers = answers

    def __call__(self, prompts, images):
        return [json.dumps(self.answers[i[-1]]) for i in images]


def asks(*ids):
    return [{"question_id": i, "question_text": f"Please describe {i} fully"} for i in ids]


def toc(*sections):
    entries = [{"section_id": s, "title": t, "page": p, "is_major_section": True, "position": "top"} for s, t, p in sections]
    return lambda prompts, images: [json.dumps(entries)]


def read(spark, answers, outline=None):
    pages = spark.createDataFrame([(1, i, k) for i, k in enumerate(answers, 1)], "doc_id bigint, page int, image string")
    out = R.breakdown_reading(pages, Pages(answers), outline, models.KeepItems()).orderBy("place").collect()
    return [(r.section, r.depiction, [q.question_id for q in r.questions]) for r in out]


def test_reading_two_parts(spark):
    got = read(spark, {"p1": {"extracted_questions": asks("A.1", "A.2")}, "p2": {"extracted_questions": asks("B.1", "B.2")}}, toc(("A", "A - Scope", 1), ("B", "B - General Information", 2)))
    assert got == [("A", "Scope", ["A.1", "A.2"]), ("B", "General Information", ["B.1", "B.2"])]


def test_reading_section_starts_inside_a_page(spark):
    first = {"extracted_questions": asks("A.15", "A.16", "B.1", "B.2"), "detected_new_chapters": [{"id": "B", "title": "Gen", "first_question_id": "B.1"}]}
    got = read(spark, {"p1": first, "p2": {"extracted_questions": asks("B.3")}}, toc(("A", "Scope", 1)))
    assert [(s, q) for s, _, q in got] == [("A", ["A.15", "A.16"]), ("B", ["B.1", "B.2", "B.3"])]


def test_reading_without_contents_and_with_a_missed_section(spark):
    answers = {
        "p1": {"extracted_questions": asks("A.1"), "detected_new_chapters": [{"id": "A", "title": "x"}]}, "p2": {"extracted_questions": asks("A.2")},
        "p3": {"extracted_questions": asks("A.3", "B.1"), "detected_new_chapters": [{"id": "B", "first_question_id": "B.1"}]}, "p4": {"extracted_questions": asks("B.2")},
    }
    assert [(s, len(q)) for s, _, q in read(spark, answers)] == [("A", 3), ("B", 2)]
    missed = {"p1": {"extracted_questions": asks("A.1")}, "p2": {"extracted_questions": asks("B.1"), "detected_new_chapters": [{"id": "B"}]}, "p3": {"extracted_questions": asks("C.1")}}
    assert [s for s, _, _ in read(spark, missed, toc(("A", "a", 1), ("C", "c", 3)))] == ["A", "B", "C"]


def held(spark, cases, fn):
    """``fn`` of the columns of every case."""
    width = len(cases[0])
    kinds = ["array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "string" for v in cases[0]]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{k} {kinds[k]}" for k in range(width)))
    return [r[0] for r in rows.orderBy("i").select(fn(*(F.col(f"c{k}") for k in range(width))).alias("o")).collect()]


def test_sections_of_ids(spark):
    letters, parts = ["K", "L", "M"], ["Part K", "Part L", "Chapter IX"]
    cases = [("L.4", letters), ("L.4.c", letters), ("K.22", letters), ("3.1", letters), ("Part L.7", letters), ("Part L.7", parts), ("L.7", parts), ("L", parts),
             ("Chapter IX.2", parts), ("KL.1", letters), ("", letters), (None, letters), ("l_4", letters), ("K.1", ["K", "K.1", UNNAMED]), ("General.1", [UNNAMED])]
    want = ["L", "L", "K", None, "L", "Part L", None, "Part L", "Chapter IX", None, None, None, "L", "K.1", None]
    assert held(spark, cases, S.section_of_id) == want


def test_names_of_sections(spark):
    known = ["K", "L", "Chapter IX", "M: Water supply", "Part_N"]
    cases = [(n, known) for n in ("L", "chapter ix", "IX", "Part K", "M", "Part N", "Nowhere_Q", "", None)]
    assert held(spark, cases, S.match_section) == ["L", "Chapter IX", "Chapter IX", "K", "M: Water supply", "Part_N", "", "", ""]
    sides = [("L.1", "", "K", "K", ["K", "L"], False), ("8.1", "", "K", "L", ["K", "L"], False), ("8.2", "", "K", "L", ["K", "L"], True),
             ("8.3", "K", "L", "L", ["K", "L"], True), ("8.4", "", "", "", ["K", "L"], True), ("8.5", "", "", "", [], True)]
    assert held(spark, sides, lambda q, g, b, n, s, a: S.section_for(q, g, b, n, s, a)) == ["L", "K", "L", "K", "L", "General"]


class Remembering(Pages):
    """Second page: asks about the heading of the first if the prompt still knows it."""

    def __call__(self, prompts, images):
        if "Storage of feed" in prompts[0]:
            return [json.dumps({"extracted_questions": asks("K.9")})]
        return super().__call__(prompts, images)


def test_headings_reach_the_next_prompt(spark):
    first = {"extracted_questions": [{"question_id": "K.1", "question_text": "Storage of feed"}, *asks("K.1.1")]}
    pages = spark.createDataFrame([(1, 1, "p1"), (1, 2, "p2")], "doc_id bigint, page int, image string")
    read_rows = R.read_pages(pages, Remembering({"p1": first, "p2": {"extracted_questions": asks("K.2")}})).orderBy("page").collect()
    assert "K.9" in read_rows[1].answer


def test_outline_entries():
    cases = {"M - Water supply (wells)": ("M", "Water supply (wells)"), "Part IV: Transport": ("Part IV", "Transport"), "Chapter 6 – Cold chain": ("Chapter 6", "Cold chain"), "": ("General", "")}
    assert {k: S.outline_entry(k) for k in cases} == cases
    assert S.outline_entry("M", "M. Water", "Water comes first") == ("M", "Water comes first")
    text = "M - Wells and pipes of the plant\nKindly name the office that tests the water\nWells and pipes of the plant"
    assert S.introduction(text, "M", ["<b>Kindly</b> name the office that tests the water, and when?"]) == "Wells and pipes of the plant"


def test_memory_leaves_nothing_out():
    memory = S.reading_memory(3, 8, "M", [str(i) for i in range(30)], {"id": "N", "title": "Feed"}, "an unfinished\n" + "sentence " * 30, ["M", "wells", "pipes", "valves"])
    for part in ("3/8", "29", "N Feed", "M > wells > pipes > valves", "sentence " * 29 + "sentence"):
        assert part in memory


def test_outline_order_and_propagation(spark):
    rows = [(1, 0, "C", "Inspection", "3"), (1, 1, "A", "General", "1"), (1, 2, "B.1", "Please indicate the name:", "1"), (1, 3, "B", "Specific", "2")]
    e = spark.createDataFrame(rows, "doc_id int, ord bigint, section_id string, title string, page string").withColumns(
        {"subsection_id": F.lit(""), "position": F.lit("top"), "is_major": F.lit(True), "depiction": F.lit("")})
    pages = spark.createDataFrame([(1, p) for p in range(1, 5)], "doc_id int, page int")
    out = R.outline_map(e, pages)
    assert [r.section_id for r in out["order"].orderBy("place").collect()] == ["A", "B", "C"]
    last = out["pages"].where("page = 4").first()
    assert (last.section_id, last.position, last.is_major) == ("C", "full_page", False)


def test_html_fragments(ev):
    text = "Fill in:\n| Room | Degrees |\n| --- | :---: |\n| North | 4 |\n| South | 7 & 8 |\n"
    out = ev(text, H.tables_to_html)
    assert out.startswith("Fill in:") and "<th>Room</th>" in out and "<td>North</td>" in out and "<td>7 &amp; 8</td>" in out and "---" not in out
    assert "<li>[x] Cold rooms</li>" in ev("Tick:\n- [ ] Dry rooms\n- [x] Cold rooms\n", H.checklists_to_html)
    assert ev("1. one\n2. two", H.checklists_to_html) == "<ol>\n  <li>one</li>\n  <li>two</li>\n</ol>"
    balanced = ev("<p>Q <table><thead><tr><th>H</th></tr><tbody><tr><td>Cell", H.balance_html)
    assert all(t in balanced for t in ("</td>", "</tr>", "</tbody>", "</table>", "</p>"))
    assert blocks.balance_text("<ul><li>x<script>var a='<p>'</script>") == "<ul><li>x</ul></li>"
    lists = blocks.merge_fragments("<p>Rooms:</p>\n<ul>\n  <li>north</li>\n</ul>", "<ul>\n  <li>south</li>\n</ul>")
    assert lists.count("<ul") == 1 and lists.index("north") < lists.index("south")
    for a, b, joined in (("One half", "other half", "One half other half"), ("all of it", "of  it", "all of it"), ("", "x", "x"), ("t", "<ul><li>u</li></ul>", "t\n<ul><li>u</li></ul>")):
        assert blocks.merge_fragments(a, b) == joined
    for qid, raw, want in (
        ("4.2", "4.2. Name the wells.", "Name the wells."), ("Part K.3", "Part K.3 - Rooms and doors", "Rooms and doors"), ("Part K.3", "K.3: Rooms", "Rooms"),
        ("4.2", "<p><strong>4.2.</strong> Name them.</p>", "<p>Name them.</p>"), ("4.2.7", "(7) Who holds the keys?", "Who holds the keys?"),
        ("", "Question 4: When?", "When?"), ("4.2", "<b>Never</b> open it", "<b>Never</b> open it"), ("4", "42 doors", "42 doors"), ("4.2", "4.2.", ""), ("4.2", "", ""),
    ):
        assert ev(raw, lambda c, qid=qid: H.without_id_prefix(F.lit(qid), c)) == want
    assert ev("Litres used: " + "_" * 18 + " l", H.strip_fill_blanks) == "Litres used:  l"
    box = "<p>Choose:</p><ul><li>[ ] Left</li><li>[x] Right</li></ul>"
    assert ev(box, H.strip_fill_blanks) == box
    assert ev("4.2 Which wells are open?<p>[" + "_" * 30 + "]</p>", lambda c: H.format_question_text(c, F.lit("4.2"))) == "Which wells are open?"
    row = H.linearize_text("| 4.2 | 井戸 | Wells |\n| --- | --- | --- |\nfoo\n")
    assert '<Cell column="1" role="id">4.2</Cell>' in row and row.endswith("</Row>\nfoo\n")
    assert ev("<div>a &amp;amp; b<br>c<i>d</i></div>", H.html_segments) == ["a & b", "c d"]


def test_model_json(ev):
    cut = '```json\n[\n  {"section_id": "A", "page": 1},\n  {"section_id": "B", "page": 2},\n  {"section_id": "C", "title": "Incomplete Th'
    assert [r["section_id"] for r in ev(cut, J.repair_array)] == ["A", "B"]
    assert [r["id"] for r in ev('junk {"id": "x", "n": [1]} {bad} {"id": "y"}', J.repair_array)] == ["x", "y"]
    assert ev("```json\n{\"extracted_questions\": []}\n```", J.strip_fence) == '{"extracted_questions": []}'
    kept = ev('[{"question_id": "1.1", "question_text": "S"}, {"invalid": "item"}]', lambda c: J.plain_items(c, strict=False))
    assert [i.question_id for i in kept["items"]] == ["1.1"]
    assert ev('[{"question_id": "1.1"}]', lambda c: J.plain_items(c, strict=True)).error is not None
    pairs = ev('text [{"chinese_term": " 牛 ", "english_term": "beef"}, {"chinese_term": "", "english_term": "x"}] end', J.parse_term_pairs)
    assert [(p.zh, p.en) for p in pairs] == [("牛", "beef")]
    units = ev('<JSON_Result>[{"機關": "A", "單位": "b", "理由": "r"}, {"機關": "A", "單位": "b"}]</JSON_Result>', lambda c: J.parse_units(c, 3))
    assert [(u.agency, u.unit) for u in units] == [("A", "b")]


def test_outline_asks_for_every_heading(spark):
    lines = "\n\n".join(f"Section {i} {'of many ' * 6}" for i in range(400))
    d = spark.createDataFrame([(1, lines)], "doc_id bigint, text string")
    slices = B.candidate_slices(d).collect()
    assert len(slices) > 1 and sum(len(s.cand) for s in slices) == 400

    def nodes(prompts):
        rows = [[ln.split("] ", 1)[1] for ln in p.splitlines() if ln.startswith("- [pos:")] for p in prompts]
        return [json.dumps([{"canonical_id": ln.split()[1], "raw_marker": ln[:20]} for ln in one]) for one in rows]

    got = B.skeleton(d, nodes).orderBy("ord").collect()
    assert [r.path for r in got] == [str(i) for i in range(400)] and [r.ord for r in got] == list(range(400))


class SecondTime:
    """Answers with nonsense once, then with one item."""

    def __init__(self):
        self.asked = 0

    def __call__(self, prompts):
        self.asked += 1
        return ["no json" if self.asked == 1 else '[{"question_id": "1", "question_text": "Which?"}]' for _ in prompts]


def test_unreadable_answers_are_asked_for_again(spark):
    d = spark.createDataFrame([(1, "1 Which?")], "doc_id bigint, text string")
    out = B.breakdown_v2(d, SecondTime(), keep=True)
    assert [r.question_text for r in out["items"].collect()] == ["Which?"] and out["failures"].count() == 0


def test_json_maps_come_back(spark, tmp_path):
    from dossier.sources import readers, sinks

    pairs = spark.createDataFrame([(f"k{i}", f'v "{i}"\n') for i in range(10)], "k string, v string").repartition(3)
    sinks.write_json_map(pairs, "k", "v", str(tmp_path / "m"))
    got = {(r["key"], r["value"]) for r in readers.json_map(spark, str(tmp_path / "m")).collect()}
    assert got == {(r["k"], r["v"]) for r in pairs.collect()}
    (tmp_path / "one.json").write_text('{\n  "a": "x",\n  "b": "y"\n}\n')
    assert {(r["key"], r["value"]) for r in readers.json_map(spark, str(tmp_path / "one.json")).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "none.json").write_text("not json")
    assert readers.json_map(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "rest.json").write_text('{"a":\n "x"}\n{"b": "y"} tail')
    with pytest.raises(Exception, match="behind the JSON object"):
        readers.json_map(spark, str(tmp_path / "rest.json")).collect()
