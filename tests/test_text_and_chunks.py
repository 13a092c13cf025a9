import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import chunks as C
from dossier.functions import ids
from dossier.functions import text as T
from dossier.params import AskParams, ChunkParams, RetrievalParams


def plain_chunks(text, size, overlap):
    text = text.strip()
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        piece = text[at:at + size].strip()
        if piece:
            out.append(piece)
        if at + size >= len(text):
            return out
        at += size - overlap


def test_sliding_chunks_match_a_plain_loop(spark):
    rng = random.Random(7)
    alphabet = "ab \n　牛😀c"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    for size, overlap in ((10, 3), (10, 0), (7, 6), (5, 4), (50, 5)):
        got = dict(spark.createDataFrame(rows, "i int, t string").select("i", C.sliding_chunks(F.col("t"), ChunkParams(size, overlap))).collect())
        for i, t in rows:
            assert got[i] == plain_chunks(t, size, overlap), (size, overlap, t)


def test_blank_texts_and_bad_overlap(ev):
    assert ev("  \n", lambda c: C.sliding_chunks(c)) == [""]
    assert ev("  \n", lambda c: C.sliding_chunks(c, keep_blank=False)) == []
    assert ev("", lambda c: C.sliding_chunks(c)) == []
    with pytest.raises(ValueError):
        ChunkParams(10, 10)


@settings(max_examples=50, deadline=None)
@given(st.text("abc ", min_size=0, max_size=80), st.integers(2, 20), st.data())
def test_plain_loop_covers_the_text(text, size, data):
    """Laws of the reference loop itself: pieces are bounded and keep every non-space character."""
    overlap = data.draw(st.integers(0, size - 1))
    pieces = plain_chunks(text, size, overlap)
    assert all(len(p) <= max(size, len(text.strip())) for p in pieces)
    assert set("".join(pieces)) - {" "} == set(text.strip()) - {" "}


def test_macro_chunks_drop_the_preface(ev):
    assert ev("pre\n# A\nfoo\n### x\n## B\nbar", lambda c: C.macro_chunks(c)) == ["# A\nfoo\n### x", "## B\nbar"]
    assert ev("x" * 7, lambda c: C.macro_chunks(c, 3)) == ["xxx", "xxx", "x"]


def plain_pack(sizes, limit):
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held + n > limit and i > start:
            out.append((start, i))
            start, held = i, 0
        held += n
    return out + ([(start, len(sizes))] if sizes and start < len(sizes) else [])


def test_greedy_ranges(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 12) for _ in range(rng.randint(0, 15))]) for i in range(100)]
    got = dict(spark.createDataFrame(rows, "i int, s array<bigint>").select("i", C.greedy_ranges(F.col("s"), 20)).collect())
    for i, sizes in rows:
        assert [(r.s, r.e) for r in got[i]] == plain_pack(sizes, 20)


def test_semantic_chunks(spark):
    d = spark.createDataFrame([("intro\n# A\nfoo\n## B\n" + "y\n" * 8 + "# C\nzz",), ("no heading\n\npara two\n\nlast",)], "x string")
    first, second = [r[0] for r in C.semantic_chunks(d, "x", limit=12).select("chunks").collect()]
    assert [c.text for c in first] == ["intro\n\n# A\nfoo", "## B\ny\ny\ny", "y\ny\ny\ny\ny", "# C\nzz"]
    assert [(c.start, c.stop) for c in first] == [(0, 14), (14, 24), (24, 33), (35, 41)]
    assert [c.heading for c in first] == ["# A", "## B", "## B", "# C"]
    assert [c.text for c in second] == ["no heading", "para two\n\nlast"]


def test_structure_chunks(ev):
    kind = "array<struct<type:string,text:string>>"
    blocks = [("title", "T1"), ("plain text", "a" * 10), ("table", "TT"), ("plain text", "b" * 60)]
    assert ev(blocks, lambda c: C.structure_chunks(c, 20, 25, 5), kind) == ["T1\n\n" + "a" * 10, "TT", "b" * 25, "b" * 25, "b" * 10]
    assert ev([("plain text", "c" * 30)], lambda c: C.structure_chunks(c, 20, 25, 5), kind) == ["c" * 25, "c" * 10]


def test_heading_candidates(ev):
    got = ev("x\n# A b\n**Bold**\ntext Part 1\nPart II here\n", C.heading_candidates)
    assert [(r.pos, r.line) for r in got] == [(2, "# A b"), (8, "**Bold**"), (29, "Part II here")]


def test_normalisation(ev):
    assert ev("牛 肉、製品（A）", T.normalize_for_matching) == "牛肉製品A"
    assert ev("　a\t ", T.strip) == "a"
    assert ev("a\x00\x0bb\tc", T.sanitize_for_storage) == "ab\tc"
    assert ev("# H\n![a](u) **b** `code` [t](l)\n| --- | --- |\nx|y", T.clean_markdown) == "H !a b t x y"
    assert ev("ＡＢ [x](ｈ) <ｂ>\n```\nＣ\n```\nＤ", T.nfkc) == "AB [x](ｈ) <ｂ>\n```\nＣ\n```\nD"


def test_language_share_is_strict(ev):
    assert ev("牛肉abcde", T.is_chinese) is False
    assert ev("牛肉abcd", T.is_chinese) is True


def test_question_ids(ev):
    for raw, want in (("Part_A 1", "Part A.1"), ("B..2_", "B.2"), ("1 . 2.", "1.2"), ("Part A 1", "Part A.1"), ("Chapter_II.3", "Chapter II.3")):
        assert ev(raw, ids.normalize_question_id) == want


def test_parameters():
    assert RetrievalParams(top_n=5).top_k == 30
    assert RetrievalParams(top_n=20).top_k == 45
    for bad in (lambda: RetrievalParams(top_n=0), lambda: RetrievalParams(threshold=1.5), lambda: AskParams(""), lambda: AskParams("q", 11)):
        with pytest.raises(ValueError):
            bad()


def test_candidates_with_any_character(ev):
    text = "intro \u0001 x\n# One\nbody\u0001\n**Bold\u0001 line**\nPart A of it\n" + "# " + "long " * 40 + "\nend"
    found = [(c["pos"], c["line"]) for c in ev(text, C.heading_candidates)]
    assert found == [(text.index(x), x) for x in ("# One", "**Bold\u0001 line**", "Part A of it")]
    every = [c["line"] for c in ev(text, lambda c: C.heading_candidates(c, None))]
    assert every == ["# One", "**Bold\u0001 line**", "Part A of it", ("# " + "long " * 40).strip()]
    assert ev("", C.heading_candidates) == [] and ev("# a", C.heading_candidates)[0]["pos"] == 0


def test_long_documents_are_cut_in_linear_time(spark):
    import time

    from dossier.functions import growing as G

    sizes = spark.range(1).select(F.array_repeat(F.lit(2), 12_000).alias("x"))
    start = time.perf_counter()
    sums = sizes.select(G.sums_before(F.col("x")).alias("s")).select(F.element_at("s", -1), F.element_at("s", 3), F.size("s")).first()
    assert tuple(sums) == (24_000, 4, 12_001)
    ranges = sizes.select(C.greedy_ranges(F.transform("x", lambda _: F.lit(7).cast("bigint")), 6, lone_over_limit=True).alias("r")).select(F.size("r"), F.element_at("r", -1)["e"]).first()
    assert tuple(ranges) == (12_000, 12_000)
    long = spark.createDataFrame([("# h\nline\n" * 6_000,)], "t string")
    n = C.semantic_chunks(long, "t", limit=100).select(F.size("chunks")).first()[0]
    assert n == 6_000 // 12 and time.perf_counter() - start < 60
