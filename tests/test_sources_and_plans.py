import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from dossier import models
from dossier.operators import match as M
from dossier.params import RetrievalParams
from dossier.plans import ask as A
from dossier.plans import breakdown as B
from dossier.plans import ingest as G
from dossier.plans import mining as P
from dossier.sources import readers, sinks
from dossier.streaming.logs import start_log


def test_page_selection():
    assert readers.page_selection(None) == (None, "")
    assert readers.page_selection(3) == ([3], "_page3")
    assert readers.page_selection((2, 4)) == ([2, 3, 4], "_pages2-4")
    assert readers.page_selection([5, 1, 5]) == ([1, 5], "_pages1_5")
    for bad in (0, (3, 2), [0], "x"):
        with pytest.raises(ValueError):
            readers.page_selection(bad)


def test_file_pairs(spark):
    stems = ["doc_CHT", "doc_EN", "x_EN", "r (中文)", "r(eng)", "plain"]
    f = spark.createDataFrame([("d", s, s, i) for i, s in enumerate(stems)], "folder string, stem string, path string, ord int")
    assert {(r.prefix, r.zh_path, r.en_path) for r in readers.pair_files(f).collect()} == {("doc", "doc_CHT", "doc_EN"), ("r", "r (中文)", "r(eng)")}


def test_library_and_conversion(spark, tmp_path):
    for p in ("QA/a.md", "REGULATION/sub/b.MD", "OTHER/c.md", "QA/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("# x")
    files = readers.scan_library(spark, str(tmp_path))
    assert sorted(r.doc_type for r in files.collect()) == ["QA", "REGULATION"]

    def convert(path, raw):
        if path.endswith("MD"):
            raise ValueError("bad")
        return raw.decode()

    got = readers.to_markdown(files, convert).collect()
    assert sorted((r.markdown, r.error) for r in got if r.error is None) == [("# x", None)] and any(r.error == "bad" for r in got)
    pages = readers.expand_files(files, lambda p, raw: [raw, raw]).collect()
    assert sorted({r.page_no for r in pages}) == [1, 2]


def test_chunk_table_replacement_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "parent_id string, chunk_idx int, chunk_text string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "parent_id string")
    sinks.write_chunks(spark, path, rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")), keys("a", "b"), buckets=4)
    for _ in range(2):
        sinks.write_chunks(spark, path, rows(("a", 0, "new")), keys("a", "c"), buckets=4)
    read = lambda: {(r.parent_id, r.chunk_idx, r.chunk_text) for r in spark.read.parquet(path).collect()}
    assert read() == {("a", 0, "new"), ("b", 0, "z")}
    sinks.write_chunks(spark, path, rows(("q", 0, "q")).where("false"), keys("b"), buckets=4)
    assert read() == {("a", 0, "new")}


def test_exports_and_dead_letters(spark, tmp_path):
    t = spark.createDataFrame([("牛", "beef", 3, ["u", "v"], ["f"])], "zh string, en string, count int, units array<string>, sources array<string>")
    assert sinks.write_terms_csv(t, str(tmp_path / "csv")) and not sinks.write_terms_csv(t.where("false"), str(tmp_path / "none"))
    parts = [open(f, "rb").read() for f in glob.glob(str(tmp_path / "csv" / "part-*"))]
    assert all(p.startswith(b"\xef\xbb\xbf") for p in parts) and any("u、v".encode() in p for p in parts)
    assert not os.path.exists(tmp_path / "none")
    d = spark.createDataFrame([("d1", 0, 1, "p" * 3000)], "document_id string, unit_index int, total_units int, text string")
    rec = sinks.dead_letters(d, "extract", "text", F.lit("e"), F.lit("C001"), include_raw=True)
    assert rec.first().raw_payload == d.first().text and len(sinks.dead_letters(d, "extract", "text", F.lit("e"), F.lit("C001"), True, 7).first().raw_payload) == 7
    assert len(rec.first().raw_payload_sha256) == 64
    assert sinks.write_dead_letters(rec, str(tmp_path / "dlq")) and not sinks.write_dead_letters(rec, str(tmp_path / "off"), enabled=False)
    assert spark.read.json(str(tmp_path / "dlq")).first().status == "needs_review"


def test_query_log_stream(spark, tmp_path):
    spark.createDataFrame([("a\x01b",)], "question string").write.json(str(tmp_path / "in"))
    rows = spark.readStream.schema("question string").json(str(tmp_path / "in"))
    start_log(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.question for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["ab"]


def test_ingest_and_knowledge_tables(spark):
    items = spark.createDataFrame([("i1", "t" * 600, "r", None), ("i2", "x", None, 1)], "item_id string, title string, reply string, is_deleted int")
    rows = G.ingest_questionnaires(items, models.HashingEmbedder(16)).collect()
    assert sorted((r.item_id, r.chunk_source, r.chunk_idx) for r in rows) == [("i1", "answer", 0), ("i1", "question", 0), ("i1", "question", 1)]
    assert all(len(r.embedding) == 16 for r in rows)
    docs = spark.createDataFrame([(1, "text", "n", "p")], "doc_id bigint, text string, doc_name string, file_path string")
    model = lambda ps: ['[{"doc_type":"QA","header_path":"H","content":"body"},{"doc_type":"X","header_path":"H","content":"b"}]' for _ in ps]
    tables = G.knowledge_tables(docs, G.extract_nodes(docs, model))
    assert tables["chunk"].first().chunk_text == "[H]\nbody" and tables["master"].first().doc_type == "QA"


def test_mining_stems_aliases_and_expansion(spark):
    terms = spark.createDataFrame([("牛肉及其製品", 0), ("農藥殘留標準規定", 1)], "term string, ord bigint")
    model = lambda ps: ['[{"original": "農藥殘留標準規定", "stem": "農藥殘留"}]' for _ in ps]
    assert {(r.stem, r.official) for r in P.mine_stems(terms, model).collect()} == {("牛肉", "牛肉及其製品"), ("農藥殘留", "農藥殘留標準規定")}
    units = spark.createDataFrame([(0, "A", "u", "通關")], "ord int, agency string, unit string, keywords string")
    said = lambda ps: ['[{"aliases": ["報關", "機關", "x", "通關"]}, {"aliases": ["多"]}]' for _ in ps]
    assert {(r.keyword, r.alias) for r in P.mine_aliases(units, said).collect()} == {("通關", "報關")}
    assert P.expand_keywords(units, lambda ps: ['ok ["a", "b"]' for _ in ps]).first().extended == ["a", "b"]


def test_ask_end_to_end(spark):
    emb = models.HashingEmbedder(64)
    base = spark.createDataFrame([(1, "牛肉輸出檢疫規定說明"), (2, "天氣與旅遊介紹")], "parent_id bigint, chunk_text string")
    chunks = models.embed(base, "chunk_text", emb).select(F.col("parent_id").alias("chunk_pk"), "parent_id", F.lit("question").alias("chunk_source"), F.lit(0).alias("chunk_idx"), "chunk_text", "embedding")
    items = spark.createDataFrame([(1, 0, "m", "牛肉輸出", "檢疫證明", "1"), (2, 1, "m", "旅遊", "x", "2")], "parent_id bigint, is_deleted int, master_id string, title string, reply string, item_no string")
    masters = spark.createDataFrame([("m", "M")], "master_id string, master_name string")
    files = spark.createDataFrame([("m", "/f.pdf", None), ("m", "", 0)], "master_id string, file_path string, is_deleted int")
    patterns = M.dictionary_patterns(M.load_dictionary(spark.createDataFrame([("牛肉", "beef", 0)], "zh string, en string, ord bigint")))
    units = spark.createDataFrame([(0, "農業部", "畜牧司", "牛肉", None)], "ord int, agency string, unit string, keywords string, extended array<string>")
    q = spark.createDataFrame([(1, "牛肉輸出檢疫規定")], "query_id int, question string")
    out = A.ask(q, A.Corpus(chunks, items, masters, files), patterns, M.intent_patterns(units), emb, models.EchoAnswer(), params=RetrievalParams(threshold=1.0))
    a = out["answers"].first()
    assert "Q: 牛肉輸出\nA: 檢疫證明" in a.prompt and "<en>beef</en>" in a.prompt and a.english == a.chinese_answer == "牛肉輸出檢疫規定"
    assert [(r.agency, r.unit) for r in out["routes"].collect()] == [("農業部", "畜牧司")]
    assert [r.file_path for r in out["attachments"].collect()] == ["/f.pdf"]
    label = A.route_label(out["routes"]).first()
    assert (label.intent_method, label.agencies) == ("keyword", "農業部")


def test_map_as_one_json_object(spark, tmp_path):
    pairs = spark.createDataFrame([(f"k{i % 7}", f'v "{i}"\n') for i in range(20)] + [(None, "x"), ("n", None)], "k string, v string").repartition(3)
    for name, df in (("m", pairs), ("none", pairs.where("false"))):
        sinks.write_json_object(df, "k", "v", str(tmp_path / name))
        (part,) = [p for p in (tmp_path / name).iterdir() if p.name.startswith("part-")]
        loaded = json.loads(part.read_text(encoding="utf-8"))
        want = {}
        for r in df.collect():
            if r["k"] is not None:
                want[r["k"]] = max(filter(None, [want.get(r["k"]), r["v"]]), default=None)
        assert loaded == want and list(loaded) == sorted(loaded)
    assert {(r["key"], r["value"]) for r in readers.json_map(spark, str(tmp_path / "m")).collect()} == set(json.loads(next((tmp_path / "m").glob("part-*")).read_text()).items())


def test_cached_pages_come_in_order(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"two")], "path string, content binary")
    key = files.where("path = 'a'").select(readers.image_key(F.col("content"))).first()[0]
    cache = spark.createDataFrame([(key, n, f"image{n}".encode()) for n in (10, 2, 1)], "file_md5 string, page_no int, image binary")
    got = {r["path"]: [p["page_no"] for p in r["pages"]] for r in readers.cached_pages(files, cache).collect()}
    assert got == {"a": [1, 2, 10], "b": []}


def test_terms_of_several_texts(spark):
    patterns = M.dictionary_patterns(spark.createDataFrame([(0, "食品", "food"), (1, "出口", "export")], "ord bigint, zh string, en string"), None)
    texts = spark.createDataFrame([(1, "食品", "出口"), (2, "", "食品"), (3, None, None), (4, "食", "品")], "id int, a string, b string")
    got = {r["id"]: {t["en"] for t in r["terms"]} for r in A.dictionary_terms(texts, "id", ["a", "b"], patterns).collect()}
    assert got.get(1) == {"food", "export"} and got.get(2) == {"food"} and 3 not in got


def test_translation_and_routing_by_a_model(spark):
    patterns = M.dictionary_patterns(spark.createDataFrame([(0, "食品", "victuals")], "ord bigint, zh string, en string"), None)
    texts = spark.createDataFrame([(1, "食品安全"), (2, "其他")], "id int, text string")
    got = {r["id"]: r["english"] for r in A.to_english(texts, patterns, lambda prompts: [f" terms: {'victuals' in p} " for p in prompts]).collect()}
    assert got == {1: "terms: True", 2: "terms: False"}
    units = M.intent_patterns(spark.createDataFrame([(0, "A", "u1", "水產", None)], "ord bigint, agency string, unit string, keywords string, extended array<string>"))
    profile = spark.createDataFrame([("A", "u1", "水產", 0), ("B", "u2", "肉品", 1)], "agency string, unit string, keywords string, place int")
    asked = spark.createDataFrame([(1, "水產如何"), (2, "別的")], "query_id int, chinese string")

    def model(prompts):
        return ['<JSON_Result>[{"機關": "B", "單位": "u2", "理由": "' + ("known" if "肉品" in p else "unknown") + '"}]</JSON_Result>' for p in prompts]

    rows = {(r["query_id"], r["method"]): (r["agency"], r["unit"], r["rank"]) for r in A.routed(asked, units, profile, model, 2).collect()}
    assert rows[1, "keyword"] == ("A", "u1", 1) and rows[2, "model"] == ("B", "u2", 1) and rows[1, "model"][2] == 2


def test_documents_that_nothing_can_be_read_of(spark):
    pages = spark.createDataFrame([(1, 1, "bad"), (1, 2, "bad"), (2, 1, "bad"), (2, 2, "1.1 fine text")], "doc_id bigint, page int, image string")

    def model(prompts, images):
        if images[0][0] == "bad":
            raise RuntimeError("unreadable")
        return ['[{"question_id": "1.1", "question_text": "fine text"}]']

    out = B.breakdown_pages(pages, model)
    assert [r["doc_id"] for r in out["failed"].collect()] == [1] and out["failures"].count() == 3
    with pytest.raises(RuntimeError, match="documents 1"):
        B.require_answers(out)
    assert B.require_answers({"failed": out["failed"].where("false")})


def test_large_json_maps_are_read_by_many_tasks(spark, tmp_path):
    odd = ['a, "b"', "[1, {", "} ] ,,", "back\\\\slash, \\\\", "new\nline, tab\t", "", "ünïcode, 漢字, 😀", ",", '"', '\\\\"']
    want = {f"key, {i} {odd[i % len(odd)]}": odd[(i * 7) % len(odd)] + f" {i}" for i in range(3_000)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "map.json").write_text(json.dumps(want, ensure_ascii=False, indent=1), encoding="utf-8")
    nested = {"a": ["x, y", "z"], "b": {"c": [1, 2], "d": "}"}, "e": 3, "f": None, "g": "plain"}
    (tmp_path / "in" / "nested.json").write_text(json.dumps(nested), encoding="utf-8")
    (tmp_path / "in" / "empty.json").write_text(" {} ")
    (tmp_path / "in" / "none.json").write_text("not, json")
    (tmp_path / "in" / "cut.json").write_text('{"a": "x", "b": ')
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 16_384)
        got = {}
        for r in readers.large_json_map(spark, str(tmp_path / "in")).orderBy("ord").collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["key"]] = r["value"]
        assert spark.read.text(str(tmp_path / "in" / "map.json")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got.keys() == {"map.json", "nested.json"}
    assert got["map.json"] == want and list(got["map.json"]) == list(want)
    assert {k: v if k == "g" or v is None else json.loads(v) for k, v in got["nested.json"].items()} == nested
    (tmp_path / "tail.json").write_text('{"a": "x"}, {"b": "y"}')
    with pytest.raises(Exception, match="behind the JSON object"):
        readers.large_json_map(spark, str(tmp_path / "tail.json")).collect()
