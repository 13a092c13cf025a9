"""Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns."""

import hashlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import chat, decontaminate, ledger, licenses, packing, quality, resemblance, secrets, shared, simhash, tokens, topk, vocabulary, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "Wörter über Wörter, " * 40_000
TEXTS = [None, "", "   \n\t", "a", "One two", LONG, "same text here", "same text here", "tail end <|endoftext|> x  y"]


def table(spark, texts, extra="found string, digest string, content string, version string, fp string, shard string"):
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    rows.append(rows[6] if len(rows) > 6 else rows[-1]) if rows else None
    rows.append((None, "null key", *[None] * len(names))) if rows else None
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stored_paths_and_names(spark, odd):
    assert shared.fresh_name(odd, "Found") == "_Found"
    assert shared.stored(odd, "odd").count() == odd.count()


def test_simhash_edges(spark, odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    want = brute.near_duplicates([p for p in dict.fromkeys(pairs(odd)) if p[0] is not None])
    assert {r for r in got if r[0] is not None} == want
    assert [r for r in got if r[0] is None][0][2] is None
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, _ in [(r[0], 0) for r in got if r[0] is not None and r[0] == r[2]])
    assert simhash.one_of_each(none).count() == 0


def resembling(rows, least=0.8):
    """rows: (doc_id, text) -> ids of each group that five-word sets with a resemblance of ``least`` or more lead to."""
    sets, group = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").translate(brute.LOWER).split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    for i, one in enumerate(sets):
        for n, other in enumerate(sets[:i]):
            if len(one & other) >= least * len(one | other):
                group = [group[n] if g == group[i] else g for g in group]
    return {frozenset(rows[i][0] for i, g in enumerate(group) if g == name) for name in group}


def edited(seed, bases=12, copies=12):
    """Texts with 0 to 5 words changed, so that resemblances lie on both sides of 0.8; the last base's copies are a large group."""
    draw = np.random.default_rng(seed)
    out = []
    for base in range(bases):
        words = [f"w{n}" for n in draw.integers(0, 5_000, int(draw.integers(60, 160)))]
        for _ in range(copies * (5 if base == bases - 1 else 1)):
            text = list(words)
            for at in draw.integers(0, len(text), int(draw.integers(0, 6))):
                text[at] = f"x{draw.integers(0, 5_000)}"
            out.append(" ".join(text))
    return out + ["", None, " \n", "four words are short", "FOUR words  are short", "four words are not"]


def test_near_copies_by_their_sets(spark):
    rows = list(enumerate(edited(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = resembling(rows)
    assert {len(g) for g in want} > {1} and len(want) < len(rows)
    found = {}
    for r in resemblance.groups(docs)[0].collect():
        found.setdefault(r["root"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in found.values()} == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(min(g) for g in want)


def test_sampled_fingerprints_are_simhash_of_shingles():
    hashes = resemblance.shingles(" ".join(f"w{n}" for n in range(300)))
    samples = [min(hashes.tolist(), key=lambda h: h * int(f) % 2**64) for f in resemblance._FACTORS]
    want = simhash._majority([samples[i:i + resemblance.ROWS] for i in range(0, len(samples), resemblance.ROWS)])
    assert (np.array(resemblance.bands(hashes)).view(np.uint64) ^ resemblance._TAGS).tolist() == want.tolist()
    assert resemblance.bands(hashes[:0]) == [] and len(set(resemblance.bands(hashes[:1]))) == resemblance.BANDS


def test_trees_bring_sampled_fingerprints_into_one_bucket(spark):
    random = np.random.default_rng(5).integers(0, 2**64, (120, 2), dtype=np.uint64)
    rows = []
    for i, (one, other) in enumerate(random):
        for k, bit in enumerate((None, 3, 40, 63)[: 1 + i % 4]):
            rows.append([int(v) ^ (1 << bit if bit is not None else 0) for v in (one, other)])
        # 16 bits of either half apart
        rows.append([int(one) ^ 0x00FF_0000_FF00_00FF, int(other) ^ 0xFFFF])
    signed = np.array(rows, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(n, 1, fps) for n, fps in enumerate(signed)], "node long, n long, bands array<long>")
    got = {}
    for r in resemblance._buckets(nodes).collect():
        got.setdefault(r["bucket"], []).append(r["node"])
    want = []
    for band in range(2):
        fps = [r[band] for r in rows]
        near = {n: {m for m, other in enumerate(fps) if (fps[n] ^ other).bit_count() <= 1} for n in range(len(fps))}
        seen = set()
        for n in near:
            group, ahead = set(), {n} - seen
            while ahead:
                group |= ahead
                ahead = set().union(*(near[m] for m in ahead)) - group
            seen |= group
            want += [sorted(group)] if group else []
    assert sorted(sorted(g) for g in got.values()) == sorted(want) and max(map(len, want)) == 4


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_buckets_over_batches(size):
    rows = [(1, 5), (2, 5), (2, 6), (2, 7), (3, 1), (4, 1), (5, 2), (5, 3), (6, 9)]
    table = pa.table({"bucket": [b for b, _ in rows], "node": [n for _, n in rows], "n": [10] * len(rows)})
    got = [tuple(r.values()) for b in resemblance._met(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
    assert got == [(1, 5, 10, -1), (2, 5, 10, -1), (2, 6, 10, 5), (2, 7, 10, 6), (5, 2, 10, -1), (5, 3, 10, 2), (6, 9, 10, -1)]


def test_block_links_equal_all_pairs():
    draw = np.random.default_rng(3)
    base = np.arange(100)
    sets = [np.unique(np.concatenate([draw.choice(base, 100 - int(draw.integers(0, 18)), replace=False), draw.integers(1_000, 9_000, int(draw.integers(0, 12)))])) for _ in range(60)]
    rows = [{"cluster": 1, "block": n % 2, "visitor": False, "needle": n > 5, "root": min(n, 3) if n < 6 else n, "hashes": s.tolist()} for n, s in enumerate(sets)]
    rows += [{**r, "block": 1 - r["block"], "visitor": True} for r in rows if r["needle"]]
    rows += [{**r, "cluster": 2, "root": r["root"] + 100} for r in rows[:2] if not r["visitor"]]
    rows.sort(key=lambda r: (r["cluster"], r["block"], r["visitor"]))

    def groups_of(links, nodes):
        group = {n: n for n in nodes}
        for a, b in links:
            group = {n: group[a] if g == group[b] else g for n, g in group.items()}
        return {frozenset(n for n in group if group[n] == g) for g in group.values()}

    def alike(one, other):
        common = len(np.intersect1d(one, other))
        return common >= 0.8 * (len(one) + len(other) - common)

    root = [min(n, 3) if n < 6 else n for n in range(60)]
    want = [(root[i], root[n]) for i in range(6, 60) for n in range(i) if alike(sets[i], sets[n])]
    nodes = {r["root"] for r in rows if r["cluster"] == 1}
    table = pa.Table.from_pylist(rows)
    for size in (1, 7, 1_000):
        got = [(r["a"], r["b"]) for b in resemblance._joined(table.to_batches(max_chunksize=size), 0.8) for r in b.to_pylist()]
        assert groups_of(got, nodes) == groups_of(want, nodes)
        assert len(got) < len(nodes)


def test_near_copies_without_a_fingerprint_in_common(spark):
    words = [f"w{n}" for n in range(764_539, 764_563)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(words[8:])), (4, "other words of a text that nothing is like")]
    one, other = (np.array(resemblance.bands(resemblance.shingles(rows[i][1]))).view(np.uint64) for i in (0, 1))
    assert resembling(rows) == {frozenset({1, 2}), frozenset({3}), frozenset({4})} and min(np.bitwise_count(one ^ other)) > resemblance.RADIUS
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_all_that_resemble_share_a_bucket(spark, least):
    draw = np.random.default_rng(8)
    passage = [f"p{n}" for n in range(15)]
    texts = [t for t in edited(9, bases=8, copies=6) if t and t.strip()]
    texts += [" ".join([*passage, *(f"q{n}" for n in draw.integers(0, 9_000, 60))]) for _ in range(40)] + [" ".join(passage[:n]) for n in range(1, 12)] + texts[:5]
    sets = {resemblance.shingles(t).tobytes(): resemblance.shingles(t) for t in texts}
    nodes = spark.createDataFrame([(n, len(s), bytearray(xxhash.xxh128_digest(k))) for n, (k, s) in enumerate(sets.items())], "node long, n long, set binary")
    docs = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string").repartition(5)
    buckets = {}
    for r in resemblance._shared_buckets(docs, "text", nodes, least).collect():
        buckets.setdefault(r["node"], set()).add(r["bucket"])
    own = [set(s.tolist()) for s in sets.values()]
    like = [(i, n) for i in range(len(own)) for n in range(i) if len(own[i] & own[n]) >= least * len(own[i] | own[n])]
    assert (len(like) > 30 or least == 1) and all(buckets[i] & buckets[n] for i, n in like)
    if least == 0.8:
        # the passage alone brings nothing together
        passages = set(resemblance.shingles(" ".join(passage)).tolist())
        assert sum(len(s) == 71 for s in own) >= 40 and not any(len(own[n]) == 71 and own[n] & passages for n in buckets)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_shared_shingles_over_batches(size):
    rows = [(-5, 1), (-5, 1), (1, 4), (1, 4), (1, 5), (1, 5), (1, 9), (2, 4), (3, 4), (3, 6), (3, 6)]
    table = pa.table({"token": [t for t, _ in rows], "id": [i for _, i in rows], "need": pa.array([i % 3 for _, i in rows], pa.int32())})
    got = [tuple(r.values()) for b in resemblance._shared(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
    assert got == [(1, 4, 1, 3), (1, 5, 2, 3), (1, 9, 0, 3), (3, 4, 1, 2), (3, 6, 0, 2)]


def test_near_copies_go_row_by_row(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a), (None, a + " more"), (None, "alone"), (None, b + " end"), (7, b), (7, "other text of seven"), (8, b), (None, None), (None, "")]
    kept = simhash.one_of_each(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in kept) == [(0, ""), (0, "a0"), (0, "al"), (7, "b0"), (7, "ot")]


def test_long_and_short_hash_lists_agree():
    hashes = simhash._hashes(LONG)
    assert simhash._long_majority(hashes)[0] == simhash._majority([hashes])[0] == brute.fingerprint(LONG)


@pytest.mark.parametrize("limit", [50_000, 40])
def test_all_links_are_found(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [np.uint64(int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4, 5)]
    crowd = [np.uint64(int(base[0]) ^ (1 << int(a)) ^ (1 << int(b))) for a in range(20) for b in range(a)]
    values = np.unique(np.concatenate([base, np.array(near), np.array(crowd)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in shared.components(simhash.near_links(fps)).collect()}
    group = {int(v): int(v) for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, v in enumerate(values):
        for m in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ v) <= 3):
            group[root(int(v))] = root(int(values[i + 1 + m]))
    signed = {int(v): int(np.uint64(v).astype(np.int64)) for v in values}
    want, mine = {}, {}
    for v in values:
        want.setdefault(root(int(v)), set()).add(int(v))
        mine.setdefault(got.get(signed[int(v)], signed[int(v)]), set()).add(int(v))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (5, 6)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, " ... "), (5, "lonely"), (None, "Null Item Id"), (1, "another text under id one which is long enough to be cut"), (10, "short item")]


@pytest.mark.parametrize("words", [2_000_000, 9])
def test_decontaminate_edges(spark, monkeypatch, words, odd, none):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [*TEXTS, "x " * 30 + "One, TWO three four five six seven eight nine ten eleven", "two three four five six seven eight nine ten eleven twelve twelve",
             "one two three four five six seven eight nine", "a short item, lonely; SHORT ITEM", "null item id", "one two three four five six seven eight nine ten " * 3]
    docs = table(spark, texts)
    got = {tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()}
    assert got == brute.contamination(pairs(docs), [("" if i is None else i, t) for i, t in ITEMS])
    clean = decontaminate.remove_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in got if not r[5]}
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).where("contaminated").count() == 0


def test_longest_match(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(5, 25)) + " c")], "doc_id long, text string")
    row = decontaminate.contamination(docs, items).first()
    assert (row["longest"], row["longest_item"], row["longest_at"], row["n_hit"]) == (20, "1", 2, 20)


def check_packed(pieces, rows, capacity):
    assert sum(p[2] for p in pieces) == sum(len(brute.token_ids(t)) + 1 for _, t in rows)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p[5], []).append((p[6], p[2]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_edges(spark, odd, none):
    pieces = [tuple(r) for r in packing.pack(odd, VOCABULARY, capacity=64).collect()]
    check_packed(pieces, pairs(odd), 64)
    assert [p[1:3] for p in pieces if p[0] == 0] == [(0, 1)]
    assert packing.pack(none, VOCABULARY).count() == 0


def test_packing_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "LAST_ROUND", 1_100)
    docs = spark.createDataFrame([(i, "word " * (i % 300)) for i in range(4_000)], "doc_id long, text string").repartition(24)
    pieces = [tuple(r) for r in packing.pack(docs, VOCABULARY).collect()]
    n = check_packed(pieces, pairs(docs), 1024)
    assert sum(p[2] for p in pieces) / (1024 * n) > 0.99
    assert len({p[5] >> 58 for p in pieces}) == 3


def test_harmonic_cuts():
    sizes = packing.harmonic_sizes(1024)
    assert sizes[:3] == [1024, 512, 341]
    for n in (1, 31, 32, 33, 700, 1023, 1024, 5000):
        assert sum(packing.cut(n, sizes)) == n
    assert all(1024 - size * (1024 // size) <= packing.WASTE for size in sizes)


def test_secrets_edges(spark, odd, none, tmp_path):
    book = f"file://{tmp_path}/ledger"
    texts = [*TEXTS, "password = 'hunter22' token=ab PASSWD:abcdefg", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "f" * 24 + " " + "0" * 23, "api_key: secret=abcdef", "token token=token=abcdef",
             "-----BEGIN RSA PRIVATE KEY----- x", "paſſword=abcdefgh", "ghp_" + "a" * 36]
    docs = table(spark, texts)
    rows = [r.asDict() for r in secrets.scan(docs, book).collect()]
    assert len(rows) == docs.count()
    texts_of = {}
    for i, t in pairs(docs):
        texts_of.setdefault(i, t)
    for r in rows:
        want, spans = brute.secrets(texts_of[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want
        assert set(spans) <= set(r["spans"].split(","))
    assert any("private_key" in r["spans"] for r in rows) and any("code_host" in r["spans"] for r in rows)
    # a second scan finds every blob in the ledger
    before = ledger.Ledger(spark, book, secrets.FINDINGS).rows(secrets.RULES_VERSION).count()
    assert before == len({t or "" for _, t in pairs(docs)})
    again = [r.asDict() for r in secrets.scan(docs, book).collect()]
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert ledger.Ledger(spark, book, secrets.FINDINGS).rows(secrets.RULES_VERSION).count() == before
    assert ledger.Ledger(spark, book, secrets.FINDINGS).rows("other rules").count() == 0
    assert secrets.scan(none, f"{book}-2").count() == 0


def test_masking(spark, tmp_path, none):
    docs = table(spark, [None, "", "clean", "password=abcdefgh end", "é token: 'AKIA" + "A" * 16 + "' z", "clean", "clean"])
    got = secrets.mask(docs, f"file://{tmp_path}/m")
    assert got.columns == docs.columns
    assert [r["text"] for r in got.where("doc_id IN (0, 1, 2)").orderBy("doc_id").collect()] == [None, "", "clean"]
    assert got.where("doc_id = 3").first()["text"] == "[secret] end"
    assert got.where("doc_id = 4").first()["text"] == "é [secret]' z"
    assert got.count() == docs.count()
    assert secrets.mask(none, f"file://{tmp_path}/n").count() == 0


BODY = ["MIIEowIBAAKCAQEA" + "aB3/+9xZ" * 6] * 4


@pytest.mark.parametrize("owner, line, head", [("RSA ", "\n", ""), ("", "\r\n", ""), ("ENCRYPTED ", "\\n", ""), ("EC ", "\n    ", ""), ("OPENSSH ", "\n> ", ""), ("RSA ", "\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F3A\n")])
def test_whole_keys_are_masked(spark, tmp_path, owner, line, head):
    begin, end = f"-----BEGIN {owner}PRIVATE KEY-----", f"-----END {owner}PRIVATE KEY-----"
    body = line.join([*BODY, "Qx7="])
    closed, cut = f"{begin}{head}{line}{body}{line}{end}", f"{begin}{head}{line}{body}"
    other = f"-----END X{owner}PRIVATE KEY-----"
    texts = [f"see {closed} there", f"see {cut}\nand then more", f"{cut}\n\n{closed}\n{end}", f"{cut}\n{other} tail", f"the line {begin} alone", cut]
    m = secrets.MASK
    want = [f"see {m} there", f"see {m}\nand then more", f"{m}\n\n{m}\n{end}", f"{m}\n{other} tail", f"the line {m} alone", m]
    got = secrets.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/keys")
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == want


def test_long_logins_and_broken_keys_take_linear_time():
    login = "https://" + "u" * 5_000 + ":" + "p" * 5_000 + "@"
    assert secrets.find(f"at {login}host") == [(3, 3 + len(login), "url_login")]
    begin = "-----BEGIN PRIVATE KEY-----"
    for text in (begin * 5_000, (begin + " \n" * 20) * 500, begin + "\n \n" * 50_000 + "x", "https://" + "u" * 500_000):
        assert len(secrets.find(text)) == text.count(begin)


def test_topk_edges(spark):
    big = 3e38
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [-1.0, 0.01]), (7, []), (8, [0.25]), (9, [0.0, 0.0]), (None, [1.0, 1.0]), (40, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=4).collect()]
    padded = [(i, [*v, *[0.0] * (2 - len(v))] if v is not None else None) for i, v in rows if i is not None]
    want = brute.top_k(padded, k=4)
    assert sorted(got) == sorted(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0
    assert topk.top_k(vectors, vectors.where("false")).count() == 0
    huge = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in topk.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]


class Sent:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("dense", [0.0, 0.25, 1.0])
def test_topk_blocks_and_postings(monkeypatch, dense):
    monkeypatch.setattr(topk, "SCORES", 50)
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(3)
    whole = np.where(rng.random((130, 6)) < 0.5, 0, rng.integers(-40, 40, (130, 6)))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, j)), pa.array(whole[i:j].tolist(), pa.list_(pa.int64()))], ["vec_id", "weights"]) for i, j in ((0, 50), (50, 51), (51, 130))]
    asked = np.arange(0, 130, 5)
    out = list(topk._ranked(iter(batches), Sent((np.arange(len(asked)), asked, whole[asked].astype(float))), 6))[0]
    got = {}
    for q, v, score in zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist(), out["score"].to_pylist()):
        got.setdefault(q, []).append((-score, v))
    for q in asked.tolist():
        assert sorted(got[q]) == sorted((-int(whole[q] @ whole[v]), v) for v in range(130) if v != q)[:6]
    vectors, weights = whole.astype(float), whole[asked].astype(float)
    assert (topk.Postings(vectors).scores(weights) == weights @ vectors.T).all()
    assert (topk._whole_scores(weights, vectors) == weights @ vectors.T).all()


def test_topk_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(130)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 5 = 0"), k=6).collect()]
    assert sorted(got) == sorted(brute.top_k(rows, k=6, every=5))


def test_licenses_edges(spark, odd, none):
    mit = licenses.TEMPLATES[0][1]
    texts = [*TEXTS, "cc by", "CC-BY cc by 4.0 all rights reserved. All Rights Reserved", "general public license general public", "x " + mit.upper() + " y", " ".join(mit.split()[:12]), "all rights cc by all rights reserved cc",
             mit[:150] + " filler words here " + mit[150:]]
    docs = table(spark, texts)
    texts_of = dict(pairs(docs))
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:6] == brute.licenses(texts_of[r["doc_id"]])
    rows = {r["doc_id"]: r for r in got}
    assert rows[12]["labels"] == "mit" and rows[12]["score"] == 1.0 and rows[12]["spans"][0]["start"] == 1
    assert rows[13]["labels"] == "" and rows[15]["labels"] == "mit" and rows[15]["spans"][0]["cover"] > 0.9
    assert licenses.scan(none).count() == 0


def test_matching_statistics_are_longest_runs():
    rng = np.random.default_rng(1)
    sequences = [[int(x) for x in rng.integers(0, 4, 30)] for _ in range(4)]
    sam = licenses.Automaton(sequences)
    runs = {tuple(s[i:j]): None for s in sequences for i in range(30) for j in range(i + 1, 31)}
    text = [int(x) for x in rng.integers(0, 5, 400)]
    state = length = 0
    for at, word in enumerate(text):
        state, length = sam.step(state, length, word)
        longest = max((k for k in range(1, 31) if k <= at + 1 and tuple(text[at + 1 - k:at + 1]) in runs), default=0)
        assert length == longest
        if length:
            run = text[at + 1 - length:at + 1]
            assert sam.ends[state] == {(i, j) for i, s in enumerate(sequences) for j in range(length, 31) if s[j - length:j] == run}


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", r"a\b### x: </turn> <t> ünï"), (1, 1, "assistant", "same turn"), (1, None, "system", None), (2, 5, None, ""), (2, 5, None, ""),
         (None, 0, "assistant", "nobody's\n"), (3, 0, "we:ird\nrole###", "x" * 3000), (3, 1, "assistant", "\\"), (3, 2, "assistant", "\\\\n")]


@pytest.mark.parametrize("size", [8_000_000, 40])
def test_fragments_join_to_the_same_text(monkeypatch, size):
    monkeypatch.setattr(chat, "FRAGMENT_BYTES", size)
    monkeypatch.setattr(chat, "TaskContext", Sent(None))
    monkeypatch.setattr(chat.TaskContext, "get", lambda: Sent(None), raising=False)
    monkeypatch.setattr(Sent, "partitionId", lambda self: 2, raising=False)
    turns = [(1, i, ("user", "assistant")[i % 2], f"# turn {i} ü\\n" * 3) for i in range(20)] + [(2, 0, "assistant", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*turns)], ["conv_id", "turn", "role", "text"])
    rows = [r for out in chat._formatted(iter([batch])) for r in out.to_pylist()]
    assert (len(rows) > 2) == (size == 40) and [r["part"] for r in rows] == sorted(r["part"] for r in rows)
    whole = "".join(r["formatted"] for r in rows if r["conv_id"] == 1)
    assert chat.parse(whole) == [(r, t) for c, _, r, t in turns if c == 1]
    assert "".join(chat.plain(r["formatted"][s["start"]:s["end"]]) for r in rows for s in r["loss"]) == "".join(t for _, _, r, t in turns if r == "assistant")


def test_chat_edges(spark):
    turns = spark.createDataFrame([(*t, "p") for t in TURNS], "conv_id long, turn long, role string, text string, part string").repartition(3)
    fragments = chat.format_chats(turns)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(fragments).collect()}
    want = {}
    for t in sorted(TURNS, key=lambda t: (t[0] or 0, -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        want.setdefault(t[0], []).append((t[2], t[3]))
    assert got == {c: brute.chat(t) for c, t in want.items()}
    whole = "".join(r["formatted"] for r in fragments.where("conv_id = 1").orderBy("part").collect())
    assert [r for r, _ in chat.parse(whole)] == ["system", "user", "assistant", "assistant"]
    assert chat.digests(chat.format_chats(turns.where("false"))).count() == 0


def test_chat_spread_over_tasks(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * 20) for i in range(3000)] + [(c, 0, "user", "x") for c in range(2, 40)]
    fragments = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert fragments.where("conv_id = 1").count() > 1
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(fragments).collect()}
    assert got[1] == brute.chat([(r, t) for c, _, r, t in turns if c == 1])


def test_broken_chat_text_is_an_error():
    with pytest.raises(ValueError):
        chat.parse("### user:\nopen")


def test_tokens_edges(spark, odd, none, tmp_path):
    cache = f"file://{tmp_path}/cache"
    got = sorted((tuple(r) for r in tokens.token_counts(odd, VOCABULARY, cache).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(brute.token_ids(t)), n > 1024) for i, t in pairs(odd)), key=str)
    assert got == want
    book = ledger.Ledger(spark, cache, tokens.COUNT_COLUMNS)
    assert book.rows(vocabulary.file_digest(VOCABULARY)).count() == len({t or "" for _, t in pairs(odd)})
    assert sorted((tuple(r) for r in tokens.token_counts(odd, VOCABULARY, cache).collect()), key=str) == want
    assert len(book._finished()) == 2 and book.rows(vocabulary.file_digest(VOCABULARY)).count() == len({t or "" for _, t in pairs(odd)})
    assert tokens.token_counts(none, VOCABULARY, f"{cache}-2").count() == 0


@pytest.mark.parametrize("text", ["a  b", "\n b", "a \nb", "a\n \nb", "  a ", "\x1c b \x85", "x<|endoftext|> y", "it's 'll", "漢字 かな", "é" * 3000, "a" * 5000, "​  ", "🙂 x", "ǅ ʰ ٣ ½"])
def test_encoders_agree(text):
    encode = vocabulary.encoder(VOCABULARY)
    assert encode.ids(text).tolist() == brute.token_ids(text)
    assert encode.count(text) == len(brute.token_ids(text))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name, tmp_path):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, path, f"file://{tmp_path}/c").collect()}
    assert got[2] == 0 and got[1] == len(vocabulary.encoder(path).ids("Hello  world")) > 1


def test_ledger_folds_batches_of_two_writers(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/b", "n long")
    row = spark.createDataFrame([("d", "v", 1)], "digest string, version string, n long")
    book.append(row)
    book.append(row)
    assert book.rows("v").count() == 1


def labelled(spark, n=900):
    rng = np.random.default_rng(11)
    common = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        kind = i % 5
        words = [common[j] for j in rng.integers(0, 300, 60)]
        if kind == 3:
            words = [f"{w.upper()}!!" for w in words]
        if kind == 4:
            words[7] = words[20] = "vileword"
        docs.append((i, " ".join(words), "odd" if i % 3 == 0 else f"host{i % 7}", "en"))
        if i % 2 == 0:
            labels.append((i, int(kind != 3), int(kind == 4)))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    out = quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    held = [r for r in out if r["doc_id"] % 2]
    right = sum(r["accepted"] == (r["doc_id"] % 5 not in (3, 4)) for r in held)
    assert right / len(held) > 0.97
    kept = quality.keep_accepted(docs, labels, F.col("source"), F.col("lang"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["accepted"]}


def test_sparse_sites_shrink(spark):
    rows = [("a", "p", 0.9)] * 400 + [("a", "q", 0.9)] * 400 + [("b", "p", 0.1)] * 400 + [("b", "q", 0.1)] * 2 + [("c", "p", 0.0)] + [(None, None, 0.5)]
    sites, overall = quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    rate = {(r["host"], r["path"]): r["site_rate"] for r in sites.collect()}
    assert abs(rate["a", "p"] - 0.9) < 0.02 and abs(rate["b", "p"] - 0.1) < 0.02
    assert rate["c", "p"] > 0.02 and abs(rate["b", "q"] - 0.1) < 0.1
    assert (None, None) in rate and 0.4 < overall < 0.8


def test_quality_edges(spark, odd, none):
    docs = odd.withColumn("source", F.when(F.col("doc_id") > 2, "s")).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(0, 0, 0), (4, 1, 0), (5, 1, 1), (5, 0, 1), (None, 1, 0), (6, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels, F.col("source"), F.col("lang")).count() == docs.count()
    kept = quality.keep_accepted(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns
    assert quality.classify(docs, labels.where("false"), F.col("source"), F.col("lang")).count() == docs.count()
    blank = none.withColumn("source", F.lit("s")).withColumn("lang", F.lit("l"))
    assert quality.classify(blank, labels, F.col("source"), F.col("lang")).count() == 0


PAGES = [(1, "http://a.example/x", "<html lang='en'><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- c --><p>One<br>two &lt;b&gt;<p class=\">\">thr<b>ee</b></p><a href='/l?a=1&amp;b=2'>l</a></body>"),
         (2, None, None), (3, "u", ""), (4, "u\nv", "plain\ntext"), (4, "u\nv", "plain\ntext"), (None, "n", "<p>open <b")]


def test_rows_without_keys_are_accepted_one_by_one(spark):
    docs, labels = labelled(spark)
    without, shared_key = (docs.withColumn("doc_id", F.lit(k).cast("long")) for k in (None, -5))
    rows = docs.join(labels, "doc_id", "left_semi").union(without).union(shared_key).withColumn("shown", F.col("text"))
    verdicts = quality.classify(rows, labels, F.col("source"), F.col("lang"), carried=("shown",)).where("doc_id IS NULL OR doc_id = -5")
    want = sorted((r["doc_id"] or 0, r["shown"]) for r in verdicts.where("accepted").collect())
    assert 0 < len(want) < verdicts.count()
    kept = quality.keep_accepted(rows, labels, F.col("source"), F.col("lang")).where("doc_id IS NULL OR doc_id = -5")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == want


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, block string")
    found = warc.responses(pages, "2024-01-01T00:00:00Z")
    records = warc.derive(found)
    rows = records.collect()
    assert len(rows) == 2 * len(PAGES)
    first = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    response = found.where("page_id = 1").first()
    assert first["conversion"]["block"] == "One\ntwo <b>\nthree\nl"
    assert {r["refers_to"] for r in first.values()} == {response["record_id"]}
    assert first["conversion"]["source_digest"] == warc.digest(response["body"].encode())
    for line in ("title: T & t", "language: en", "outlink: /l?a=1&b=2", "source-header: HTTP/1.1 200 OK", f"converted-to: {first['conversion']['record_id']}"):
        assert line in first["metadata"]["block"].split("\r\n")
    warc.write_warc(records, f"{tmp_path}/out")
    read = [rec for p in sorted((tmp_path / "out").glob("*.gz")) for rec in warc.parse_records(p.read_bytes())]
    assert sorted((h["WARC-Record-ID"], h["WARC-Refers-To"], block) for h, block in read) == sorted((r["record_id"], r["refers_to"], r["block"].encode()) for r in rows)
    assert all(h["WARC-Block-Digest"] == warc.digest(block) for h, block in read)
    assert warc.derive(found.where("false")).count() == 0


def test_responses_are_read_from_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>hello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc").write_bytes(record * 2)
    rows = warc.derive(warc.read_responses(spark, f"file://{tmp_path}/a.warc")).collect()
    assert [r["block"] for r in rows if r["record_type"] == "conversion"] == ["hello"] * 2


def test_escaping_is_columnar_and_reversible():
    values = pa.array(["a#b", "", "\\", "ü<:>#" * 3, "plain"])
    data, at = chat.escaped(values[1:])
    parts = [bytes(data[i:j]).decode() for i, j in zip(at[:-1], at[1:])]
    assert [chat.plain(p) for p in parts] == values[1:].to_pylist()
    assert hashlib.sha256(bytes(data)).hexdigest()


@pytest.mark.parametrize("kind, values", [("long", [None, 0, -1, *range(10, 60)]), ("string", [None, "", *(f"k{n}" for n in range(50))])])
def test_screened_rows_keep_every_key(spark, monkeypatch, kind, values):
    other = range(10_000, 14_000) if kind == "long" else [f"o{n}" for n in range(4_000)]
    docs = spark.createDataFrame([(v, "x", n) for n, v in enumerate([*values, *values, *other])], f"_at {kind}, _block string, n int")
    keys = spark.createDataFrame([(v,) for v in values] * 2, f"k {kind}")
    for most in (shared.FILTER_MOST, 1_024):  # the second has more keys than bits for them
        monkeypatch.setattr(shared, "FILTER_MOST", most)
        monkeypatch.setattr(shared, "FILTER_BLOCK", min(most, shared.FILTER_BLOCK))
        maybe, never = shared.screened(docs, F.col("_at"), keys, "k")
        assert maybe.columns == never.columns == docs.columns
        n = [{r["n"] for r in part.collect()} for part in (maybe, never)]
        assert set(range(2 * len(values))) <= n[0] and len(n[0]) + len(n[1]) == docs.count() == len(n[0] | n[1])
        assert len(n[0]) < 2 * len(values) + 0.2 * len(other)
    assert shared.screened(docs, F.col("_at"), keys.where("false"), "k")[0].count() == 0


def test_only_texts_that_may_be_met_are_joined(spark, tmp_path, monkeypatch):
    """However large the other side: without broadcasts of tables, as in a large run."""
    parts = []

    def recorded(*args):
        parts.append(shared.screened(*args))
        return parts[-1]

    texts = [" ".join(f"{d}w{n}" for n in range(40)) for d in range(300)]
    texts[7], texts[90] = texts[7] + " password=abcdefgh", texts[5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(secrets, "screened", recorded)
    monkeypatch.setattr(resemblance, "screened", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        masked = {r["doc_id"]: r["text"] for r in secrets.mask(docs, f"file://{tmp_path}/m").collect()}
        kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert masked == {d: t.replace("password=abcdefgh", "[secret]") for d, t in enumerate(texts)}
    assert kept == [d for d in range(300) if d != 90]
    assert len(parts) == 3 and all(maybe.count() < 30 for maybe, _ in parts)


def test_only_sets_that_lead_many_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "LED", 20)
    pairs = spark.createDataFrame([(1, b) for b in range(100, 150)] + [(a, a + 1_000) for a in range(2, 12)], "a long, b long")
    rows = {n: [n, n + 1] for p in pairs.collect() for n in p}
    sets = spark.createDataFrame(list(rows.items()), "node long, hashes array<long>")
    salted, heads = resemblance._dealt(pairs, sets)
    copies = {r["a"]: r["count"] for r in heads.groupBy("a").count().collect()}
    assert copies == {1: resemblance.SALTS} | dict.fromkeys(range(2, 12), 1)
    assert sorted((r["a"], r["b"]) for r in salted.join(heads, ["a", "salt"]).collect()) == sorted(map(tuple, pairs.collect()))
    assert salted.where("a = 1").select("salt").distinct().count() > 1
