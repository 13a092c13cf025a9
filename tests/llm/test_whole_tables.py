"""Whole small tables: site posteriors, archive records and every stage of the pipeline against plain readings."""

import base64
import hashlib
import html.parser
import os
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import quality, queries, secrets
from dossier.llm.shared import stored

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def logit(p):
    return np.log(p / (1 - p))


def strength(n, s, mean):
    """Prior strength by moments, from the spread of the groups' rates."""
    within = mean * (1 - mean)
    seen, chance, room = (n * (s / n - mean) ** 2).sum(), within.sum(), ((n - 1) * within).sum()
    if room <= 0 or seen <= chance:
        return quality.STRONGEST
    return float(np.clip(room / (seen - chance) - 1, quality.WEAKEST, quality.STRONGEST))


def test_site_posteriors(spark):
    rows = queries.QUERIES["op1_quality"](spark, DATA).collect()
    good = {r["doc_id"]: float(r["quality"] > 0) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    paths = defaultdict(lambda: [0.0, 0.0])
    for r in rows:
        paths[r["host"], r["path"]][0] += 1
        paths[r["host"], r["path"]][1] += good.get(r["doc_id"], r["doc_score"])
    hosts = defaultdict(lambda: [0.0, 0.0])
    for (host, _), (n, s) in paths.items():
        hosts[host][0] += n
        hosts[host][1] += s
    n, s = np.array(list(hosts.values())).T
    overall = s.sum() / n.sum()
    k = strength(n, s, np.full(len(n), overall))
    host_rate = {h: (s + k * overall) / (n + k) for h, (n, s) in hosts.items()}
    pn, ps = np.array(list(paths.values())).T
    means = np.array([host_rate[h] for h, _ in paths])
    k = strength(pn, ps, means)
    rate = {key: (s + k * host_rate[key[0]]) / (n + k) for key, (n, s) in paths.items()}
    for r in rows:
        site = rate[r["host"], r["path"]]
        assert np.isclose(r["site_rate"], site, rtol=1e-6) and r["site_n"] == paths[r["host"], r["path"]][0]
        want = 1 / (1 + np.exp(-(logit(r["doc_score"]) + logit(np.clip(site, 1e-4, 1 - 1e-4)) - logit(overall))))
        assert np.isclose(r["score"], want, rtol=1e-5)
        assert r["accepted"] == (r["score"] >= 0.5 and r["toxic_score"] < 0.7)


class Reader(html.parser.HTMLParser):
    """Text outside of scripts, styles and titles, as words."""

    def __init__(self):
        super().__init__()
        self.depth, self.said = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "noscript", "template", "title")
        self.said.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "noscript", "template", "title") and self.depth > 0
        self.said.append(" ")

    def handle_data(self, data):
        if not self.depth:
            self.said.append(data)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archive_records(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = defaultdict(dict)
    for r in queries.QUERIES["op6_warc"](spark, DATA).collect():
        found[r["page_id"]][r["record_type"]] = r
    assert found.keys() == pages.keys()
    for page_id, page in pages.items():
        about, text = found[page_id]["metadata"], found[page_id]["conversion"]
        source = sha1((page["html"] or "").encode())
        for r in (about, text):
            block = r["block"].encode()
            assert (r["source_digest"], r["block_digest"], r["content_length"]) == (source, sha1(block), len(block))
            assert r["target_uri"] == page["url"] and r["refers_to"] == about["refers_to"] != r["record_id"]
            headers = dict(line.split(": ", 1) for line in r["headers"].split("\r\n")[1:] if line)
            assert headers["WARC-Refers-To"] == r["refers_to"] and headers["Content-Length"] == str(len(block)) and headers["WARC-Type"] == r["record_type"]
        assert f"converted-to: {text['record_id']}" in about["block"] and f"source-payload-digest: {source}" in about["block"]
        reader = Reader()
        reader.feed(page["html"] or "")
        assert "".join(text["block"].split()) == "".join("".join(reader.said).split())


def alike(one, other):
    return len(one & other) >= 0.8 * len(one | other) - 1e-9


def near_groups(rows):
    """Ids that stand for the groups which five-word sets with a resemblance of 0.8 lead to."""
    sets = []
    for _, text in rows:
        w = (text or "").translate(brute.LOWER).split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for n in range(i):
            if root(i) != root(n) and (sets[i] == sets[n] or alike(sets[i], sets[n])):
                a, b = root(i), root(n)
                group[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return {rows[root(i)][0] for i in range(len(rows))}


def test_every_stage_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]

    def ran(name, given):
        out = stored(stages[name](spark, given, DATA), f"test-{name}")
        return out, [(r["doc_id"], r["text"]) for r in out.collect()] if "text" in out.columns else out.collect()

    kept, rows = ran("quality", docs)
    wanted = queries.QUERIES["op1_quality"](spark, DATA).where("accepted").collect()
    assert {i for i, _ in rows} == {r["doc_id"] for r in wanted} and kept.columns == docs.columns

    single, after = ran("near_dedup", kept)
    assert {i for i, _ in after} == near_groups(sorted(rows)) and set(after) <= set(rows) and single.columns == docs.columns

    clean, rows = ran("decontaminate", single)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {i for i, _ in rows} == {r[0] for r in brute.contamination(after, items) if not r[5]} and set(rows) <= set(after)

    masked, hidden = ran("secrets", clean)
    assert masked.columns == docs.columns and len(hidden) == len(rows)
    before = dict(rows)
    for doc_id, text in hidden:
        spans = sorted({(a, b) for a, b, _ in secrets.find(before[doc_id])})
        want, at = "", 0
        for a, b in spans:
            want += before[doc_id][at:a] + secrets.MASK if a >= at else ""
            at = max(at, b)
        assert text == want + before[doc_id][at:]
    assert masked.where(F.col("n_chars") != F.length("text")).count() == 0

    _, pieces = ran("packing", masked)
    by_doc, used = defaultdict(list), defaultdict(int)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        used[p["sequence_id"]] += p["length"]
    assert by_doc.keys() == {i for i, _ in hidden} and max(used.values()) <= 1024
    for doc_id, text in hidden:
        ids = [*brute.token_ids(text), 0]
        listed = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert sum(p["length"] for p in listed) == len(ids)
        assert all(p["ids_crc32"] == brute.crc(ids[p["start"]:p["start"] + p["length"]]) for p in listed)
