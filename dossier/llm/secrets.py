"""Secret scans behind a ledger of blobs and rule versions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.ledger import Ledger
from dossier.llm.shared import fresh_name, over_batches, same, screened, slices, stored

FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# The base kinds in their order, with the group whose length counts and the least length.
_BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 0, 24),
)
# A key's text runs through the END line of its kind. Without one before the next BEGIN it ends with its base64 lines: header fields, lines of
# 16 characters or more, a shorter last one. Line ends may be written out as \\n, and lines be indented, quoted or run together by blanks.
_GAP = r"[\x20\t]*+(?:\\[nr]|\r?\n)(?:\\[nr]|[\x20\t\r\n>])*+"
_CLOSED = r"(?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20(?P=owner)PRIVATE KEY-----"
_OPEN = rf"(?:(?:{_GAP}[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+)*+(?:(?:{_GAP}|\x20*+)[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/=]++(?![^\s\\\"']))?+)?+"
# Published shapes of further credentials, after the base kinds.
_MORE = (
    ("private_key", rf"-----BEGIN (?P<owner>[A-Z ]*)PRIVATE KEY-----(?:{_CLOSED}|{_OPEN})", 0, 0, 1),
    ("code_host", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 0, 1),
    ("chat_bot", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 1),
    ("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0, 1),
    ("map_key", r"\bAIza[A-Za-z0-9_-]{35}", 0, 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]{3,}+@", 0, 0, 1),
)
RULES = tuple((kind, re.compile(pattern, flags), group, least) for kind, pattern, flags, group, least in _BASE + _MORE)
BASE_KINDS = tuple(kind for kind, *_ in _BASE)
#: Version of the rules: another pattern is another version, and all blobs are scanned again.
RULES_VERSION = hashlib.sha256(repr(_BASE + _MORE).encode()).hexdigest()
MASK = "[secret]"


def find(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all rules, by start and then by the rules' order; code points, end exclusive."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def _digest_row(text: str) -> tuple:
    spans = find(text)
    listed = [(kind, f"{kind}:{start}:{end}") for start, end, kind in spans]
    base = [shown for kind, shown in listed if kind in BASE_KINDS]
    counts = [sum(kind == k for kind, _ in listed) for k in BASE_KINDS]
    return (*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(shown for _, shown in listed))


def _scanned(batches: Iterator[pa.RecordBatch], version: str) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 3 + [pa.string()] * 2
    names = ["digest", "version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for batch in slices(batches):
        rows = [_digest_row(text) for text in batch.column(1).to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(rows), pa.string()), *columns], names)


def scan(versions: DataFrame, ledger_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every row: ``doc_id, digest, n_assign, n_access, n_hex, base_sha256, spans``.

    Rows are versions of files: a path (``key``, any type, as often as it has versions) and the whole content at that version. A content is a blob
    named by its SHA-256. Only blobs that the ledger has no entry for under these rules are scanned, each once however many paths hold it; their
    entries are appended, and the entries of all blobs are joined back to the paths.

    A null text is empty: counts of 0, the digest of the empty string, empty spans. Repeated rows give repeated rows, null keys stay, no rows give
    none; other columns play no part.
    """
    ledger = Ledger(versions.sparkSession, ledger_path, FINDINGS)
    paths = versions.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("content")).withColumn("digest", F.sha2("content", 256))
    unseen = ledger.unseen(paths.select("digest", "content"), RULES_VERSION)
    ledger.append(over_batches(unseen, partial(_scanned, version=RULES_VERSION), ledger.schema))
    return paths.select("doc_id", "digest").join(ledger.rows(RULES_VERSION).drop("version"), "digest")


def _masked_text(text: str, spans: str) -> str:
    out, at = [], 0
    for span in spans.split(","):
        _, start, end = span.split(":")
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def _masked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, spans = batch.columns
        found = [i for i, s in enumerate(spans.to_pylist()) if s]
        if found:
            texts = kept[column].to_pylist()
            for i in found:
                texts[i] = _masked_text(texts[i], spans[i].as_py())
            kept[column] = pa.array(texts, kept[column].type)
        yield pa.RecordBatch.from_arrays(kept, batch.schema.names[:-1])


def mask(docs: DataFrame, ledger_path: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with every finding in ``text`` replaced by ``[secret]``; overlapping findings become one.

    Texts without a finding, null ones among them, stay as they are. Rows meet their findings by the content's digest, so repeated rows and rows with
    a null key are masked alike. Columns may have any names. Only texts that pass a filter of the findings' digests are shuffled to meet their findings.
    """
    ledger = Ledger(docs.sparkSession, ledger_path, FINDINGS)
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    contents = docs.select(digest.alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    ledger.append(over_batches(ledger.unseen(contents, RULES_VERSION), partial(_scanned, version=RULES_VERSION), ledger.schema))
    named, listed = fresh_name(docs, "_digest"), fresh_name(docs, "_spans")
    # written apart, because the filter and the join both read it
    found = stored(ledger.rows(RULES_VERSION).where("spans <> ''").select(F.col("digest").alias(named), F.col("spans").alias(listed)), "findings")
    marked, clean = screened(docs, digest, found, named)
    rows = marked.join(found, same(digest, F.col(named)), "left").drop(named)
    return over_batches(rows, partial(_masked, column=docs.columns.index(text)), docs.schema).union(clean)
