"""Plain readings of the contracts, row by row, to hold the operators against."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    """rows: (doc_id, text) -> {(doc_id, fingerprint, component_id)}"""
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[n] ^ values[n + 1:]) <= 3):
            a, b = root(i), root(ids[n + 1 + m])
            group[max(a, b)] = min(a, b)
    return {(i, f"{prints[i]:016x}", root(i)) for i in ids}


def contamination(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        if w:
            windows += [(str(item), tuple(w[i:i + 10])) for i in range(max(1, len(w) - 9))]
    by_first = {}
    for item, window in windows:
        by_first.setdefault(window[0], set()).add((item, window))
    out = set()
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for at, first in enumerate(w):
            for item, window in by_first.get(first, ()):
                if tuple(w[at:at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item)
        out.add((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def token_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


KINDS = (
    ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text):
    text = text or ""
    spans = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[group]) >= least]
    shown = [s for _, _, s in sorted(spans)]
    return (*(sum(s.startswith(kind) for s in shown) for kind, *_ in KINDS), sha(",".join(shown))), shown


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def licenses(text):
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def top_k(rows, k=20, every=20):
    """rows: (vec_id, vector) -> [(query_id, rank, vec_id, score)]"""
    sound = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qid, q in sound:
        if qid % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in sound if i != qid)
            out += [(qid, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], start=1)]
    return out


def chat(turns):
    """Ordered (role, text) of one conversation -> n_turns, turns_sha256, loss_chars, loss_sha256"""
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), sha(loss)
