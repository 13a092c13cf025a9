"""Token ids and counts by vocabulary files of public tokenizer libraries."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np

#: Texts with a longer run of non-space characters are left to the tokenizers library, whose merging is not quadratic.
LONGEST_RUN = 2_000
#: Code points tried one by one against the tokenizers library when an encoder is made: Latin to Cyrillic, and general punctuation.
_TRIED = (range(0x00, 0x530), range(0x2000, 0x2070), range(0x20A0, 0x20C0))


def file_digest(path: str) -> str:
    """SHA-256 of a vocabulary file: its version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, without begin, end or added special tokens, padding or truncation."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)


class ProvenEncoder(LibraryEncoder):
    """The same ids several times faster: a rank encoder for the texts on which it is proven to agree, the library for the others.

    The pattern that splits texts tells code points apart by class alone, and merging is by rank alone. So agreement on every code point in every
    context of a class, with merges in the order of their ids, is agreement on all texts of these code points. Code points that were not tried
    or that differ send the text to the library, as do long runs without a space.
    """

    def __init__(self, path: str, spec: dict) -> None:
        super().__init__(path)
        import public_tokenizers
        import tiktoken

        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        agreed = [c for c in (chr(n) for span in _TRIED for n in span) if self._agree(c)]
        self.untried = re.compile("[^" + "".join(re.escape(c) for c in agreed) + "]")
        self.long_run = re.compile(rf"\S{{{LONGEST_RUN}}}")

    def _agree(self, c: str) -> bool:
        probe = f"a{c}b {c} {c}{c}1{c}2 ,{c}, \n{c}\n {c}  {c}'s{c}"
        return self._ranked(probe) == super().ids(probe).tolist()

    def _ranked(self, text: str) -> list[int]:
        return self.ranked.encode(text, allowed_special="all")

    def _safe(self, text: str) -> bool:
        return not self.untried.search(text) and (len(text) < LONGEST_RUN or not self.long_run.search(text))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._ranked(text), dtype=np.uint32) if self._safe(text) else super().ids(text)

    def count(self, text: str) -> int:
        return len(self._ranked(text)) if self._safe(text) else super().count(text)


class PieceEncoder:
    """Ids by a sentencepiece model, without begin and end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text, num_threads=1), dtype=np.uint32)

    def count(self, text: str) -> int:
        return len(self.processor.encode(text, num_threads=1))


def _ranks_apply(spec: dict) -> bool:
    """Whether the vocabulary is byte-level with the common split pattern and merges in the order of their ids."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        return False
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token"):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))


@lru_cache(maxsize=4)
def encoder(path: str):
    """Encoder for a vocabulary file: sentencepiece for ``.model``, tokenizers for ``.json``. One for each worker process."""
    if path.endswith(".model"):
        return PieceEncoder(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return ProvenEncoder(path, spec) if _ranks_apply(spec) else LibraryEncoder(path)
