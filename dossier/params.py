"""Request parameters with the ranges the service accepts."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults and limits of the service.
TOP_K_DEFAULT = 30
TOP_N_DEFAULT = 5
DISTANCE_CEILING = 0.75
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MACRO_CHUNK_SIZE = 3000
MINING_CHUNK_SIZE = 2000
MINING_CHUNK_OVERLAP = 300
BLOCK_LIMIT = 6000
VERIFY_BATCH = 80
EMBED_BATCH = 16
CALL_WINDOW = 5
ENRICH_TERMS = 5
UPLOAD_EXTENSIONS = ("pdf", "doc", "docx", "xlsx", "xls")
DOC_TYPES = ("REGULATION", "GUIDELINE", "QA")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class RetrievalParams:
    """``threshold`` is a ceiling on cosine *distance*, inclusive."""

    top_n: int = TOP_N_DEFAULT
    threshold: float = DISTANCE_CEILING
    base_top_k: int = TOP_K_DEFAULT
    merge_mode: str = "independent"

    def __post_init__(self) -> None:
        _require(1 <= self.top_n <= 100, "top_n must be in 1..100")
        _require(0.0 <= self.threshold <= 1.0, "threshold must be in 0..1")
        _require(self.merge_mode in ("independent", "compete"), "unknown merge mode")

    @property
    def top_k(self) -> int:
        """Candidates are never fewer than top_n plus 25."""
        return max(self.base_top_k, self.top_n + 25)


@dataclass(frozen=True)
class AskParams:
    question: str
    intent_top_n: int = 1
    retrieval: RetrievalParams = RetrievalParams()

    def __post_init__(self) -> None:
        _require(1 <= len(self.question) <= 2000, "question must have 1..2000 characters")
        _require(1 <= self.intent_top_n <= 10, "intent_top_n must be in 1..10")


@dataclass(frozen=True)
class TranslateParams:
    text: str

    def __post_init__(self) -> None:
        _require(1 <= len(self.text) <= 5000, "text must have 1..5000 characters")


@dataclass(frozen=True)
class ChunkParams:
    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP

    def __post_init__(self) -> None:
        _require(self.size > 0, "chunk size must be positive")
        # overlap >= size would never advance
        _require(0 <= self.overlap < self.size, "overlap must be smaller than the chunk size")

    @property
    def step(self) -> int:
        return self.size - self.overlap
