"""Pluggable embedding and chat models, with deterministic stand-ins that need no network.

A model is a picklable callable that takes a list of inputs and returns a list of the
same length. It runs inside Arrow batches on the workers.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.params import CALL_WINDOW, EMBED_BATCH

ChatModel = Callable[[Sequence[str]], Sequence[str]]
VisionModel = Callable[[Sequence[str], Sequence[Sequence]], Sequence[str]]
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class HashingEmbedder:
    """Unit vector of hashed character trigrams: equal texts get equal vectors."""

    def __init__(self, dim: int = 1024) -> None:
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.ljust(3).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        mixed = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)
        mixed ^= mixed >> np.uint64(15)
        sign = np.where(mixed & np.uint64(1 << 20), 1.0, -1.0)
        v = np.bincount((mixed % np.uint64(self.dim)).astype(np.int64), weights=sign, minlength=self.dim)
        norm = float(np.linalg.norm(v))
        return (v / norm if norm else v).astype(np.float32)


def embed(df: DataFrame, text: str, model: Embedder, out: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """Add a vector per row, calling the model with at most ``batch`` texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("empty").tolist()
        vectors = []
        for i in range(0, len(values), batch):
            vectors.extend(np.asarray(v, dtype=np.float32) for v in model(values[i:i + batch]))
        return pd.Series(vectors, dtype="object")

    return df.withColumn(out, run(F.col(text)))


def require_items(answer: str) -> None:
    """ValueError unless the answer is a JSON array of objects with an id and a text."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (answer or "").strip(), flags=re.I)
    said = json.loads(body)
    if not isinstance(said, list) or not all(isinstance(x, dict) and {"question_id", "question_text"} <= x.keys() for x in said):
        raise ValueError("answer is not a JSON array of question items")


def in_order(fn: Callable, inputs: Iterable, window: int = CALL_WINDOW, timeout: float | None = None) -> Iterator:
    """``fn`` of every input in order, up to ``window`` calls at a time.

    Calls are started as the window has room and waited for from the oldest on, so no more than ``window`` results are held. A call that raises, or takes
    longer than ``timeout`` seconds, gives its exception in place of a result; what a call says after its time is not looked at.
    """

    def started(x) -> tuple[threading.Thread, list, float]:
        box: list = []

        def run() -> None:
            try:
                box.append(fn(x))
            except Exception as exc:  # noqa: BLE001
                box.append(exc)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread, box, time.monotonic()

    def finished(thread: threading.Thread, box: list, since: float):
        thread.join(None if timeout is None else max(0.0, since + timeout - time.monotonic()))
        return box[0] if box else TimeoutError(f"no answer within {timeout} s")

    open_: deque = deque()
    for x in inputs:
        if len(open_) >= window:
            yield finished(*open_.popleft())
        open_.append(started(x))
    while open_:
        yield finished(*open_.popleft())


def chat(
    prompt: Column, model: ChatModel, images: Column | None = None, retries: int = 0, check: Callable[[str], None] | None = None,
    window: int = CALL_WINDOW, timeout: float | None = None,
) -> Column:
    """Struct(answer, error): one call per row; a failing call becomes an error, not a failed task.

    A task has up to ``window`` calls open at a time, so a model must bear calls from several threads; answers keep the order of their rows. A row's calls
    together may take ``timeout`` seconds.

    A call counts as failed when the model raises or ``check`` refuses its answer; it is made again up to ``retries`` times.
    The last refused answer is kept, for the plan to say what is wrong with it.

    With ``images`` (array<binary> or array<string>) the model gets (prompts, images). The
    function counts as non-deterministic so that no plan rewrite calls a model twice.
    """
    out = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def ask(*inputs) -> tuple:
        answer = last = None
        for _ in range(retries + 1):
            try:
                answer = model(*[[x] for x in inputs])[0]
                if check is not None:
                    check(answer)
                return answer, None
            except Exception as exc:  # noqa: BLE001
                last = f"{type(exc).__name__}: {exc}"
        return answer, last

    def answered(rows: list[tuple]) -> pd.DataFrame:
        said = in_order(lambda row: ask(*row), rows, window, timeout)
        return pd.DataFrame([x if isinstance(x, tuple) else (None, f"{type(x).__name__}: {x}") for x in said], columns=["answer", "error"])

    if images is None:

        @F.pandas_udf(out)
        def run(prompts: pd.Series) -> pd.DataFrame:
            return answered([(p,) for p in prompts])

        return run.asNondeterministic()(prompt)

    @F.pandas_udf(out)
    def see(prompts: pd.Series, shown: pd.Series) -> pd.DataFrame:
        return answered([(p, list(i)) for p, i in zip(prompts, shown)])

    return see.asNondeterministic()(prompt, images)


class EchoItems:
    """Stand-in extractor: confirms every source candidate, or numbers the lines of a text."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    @staticmethod
    def _one(prompt: str) -> str:
        import json
        import re

        found = re.findall(r'<Candidate source_key="(C\d+)" question_id="[^"]*" kind="(\w+)"[^>]*>(.*?)</Candidate>', prompt, re.S)
        if found:
            return json.dumps([{"source_key": k, "role": kind, "question_text": t.strip()} for k, kind, t in found], ensure_ascii=False)
        path = re.search(r"<Active_Ancestor_Path>.*?prefix: ([^\n]+)\n", prompt, re.S)
        body = re.search(r"<Markdown>\n(.*)\n</Markdown>", prompt, re.S)
        lines = [ln.strip() for ln in (body.group(1) if body else prompt).splitlines() if ln.strip()]
        head = (path.group(1).strip() + ".") if path else ""
        return json.dumps([{"question_id": f"{head}{i}", "question_text": ln} for i, ln in enumerate(lines, 1)], ensure_ascii=False)


class KeepItems:
    """Stand-in reviewer: gives back the items it was shown."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        return list(prompts)


class EchoAnswer:
    """Stand-in writer: repeats the question in both halves of the answer."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        import re

        out = []
        for p in prompts:
            m = re.search(r"<User_Query>\n(.*?)\n</User_Query>", p, re.S)
            q = m.group(1) if m else p.strip().splitlines()[-1]
            out.append(f"{q}\n---\n{q}")
        return out


class ReadPage:
    """Stand-in page reader: every line of a text page with a leading label is an item."""

    def __call__(self, prompts: Sequence[str], images: Sequence[Sequence]) -> list[str]:
        import json
        import re

        out = []
        for prompt, pages in zip(prompts, images):
            text = "\n".join(p.decode() if isinstance(p, bytes) else p for p in pages)
            labels = re.findall(r"(?m)^\s*((?:[A-Z]\.)?\d+(?:\.\d+)*|\([a-z]\))[.)]?\s+(\S.*)$", text)
            out.append(json.dumps([{"question_id": a, "question_text": b} for a, b in labels], ensure_ascii=False))
        return out
