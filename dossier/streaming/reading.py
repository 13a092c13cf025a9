"""Sequential page reading of a stream: a document's state, its pages and what was read on them live in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from dossier.functions import pagereading as P
from dossier.models import VisionModel

#: State store that the processor's maps need; a session that runs the stream names it in this setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Error of a page that came after its turn had been passed over.
LATE = "late: the page came after its turn"


class PageProcessor(StatefulProcessor):
    """Reads the pages of a document in order, whatever the order they come in.

    A page waits in the store until those in front of it have been read. A gap that no page fills within ``patience_ms`` is passed over when its timer
    fires; a page that comes for a place passed over gives a row with the error LATE and is not read. Pages stay in the store until the last one, for
    the model to see them again; with the last page the document's state goes.
    """

    def __init__(self, model: VisionModel, patience_ms: int, image_type: str) -> None:
        self.model, self.patience_ms, self.image_type = model, patience_ms, image_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reader = handle.getValueState("reader", "state string, next int, total int")
        self.images = handle.getMapState("images", "page int", f"image {self.image_type}")
        self.read = handle.getMapState("read", "page int", "active string, answer string, pending string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, at, total = self._held()
        found = []
        for batch in rows:
            for r in batch.itertuples(index=False):
                if state is None:
                    total = int(r.total)
                    state, at = P.Reader.start(total, r.outline), 1
                if r.page < at:
                    found.append((key[0], int(r.page), *(None,) * 10, LATE))
                elif not self.images.containsKey((int(r.page),)):
                    self.images.updateValue((int(r.page),), (r.image,))
        yield from self._advance(key, state, at, total, found, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, at, total = self._held()
        if state is not None and self.images.exists():
            waiting = [p for (p,) in self.images.keys() if p >= at]
            if waiting:
                yield from self._advance(key, state, min(waiting), total, [], timerValues)

    def _held(self) -> tuple[P.Reader | None, int, int]:
        if not self.reader.exists():
            return None, 1, 0
        text, at, total = self.reader.get()
        return P.Reader.load(text), at, total

    def _advance(self, key, state: P.Reader | None, at: int, total: int, found: list, timers) -> Iterator[pd.DataFrame]:
        while state is not None and at <= total and self.images.containsKey((at,)):
            image = self.images.getValue((at,))[0]
            step = P.first_look(state, at, image, self.model)
            if step.back:
                seen = [p for p in step.back if self.images.containsKey((p,))]
                shown = [self.images.getValue((p,))[0] for p in seen]
                told = [P.remembered(p, *self.read.getValue((p,))) for p in step.back if self.read.containsKey((p,))]
                P.second_look(state, at, step, [*shown, image], told, self.model)
            row = P.finish(state, at, step)
            found.append((key[0], at, *row))
            self.read.updateValue((at,), (row[1], row[6], row[7]))
            at += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is not None and at > total:
            # the last place stays known, so that what comes again is late and is not read twice
            self.images.clear()
            self.read.clear()
            self.reader.update((P.Reader.start(total, None).dump(), at, total))
        elif state is not None:
            self.reader.update((state.dump(), at, total))
            if any(p > at for (p,) in self.images.keys()):
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)
        if found:
            yield pd.DataFrame(found, columns=P.COLUMNS)

    def close(self) -> None:
        pass


def read_page_stream(pages: DataFrame, model: VisionModel, patience_ms: int = 600_000) -> DataFrame:
    """Rows of ``read_pages``, as pages stream in. pages: doc_id, page, image, total (pages of the document), outline (JSON text or null).

    The session's state store has to be STATE_STORE. Rows without a document, page or total are left out; a page that comes twice is read once.
    """
    kept = pages.where("doc_id IS NOT NULL AND page IS NOT NULL AND total IS NOT NULL").selectExpr("cast(doc_id as bigint) doc_id", "cast(page as int) page", "image", "cast(total as int) total", "outline")
    processor = PageProcessor(model, patience_ms, kept.schema["image"].dataType.simpleString())
    return kept.groupBy("doc_id").transformWithStateInPandas(processor, StructType.fromDDL(P.ROWS), "append", "processingTime")


def start_reading(pages: DataFrame, model: VisionModel, path: str, checkpoint: str, patience_ms: int = 600_000, every: str | None = None) -> StreamingQuery:
    """Appends the rows of the pages that have come so far, or with ``every`` (such as ``10 seconds``) goes on until it is stopped.

    A later start with the same checkpoint goes on where this one ended. A run that ends by itself makes no batches without pages, so a gap's timer fires with the
    pages of the next run.
    """
    spark, empty_batches = pages.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    writer = read_page_stream(pages, model, patience_ms).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    held = spark.conf.get(empty_batches)
    try:
        # read by the query when it starts
        spark.conf.set(empty_batches, str(every is not None).lower())
        return writer.start()
    finally:
        spark.conf.set(empty_batches, held)
