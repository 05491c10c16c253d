"""M2: listing pages of a stream, taken until the first empty or repeated one (arbitrary state per listing).

Pages arrive in any order and in any number of micro-batches.  For each listing the state holds the next
expected ``start``, the signatures of the pages taken, and pages that came early.  Pages are taken in
the order of ``start``; the first one that is empty, or whose ordered ids were on an earlier page, ends the
listing: its state shrinks to one flag and whatever arrives later is dropped.  State not touched for the
time to live is removed, the flag too.  A missing page holds back those behind it until it arrives.

One listing is a sequence by nature and belongs to one task at a time; listings are dealt over all tasks.
The state is kept by RocksDB with the stream's checkpoint, so a restarted stream goes on where it was.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rankframe import schemas as S
from rankframe.operators.extract import extract_listing_pages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME_TO_LIVE_MS = 7 * 24 * 3600 * 1000
_KEPT = "listing string, page_id long, start long, rows string"


class TakeUntilRepeat(StatefulProcessor):
    """Per listing: pages (page_id, start, signature, n_rows, rows) in, those before the first empty or repeated one out."""

    def __init__(self, first: int, step: int, ttl_ms: int):
        self.first, self.step, self.ttl_ms = first, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "start long", self.ttl_ms)
        self.ended = handle.getValueState("ended", "start long", self.ttl_ms)
        self.seen = handle.getMapState("seen", "signature string", "start long", self.ttl_ms)
        self.early = handle.getMapState("early", "start long", "page_id long, signature string, n_rows int, rows string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            for _ in rows:
                pass
            return
        at = self.expected.get()[0] if self.expected.exists() else self.first
        for pdf in rows:
            for r in pdf.sort_values(["start", "page_id"]).itertuples():
                if r.start >= at and not self.early.containsKey((int(r.start),)):
                    self.early.updateValue((int(r.start),), (int(r.page_id), r.signature, int(r.n_rows), r.rows))
        taken = []
        while self.early.containsKey((at,)):
            page_id, signature, n_rows, text = self.early.getValue((at,))
            if n_rows == 0 or self.seen.containsKey((signature,)):
                self.ended.update((at,))
                self.expected.clear()
                self.seen.clear()
                self.early.clear()
                break
            self.seen.updateValue((signature,), (at,))
            self.early.removeKey((at,))
            taken.append((key[0], page_id, at, text))
            at += self.step
        else:
            self.expected.update((at,))
        if taken:
            yield pd.DataFrame(taken, columns=["listing", "page_id", "start", "rows"])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own settings come back at the end.

    State past its time to live goes with the next batch that has data: batches without any would
    follow one another for ever.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pages_until_repeat_stream(pages: DataFrame, base_url: str, listing_col: str | None = None, first: int = 1, step: int = S.LISTING_PAGE_ROWS,
                              ttl_ms: int = TIME_TO_LIVE_MS) -> DataFrame:
    """Listing rows (listing, page_id, start, row_pos, ...) of a stream of pages (page_id, start, html, maybe a listing column).

    Start the stream inside :func:`rocksdb_state`.  Of several pages with one start the first to arrive
    counts (in one micro-batch the smallest page_id).
    """
    listing = F.coalesce(F.col(listing_col).cast("string"), F.lit("")) if listing_col else F.lit("")
    read = extract_listing_pages(pages.select(listing.alias("listing"), "page_id", "start", "html"), base_url, keep=("listing", "page_id", "start"))
    kind = read.schema["rows"].dataType
    given = read.select("listing", F.col("page_id").cast("long").alias("page_id"), F.col("start").cast("long").alias("start"),
                        F.md5(F.col("signature").cast("binary")).alias("signature"), F.col("n_rows").cast("int").alias("n_rows"), F.to_json("rows").alias("rows"))
    kept = given.groupBy("listing").transformWithStateInPandas(TakeUntilRepeat(first, step, ttl_ms), _KEPT, "append", "processingTime")
    return (kept.select("listing", "page_id", "start", F.explode(F.from_json("rows", kind)).alias("r"))
            .select("listing", "page_id", "start", "r.*"))
