"""Which landed scans are whole: keyed state with timers over slim facts of the landed rows.

A crawler ends a scan with a row of provider SCAN_END, whose page_no is the number of the scan's pages.  The stream reads no body: per row
it takes the scan, the page and where the row lies (file and row number).

Two stages of state, both bounded by time and kept in RocksDB:

* a page delivered again within ``wait`` of its first arrival is dropped (``dropDuplicatesWithinWatermark``);
* one state per scan holds the distinct pages seen and the end.  A scan with as many pages as its end says is ``complete``, and
  its pages are given out, each once, wherever and however often they landed.  Pages that come after that are ``surplus``.  A scan to
  which nothing is added for ``wait`` is given out as ``incomplete``, with what has landed of it, and forgotten.

Event time is the time of arrival, so no row is too late for the watermark, however old its observation is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import SCAN_END

# Executors need not have this package installed: the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT = "1 day"
PAGE = "source_id STRING, query_no INT, page_no INT"
PLACE = "file STRING, row LONG"
FINISHED = f"scan_id STRING, status STRING, {PLACE}"


class ScanPages(StatefulProcessor):
    """The pages of one scan until it is whole, or until it has been waited for in vain."""

    def __init__(self, wait_ms: int, end: str = SCAN_END):
        self.wait_ms, self.end = wait_ms, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "pages INT, expected INT, done BOOLEAN")
        self.pages = handle.getMapState("pages", PAGE, PLACE)

    def given_out(self, scan: str, status: str) -> pd.DataFrame:
        places = list(self.pages.values())
        self.pages.clear()
        return pd.DataFrame([(scan, status, *p) for p in places], columns=["scan_id", "status", "file", "row"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pages, expected, done = self.facts.get() if self.facts.exists() else (0, None, False)
        surplus, last = [], 0
        for part in rows:
            last = max(last, int(part["arrived_ms"].max()))
            for r in part.itertuples(index=False):
                number = None if pd.isna(r.page_no) else int(r.page_no)
                if r.provider == self.end:
                    expected = max(expected or 0, number or 0)
                    continue
                place = (r.file, int(r.row))
                page = (r.source_id, None if pd.isna(r.query_no) else int(r.query_no), number)
                if done:
                    surplus.append((key[0], "surplus", *place))
                elif not self.pages.containsKey(page):
                    self.pages.updateValue(page, place)
                    pages += 1
        if surplus:
            yield pd.DataFrame(surplus, columns=["scan_id", "status", "file", "row"])
        if not done and expected is not None and pages >= expected:
            done = True
            yield self.given_out(key[0], "complete")
        self.facts.update((pages, expected, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts = self.facts.get() if self.facts.exists() else None
        if facts is not None and not facts[2]:
            yield self.given_out(key[0], "incomplete")
        self.pages.clear()
        self.facts.clear()

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def wait_in_ms(spark: SparkSession, wait: str) -> int:
    """Milliseconds of an interval such as ``1 day``."""
    return spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {wait}"))).first()[0]


def finished_scans(landed: DataFrame, wait: str = WAIT, arrived: Column | None = None) -> DataFrame:
    """``scan_id, status, file, row`` of the pages of each scan that is complete, or has been given up, and of surplus pages.

    ``landed`` is a stream of files with LANDED columns.  ``arrived`` is the time of a row's arrival, by default that of its micro-batch.
    """
    slim = landed.select(
        "scan_id", "provider", "source_id", "query_no", "page_no",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        (F.current_timestamp() if arrived is None else arrived).alias("arrived_at"),
    )
    once = slim.withWatermark("arrived_at", wait).dropDuplicatesWithinWatermark(["scan_id", "provider", "source_id", "query_no", "page_no"])
    keyed = once.withColumn("arrived_ms", F.unix_millis("arrived_at")).groupBy("scan_id")
    processor = ScanPages(wait_in_ms(landed.sparkSession, wait))
    return keyed.transformWithStateInPandas(processor, FINISHED, "append", "EventTime")
