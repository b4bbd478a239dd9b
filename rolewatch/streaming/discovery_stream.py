"""The scheduled loop as a stream: landed files in, snapshot, changes, deliveries and results out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import outbox, replay
from ..operators.scans import summarize_runs
from ..plans import discovery
from ..schemas import DELIVERY, LANDED, POSTING, SCAN_END, SNAPSHOT
from ..sources.board_payloads import asked_pages, page_facts
from ..sources.strategies import Strategy
from . import arrivals, tables, views

SCANS = "source_id STRING, scanned_at TIMESTAMP"
Targets = Callable[[SparkSession], DataFrame]


def landed_pages(spark: SparkSession, landed_path: str, places: DataFrame) -> DataFrame:
    """The landed rows at ``places`` (file, row), read from the files where they landed."""
    files = [unquote(r.file) for r in places.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], LANDED)
    rows = spark.read.schema(LANDED).option("basePath", landed_path).parquet(*files)
    columns = spark.createDataFrame([], LANDED).columns
    placed = rows.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    wanted = places.select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    return placed.join(wanted, ["_file", "_row"], "left_semi").select(*columns)


def process_finished(
    finished: DataFrame, batch: int, landed_path: str, root: str, targets: Targets, strategies: Sequence[Strategy] = ()
) -> None:
    """One micro-batch of scans that are whole or given up; see ``arrivals``.

    Bodies stay in the landed files until their scan is whole, and are read there.  Scans that were given up
    and surplus pages go to the ``incomplete`` table, by scan and place.
    """
    spark = finished.sparkSession
    tables.append(finished, root, "finished", batch)
    known = spark.read.schema(arrivals.FINISHED).parquet(f"{root}/finished/batch={batch}")
    tables.append(known.where("status <> 'complete'"), root, "incomplete", batch)
    complete = known.where("status = 'complete'")
    if complete.isEmpty():
        tables.carry(spark, root, batch)
    else:
        process_batch(landed_pages(spark, landed_path, complete), batch, root, targets, strategies)


def process_batch(landed: DataFrame, batch: int, root: str, targets: Targets, strategies: Sequence[Strategy] = ()) -> None:
    """One micro-batch of whole scans, several of them in any order.

    A scan that is not newer than the last one of its source goes to the ``late`` table instead of rewriting history.
    """
    spark = landed.sparkSession
    landed = landed.where(F.col("provider") != SCAN_END)
    # Tables instead of cached plans: they survive lost executors and keep the later plans small.
    tables.append(asked_pages(page_facts(landed)), root, "asked", batch)
    asked = spark.read.parquet(f"{root}/asked/batch={batch}")
    tables.append(discovery.extract(landed, targets(spark), asked, strategies), root, "extracted", batch)
    found = spark.read.schema(POSTING + ", scan_id STRING").parquet(f"{root}/extracted/batch={batch}")
    tables.append(discovery.results_of(landed, found, asked, strategies), root, "source_results", batch)
    results = spark.read.parquet(f"{root}/source_results/batch={batch}")
    _apply(spark, discovery.winners_of(found, results), results, batch, root)


def _apply(spark: SparkSession, postings: DataFrame, results: DataFrame, batch: int, root: str) -> None:
    folders = tables.current_folders(spark, root, batch)
    # One row per source, as of the last batch that had any.
    last = tables.read_version(spark, root, "last_scans", SCANS, folders.get(tables.LAST_SCANS))
    dated = results.join(last.withColumnRenamed("scanned_at", "_last"), "source_id", "left")
    in_time = F.coalesce(F.col("scanned_at") > F.col("_last"), F.lit(True))
    good = F.col("status") == "SUCCESS"
    scans = dated.where(good & in_time).select("source_id", "scanned_at")

    # A bucket holds whole companies; only buckets with a scanned company are read and rewritten.
    touched = {r.b for r in results.select(tables.bucket_of(F.col("company_id")).alias("b")).distinct().collect()}
    stored = tables.read_buckets(spark, root, SNAPSHOT, {b: n for b, n in folders.items() if b in touched})

    columns = [c for c in postings.columns if c != "scan_id"]
    timely = postings.join(dated.where(good & in_time).select("scan_id", "source_id"), ["scan_id", "source_id"], "left_semi")
    fresh, overtaken = replay.split_late(timely.select(*columns), stored)
    late_scans = dated.where(good & ~in_time).select("scan_id", "source_id")
    late = postings.join(late_scans, ["scan_id", "source_id"], "left_semi").select(*columns)

    changes = replay.replay_changes(fresh, stored).drop("canonical_url")
    tables.append(late.unionByName(overtaken.select(*columns)), root, "late", batch)
    tables.append(scans, root, "scans", batch)
    newest = last.unionByName(scans).groupBy("source_id").agg(F.max("scanned_at").alias("scanned_at"))
    tables.append(newest, root, "last_scans", batch)
    tables.append(changes, root, "changes", batch)
    # Ids of these changes carry scan times newer than all stored ones, so none was enqueued before.
    fresh_changes = spark.read.parquet(f"{root}/changes/batch={batch}")
    none = spark.createDataFrame([], DELIVERY)
    enqueued_at = F.col("created_at")
    tables.append(outbox.enqueue_at(none, fresh_changes, enqueued_at), root, "deliveries", batch)
    runs = summarize_runs(results.withColumn("finished_at", F.col("scanned_at")), postings.groupBy("scan_id").agg(F.count("*").alias("job_count")))
    tables.append(runs.withColumnRenamed("scan_id", "id"), root, "scan_runs", batch)

    tables.write_buckets(replay.replay_snapshot(fresh, scans, stored), root, batch)
    # A batch without a posting and without a stored one writes no file, hence the given schema.
    written = spark.read.schema("bucket INT").parquet(f"{root}/snapshot/batch={batch}").select("bucket").distinct().collect()
    # What this batch alone changed, for readers of counts and of the newest changes.
    after = tables.read_buckets(spark, root, SNAPSHOT, {r.bucket: batch for r in written})
    views.append_log(fresh_changes, root, batch)
    tables.append(views.differences(stored, after, fresh_changes, runs), root, "counts", batch)
    tables.commit(spark, root, batch, folders | {r.bucket: batch for r in written} | {tables.LAST_SCANS: batch})


def start_discovery(
    spark: SparkSession,
    landed_path: str,
    root: str,
    checkpoint: str,
    targets: Targets,
    max_files: int | None = None,
    end_markers: bool = True,
    wait: str = arrivals.WAIT,
    arrived: Column | None = None,
    strategies: Sequence[Strategy] = (),
) -> StreamingQuery:
    """Process all landed files that are new since the last run, then stop.

    ``root`` and ``checkpoint`` lie on storage every executor reaches.  ``targets`` reads the watchlist
    anew for each micro-batch.  Without ``end_markers`` each scan must land in one file.  ``wait`` is how long a scan
    may stand still before it is given up, and how long a repeated page is recognised.
    """
    reader = spark.readStream.schema(LANDED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    landed = reader.parquet(landed_path)
    if end_markers:
        arrivals.use_state_store(spark)
        finished = arrivals.finished_scans(landed, wait, arrived)
        writer = finished.writeStream.foreachBatch(lambda df, batch: process_finished(df, batch, landed_path, root, targets, strategies))
    else:
        writer = landed.writeStream.foreachBatch(lambda df, batch: process_batch(df, batch, root, targets, strategies))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_snapshot(spark: SparkSession, root: str, batches: int | None = None) -> DataFrame:
    """The state after the first ``batches`` batches, by default after all committed ones."""
    batches = tables.committed(spark, root) if batches is None else batches
    return tables.read_buckets(spark, root, SNAPSHOT, tables.current_folders(spark, root, batches))
