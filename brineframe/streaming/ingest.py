"""Incremental daily ingest: each new delivery of a day replaces that day, by a new version of its slice."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import version_token
from ..sources.versions import commit, current_versions, prepare_store, read_ledger, write_slices

FILES = "date date, delivery string, path string, run string, batch long"


def delivery_of_name(path: str = "_file") -> Column:
    """Delivery of a landed file: the version token of its name, "" if it has none.

    All files of a day with the same version are parts of one delivery, however many
    there are.
    """
    return F.coalesce(version_token(F.element_at(F.split(F.col(path), "/"), -1)), F.lit(""))


def deliveries_of(batch: DataFrame) -> DataFrame:
    """(date, delivery, newest modification time) of a batch."""
    return batch.where(F.col("date").isNotNull()).groupBy("date", "_delivery").agg(F.max("_mtime").alias("_mtime"))


def to_do(batch: DataFrame, ledger: DataFrame, new_parts: DataFrame, force: bool) -> DataFrame:
    """(date, _delivery, again): the delivery to apply for each day of a batch.

    A day's current delivery is the one of its newest finished commit. A delivery that was current
    once and is not any more is never applied again. Of the others the one with the newest file
    counts; it is applied if the day has none yet, if it is the current one itself (``again``) and has files that no
    batch had before (``new_parts``), or by force.
    """
    current = current_versions(ledger).select("date", F.col("delivery").alias("_current"))
    once = ledger.where(F.col("status") == "done").select("date", F.col("delivery").alias("_delivery")).distinct()
    superseded = once.join(current, "date").where(F.col("_delivery") != F.col("_current")).select("date", "_delivery")
    open_ = deliveries_of(batch).join(superseded, ["date", "_delivery"], "left_anti")
    newest = open_.groupBy("date").agg(F.max(F.struct("_mtime", "_delivery"))["_delivery"].alias("_delivery"))
    state = newest.join(current, "date", "left").withColumn("again", F.coalesce(F.col("_delivery") == F.col("_current"), F.lit(False)))
    state = state.join(new_parts.withColumn("_new", F.lit(True)), ["date", "_delivery"], "left")
    wanted = F.lit(force) | (F.col("again") & F.col("_new").isNotNull()) | F.col("_current").isNull()
    return state.where(wanted).select("date", "_delivery", "again")


def ingest(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    n_lon: int,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    force: bool = False,
    delivery: Column | None = None,
    files_per_batch: int | None = None,
) -> None:
    """Process every landed file once and stop (``availableNow``).

    ``prepare`` maps raw landed rows to rows with a ``date`` column (row by row);
    ``transform`` maps the rows of whole days to cube cells. ``delivery`` names the delivery a
    row belongs to, by the landed columns or ``_file`` (default: the version in the file name).

    Per micro-batch and day: see ``to_do``. A delivery of which a part was finished before is
    done again from all its landed files (``<root>/files`` says which they are), so late parts are never lost. All
    days go through one job that writes their slices beside the current ones; one appended commit row per day
    switches them, also for a day left without a valid cell. A replayed batch applies the
    same days again, whatever checkpoint the batches before it used, so every day is applied exactly once. If a batch fails, its
    days are halved until the failing ones stand alone; those are recorded without stopping the
    others, and their current slices stay.
    """
    prepare_store(spark, root)
    spark.createDataFrame([], FILES).write.mode("append").parquet(f"{root}/files")

    def rows_of(raw: DataFrame) -> DataFrame:
        rows = raw.withColumns({"_file": F.col("_metadata.file_path"), "_mtime": F.col("_metadata.file_modification_time")})
        rows = rows.withColumn("_delivery", F.coalesce(delivery_of_name() if delivery is None else delivery, F.lit("")))
        return prepare(rows) if prepare else rows

    def replace(rows: DataFrame, pending: list, mark: dict) -> None:
        """Apply the pending (date, delivery) pairs; on failure, each half by itself."""
        days = spark.createDataFrame(pending, "date date, _delivery string")
        mine = rows.join(F.broadcast(days), ["date", "_delivery"], "left_semi").drop("_file", "_mtime", "_delivery")
        named = days.withColumnRenamed("_delivery", "delivery").withColumns({k: F.lit(v) for k, v in mark.items()})
        try:
            version = write_slices(transform(mine), root, n_lon)
            commit(named.withColumns({"version": F.lit(version), "status": F.lit("done"), "message": F.lit(None)}), root)
        except Exception as err:  # noqa: BLE001 - isolate the failing days
            if len(pending) == 1:
                commit(named.withColumns({"version": F.lit(None), "status": F.lit("failed"), "message": F.lit(str(err).splitlines()[0][:500])}), root)
                return
            half = len(pending) // 2
            replace(rows, pending[:half], mark)
            replace(rows, pending[half:], mark)

    def files_of(pending: list) -> list[str]:
        """The landed files that hold the pending deliveries: a few per day."""
        days = spark.createDataFrame(pending, "date date, delivery string")
        known = spark.read.schema(FILES).parquet(f"{root}/files").join(F.broadcast(days), ["date", "delivery"], "left_semi")
        return sorted(r["path"] for r in known.select("path").distinct().collect())

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            # batch numbers start anew with a new checkpoint; its id tells them apart
            run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
            found = batch.where(F.col("date").isNotNull()).select("date", F.col("_delivery").alias("delivery"), F.col("_file").alias("path")).distinct()
            ledger, other = read_ledger(spark, root), ~((F.col("run") == run) & (F.col("batch") == batch_id))
            seen = spark.read.schema(FILES).parquet(f"{root}/files").where(other)
            new_parts = found.join(seen, ["date", "delivery", "path"], "left_anti").select("date", F.col("delivery").alias("_delivery")).distinct()
            # the calendar days of this batch: one short row each
            todo = [tuple(r) for r in to_do(batch, ledger.where(other), new_parts, force).collect()]
            found.withColumns({"run": F.lit(run), "batch": F.lit(batch_id).cast("long")}).coalesce(1).write.mode("append").parquet(f"{root}/files")
            mark = {"run": run, "batch": batch_id, "sequence": (ledger.agg(F.max("sequence")).first()[0] or 0) + 1}
            fresh, again = ([(d, v) for d, v, a in todo if a is which] for which in (False, True))
            if fresh:
                replace(batch, sorted(fresh), mark)
            if again:
                replace(rows_of(spark.read.schema(schema).parquet(*files_of(again))), sorted(again), mark)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    query = (
        rows_of(stream.parquet(landing)).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(apply).start()
    )
    query.awaitTermination()
