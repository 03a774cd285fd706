"""Parquet and CSV sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter import journal
from shopmeter.schemas import PARTITION_COLUMN
from shopmeter.sources.catalog import register_days


def write_snapshot(df: DataFrame, path: str, compression: str = "zstd", table: str | None = None) -> None:
    """Replace a whole dataset (dimension snapshots), which ``df`` may have been read from.

    The new snapshot is written beside the old one and takes its place when it is complete, by
    a journaled commit: until then the old one can be read, whatever fails. ``table`` is the
    catalog's name of it, if any, whose readers then see the new files.
    """
    spark = df.sparkSession
    commit = journal.begin(spark, path)
    try:
        df.write.option("compression", compression).parquet(journal.staged(commit))
        journal.publish(spark, path, commit, [journal.WHOLE])
    except Exception:
        journal.abandon(spark, commit)
        raise
    if table:
        spark.catalog.refreshTable(table)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or ``ValueError`` when it has no row."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def write_partitions(
    df: DataFrame,
    path: str,
    column: str,
    compression: str = "zstd",
    order: tuple[str, ...] = ("store_id",),
) -> None:
    """Replace exactly the ``column`` partitions present in ``df``, which isn't read from them.

    The rebalance hint gives a small date one file and splits a large date into several,
    so neither tiny files nor one overloaded writer result. Rows are ordered by store
    within a file: a lookup by date and store then skips row groups.
    """
    (
        df.hint("rebalance", column)
        .sortWithinPartitions(column, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(column)
        .parquet(path)
    )


def replace_days(
    df: DataFrame,
    path: str,
    column: str,
    days: list[dt.date],
    compression: str = "zstd",
    order: tuple[str, ...] = ("store_id",),
    table: str | None = None,
) -> None:
    """Replace the folders of ``days`` in a dataset partitioned by ``column``.

    ``df`` holds the complete rows of these days and may have been read from them: it is
    written to a folder beside the table first, its rows are counted there, and only then
    are the day folders exchanged, by a journaled commit. A failed write leaves the table as
    it was; a driver killed in the midst of the exchange leaves one that the next call, or the next
    daily job, finishes. ``table`` is the catalog's name of the dataset, if any: exactly
    these days are registered there.
    """
    spark = df.sparkSession
    commit = journal.begin(spark, path)
    in_days = df.filter(F.col(column).isin(days))
    if not df.filter(~F.coalesce(F.col(column).isin(days), F.lit(False))).isEmpty():
        raise ValueError(f"rows of other days than {column} in {days}")
    try:
        staged = journal.staged(commit)
        write_partitions(in_days, staged, column, compression, order)
        written, expected = spark.read.schema(df.schema).parquet(staged).count(), in_days.count()
        if written != expected:
            raise RuntimeError(f"{written} rows written of {expected}")
        found = set(journal.names(spark, staged))
        changed = [day for day in days if f"{column}={day.isoformat()}" in found]
        if changed:
            journal.publish(spark, path, commit, [f"{column}={day.isoformat()}" for day in changed])
        else:
            journal.abandon(spark, commit)
    except Exception:
        journal.abandon(spark, commit)
        raise
    if table and changed:
        register_days(spark, table, column, changed)


def write_metrics(df: DataFrame, path: str, days: list[dt.date], table: str | None = None) -> None:
    replace_days(df, path, PARTITION_COLUMN["traffic_metrics"], days, compression="snappy", table=table)


def export_name(period: str, store_id: str | None = None, year: int | None = None,
                month: int | None = None) -> str:
    """Name of an export: stores, period, then year and month where the period has them."""
    stores = "all_stores" if store_id is None else f"store_{store_id}"
    suffix = "".join(f"_{part}" for part in (year, month) if part is not None)
    return f"metrics_{stores}_{period}{suffix}.csv"


def export_csv(df: DataFrame, folder: str) -> None:
    """Header, UTF-8, no row numbers; one directory of part files."""
    df.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(folder)
