"""The last published rows of every store and weekday, kept beside the metrics table.

The averages of a batch look back over three rows of the store and weekday. These rows are
kept as a small snapshot, so a batch that follows the published dates reads neither four weeks of
day folders nor, for averages over the full history, the whole table. The snapshot carries a
stamp of the table it was taken from: the table's last commit, its number of days and its last day.
Rows of another stamp are never used; a job killed before it kept its rows, a write by
someone else and a batch of earlier dates all lead back to the table itself.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter import journal
from shopmeter.operators.metrics import AVERAGES, DAY_KEY, last_rows
from shopmeter.schemas import TRAFFIC_METRICS
from shopmeter.sinks.writers import write_snapshot
from shopmeter.sources.tables import day_folders, read_days, read_table

# The averages of a batch reach back so far.
HISTORY = dt.timedelta(weeks=4)
COLUMNS = [*DAY_KEY, *AVERAGES]
KEPT = T.StructType(
    [TRAFFIC_METRICS[name] for name in COLUMNS]
    + [T.StructField("since", T.DateType()), T.StructField("stamp", T.StringType())]
)


class Recent(NamedTuple):
    """Kept rows, and the first date that was looked at for them; None if all dates were."""

    rows: DataFrame
    since: dt.date | None


def kept_path(metrics_path: str) -> str:
    """Where the rows of a metrics table are kept; Spark's readers pass over its name."""
    parent, slash, name = metrics_path.rstrip("/").rpartition("/")
    return f"{parent}{slash}_recent-{name}"


def _stamp(spark: SparkSession, metrics_path: str, done: list[dt.date]) -> str | None:
    version = journal.version(spark, metrics_path)
    return version and f"{version} {len(done)} {max(done, default=None)}"


def kept(spark: SparkSession, metrics_path: str, done: list[dt.date]) -> Recent | None:
    """The rows kept for the table as it is now, with ``done`` as its dates; None if there are none."""
    stamp = _stamp(spark, metrics_path, done)
    if stamp is None:
        return None
    rows = read_table(spark, kept_path(metrics_path), KEPT).filter(F.col("stamp") == stamp)
    first = rows.select("since").first()
    return first and Recent(rows.select(*COLUMNS), first.since)


def following(
    spark: SparkSession, metrics_path: str, done: list[dt.date], start: dt.date, full_history: bool = False
) -> Recent | None:
    """The kept rows, if a batch from ``start`` on may take its history from them."""
    if not done or start <= max(done):
        return None
    found = kept(spark, metrics_path, done)
    if found is None or found.since is None:
        return found
    return None if full_history or found.since > start - HISTORY else found


def history(
    spark: SparkSession,
    metrics_path: str,
    done: list[dt.date],
    start: dt.date,
    recent: Recent | None,
    full_history: bool = False,
) -> DataFrame:
    """What the averages of a batch from ``start`` on look back to.

    That is the four weeks before it, or all published rows: of the kept rows where they
    serve, else of the table.
    """
    if recent is None:
        days = done if full_history else [d for d in done if start - HISTORY <= d < start]
        return read_days(spark, metrics_path, TRAFFIC_METRICS, "date", days).select(*COLUMNS)
    if full_history:
        return recent.rows
    return recent.rows.filter(F.col("date") >= F.lit(start - HISTORY))


def keep(
    spark: SparkSession,
    metrics_path: str,
    before: list[dt.date],
    recent: Recent | None,
    full_history: bool = False,
) -> None:
    """Keep the last rows of the table for the next batch; ``before`` were its dates so far.

    ``recent`` rows are carried on with the new days alone. Without them the last four weeks
    are read, or with ``full_history`` all rows; kept rows know which of the two.
    """
    done = day_folders(spark, metrics_path, "date")
    stamp = _stamp(spark, metrics_path, done)
    if stamp is None:
        return
    if recent:
        since, days = recent.since, sorted(set(done) - set(before))
    else:
        since = max(done) + dt.timedelta(days=1) - HISTORY
        if full_history or min(done) >= since or not before:
            since = None
        days = [d for d in done if since is None or d >= since]
    rows = read_days(spark, metrics_path, TRAFFIC_METRICS, "date", days).select(*COLUMNS)
    if recent:
        rows = recent.rows.unionByName(rows)
    stamped = last_rows(rows).withColumns(
        {"since": F.lit(since).cast("date"), "stamp": F.lit(stamp)}
    )
    # A few rows a store: files as large as the writer makes them, not one for every shuffle partition.
    write_snapshot(stamped.hint("rebalance"), kept_path(metrics_path))
