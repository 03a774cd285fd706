"""Readers for the model tables: Parquet datasets and JSON feeds."""

from __future__ import annotations

import datetime as dt
import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter import journal
from shopmeter.schemas import conform, parse_date
from shopmeter.session import durable
from shopmeter.sources.arrays import array_elements

PARTITIONED_FEEDS = ["sales", "retail_data"]
NOTHING_THERE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
# Names of suspect files that the driver holds at once.
NAMES_AT_ONCE = 1_000


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A Parquet dataset in its declared types; a missing or empty path has no rows.

    Files may differ in columns and in numeric types. Any other read error is raised.
    """
    try:
        return read_dataset(spark, path, schema, **options)
    except AnalysisException as error:
        if error.getCondition() not in NOTHING_THERE:
            raise
        # A snapshot is not in its place while a commit that was cut off holds it.
        if journal.recover(spark, path):
            return read_dataset(spark, path, schema, **options)
        return empty(spark, schema)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Like :func:`read_table`, but a missing or empty path is an error too."""
    try:
        found = spark.read.options(mergeSchema="true", **options).parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if not _is_conflict(error):
            raise
        return read_mixed(spark, [path], schema, **{"basePath": path, **options})
    return conform(found, schema)


def list_files(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Parquet files with their partition columns and metadata; their content is not read."""
    return spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", **options).load(path)


def read_mixed(
    spark: SparkSession, paths: list[str], schema: T.StructType, partition: str | None = None,
    all_columns: bool = False, **options: str,
) -> DataFrame:
    """Folders or files that may differ in columns and types, as one frame of declared types.

    A count column is whole on one day and floating on a day with gaps when the
    writer infers types, and a file may lack a column that others have. The columns
    of all files are united from their footers in one distributed pass; a column is
    null only in files without it. Spark can't unite columns of different types: a second
    pass over the footers then groups the files by them, and there is one strict scan for each
    set of types that disagree. A file without a readable footer is an error; with
    ``all_columns`` so is a column that ``schema`` lacks.
    """
    frames = []
    for members, found in _agreeing(spark, paths, **options):
        unknown = set(found.names) - set(schema.names) - {partition}
        if all_columns and unknown:
            raise ValueError(f"columns that would be lost: {', '.join(sorted(unknown))}")
        frames.append(conform(_typed(spark, members, found, schema, partition, **options), schema))
    return functools.reduce(DataFrame.unionByName, frames) if frames else empty(spark, schema)


def _typed(
    spark: SparkSession, paths: list[str], found: T.StructType, schema: T.StructType, partition: str | None, **options: str
) -> DataFrame:
    fields = [f for f in found if f.name != partition]
    if partition:
        fields.append(schema[partition])
    return spark.read.schema(T.StructType(fields)).options(**options).parquet(*paths)


def _is_conflict(error: Exception) -> bool:
    return "CANNOT_MERGE_SCHEMAS" in str(error)


def _agreeing(spark: SparkSession, paths: list[str], **options: str) -> Iterator[tuple[list[str], T.StructType]]:
    """Parts of the paths with the columns of all their files; missing paths are left out.

    As many parts as there are sets of types that can't be united, in whatever order they come.
    """
    there = [path for path in paths if journal.matches(spark, path)]
    if not there:
        return
    merged = spark.read.options(mergeSchema="true", **options)
    try:
        yield there, merged.parquet(*there).schema
        return
    except (PySparkException, Py4JJavaError) as error:
        condition = error.getCondition() if isinstance(error, AnalysisException) else None
        if condition == "UNABLE_TO_INFER_SCHEMA":
            # Files of no schema are broken; no file at all is no data.
            if not list_files(spark, there, **options).isEmpty():
                raise
            return
        if not _is_conflict(error):
            raise
    for members in by_footer(spark, there, **options):
        yield members, merged.parquet(*members).schema


def by_footer(spark: SparkSession, paths: list[str], **options: str) -> list[list[str]]:
    """The paths' folders, grouped so that no column has two types in a group.

    One distributed pass reads every footer, in the tasks. The driver gets the different
    schemas, each with the folders that hold it, and the files of those folders alone that hold
    several. A file without a readable footer is an error.
    """
    listed = list_files(spark, paths, **options)
    names = listed.select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("uri"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = names.repartition(tasks).withColumn("content", F.lit(None).cast("binary"))
    try:
        pa_fs.FileSystem.from_uri(names.first()["uri"])
    except (pa.ArrowException, OSError, ValueError):
        # A store that only Spark reaches: it hands over the files, footers and all.
        files = listed.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("uri"), "content")
    footers = files.mapInArrow(_read_footers, "file string, columns string")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    indexed = durable(footers.withColumn("folder", folder))
    kinds = indexed.groupBy("folder").agg(F.collect_set("columns").alias("all"))
    groups: list[tuple[dict[str, str], list[str]]] = []
    mixed = []
    for row in kinds.collect():
        if len(row["all"]) == 1 or _united([json.loads(c) for c in row["all"]]) is not None:
            _place(groups, [json.loads(c) for c in row["all"]], row["folder"])
        else:
            mixed.append(row["folder"])
    if mixed:
        for row in indexed.filter(F.col("folder").isin(mixed)).select("file", "columns").toLocalIterator():
            _place(groups, [json.loads(row["columns"])], row["file"])
    return [sorted(members) for _, members in groups]


def _united(schemas: list[dict[str, str]]) -> dict[str, str] | None:
    """The columns of several schemas in one; None if a column has two types."""
    out: dict[str, str] = {}
    for schema in schemas:
        for column, kind in schema.items():
            if out.setdefault(column, kind) != kind:
                return None
    return out


def _place(groups: list[tuple[dict[str, str], list[str]]], schemas: list[dict[str, str]], member: str) -> None:
    """Put a folder or file into the first group that it agrees with."""
    for i, (known, members) in enumerate(groups):
        united = _united([known, *schemas])
        if united is not None:
            members.append(member)
            groups[i] = (united, members)
            return
    groups.append((_united(schemas) or {}, [member]))


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of every file, as text: their names and types."""
    for batch in batches:
        columns = []
        for i, uri in enumerate(batch.column(1).to_pylist()):
            if uri is None:
                found = pq.read_schema(pa.BufferReader(batch.column(2)[i].as_buffer()))
            else:
                store, path = pa_fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    found = pq.read_schema(file)
            columns.append(json.dumps({field.name: str(field.type) for field in found}, sort_keys=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.string())], names=["file", "columns"])


def day_folders(spark: SparkSession, path: str, column: str) -> list[dt.date]:
    """Dates of a dataset's folders named ``column=YYYY-MM-DD``, at most one per calendar day.

    Only the first level below ``path`` is listed; a missing path has none. A folder or
    file of another name is an error, unless it is hidden (``_`` or ``.``).
    """
    days = []
    for name in journal.names(spark, path):
        if name[:1] in "_.":
            continue
        if not name.startswith(f"{column}="):
            raise ValueError(f"{path} is not partitioned by {column}: {name}")
        value = name.partition("=")[2]
        if value != "__HIVE_DEFAULT_PARTITION__":
            days.append(dt.date.fromisoformat(value))
    return sorted(set(days))


def read_days(
    spark: SparkSession, path: str, schema: T.StructType, column: str, days: Iterable[dt.date], all_columns: bool = False
) -> DataFrame:
    """Some days of a dataset partitioned by ``column``; only their folders are listed."""
    root = path.rstrip("/")
    folders = [f"{root}/{column}={day.isoformat()}" for day in days]
    return read_mixed(spark, folders, schema, column, all_columns, basePath=root)


def read_json_feed(
    spark: SparkSession, path: str, schema: T.StructType, lines: bool = True
) -> DataFrame:
    """A JSON feed, error rows included, so that they can be counted.

    A missing path is an error, and so is a line or file that is no JSON, found when the
    rows are read: no feed is taken for an empty one. Numbers may come as ``5.0`` or as
    text. A value that doesn't fit its column makes an error row, which names the column.

    ``lines`` is the layout to use: JSON lines, or else files that are one array each. Both are
    split between tasks; a file that is a single object is read by one task.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in [*schema.fields, _ERROR, _BROKEN]])
    found = _json(spark, path, as_text, "false") if lines else _json_arrays(spark, path, as_text)
    broken = F.raise_error(F.concat(F.lit("no JSON: "), F.substring(_BROKEN.name, 1, 200)))
    misfit, columns = F.lit(None).cast("string"), []
    for field in schema.fields:
        value = _from_text(field)
        given = F.col(field.name).isNotNull()
        misfit = F.coalesce(misfit, F.when(given & value.isNull(), F.lit(f"unfit {field.name}")))
        columns.append(value.alias(field.name))
    # The check rides on the error column, which every use of a feed reads.
    error = F.when(F.col(_BROKEN.name).isNotNull(), broken).otherwise(F.coalesce("error", misfit))
    return found.select(*columns, error.alias("error"))


def _json(spark: SparkSession, path: str | list[str], schema: T.StructType, whole: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", whole)
    return reader.option("columnNameOfCorruptRecord", _BROKEN.name).json(path)


def _json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    elements, others = array_elements(spark, path)
    options = {"columnNameOfCorruptRecord": _BROKEN.name}
    parsed = elements.select("broken", F.from_json("value", schema, options).alias("o"))
    names = [F.col(f"o.{f.name}").alias(f.name) for f in schema if f.name != _BROKEN.name]
    found = parsed.select(*names, F.coalesce("broken", f"o.{_BROKEN.name}").alias(_BROKEN.name))
    if others:
        found = found.unionByName(_json(spark, others, schema, "true").select(*found.columns))
    return found


_ERROR = T.StructField("error", T.StringType())
_BROKEN = T.StructField("_broken", T.StringType())


def _from_text(field: T.StructField) -> Column:
    """A value sent as text in its declared type, null where it doesn't fit."""
    text = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, T.DateType):
        return parse_date(text)
    if isinstance(field.dataType, T.IntegralType):
        exact = text.try_cast("decimal(38,10)")
        return F.when(exact == F.floor(exact), exact.try_cast(field.dataType))
    return text.try_cast(field.dataType)


def error_rows(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that carry an error message or lack a key."""
    broken = F.col("error").isNotNull()
    for key in keys:
        broken = broken | F.col(key).isNull()
    return feed.filter(broken)


def drop_error_rows(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The usable rows of a feed, without the error column."""
    return feed.filter(F.col("error").isNull()).dropna(subset=keys).drop("error")


_CACHED: dict[tuple[str, str], tuple[str | None, DataFrame]] = {}


def cached_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table kept in executor memory (spilling to disk) for a session of lookups.

    Ask for it at every lookup: the rows kept are used again until a sink of this library
    commits to the table, from any session, and read anew then. Other writers go unnoticed.
    """
    root = path.rstrip("/")
    key, now = (spark.sparkContext.applicationId, root), journal.version(spark, root)
    kept = _CACHED.get(key)
    if kept and kept[0] == now and kept[1].schema == schema:
        return kept[1]
    if kept:
        kept[1].unpersist()
        spark.catalog.refreshByPath(root)
    _CACHED[key] = (now, read_table(spark, root, schema).cache())
    return _CACHED[key][1]


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``file, records, readable`` of every Parquet file below a folder.

    Records are counted from footers, so one reader serves files of any schema. Files
    that gave no row are looked at one by one: one that begins and ends as Parquet files
    do is counted again, strictly, the others are not readable and have null records.
    """
    below = {"recursiveFileLookup": "true"}
    name = F.col("_metadata.file_path").alias("file")
    listed = list_files(spark, path, **below).select(name)
    loose = spark.read.schema("any string").options(pathGlobFilter="*.parquet", **below)
    counted = loose.options(ignoreCorruptFiles="true").parquet(path).groupBy(name).agg(F.count("*").alias("records"))
    known = listed.join(counted, "file", "left")
    parts = [known.filter("records is not null").withColumn("readable", F.lit(True))]
    for names in _portions(known.filter("records is null").select("file")):
        content = spark.read.format("binaryFile").load(names)
        mark = F.lit("PAR1").cast("binary")
        whole = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
        looked = content.select(name, whole.alias("readable")).collect()
        for readable in (True, False):
            found = [(r["file"], 0 if readable else None, readable) for r in looked if r["readable"] == readable]
            if found:
                rows = spark.createDataFrame(found, "file string, records long, readable boolean")
                if readable:
                    again = spark.read.schema("any string").parquet(*[f[0] for f in found])
                    again = again.groupBy(name).agg(F.count("*").alias("again"))
                    rows = rows.join(again, "file", "left").select("file", F.coalesce("again", "records").alias("records"), "readable")
                parts.append(rows)
    return functools.reduce(DataFrame.unionByName, parts)


def _portions(names: DataFrame) -> Iterator[list[str]]:
    """File names in lists of bounded length."""
    portion: list[str] = []
    for row in names.toLocalIterator():
        portion.append(row[0])
        if len(portion) == NAMES_AT_ONCE:
            yield portion
            portion = []
    if portion:
        yield portion


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the Parquet files below a folder that can't be read."""
    return file_inventory(spark, path).filter("not readable").select("file")


def extract_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files and records per stored dataset below the extract root.

    A partitioned feed reports one row per day folder, everything else one row
    per file or folder directly under the root.
    """
    below = F.substring_index("file", root.rstrip("/") + "/", -1)
    top = F.substring_index(below, "/", 1)
    day_folder = F.regexp_replace(below, "/[^/]*$", "")
    return (
        file_inventory(spark, root)
        .withColumn("dataset", F.when(top.isin(*PARTITIONED_FEEDS), day_folder).otherwise(top))
        .groupBy("dataset")
        .agg(
            F.count("*").alias("files"),
            F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
            F.count_if(~F.col("readable")).alias("unreadable_files"),
        )
    )


def table_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Record count per named dataset."""
    counts = [
        spark.read.parquet(path).agg(F.count("*").alias("records")).select(
            F.lit(name).alias("table_name"), "records"
        )
        for name, path in paths.items()
    ]
    return functools.reduce(DataFrame.unionByName, counts)
