"""Commits that survive a killed driver: folders are swapped by a journal written first.

New folders are staged beside a dataset, in ``_commits-<dataset>/<commit>/new``. Once they are
complete, a plan naming them is put in place by one rename; from then on the commit counts, and
whoever comes next finishes it. Every step looks at what is there before it acts, so it can
be repeated from any point: a folder still staged takes its place, and the one it
replaces is kept in ``old`` until all are in place. Without a plan nothing was touched.

One writer at a time writes a dataset. The store must rename folders in one step, as
HDFS and local disks do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

#: The name of a whole dataset among the folders of a commit.
WHOLE = "."
#: Staged folders without a plan are left alone for so long: their writer may be at work.
STALE_HOURS = 48


def store_of(spark: SparkSession, path: str) -> Any:
    """The file system of ``path``."""
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    return bool(store_of(spark, path).exists(_path(spark, path)))


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a name not taken; done already counts as done."""
    store = store_of(spark, source)
    store.mkdirs(_path(spark, target).getParent())
    if not store.rename(_path(spark, source), _path(spark, target)):
        if _exists(spark, source) or not _exists(spark, target):
            raise RuntimeError(f"{source} can't be renamed to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    store_of(spark, path).delete(_path(spark, path), True)


def _write(spark: SparkSession, path: str, text: str) -> None:
    out = store_of(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str:
    data = store_of(spark, path).open(_path(spark, path))
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def names(spark: SparkSession, path: str) -> Iterator[str]:
    """Names directly below a folder, one after the other; a missing one has none."""
    if _exists(spark, path):
        entries = store_of(spark, path).listStatusIterator(_path(spark, path))
        while entries.hasNext():
            yield entries.next().getPath().getName()


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether there is anything of that name or pattern."""
    return bool(store_of(spark, pattern).globStatus(_path(spark, pattern)))


def commits_folder(path: str) -> str:
    """Where a dataset's commits are; Spark's readers pass over its name."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_commits-{name}" if parent or path.startswith("/") else f"_commits-{name}"


def begin(spark: SparkSession, path: str) -> str:
    """Finish what an earlier writer left, and name the folder of a new commit."""
    recover(spark, path)
    return f"{commits_folder(path)}/{uuid.uuid4().hex}"


def staged(commit: str, name: str = WHOLE) -> str:
    """Where the new folder ``name`` of a commit is to be written."""
    return f"{commit}/new" if name == WHOLE else f"{commit}/new/{name}"


def publish(spark: SparkSession, path: str, commit: str, names: list[str]) -> None:
    """Put the staged folders ``names`` in the place of those of the dataset."""
    _write(spark, f"{commit}/plan.part", "\n".join(names))
    _move(spark, f"{commit}/plan.part", f"{commit}/plan")
    _finish(spark, path, commit)


def abandon(spark: SparkSession, commit: str) -> None:
    """Remove what was staged, unless it counts already."""
    if not _exists(spark, f"{commit}/plan"):
        _delete(spark, commit)


def _finish(spark: SparkSession, path: str, commit: str) -> None:
    root = path.rstrip("/")
    for name in _read(spark, f"{commit}/plan").split("\n"):
        new, old = staged(commit, name), f"{commit}/old" if name == WHOLE else f"{commit}/old/{name}"
        target = root if name == WHOLE else f"{root}/{name}"
        if _exists(spark, new):
            if _exists(spark, target):
                if _exists(spark, old):
                    raise RuntimeError(f"{target} was written while {commit} was in progress")
                _move(spark, target, old)
            _move(spark, new, target)
        elif not _exists(spark, target):
            raise RuntimeError(f"{target} is lost: neither in place nor in {commit}")
    _write(spark, f"{commits_folder(path)}/version", commit.rpartition("/")[2])
    # A commit whose plan is gone counts as not begun, so the plan goes last.
    for part in ("old", "new"):
        _delete(spark, f"{commit}/{part}")
    _delete(spark, commit)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish commits of a dataset that were planned and not finished; whether there was one.

    Staged folders that never got a plan are removed when they are old.
    """
    folder, found = commits_folder(path), False
    store = store_of(spark, folder)
    if not _exists(spark, folder):
        return False
    for entry in store.listStatus(_path(spark, folder)):
        if not entry.isDirectory():
            continue
        commit = f"{folder}/{entry.getPath().getName()}"
        if _exists(spark, f"{commit}/plan"):
            _finish(spark, path, commit)
            found = True
        elif time.time() - entry.getModificationTime() / 1000 > STALE_HOURS * 3600:
            _delete(spark, commit)
    return found


def version(spark: SparkSession, path: str) -> str | None:
    """The last commit of a dataset; None if no commit wrote it."""
    stamp = f"{commits_folder(path)}/version"
    return _read(spark, stamp) if _exists(spark, stamp) else None
