"""K3, K4, V2: an append-only log of what is published.

A root holds data folders and ``_versions/<n>.json``, one small file per
published version: the names of all folders that belong to it. Readers take
the newest entry and read exactly its folders, so several folders (events and
their roll-up, say) switch together. An entry is created only if its number is
free, which the file system decides: of two refreshes that end at once, one gets
the number and the other looks at the new state and tries the next one. Numbers
have no gaps, so the newest is found by a search over them; nobody lists or
collects the log.

On a local path (``file:``, also a shared mount) an entry is made by a hard link,
elsewhere by the file system's rename, which fails on an existing target. The
data itself goes through Spark's writers.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

LOG = "_versions"
Folders = dict[str, list[str]]


class ConcurrentRefresh(RuntimeError):
    """Others took every number that was tried."""


@dataclass(frozen=True)
class Version:
    """One entry; version 0 stands for a root where nothing was published yet."""

    number: int = 0
    folders: Folders = field(default_factory=dict)
    loads: dict[str, int] = field(default_factory=dict)
    rows: int | None = None
    committed_at: str | None = None


def _entry(spark: SparkSession, root: str, number: int):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{LOG}/{number:012d}.json")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _published(spark: SparkSession, root: str, number: int) -> bool:
    fs, path = _entry(spark, root, number)
    return bool(fs.exists(path))


def newest(spark: SparkSession, root: str) -> int:
    """The newest version's number, 0 if there is none; about 2 log2(n) looks."""
    high = 1
    while _published(spark, root, high):
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if _published(spark, root, mid) else (low, mid)
    return low


def read(spark: SparkSession, root: str, number: int) -> Version:
    fs, path = _entry(spark, root, number)
    if not fs.exists(path):
        raise FileNotFoundError(f"no committed version {number} under {root}")
    stream = fs.open(path)
    try:
        got = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(number, got["folders"], got["loads"], got["rows"], got["committed_at"])


def current(spark: SparkSession, root: str) -> Version:
    number = newest(spark, root)
    return read(spark, root, number) if number else Version()


def claim(spark: SparkSession, root: str, version: Version) -> bool:
    """Create the entry of ``version.number``, whole or not at all; False if the number is taken."""
    fs, path = _entry(spark, root, version.number)
    text = json.dumps({"folders": version.folders, "loads": version.loads, "rows": version.rows,
                       "committed_at": dt.datetime.now(dt.timezone.utc).isoformat()})
    if fs.getUri().getScheme() == "file":
        target = path.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.draft-{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{LOG}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = not fs.exists(path) and bool(fs.rename(draft, path))
    if not done:
        fs.delete(draft, False)
    return done


def known(version: Version, source: str, number: int) -> bool:
    """Whether a source's load of this number, or a later one, is published; only the last is kept."""
    return version.loads.get(source, -1) >= number


def commit(spark: SparkSession, root: str, update: Callable[[Version], Folders | None], *,
           load: tuple[str, int] | None = None, rows: int | None = None, tries: int = 50) -> int:
    """Publish ``update(newest version)`` as the next one, and return its number.

    If another refresh publishes in between, ``update`` is asked again with
    the new state. ``load`` is a source's name and its running number; one
    that is published already changes nothing, nor does an update of None.
    """
    for _ in range(tries):
        now = current(spark, root)
        if load is not None and known(now, *load):
            return now.number
        folders = update(now)
        if folders is None:
            return now.number
        loads = now.loads | ({load[0]: load[1]} if load is not None else {})
        if claim(spark, root, Version(now.number + 1, folders, loads, rows)):
            return now.number + 1
    raise ConcurrentRefresh(f"{tries} versions of {root} were taken by others")


def new_folder(root: str, kind: str) -> str:
    """A folder of its own; it counts only once an entry names it."""
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
