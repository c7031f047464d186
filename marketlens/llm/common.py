"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens.session import scratch_path

#: Rows and bytes of an Arrow batch. Texts have no length limit, so a batch is kept to a few
#: hundred rows and some MB; one longer text is a batch of its own.
ARROW_BATCH_ROWS = 256
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings that the Arrow operators rely on for bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a given table; further columns never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files every executor can read, so that a lost executor
    costs a task and not the whole chain, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    tries = (name if k == 0 else f"{name}_{k}" for k in range(len(taken) + 1))
    return next(x for x in tries if x.lower() not in taken)


#: What outlives a task in this worker process, by the operator that holds it, and the one that ran last.
_HELD: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def held_by(name: str, release: Callable[[], None]) -> None:
    _HELD[name] = release


def entering(name: str) -> None:
    """Called as an operator's tasks start: what other operators left in this process goes back to the system."""
    if _LAST == [name]:
        return
    for k in [k for k in _HELD if k != name]:
        _HELD.pop(k)()
    if _LAST:
        trimmed()
    _LAST[:] = [name]


def lean(name: str, fn):
    """A batch function that leaves no memory behind: neither others' at its start nor its own at its end."""
    def run(batches):
        entering(name)
        try:
            yield from fn(batches)
        finally:
            trimmed()
    return run


def trimmed() -> None:
    """Free memory goes back to the system; a worker process may idle long after its task."""
    import ctypes
    import gc
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
