"""Helpers that the operators share: tables, the shared folder, batches and text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, wherever the driver was started.

    A cluster whose machines have it elsewhere, or get it with --py-files, is not disturbed.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach, as spark.checkpoint.dir names it.

    Where it is unset a temporary folder is made and set, on a local master only: elsewhere each machine would write to
    a disk of its own.  The temporary folder is deleted when the driver ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        made = tempfile.mkdtemp(prefix="burnish-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_kept: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; deleted by cleanup(), or when the driver ends."""
    path = f"{shared_dir(spark)}/burnish-{spark.sparkContext.applicationId}"
    if path not in _kept:
        _kept.add(path)
        atexit.register(_delete, path, spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def _delete(path: str, jvm, conf) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may have ended before
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to a path and read back, so a lost executor never forces its lineage to be redone."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to this application's folder and read back."""
    return written(df, f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def cleanup(spark: SparkSession) -> None:
    """Delete every table that materialise() has written for this application."""
    _delete(work_dir(spark), spark._jvm, spark._jsc.hadoopConfiguration())


#: A table is sent to every executor only if its measured bytes are within this.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, *, most: int | None = None) -> DataFrame:
    """df marked for broadcast if its measured size is within most bytes (default BROADCAST_BYTES), else as it is.

    Texts and arrays are measured in the rows, the rest counts 16 bytes a column; df should be a written table.
    """
    width = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            width = width + F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 16
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


def unused(columns: Iterable[str], name: str) -> str:
    """name, or name with underscores before it, so that no column is called that in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def content_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text, the same wherever and however often they are taken.

    Rows that repeat both share a key: they are alike in all that an operator decides about.
    """
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    parts = (id_, id_.isNull(), text, text.isNull())
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def row_id() -> Column:
    """A name for each input row, so that repeated ids stay separate rows."""
    return F.monotonically_increasing_id()


_memory: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), kept for the next tasks of this worker process; what was kept under another key goes first.

    A worker outlives its tasks and meets those of other operators, so it keeps one thing at a time.
    """
    if key not in _memory:
        _memory.clear()
        _memory[key] = make()
    return _memory[key]


def forget() -> None:
    """Drop what remembered() keeps. A function of the module, as closures that are sent to workers take copies of globals."""
    _memory.clear()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, remembers: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; what a task has freed goes back to the system, as idle workers live on beside busy ones.

    Unless run asks for something remembered(), what the worker's tasks before it have kept goes first.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def bounded_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most most_bytes of text (one row at least), so memory follows bytes, not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def string_array(array: pa.Array) -> pa.Array:
    """Nulls become empty texts; a copy that starts at offset zero, as some string kernels misread slices."""
    if array.offset:
        array = pa.concat_arrays([array, pa.array([], array.type)])
    return pc.fill_null(array.cast(pa.large_string()), "")
