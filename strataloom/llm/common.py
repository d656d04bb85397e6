"""Helpers shared by the corpus operators: shared storage, Arrow batches, word splitting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into arrays at a time; one longer text goes alone.
SLICE_BYTES = 2_000_000

#: Rows that go to a Python worker at a time.
BATCH_ROWS = 2000

#: The white space of ``[\x20\x09-\x0D]``, which is also what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is
    unset in a local session, a temporary folder that is then set for the session. On a cluster an
    unset folder is an error, as executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives
    lost executors, and lets later steps scan narrow columns instead of the texts."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._strataloom_path = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing may read them any more."""
    for table in tables:
        path = getattr(table, "_strataloom_path", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table. Files of fewer row groups than there are cores are dealt out, as one
    row group is one task."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def filesystem(uri: str):
    """(file system, path) for a URI or a plain path, on the driver and on executors alike."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_atomic(uri: str, chunks) -> None:
    """Write byte chunks under a temporary name, then rename; a retried task replaces the file
    with the same bytes."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(part, path)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n+1 offsets) of a string column, nulls as empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset or len(column) == 0:
        column = pa.concat_arrays([column, pa.array([], pa.large_string())])
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    first = column.offset
    offsets = np.frombuffer(offsets, np.int64)[first : first + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece hold about ``limit`` bytes at most."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < n:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in order, n+1 offsets of the texts in them); words are what white
    space separates. ``data`` has to be valid UTF-8."""
    column = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    split = pc.ascii_split_whitespace(column)
    words, at = split.flatten(), np.asarray(split.offsets, np.int64)
    some = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), kept[at - at[0]]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each interval of ``offsets``; empty intervals give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that a session needs no other set-up; batches of
    texts that go to workers are made smaller than Spark's own."""
    context = spark.sparkContext
    if getattr(context, "_strataloom_shipped", False):
        return
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="strataloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, str(file.relative_to(package.parent)))
        context.addPyFile(str(archive))
    context._strataloom_shipped = True


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which gives a reused worker's free memory back to the system when its task is done."""

    def tidied(batches):
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def arrow_rows(df: DataFrame, columns: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns alone, so that clashing extra columns never matter, nor
    does what is in a name."""
    ship(df.sparkSession)

    def named(batches):
        return run(b.rename_columns(columns) for b in batches)

    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(tidy(named), schema)


def crc32_mod(column, modulus: int):
    """crc32 of a column as text, modulo; null ids count as remainder 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0))


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counts`` with ``n`` at or above some value, ``most`` rows at most.

    The value comes from a histogram of n on a logarithmic scale, a few hundred rows; a sort with a
    limit would send ``most`` rows of every task to the driver.
    """
    bucket = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    histogram = sorted(((r.b, r.k) for r in counts.where(F.col(n) > 0).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, taken = None, 0
    for b, k in histogram:
        if taken + k > most:
            break
        least, taken = b, taken + k
    return counts.where((F.col(n) > 0) & (bucket >= least)) if least is not None else counts.limit(0)
