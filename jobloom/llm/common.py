"""Helpers that the operators of this subpackage share: table paths, shared scratch tables, row-wise Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset (tests, local mode)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="jobloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


#: Folders that operators wrote and nobody has deleted yet.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; ``release`` deletes it."""
    _WRITTEN.append(f"{scratch(spark)}/jobloom-{what}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage in a way that survives a lost executor."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.jobloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "jobloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            if path in _WRITTEN:
                _WRITTEN.remove(path)


def written() -> frozenset[str]:
    """The folders that this session's operators have written and not yet deleted."""
    return frozenset(_WRITTEN)


def release(spark: SparkSession, but: frozenset[str] = frozenset()) -> None:
    """Delete every table and archive that this session's operators still keep, except ``but``; save results that read them before."""
    for path in [p for p in _WRITTEN if p not in but]:
        _delete(spark, path)
        _WRITTEN.remove(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` where the text is plain ASCII, ``translate`` elsewhere."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Rows of an Arrow batch: whole texts in it are held by the executor and by its Python worker at once.
ROWS = 1_000


def _in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded to ``ROWS`` rows; a smaller bound stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Apply ``make()(*column lists)``, which gives one list per output column, to slices of each Arrow batch.

    ``make`` runs once per task, so caches and models live as long as the task.  Slices hold at most about
    2 MB of text, so a batch of very long texts needs no more memory than a batch of short ones.
    """
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, arrow = make(), to_arrow_schema(out)
        for part in _slices(batches):
            cols = fn(*map(values, part.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return _in_small_batches(df).select(*columns).mapInArrow(run, out)


def fold_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Fold whole partitions: ``make()`` gives a task's fold, called with column lists slice by slice and at last with None.

    Each call gives the rows that the fold lets go of, as tuples of columns (lists or Arrow arrays), possibly none; so a
    fold holds what it gathers and spills it when that gets large.
    """
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, arrow = make(), to_arrow_schema(out)
        for part in itertools.chain(_slices(batches), (None,)):
            for cols in fold(part if part is None else [values(c) for c in part.columns]):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return _in_small_batches(df).select(*columns).mapInArrow(run, out)


def pieces(blob: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``blob`` in pieces of about ``size`` bytes, cut at spaces, so that a very long text is never one list of words."""
    at = 0
    while at < len(blob):
        end = blob.find(b" ", at + size)
        end = len(blob) if end < 0 else end
        yield blob[at:end]
        at = end


def rows_in_slices(rows: list[tuple], size: int = 20_000) -> Iterator[list[list]]:
    """Column lists of ``rows``, at most ``size`` rows at a time."""
    for at in range(0, len(rows), size):
        yield list(map(list, zip(*rows[at : at + size])))


def values(column: pa.Array) -> list:
    """A column as Python values; lists of numbers as numpy arrays."""
    if not pa.types.is_list(column.type) or not pa.types.is_primitive(column.type.value_type) or column.null_count:
        return column.to_pylist()
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [values[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)] if len(ends) else []


def _tidy() -> None:
    """Give back to the system what earlier tasks of this worker have left; the C library keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _tidy()
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * 2e6 / max(batch.nbytes, 1)) or 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, so that no name (a dot in it, or one that stands twice) can be misread."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def keep_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., list[bool]]]) -> DataFrame:
    """The rows of ``df``, with all its columns whatever their names, for which ``make()(*column lists)`` says true; no shuffle."""
    places = [df.columns.index(c) for c in columns]
    plain = _numbered(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in _slices(batches):
            yield part.filter(pa.array(fn(*(part.column(k).to_pylist() for k in places)), pa.bool_()))

    return _in_small_batches(plain).mapInArrow(run, plain.schema).toDF(*df.columns)


#: Keys (16 bytes each) up to which ``without`` broadcasts them.
KEYS = 4_000_000


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows; of a larger one Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df``, with all its columns whatever their names, whose ``column`` isn't in the one column of ``keys``."""
    plain, keys = _numbered(df), stored(keys.toDF("key").distinct(), "keys")
    return plain.join(small(keys, KEYS), plain[f"c{df.columns.index(column)}"] == keys.key, "left_anti").toDF(*df.columns)
