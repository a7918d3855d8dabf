"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; results carry null again.
NULL_ID = -(2**63)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text)`` of a table: ids as long, null texts as empty ones.

    All other columns are left out before anything else, so that their names
    can't clash with those an operator uses.
    """
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the driver and all executors share.

    That is ``spark.checkpoint.dir`` of the session.  Where it is unset, local
    sessions get a temporary folder and others a folder of the warehouse.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidelog"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder, which is there already, when the application ends."""
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)


def materialised(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there; the folder goes when the application ends."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


class Scratch:
    """The folders that an operator writes between its steps.

    Folders are removed as soon as no later step reads them; those that the
    operator's result reads stay until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[tuple[DataFrame, str, dict]] = []

    def written(self, df: DataFrame, name: str, at_most: int | None = None, each: int = 100_000, **measures: Column) -> DataFrame:
        """The rows of ``df``, written and read again; they are counted on the way, and ``measures`` are taken.

        With a bound ``at_most`` on the rows, no more files are written than
        hold ``each`` rows, as a small table in many files costs more than it
        holds.
        """
        path, seen = shared_dir(self.spark, name), Observation()
        if at_most is not None:
            df = df.coalesce(at_most // each + 1)
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())).write.parquet(path)
        remove_at_exit(self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.folders.append((out, path, seen.get))
        return out

    def seen(self, table_: DataFrame) -> dict:
        """What was measured of a written table; ``rows`` is their number."""
        return next(m for t, _, m in self.folders if t is table_)

    def drop(self, *tables: DataFrame) -> None:
        """Removes the folders of tables that :meth:`written` has given."""
        for table_, path, _ in self.folders:
            if any(table_ is t for t in tables):
                remove_dir(self.spark, path)
        self.folders = [f for f in self.folders if not any(f[0] is t for t in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Removes all folders but those of ``tables``."""
        self.drop(*(t for t, *_ in self.folders if not any(t is x for x in tables)))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without a detour over str."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


_OWN: dict = {}


def worker_state(owner: str, key, build):
    """What an operator keeps in a worker process between batches and tasks: built once, for one key.

    Workers are reused by later stages; a process keeps the state of one
    operator at a time, so tables and memos of several don't add up.
    """
    if _OWN.get("owner") != owner or _OWN.get("key") != key:
        _OWN.clear()
        _OWN.update(owner=owner, key=key, state=build())
    return _OWN["state"]


def forget_state(owner: str) -> None:
    """Frees what another operator has kept in this process."""
    if _OWN.get("owner") not in (None, owner):
        _OWN.clear()
        release()


def release() -> None:
    """Gives memory that this process has freed back to the machine, which the executor shares with its workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows are handed on in slices of about this many bytes, so that what they become in Python is small beside an executor.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """A batch in slices of consecutive rows, of at most about ``most`` bytes or one row each."""
    n = batch.num_rows
    if batch.nbytes <= most or n < 2:
        if n:
            yield batch
        return
    size = np.full(n, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            size += column.nbytes // n
    ends, a = np.cumsum(size), 0
    while a < n:
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def map_batches(df: DataFrame, fn, schema: str, owner: str = "") -> DataFrame:
    """``fn`` (RecordBatch to RecordBatch, or a generator of them) over slices of Arrow batches; ``owner`` may have worker state."""

    def run(batches):
        forget_state(owner)
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        release()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, judge, text_col: str = "text", owner: str = "") -> DataFrame:
    """Rows of ``df``, all columns, for which ``judge`` (batch of UTF-8 texts to booleans) is true; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches):
        forget_state(owner)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judge(as_bytes(part.column(at))), pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
