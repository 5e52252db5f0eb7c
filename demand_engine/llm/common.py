"""Helpers shared by the operators: tables, shared work folder, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows of an Arrow batch that are Python objects at a time.
ROWS_AT_ONCE = 500
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id long, text string)``; a null text becomes the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. It is read from the
    session; only a local session without the setting gets a folder of its own."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts the
    lineage, and no later use (or lost executor) repeats the work before it.
    The files go when the application ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code() -> None:
    """Send this subpackage's functions to the executors with their tasks, so
    that it need not be installed there."""
    for name, module in list(sys.modules.items()):
        if name.startswith(__package__ + "."):
            cloudpickle.register_pickle_by_value(module)


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold ``BATCH_ROWS`` rows at most (the default of
    10,000 documents is tens of megabytes in the JVM and again in Python)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Sent:
    """A broadcast value of one of this subpackage's classes."""

    def __init__(self, spark: SparkSession, value):
        ship_code()
        self._broadcast = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "_value": None}

    def forget(self) -> None:
        """Drop the value; the next use unpacks it again."""
        self._value = None

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._broadcast.value)
        return self._value


def column_function(fn: Callable, returns: str):
    """A column function from ``fn``, a function of one pandas series."""
    ship_code()
    _small_batches(SparkSession.active())
    return F.pandas_udf(fn, returns)


def map_columns(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """One Arrow batch at a time: ``fn(*columns)`` gets the batch's columns as
    Python lists and returns the output columns in the order of ``schema``."""
    def rows(columns: list[list]) -> Iterator[tuple]:
        yield fn(*columns)
    return map_stream(df, lambda batches: (out for cols in batches for out in rows(cols)), schema)


def tidy() -> None:
    """Give memory that a finished partition has freed back to the system: a Python
    worker lives through all stages of an application."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def map_stream(df: DataFrame, fn: Callable[[Iterator[list]], Iterator[tuple]], schema: str,
               arrays: bool = False) -> DataFrame:
    """A partition at a time: ``fn`` gets an iterator of column lists (numpy
    arrays with ``arrays``) and yields tuples of output columns."""
    ship_code()
    if not arrays:
        _small_batches(df.sparkSession)
    out_type = T.StructType.fromDDL(schema)

    def columns(batch):
        if arrays:
            yield [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            return
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):  # bounds the Python objects alive
            yield [c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns]

    def run(batches):
        arrow = to_arrow_schema(out_type)
        for cols in fn(part for b in batches for part in columns(b)):
            arrays = [pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        cols = arrays = None
        tidy()

    return df.mapInArrow(run, out_type)


def fold_of(doc_id: Column, folds: int = 3) -> Column:
    """``crc32(doc_id as text) mod folds``, the fixed split of labelled rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two differently seeded 64-bit hashes."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
