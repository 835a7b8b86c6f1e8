"""Shared pieces of the training-data operators: scratch tables, row-wise Arrow functions, hashing.

Cutting lineage: ``materialize`` writes a table below ``spark.checkpoint.dir`` (the folder that
all executors share) and reads it again, so a lost executor costs a reread and no recomputation.
Joins on keys that may be hot are made between two such tables: both sides then have a plain
exchange, which adaptive execution can split where a key is large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shipping import ship

#: Where scratch tables go if the session names no folder and runs on one machine.
LOCAL_SCRATCH = "file:///tmp/checkpoints"
#: Rows in an Arrow batch; with texts of a few KB a batch is a few MB.
BATCH_ROWS = 500
BATCH_BYTES = "16m"
MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the table; removed when the driver's JVM ends.

    With ``partition_by``, its last column, the table has a folder for each value of it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, and let executors import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def append_columns(
    df: DataFrame,
    inputs: Sequence,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """``df`` with the columns ``fields``, computed batch by batch from the columns ``inputs``.

    ``make()`` is called once per task and returns the function that maps the Arrow arrays of the
    inputs to one sequence for each field. Columns of ``df`` that have the name of a field are replaced.
    """
    small_batches(df.sparkSession)
    kept = df.drop(*[f.name for f in fields])
    n_kept = len(kept.columns)
    names = [f"__in_{uuid.uuid4().hex[:8]}_{i}" for i in range(len(inputs))]
    wide = df.select(*[df[f"`{c}`"] for c in kept.columns], *[c.alias(n) for c, n in zip(inputs, names, strict=True)])
    schema = T.StructType([*kept.schema.fields, *fields])
    out_names = schema.fieldNames()
    arrow_types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                new = fn(*b.columns[n_kept:])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(new, arrow_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], *arrays], names=out_names)
        pa.default_memory_pool().release_unused()  # workers are used again by later tasks

    return wide.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def text_bytes(text_col: str):
    """The text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")


class WordHash(dict):
    """Word (bytes) to 64-bit hash, remembered for a bounded number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    x = h[:n].copy()
    for j in range(1, width):
        x = mix(x) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(x)


def remainder(id_col: str, m: int):
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % m


def unit_hash(col, seed: int):
    """A reproducible number in [0, 1) from a column."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 40)) / F.lit(float(1 << 40))
