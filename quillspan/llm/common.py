"""Shared helpers: table scans, durable cuts of lineage, and text expressions."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of an Arrow batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so lost executors cost nothing.

    The folder is the one the session names in spark.checkpoint.dir; only a local session without one
    (a test) gets a folder of its own. On a cluster, a folder of one machine would be lost with it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspan-checkpoint-"))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let the session delete the shuffle files and checkpoints that nothing refers to any more.

    Spark deletes them once the driver has collected its garbage, which it may not do for long; a loop with many small
    shuffles would fill the disks meanwhile.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Python workers get batches of BATCH_BYTES at most; a smaller limit of its own stays.

    Spark's own limit is 64 MB. A batch is held several times over, by the executor outside its heap and by the worker,
    and neither gives all of that back.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, prefix: str) -> str:
    """``prefix``, made longer until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_batch(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """Apply ``f`` to each Arrow batch; ``f`` returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = f(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)
