"""Helpers shared by the training-data operators."""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pairlens.llm

# Executors need no installed copy of the package: its functions travel with the task.
cloudpickle.register_pickle_by_value(pairlens.llm)

#: Text bytes that one numpy step works on; bounds a task's memory whatever the Arrow batch holds.
SLICE_BYTES = 8 << 20
#: Rows that Spark hands to a Python worker at once.
ARROW_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as checkpoint folder.

    A folder of this process is used only where the setting is absent in local mode (tests).
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this job in the shared store, once all that is read from it is written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (Spark's names ignore case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the rows that Spark hands to Python at once, for the session and to the same number always: texts
    may be long, and a batch is held on both sides. Larger runs of rows are gathered in the task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(conf.get(name, "0"))
    if not 0 < rows <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows holding about ``limit`` bytes of ``column`` (a longer row stands alone)."""
    n = batch.num_rows
    if not n:
        return
    ends = string_offsets(batch.column(batch.schema.get_field_index(column)))[1:]
    at, base = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at, base = to, int(ends[to - 1])


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about ``limit`` bytes of ``column``, however few rows Spark hands over at once."""
    held, size = [], 0
    for batch in batches:
        more = int(string_offsets(batch.column(batch.schema.get_field_index(column)))[-1]) if batch.num_rows else 0
        if held and size + more > limit:
            yield from slices(joined(held), column, limit)
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield from slices(joined(held), column, limit)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of all batches as one."""
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def string_offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1, from 0) of a string column."""
    wide = pa.types.is_large_string(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    out = raw[col.offset: col.offset + len(col) + 1].astype(np.int64)
    return out - out[0]


def string_bytes(col: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of a string column without nulls, end to end."""
    wide = pa.types.is_large_string(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    lo, hi = int(raw[col.offset]), int(raw[col.offset + len(col)])
    data = col.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over bounded runs of rows, inside tasks, in the order of the rows."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                yield fn(part)
    return small_batches(df).mapInArrow(run, schema)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker, kept between the tasks that the worker runs."""
    held = sys.modules.setdefault("_llm_worker_cache", type(sys)("_llm_worker_cache")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
