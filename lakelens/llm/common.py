"""Session helpers that the operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts name it: \x20 and \x09-\x0D, exactly what bytes.split() splits on.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the cluster names none, a temporary one is set in local mode, where every task
    runs on this machine; elsewhere that is an error, as executors would write to disks that the others can't see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_now = spark.sparkContext.getCheckpointDir()
    if set_now is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakelens-"))
        set_now = spark.sparkContext.getCheckpointDir()
    return set_now.rstrip("/")


#: The folder of this process's stashes, by session's application.
_OWN: dict[str, str] = {}


def stash_dir(spark: SparkSession) -> str:
    """A folder below the shared one for what this application writes between stages. It's removed when the driver ends, as a
    result may be read until then; what a killed driver leaves is named by its application's id."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{shared_dir(spark)}/lakelens/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Through Spark's own file system, wherever the folder is; a session that has ended can't."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone at exit, and nothing depends on this
        pass


#: Set, a query's shuffle files go at its end. Else they stay until the driver happens to collect its garbage, so that those of
#: all steps of an operator may lie on the disks at once.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """Queries that run here leave no shuffle files behind."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{stash_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of df has, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    while len(out) < n:
        name = f"__own{len(out)}"
        while name in have:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(col):
    """crc32 of the id's text modulo 5; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % 5


def with_columns(df: DataFrame, inputs: list[str], fn, fields: list) -> DataFrame:
    """df with new columns from fn(list of Arrow arrays) -> list of Arrow arrays, a batch at a time. A column of df that has
    a new column's name is replaced by it."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    new = {f.name for f in fields}
    keep = [i for i, c in enumerate(df.columns) if c not in new]
    at = [df.columns.index(c) for c in inputs]
    schema = StructType([df.schema.fields[i] for i in keep] + list(fields))
    names = schema.names

    def run(batches):
        for whole in batches:
            for first, n in spans([whole.column(i) for i in at], whole.num_rows):
                b = whole.slice(first, n)
                yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + fn([b.column(i) for i in at]), names=names)

    return df.mapInArrow(trimmed(run), schema)


def spans(cols: list, rows: int, most_rows: int = 1024, most_bytes: int = 2_000_000):
    """(first row, rows) of slices with at most so many rows and, unless one row alone has more, so many bytes of strings."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.zeros(rows + 1, np.int64)
    for c in cols:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size[1:] += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    size, first = np.cumsum(size), 0
    while first < rows:
        last = min(first + most_rows, int(np.searchsorted(size, size[first] + most_bytes, "right")) - 1)
        last = max(last, first + 1)
        yield first, last - first
        first = last


def trimmed(fn):
    """fn, a function of a task's Arrow batches, that gives freed memory back at its end: idle workers stay beside the JVM."""
    import ctypes

    import pyarrow as pa

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def tree_sum(vectors: DataFrame, size: int):
    """Sum of int64 vectors, given as rows with a binary column v, over levels of at most 16 to a task."""
    import numpy as np
    import pyarrow as pa

    def add(batches):
        total, any_row = np.zeros(size, np.int64), False
        for b in batches:
            for v in b.column(0).to_pylist():
                total, any_row = total + np.frombuffer(v, np.int64), True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    n = vectors.rdd.getNumPartitions()
    while n > 16:
        n = -(-n // 16)
        vectors = vectors.repartition(n).mapInArrow(add, "v binary")
    return sum((np.frombuffer(r.v, np.int64) for r in vectors.toLocalIterator()), np.zeros(size, np.int64))
