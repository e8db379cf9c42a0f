"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, local mode) a temporary folder is made
    and set; on a cluster without the setting this raises instead of using a local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='citytables-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", compression).option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def lookup(rows: DataFrame, known: DataFrame, on: list[str], places: str, hot: int) -> DataFrame:
    """rows with the columns that known has for their key (one row a key; rows without one are left out).

    places, a column of known, says how many rows a key has about. Keys of more than hot rows are few - the
    rows by hot at most - and known's rows of these are broadcast, so that no task gets all rows of one key.
    """
    crowded = known.where(F.col(places) > hot)
    calm = rows.join(F.broadcast(crowded.select(*on)), on, "left_anti").join(known.where(F.col(places) <= hot), on)
    return calm.unionByName(rows.join(F.broadcast(crowded), on))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores behind those that the columns already have in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fields(schema) -> str:
    """A schema as the text that mapInArrow takes."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _give_back() -> None:
    """Return the memory that this worker has freed to the system: an idle worker lives on beside the next stage's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches() -> None:
    """Arrow batches of 4 MB at most in this session, unless it asks for less: rows may hold long texts."""
    spark = SparkSession.getActiveSession()
    if spark is not None and int(re.sub(r"\D", "", spark.conf.get(_BATCH_BYTES))) > 4 << 20:
        spark.conf.set(_BATCH_BYTES, str(4 << 20))


def rested(spark: SparkSession) -> None:
    """Have the executors' JVMs collect once: heap that a stage made them grow to goes back to the system ahead of the next.

    An executor's JVM otherwise keeps all it has ever touched, beside the Python workers of the stages to come.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def tidy(run):
    """An Arrow task function that gives freed memory back to the system at its end; its batches are of bounded size."""
    _small_batches()

    def tidied(given):
        try:
            yield from run(given)
        finally:
            _give_back()

    return tidied


def tidy_group(run):
    """The same for a function of one group; often enough, as groups are small."""
    _small_batches()

    def tidied(group):
        try:
            return run(group)
        finally:
            if group.nbytes > 1 << 20:
                _give_back()

    return tidied


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def pieces(batches, column: str, limit: int = 4 << 20):
    """Record batches cut into runs of rows with at most limit bytes in a string or binary column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(size):
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), limit, side="right")))
            yield batch.slice(at, n)
            at += n
