"""Reading tables, the shared folder for tables that cut lineage, and scratch names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """What every operator with Python workers needs: the package on the executors, and batches between the JVM and Python of some MB, unless the session says otherwise."""
    ship(spark)
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # the default
        spark.conf.set(BATCH_BYTES, "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests, one machine) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str = "zstd", files: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: survives the loss of any executor.

    files: their number at most, from file_count(). Many small files cost more than
    their bytes: each takes several calls to the file system, and on local ones processes.
    """
    df = df.coalesce(files) if files is not None else df
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the shuffles behind a written table aren't read again
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


FILE_BYTES = 64 << 20
MOST_FILES = 10_000_000


def file_count(source: DataFrame) -> int:
    """Files for a table made from a source: by the source's size, and two for each core at least. A source of unknown size counts as huge."""
    return min(MOST_FILES, max(2 * source.sparkSession.sparkContext.defaultParallelism, -(-plan_bytes(source) // FILE_BYTES)))


def discard(df: DataFrame) -> None:
    """Remove a table that written() gave and that nothing will read again."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, from file sizes for scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
