"""The change log of a store as a stream, and a table kept up to date from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "reset boolean, record_number long, before string, after string, txn long"


def change_stream(spark: SparkSession, folder: str, transactions: int | None = None) -> DataFrame:
    """A streaming frame of the change log; each committed file is read once. transactions: files a trigger at most."""
    reader = spark.readStream.schema(SCHEMA)
    if transactions is not None:
        reader = reader.option("maxFilesPerTrigger", transactions)
    return reader.parquet(f"{folder.rstrip('/')}/changes")


def parsed(changes: DataFrame, row: T.StructType) -> DataFrame:
    """before and after as structs."""
    return changes.withColumns({n: F.from_json(n, row) for n in ("before", "after")})


def change_counts(changes: DataFrame) -> DataFrame:
    """Inserts, updates and deletes of each transaction: a streaming aggregation."""
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "remove").otherwise("update")
    return changes.groupBy("txn", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def mirror(changes: DataFrame, target: str, checkpoint: str):
    """Keep the latest content of every row in Parquet folders under target, one a batch; a reset starts anew. A streaming query."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            last_reset = batch.where("reset").agg(F.max("txn")).first()[0]
            news = batch.where(F.col("txn") >= last_reset) if last_reset is not None else batch
            newest = news.groupBy("record_number").agg(F.max_by(F.struct("after"), "txn").alias("x")).select("record_number", F.col("x.after").alias("content"))
            if last_reset is None and number > 0:
                old = spark.read.parquet(f"{target}/{number - 1:08d}")
                newest = old.join(newest, "record_number", "left_anti").unionByName(newest)
            newest.where("content is not null").write.mode("overwrite").parquet(f"{target}/{number:08d}")
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
