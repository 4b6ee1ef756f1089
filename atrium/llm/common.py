"""Tables in the folder that the cluster shares, and small helpers of all operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words as the SQL functions see them; text.Words finds the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts hold 2,000 rows instead of 10,000 in this session, unless another number was set: bounds a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read from there, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named own_0, own_1, ..., so that no name of theirs meets one of an operator's."""
    return df.toDF(*[f"own_{i}" for i in range(len(df.columns))])


def placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with ``at``, their place from 0 among those of equal key (not null) by ``order``, and ``total``, the key's rows.

    Rows are sorted over all tasks; a row's place is its place within its task
    plus the rows of its key in the tasks before, so no key is gathered in one.
    """
    by = [F.col(key), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("place", 33))
    runs = ranged.groupBy(key, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # a key has at most one run a task
    before = F.sum("n").over(W.partitionBy(key).orderBy("part")) - F.col("n")
    runs = runs.select(key, "part", "first", before.alias("before"), F.sum("n").over(W.partitionBy(key)).alias("total"))
    return ranged.join(runs, [key, "part"]).withColumn("at", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "first", "before")


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
