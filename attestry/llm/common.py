"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python; keeps a task's memory bounded when texts are long.
ARROW_BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, and lets Python workers on this machine find the package wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``, or on one machine a folder of our own where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        prepare(spark)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a map of ids: a fixed size, 2 MB packed.
MAP_BITS = 24


def id_bit(doc_id: Column) -> Column:
    """An id's place in a map of ids."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - MAP_BITS)


def id_words(ids: DataFrame) -> DataFrame:
    """(word, mask): a map of the column ``doc_id`` as words of 32 bits; at most 2**19 rows at any input size."""
    bits = ids.select(id_bit(F.col("doc_id")).alias("bit")).select(F.shiftright("bit", 5).alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("mask"))
    return bits.groupBy("word").agg(F.bit_or("mask").alias("mask"))
