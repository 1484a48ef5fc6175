"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Whether shuffle files go as soon as the job that made them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.
    The shuffles that made it are deleted as soon as it is written."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/glyphmill-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more, and let Spark drop dead shuffles."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()  # plans that Python still refers to keep their shuffles
    jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name in taken:
        n += 1
        name = f"__{stem}{n}"
    return name
