"""File sources and snapshot sinks, read and written by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_source
from ..operators.store import object_id

SUFFIXES = ("txt", "md", "csv")


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, exclude: str | None = None, most: int | None = None) -> DataFrame:
    """path, modified, length of the files below ``root``: no dot files or folders, wanted suffixes, each once, in order.

    More than ``most`` of them are refused, not cut."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    found = files.select("path", F.col("modificationTime").alias("modified"), "length").where(~F.col("path").rlike(r"/\.[^/]+(/|$)"))
    if exclude:
        found = found.where(~F.col("path").rlike(exclude))
    found = found.dropDuplicates(["path"])
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files below {root}")
    return found.orderBy("path")


def snapshot(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, most_bytes: int = 64 << 20) -> DataFrame:
    """path, modified, status, object_id, byte_length, content.  Files over ``most_bytes`` have status TOO_LARGE and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    small = files.where(F.col("length") <= most_bytes).select("path", F.col("modificationTime").alias("modified"), F.lit("READ").alias("status"), object_id(F.col("content")).alias("object_id"), F.col("length").alias("byte_length"), "content")
    large = files.where(F.col("length") > most_bytes).select("path", F.col("modificationTime").alias("modified"), F.lit("TOO_LARGE").alias("status"), F.lit(None).cast("string").alias("object_id"), F.col("length").alias("byte_length"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def texts(snapshots: DataFrame) -> DataFrame:
    """path, object_id and decoded text; files that are not UTF-8 have a null text."""
    return snapshots.select("path", "object_id", decode_source(F.col("content")).alias("text"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict CSV with a header and a declared schema: a malformed record fails the read."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "FAILFAST").csv(path)


def commit(df: DataFrame, root: str, version: int) -> str:
    """Writes a whole version; readers look at the newest one that is complete."""
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version whose write succeeded."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{root}/{names[-1]}") if names else None


def replace_documents(spark: SparkSession, root: str, version: int, rows: DataFrame, key: str = "doc_id") -> str:
    """A next version in which the documents of ``rows`` are replaced and all others stay."""
    old = latest(spark, root)
    whole = rows if old is None else old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
    return commit(whole, root, version)
