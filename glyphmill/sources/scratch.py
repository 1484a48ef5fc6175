"""Tables written once to the folder that all machines of a cluster share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where none is named a temporary one serves, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Whether shuffle files go as soon as the job that made them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str, clean: bool = False) -> DataFrame:
    """Writes ``df`` once and reads it back: cuts lineage, survives lost executors.  ``clean``: its shuffles are deleted at once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/glyphmill-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    if clean:
        spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@lru_cache(maxsize=1)
def code_digest() -> str:
    """Digest of the code that makes tables: what other code made is not read."""
    here = Path(__file__).resolve().parents[1]
    parts = sorted(p for folder in ("functions", "operators") for p in (here / folder).glob("*.py"))
    return hashlib.sha256(b"".join(p.read_bytes() for p in parts)).hexdigest()


def fingerprint(sources: DataFrame) -> str:
    """Digest of the files that ``sources`` reads (their paths, lengths and times) and of the code that reads them."""
    spark = sources.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    facts = [code_digest()]
    for name in sorted(sources.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        facts.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(facts).encode()).hexdigest()[:32]


def kept(sources: DataFrame, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``tag`` made from ``sources``: built once for these files, read by every later query of the cluster.

    It is written beside its place and moved there when whole; changed files have another place."""
    spark = sources.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = f"{scratch_root(spark)}/glyphmill-{tag}-{fingerprint(sources)}"
    path = jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        beside = f"{at}.{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").parquet(beside)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(beside), path) and not fs.exists(path):
            raise RuntimeError(f"cannot move the table to {at}")
    return spark.read.parquet(at)
