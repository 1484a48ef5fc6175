"""A stream of delta pages whose offset is the cursor.

A client follows a chain of pages: ``initial()`` gives the first cursor, ``after(cursor)`` the cursor behind a page or
null at the end of the chain, ``fetch(cursor)`` the page's changes.  It may raise ``Throttled`` (the end waits for the
next trigger, after a bounded number of tries) and ``CursorReset`` (the chain is void).  Each page is one partition: the
driver walks cursors only, tasks fetch pages.  Spark keeps offsets in its checkpoint before a batch runs and fetches just
the same pages again after a crash, so none is lost or applied twice.

Defined results: an empty page gives no rows; a chain that comes back to a page it has passed is an error; after a reset
the stream begins anew from the first cursor in the next epoch, if ``reset`` is ``restart``, and fails otherwise; rows
name their epoch, so that a target knows when to begin anew.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.change import last_writes

SCHEMA = "epoch int, page int, ordinal int, item_key string, kind string, revision string"


class CursorReset(RuntimeError):
    """The cursor leads nowhere any more."""


class Throttled(RuntimeError):
    """The server asks to wait so many seconds."""

    def __init__(self, seconds: float = 0.1):
        super().__init__(f"throttled for {seconds} s")
        self.seconds = seconds


class Client(Protocol):
    def initial(self) -> str: ...
    def after(self, cursor: str) -> str | None: ...
    def fetch(self, cursor: str) -> list[tuple[str, str, str]]: ...


class FolderClient:
    """Pages in a folder that all machines share: ``<cursor>.json`` with changes [item_key, kind, revision] and next.

    A file ``reset`` names cursors that are void."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path)
        self._fs = fs

    def _read(self, name: str) -> dict | None:
        at = f"{self.root}/{name}"
        if self.fs.get_file_info(at).type == self._fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def _page(self, cursor: str) -> dict | None:
        if cursor in (self._read("reset") or []):
            raise CursorReset(cursor)
        return self._read(f"{cursor}.json")

    def initial(self) -> str:
        return (self._read("initial") or {"cursor": "0"})["cursor"]

    def after(self, cursor: str) -> str | None:
        page = self._page(cursor)
        return page and page["next"]

    def fetch(self, cursor: str) -> list[tuple[str, str, str]]:
        return [tuple(c) for c in (self._page(cursor) or {"changes": []})["changes"]]


class Page(InputPartition):
    def __init__(self, epoch: int, number: int, cursor: str):
        self.epoch, self.number, self.cursor = epoch, number, cursor


class Waiting(NamedTuple):
    tries: int = 3
    longest: float = 2.0


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
        self.make = lambda: getattr(importlib.import_module(module), name)(options["path"])
        self.client, self.most, self.restart = self.make(), int(options.get("pages", "1000")), options.get("reset", "fail") == "restart"
        self.at: dict | None = None
        self.chains: dict[int, list[str]] = {}

    def _asked(self, what, *args):
        """The client's answer; null if it is still throttled after some tries."""
        for n in range(Waiting().tries):
            try:
                return what(*args)
            except Throttled as e:
                if e.seconds > Waiting().longest or n + 1 == Waiting().tries:
                    return None
                time.sleep(e.seconds)
        return None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": 0, "page": 0, "cursor": self.client.initial()}

    def latestOffset(self) -> dict:  # noqa: N802
        """As far as the chain goes, at most so many pages at once."""
        now = dict(self.at or self.initialOffset())
        seen = {now["cursor"]}
        for _ in range(self.most):
            try:
                behind = self._asked(self.client.after, now["cursor"])
            except CursorReset:
                if not self.restart:
                    raise
                now = {"epoch": now["epoch"] + 1, "page": 0, "cursor": self.client.initial()}
                break  # a batch holds pages of one epoch
            if behind is None:
                break
            if behind in seen:
                raise RuntimeError(f"the chain of pages comes back to {behind}")
            seen.add(behind)
            now = {"epoch": now["epoch"], "page": now["page"] + 1, "cursor": behind}
        return now

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end
        if start["epoch"] != end["epoch"]:
            start = {"epoch": end["epoch"], "page": 0, "cursor": self.client.initial()}
        out, cursor = [], start["cursor"]
        for number in range(start["page"], end["page"]):
            out.append(Page(end["epoch"], number, cursor))
            cursor = self._asked(self.client.after, cursor)
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        client = self.make()
        for n in range(Waiting().tries):
            try:
                changes = client.fetch(partition.cursor)
                break
            except Throttled as e:
                if n + 1 == Waiting().tries:
                    raise
                time.sleep(min(e.seconds, Waiting().longest))
        for ordinal, (key, kind, revision) in enumerate(changes):
            yield partition.epoch, partition.number, ordinal, key, kind, revision

    def commit(self, end: dict) -> None:
        self.at = end


class DeltaPages(DataSource):
    """Format ``delta_pages``; options: path, client (module:class), pages (at once), reset (fail or restart)."""

    @classmethod
    def name(cls) -> str:
        return "delta_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(DeltaPages)
    return spark.readStream.format("delta_pages").options(path=path, **options).load()


def sync_pages(pages: DataFrame, target: str, checkpoint: str):
    """Applies pages to a table with a folder a batch, in which the last write of each item wins; a new epoch begins anew.

    A batch writes its folder whole, from the one before, so doing it again changes nothing."""
    spark = pages.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        epoch = batch.agg(F.max("epoch")).first()[0]
        new = last_writes(batch.where(F.col("epoch") == F.lit(epoch))).withColumn("epoch", F.lit(epoch))
        if n:
            kept = spark.read.parquet(f"{target}/v{n - 1}")
            kept = kept if epoch is None else kept.where(F.col("epoch") == F.lit(epoch))
            new = kept.join(batch.select("item_key").distinct(), "item_key", "left_anti").unionByName(new.select(*kept.columns))
        new.select("item_key", "revision", F.col("epoch").cast("int").alias("epoch")).write.mode("overwrite").parquet(f"{target}/v{n}")

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_all(pages: Callable[[], DataFrame], target: str, checkpoint: str) -> None:
    """``sync_pages`` to the end of the chain.  Sources in Python take one batch a run, of so many ``pages``: runs follow until one finds no new page."""
    end = None
    while True:
        query = sync_pages(pages(), target, checkpoint)
        query.awaitTermination()
        came = query.lastProgress and query.lastProgress["sources"][0]["endOffset"]
        if not came or came == end:
            return
        end = came


def synced(spark: SparkSession, target: str) -> DataFrame:
    """The table as the last whole batch left it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    done = [int(f.getPath().getName()[1:]) for f in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{target}/v{max(done)}").select("item_key", "revision")
