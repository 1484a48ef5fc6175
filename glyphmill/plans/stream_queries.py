"""Queries that run streams to their end: delta pages by cursor, and the watch cycle."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window as Order
from pyspark.sql import functions as F

from ..sources.scratch import scratch_root
from ..streaming import delta_pages as D
from ..streaming import watch as W
from .change_queries import STATES, seen
from .registry import query, table

#: Events to a page.
PAGE = 5000


def write_pages(changes, root: str) -> None:
    """changes: page, ordinal, item_key, kind, revision.  One JSON file a page, each with the cursor behind it: the next page that there is."""
    each = changes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "item_key", "kind", "revision"))).alias("rows"))
    # numbers of pages only: one for thousands of changes
    links = changes.select("page").distinct().select("page", F.coalesce(F.lead("page").over(Order.orderBy("page")), F.col("page") + 1).alias("next"))
    whole = each.join(links, "page")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        store.create_dir(at)
        for pdf in batches:
            for row in pdf.itertuples():
                with store.open_output_stream(f"{at}/{row.page}.json") as f:
                    f.write(json.dumps({"changes": [[r["item_key"], r["kind"], r["revision"]] for r in row.rows], "next": str(row.next)}).encode())
            yield pdf[["page"]]

    if not whole.mapInPandas(write, "page long").count():
        raise RuntimeError("no pages")


@query("s15_delta_pages", "SELECT user_id::VARCHAR AS item_key, revision FROM (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), event_id) AS revision FROM events GROUP BY 1) WHERE kind <> 'error'")
def s15(spark, d):
    """The changes of the events table, read page by page along the chain of cursors and applied to a table."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_id")).first()[0] or 0
    changes = e.select(F.expr(f"(event_id - {first}) div {PAGE}").alias("page"), F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("item_key"), F.when(F.col("event_type") == "error", "TOMBSTONE").otherwise("UPSERT").alias("kind"), F.floor("value").cast("string").alias("revision"))
    root = f"{scratch_root(spark)}/glyphmill-delta-{uuid.uuid4().hex}"
    pages = f"{root}/pages" if "://" in root else f"file://{root}/pages"
    write_pages(changes, pages)
    D.sync_all(lambda: D.read_pages(spark, pages), f"{root}/table", f"{root}/checkpoint")
    return D.synced(spark, f"{root}/table")


@query("x01_watch_cycle", f"WITH {STATES}")
def x01(spark, d):
    """Observations of all paths through the stateful stream: the states that the batch operator gives."""
    root = f"{scratch_root(spark)}/glyphmill-watch-{uuid.uuid4().hex}"
    rows = seen(spark, d).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    rows.write.parquet(f"{root}/in")
    stream = W.watch(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), 600_000, 86_400_000)
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(W.STATES).parquet(f"{root}/out")
    return out.where("not timed").select("path", F.col("seen_at").cast(table(spark, d, "events").schema["ts"].dataType).alias("seen_at"), "state", "event")
