"""Packages of objects: a data source that writes and reads BagIt archives.

``df.write.format("bag").option("path", uri)`` takes rows (shard, digest, content) in order of shard and digest and
writes one archive a shard: an uncompressed ZIP with fixed times, payload under ``data/sha256/``, in order of path,
so that equal objects give equal bytes.  Tasks write beside the place; only when all are done are the archives moved
there and the list of them is written, which readers go by; a failed write leaves nothing.  ``read`` gives every
entry of every archive as it is, with what its manifest says; ``faults`` names what disagrees.

Defined results: equal objects are stored once; null content is left out; an object whose name is not its digest, one
that is not listed or listed and missing, a changed tag file and a broken or missing archive are faults; a package
of no objects has no archive.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "archive string, path string, kind string, length long, sha256 string, listed string, content binary, fault string"

# What the archives hold besides objects.
BAGIT = b"BagIt-Version: 1.0\nTag-File-Character-Encoding: UTF-8\n"
WHEN = (1980, 1, 1, 0, 0, 0)
MANIFEST, TAGS, LIST = "manifest-sha256.txt", "tagmanifest-sha256.txt", "packages.json"
# End of fixed values.


def store_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lines(digests: dict[str, str]) -> bytes:
    """A manifest: digest and path, in order of path."""
    return "".join(f"{d}  {p}\n" for p, d in sorted(digests.items())).encode()


def listed(manifest: bytes) -> dict[str, str]:
    return {p: d for d, _, p in (line.partition("  ") for line in manifest.decode().splitlines())}


class Archive:
    """One archive as it is written, object after object."""

    def __init__(self, stream):
        self.stream, self.zip, self.payload, self.size = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), {}, 0

    def _put(self, path: str, data: bytes) -> None:
        info = zipfile.ZipInfo(path, WHEN)
        info.external_attr = 0o644 << 16
        self.zip.writestr(info, data)

    def add(self, digest: str, content: bytes) -> None:
        path = f"data/sha256/{digest}"
        if path not in self.payload:
            self._put(path, content)
            self.payload[path] = digest
            self.size += len(content)

    def close(self) -> None:
        tags = {"bag-info.txt": f"Payload-Oxum: {self.size}.{len(self.payload)}\n".encode(), "bagit.txt": BAGIT, MANIFEST: lines(self.payload)}
        tags[TAGS] = lines({p: sha(d) for p, d in tags.items()})
        for path, data in sorted(tags.items()):
            self._put(path, data)
        self.zip.close()
        self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    """(archive, objects, bytes of payload) of each archive that a task wrote."""

    archives: list[tuple[str, int, int]]


class BagWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.beside = path.rstrip("/"), f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, root = store_of(self.path)
        attempt = TaskContext.get().taskAttemptId()
        done, archive, now = [], None, None
        for row in rows:
            if row.content is None:
                continue
            if row.shard != now:
                if archive:
                    archive.close()
                    done[-1] = (done[-1][0], len(archive.payload), archive.size)
                now, name = row.shard, f"{row.shard:06d}-{attempt}"
                store.create_dir(f"{root}/{self.beside}")
                archive = Archive(store.open_output_stream(f"{root}/{self.beside}/{name}"))
                done.append((name, 0, 0))
            archive.add(row.digest, bytes(row.content))
        if archive:
            archive.close()
            done[-1] = (done[-1][0], len(archive.payload), archive.size)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        store.create_dir(root)
        packages = []
        for name, objects, size in sorted(a for m in messages if m for a in m.archives):
            final = f"bag-{name.partition('-')[0]}.zip"
            store.move(f"{root}/{self.beside}/{name}", f"{root}/{final}")
            packages.append({"archive": final, "objects": objects, "bytes": size})
        with store.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps(packages).encode())
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        at = f"{root}/{self.beside}"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class OneArchive(InputPartition):
    def __init__(self, name: str, objects: int):
        self.name, self.objects = name, objects


class BagReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.path)
        with store.open_input_stream(f"{root}/{LIST}") as f:
            return [OneArchive(p["archive"], p["objects"]) for p in json.loads(f.read())] or [OneArchive("", 0)]

    def read(self, partition: OneArchive) -> Iterator[tuple]:
        if not partition.name:
            return
        store, root = store_of(self.path)
        name, found, payload = partition.name, set(), 0
        try:
            with store.open_input_file(f"{root}/{name}") as raw, zipfile.ZipFile(raw) as bag:
                said = listed(bag.read(TAGS)) | listed(bag.read(MANIFEST))
                for info in bag.infolist():
                    found.add(info.filename)
                    kind = "payload" if info.filename.startswith("data/") else "tag"
                    payload += kind == "payload"
                    try:
                        data = bag.read(info)
                    except zipfile.BadZipFile:
                        yield name, info.filename, kind, info.file_size, None, said.get(info.filename), None, "entry is broken"
                        continue
                    digest, want = sha(data), said.get(info.filename)
                    fault = None
                    if info.filename != TAGS and want is None:
                        fault = "not listed"
                    elif info.filename != TAGS and digest != want:
                        fault = "digest differs"
                    elif kind == "payload" and info.filename != f"data/sha256/{digest}":
                        fault = "name is not the digest"
                    yield name, info.filename, kind, len(data), digest, want, data if kind == "payload" else None, fault
                for path in sorted(set(said) - found):
                    yield name, path, "payload" if path.startswith("data/") else "tag", None, None, said[path], None, "missing"
                if payload != partition.objects:
                    yield name, None, None, None, None, None, None, f"{payload} objects of {partition.objects}"
        except (OSError, KeyError, UnicodeDecodeError, zipfile.BadZipFile) as e:
            yield name, None, None, None, None, None, None, f"archive is broken: {type(e).__name__}"


class Bag(DataSource):
    """Format ``bag``; option: path (a URI of a shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BagReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BagWriter(self.options["path"])


def export(objects: DataFrame, path: str, shards: int) -> None:
    """Writes objects (content) as a package of at most ``shards`` archives, each in order of digest."""
    objects.sparkSession.dataSource.register(Bag)
    digest = F.sha2("content", 256)
    rows = objects.where("content is not null").select(digest.alias("digest"), "content").withColumn("shard", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))
    rows.select("shard", "digest", "content").repartition(shards, "shard").sortWithinPartitions("shard", "digest").write.format("bag").mode("append").option("path", path).save()


def entries(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Bag)
    return spark.read.format("bag").option("path", path).load()


def faults(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, fault of all that disagrees."""
    return entries(spark, path).where("fault is not null").select("archive", "path", "fault")


def imported(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """object_id, length, content of a package without faults, without those that are known (object_id) already."""
    first = faults(spark, path).orderBy("archive", "path").limit(3).collect()
    if first:
        raise ValueError("package has faults: " + "; ".join(f"{r['archive']} {r['path']}: {r['fault']}" for r in first))
    rows = entries(spark, path).where("kind = 'payload'").select(F.concat(F.lit("sha256:"), "sha256").alias("object_id"), "length", "content")
    return rows if known is None else rows.join(known.select("object_id"), "object_id", "left_anti")
