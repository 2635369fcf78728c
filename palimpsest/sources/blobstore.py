"""A store of raw inputs by content: tasks write packs, one manifest makes them count.

A pack is a Parquet file of many blobs, so that small files don't pile up.  What
a lost, failed or repeated task wrote is in no manifest, and so not in the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from palimpsest.sources import scratch

SCHEMA = "content_hash string, byte_size long, content binary"
#: Bytes that a task holds before it writes them as a group of rows.
GROUP_BYTES = 32 << 20
#: Hashes of new contents that tasks are told (some 100 bytes each); more are joined.
MOST_TOLD = 1_000_000
_MANIFEST = "run string, packs array<struct<pack: string, blobs: long, bytes: long>>"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address; without a scheme, of this machine's files."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Pack(WriterCommitMessage):
    pack: str
    blobs: int
    bytes: int


class PackWriter(DataSourceArrowWriter):
    """Packs of one run; ``commit`` is the only switch, ``abort`` takes the run's packs away."""

    def __init__(self, path: str, group_bytes: int = GROUP_BYTES) -> None:
        self.path, self.run, self.group_bytes = path.rstrip("/"), uuid.uuid4().hex, group_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        done = Pack(f"packs/{self.run}/{task.partitionId():06d}-{task.taskAttemptId()}.parquet", 0, 0)
        fs, top = _place(self.path)
        held: list[pa.RecordBatch] = []
        size, sink = 0, None
        try:
            for batch in iterator:
                held.append(batch)
                size += batch.nbytes
                done.blobs += batch.num_rows
                if size >= self.group_bytes:
                    sink = self._group(fs, top, done, held, sink)
                    held, size = [], 0
            if any(b.num_rows for b in held):
                sink = self._group(fs, top, done, held, sink)
        finally:
            if sink:
                sink.close()
        return done

    @staticmethod
    def _group(fs: pafs.FileSystem, top: str, done: Pack, held: list[pa.RecordBatch], sink: pq.ParquetWriter | None) -> pq.ParquetWriter:
        group = pa.Table.from_batches(held)
        if sink is None:
            fs.create_dir(f"{top}/{done.pack}".rsplit("/", 1)[0], recursive=True)
            sink = pq.ParquetWriter(f"{top}/{done.pack}", group.schema, filesystem=fs, compression="zstd")
        sink.write_table(group)
        done.bytes += group.nbytes
        return sink

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        packs = sorted((vars(m) for m in messages if isinstance(m, Pack) and m.blobs), key=lambda p: p["pack"])
        if not packs:
            return
        fs, top = _place(self.path)
        fs.create_dir(f"{top}/manifests", recursive=True)
        # Files whose names begin with an underscore are not read.
        with fs.open_output_stream(f"{top}/manifests/_{self.run}") as out:
            out.write(json.dumps({"run": self.run, "packs": packs}).encode())
        fs.move(f"{top}/manifests/_{self.run}", f"{top}/manifests/{self.run}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = _place(self.path)
        if fs.get_file_info(f"{top}/packs/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/packs/{self.run}")


class PackSink(DataSource):
    """Data source ``blob_packs``: appends blobs to the store at ``path``, ``group_bytes`` of them at a time."""

    @classmethod
    def name(cls) -> str:
        return "blob_packs"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PackWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("a store of blobs only grows")
        return PackWriter(self.options["path"], int(self.options.get("group_bytes", GROUP_BYTES)))


class BlobStore:
    """Each content once, whatever is added in whatever order; one run adds at a time.

    ``path`` is a folder that driver and executors share, an address that both
    Spark and Arrow know.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        spark.dataSource.register(PackSink)

    def _packs(self) -> list[str]:
        """The packs that count, as many as there were tasks with new blobs."""
        fs, top = _place(self.path)
        if fs.get_file_info(f"{top}/manifests").type != pafs.FileType.Directory:
            return []
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests").select(F.explode("packs.pack").alias("pack")).collect()
        return [f"{self.path}/{r.pack}" for r in rows]

    def read(self) -> DataFrame:
        """``content_hash``, ``byte_size``, ``content``."""
        packs = self._packs()
        return self.spark.read.schema(SCHEMA).parquet(*packs) if packs else self.spark.createDataFrame([], SCHEMA)

    def add(self, blobs: DataFrame) -> None:
        """Stores each ``content`` that isn't there yet; null is no content, empty is one.

        Hashes alone say which contents are new, and the tasks that read
        contents are told, up to ``MOST_TOLD`` of them: what is stored stays where
        it is.  Of more, all contents move once.  Copies within a task collapse
        before they move, so a content with many copies reaches its task once
        from each of the others.
        """
        content = F.col("content").cast("binary")
        each = blobs.where(F.col("content").isNotNull()).select(F.sha2(content, 256).alias("content_hash"), F.octet_length(content).cast("long").alias("byte_size"), content.alias("content"))
        new = scratch.stored(each.select("content_hash").distinct().join(self.read().select("content_hash"), "content_hash", "left_anti"), "new-blobs")
        count = new.count()
        if not count:
            return
        found = each.join(F.broadcast(new), "content_hash", "left_semi").dropDuplicates(["content_hash"]) if count <= MOST_TOLD else each.dropDuplicates(["content_hash"]).join(new, "content_hash", "left_semi")
        found.select("content_hash", "byte_size", "content").write.format(PackSink.name()).mode("append").option("path", self.path).save()

    def clean(self) -> None:
        """Removes packs of runs without a manifest, such as a killed driver leaves; none may be at work."""
        fs, top = _place(self.path)
        kept = {p.removeprefix(f"{self.path}/") for p in self._packs()}
        for f in fs.get_file_info(pafs.FileSelector(f"{top}/packs", allow_not_found=True, recursive=True)):
            if f.is_file and "/".join(f.path.split("/")[-3:]) not in kept:
                fs.delete_file(f.path)
