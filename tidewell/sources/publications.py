"""A feed as numbered publications, with offsets, admission by events and writes that happen once.

A publication is a folder ``batch=<number>`` of Parquet files in the feed's
schema.  It counts once its manifest, ``_SUCCESS``, names its files and their
rows.  Readers see publications in the order of their numbers; one that is
still being written holds up later ones, as an open transaction does on a
broker, so nothing is passed by.

``tidewell_feed`` is the Spark data source over such a folder::

    spark.readStream.format("tidewell_feed").option("path", feed).option("maxEvents", 5000).load()
    rows.write.format("tidewell_feed").mode("append").option("path", feed).option("batch", 7).save()

Folders are reached through Arrow file systems (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidewell.model import FEED_SCHEMA

FORMAT = "tidewell_feed"
MANIFEST = "_SUCCESS"
#: Seconds after which an unfinished publication no longer holds up later ones.
ABANDONED_AFTER = 3600
_ARROW = pa.schema(
    [
        ("key", pa.binary()),
        ("value", pa.binary()),
        ("partition", pa.int32()),
        ("offset", pa.int64()),
        ("timestamp", pa.timestamp("us", "UTC")),
    ]
)


@dataclass(frozen=True, order=True)
class Position:
    """Where a reader goes on: in a publication, at a file, at a row.  The first one lies before all publications."""

    batch: int = -1
    file: int = 0
    row: int = 0

    @classmethod
    def of(cls, offset: Mapping) -> Position:
        return cls(offset["batch"], offset["file"], offset["row"])

    @property
    def offset(self) -> dict:
        return {"batch": self.batch, "file": self.file, "row": self.row}


@dataclass
class Piece(InputPartition):
    """Some rows of one file."""

    path: str
    first: int
    end: int


class Feed:
    """The publications below a folder."""

    def __init__(self, path: str, abandoned_after: float = ABANDONED_AFTER):
        local = re.fullmatch(r"file:(/[^/].*)", path)
        self.fs, self.root = FileSystem.from_uri(f"file://{local[1]}" if local else path)
        self.abandoned_after = abandoned_after
        self._manifests: dict[int, list[dict]] = {}

    def folder(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def manifest(self, batch: int) -> list[dict] | None:
        """Files and rows of a publication; None while it is being written.  What is complete never changes."""
        if batch not in self._manifests:
            try:
                with self.fs.open_input_stream(f"{self.folder(batch)}/{MANIFEST}") as f:
                    self._manifests[batch] = json.loads(f.read())["files"]
            except FileNotFoundError:
                return None
        return self._manifests[batch]

    def _listed(self) -> list[tuple[int, float]]:
        found = []
        for info in self.fs.get_file_info(FileSelector(self.root, allow_not_found=True)):
            named = re.fullmatch(r"batch=(\d+)", info.base_name)
            if named and info.type == FileType.Directory:
                found.append((int(named[1]), info.mtime.timestamp() if info.mtime else 0.0))
        return sorted(found)

    def complete(self, after: int = -1) -> Iterator[tuple[int, list[dict]]]:
        """Publications from number ``after`` on, up to the first that is being written."""
        for batch, touched in self._listed():
            if batch < after:
                continue
            files = self.manifest(batch)
            if files is not None:
                yield batch, files
            elif time.time() - touched < self.abandoned_after:
                return

    def newest(self) -> int:
        return max((batch for batch, _ in self._listed()), default=-1)

    def admit(self, start: Position, most: int | None = None) -> Position:
        """The position after at most ``most`` events from ``start``."""
        here, left = start, most
        for batch, files in self.complete(start.batch):
            file, row = (here.file, here.row) if batch == here.batch else (0, 0)
            while file < len(files):
                rows = files[file]["rows"] - row
                if left is not None and rows > left:
                    return Position(batch, file, row + left)
                left = None if left is None else left - rows
                file, row = file + 1, 0
                here = Position(batch, file, row)
            here = max(here, Position(batch, len(files), 0))
        return here

    def pieces(self, start: Position, end: Position) -> list[Piece]:
        """What lies between two positions, file by file."""
        out = []
        for batch, files in self.complete(start.batch):
            if batch > end.batch:
                break
            for k, file in enumerate(files):
                first = start.row if (batch, k) == (start.batch, start.file) else 0
                last = end.row if (batch, k) == (end.batch, end.file) else file["rows"]
                passed = (batch, k) < (start.batch, start.file) or (batch, k) > (end.batch, end.file)
                if not passed and first < last:
                    out.append(Piece(f"{self.folder(batch)}/{file['name']}", first, last))
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of a piece; row groups before and after it are not read."""
        with self.fs.open_input_file(piece.path) as f:
            file, at = pq.ParquetFile(f), 0
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                low, high = max(piece.first - at, 0), min(piece.end - at, rows)
                at += rows
                if low < high:
                    yield from file.read_row_group(group).slice(low, high - low).cast(_ARROW).to_batches(10_000)


class _BatchReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        feed = Feed(self.path)
        return feed.pieces(Position(), feed.admit(Position()))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Feed(self.path).read(partition)


class _StreamReader(DataSourceStreamReader):
    """Admits at most ``most`` events a batch, whatever the sizes of files.

    The engine tells where it stands by asking for the partitions up to
    there, after a restart too; the next batch is measured from that place.
    """

    def __init__(self, path: str, most: int | None):
        self.path, self.most = path, most
        self.feed, self.reached = Feed(path), Position()

    def initialOffset(self) -> dict:
        return Position().offset

    def latestOffset(self) -> dict:
        return self.feed.admit(self.reached, self.most).offset

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.reached = max(self.reached, Position.of(end))
        return self.feed.pieces(Position.of(start), Position.of(end))

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, Position.of(end))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Feed(self.path).read(partition)


@dataclass
class _Written(WriterCommitMessage):
    task: int
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    """Writes one publication; one that is there already is left as it is, so a replay adds nothing."""

    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch
        # seen from now on, so that readers wait for it
        feed = Feed(path)
        feed.fs.create_dir(feed.folder(batch), recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        feed, task = Feed(self.path), TaskContext.get().partitionId()
        if feed.manifest(self.batch) is not None:
            return _Written(task, None, 0)
        # each attempt writes a file of its own; only that of the attempt that counts enters the manifest
        name, rows, writer = f"part-{task:05d}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).cast(_ARROW)
                writer = writer or pq.ParquetWriter(f"{feed.folder(self.batch)}/{name}", _ARROW, filesystem=feed.fs)
                writer.write_table(table)
                rows += table.num_rows
        if writer is None:
            return _Written(task, None, 0)
        writer.close()
        return _Written(task, name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        feed = Feed(self.path)
        if feed.manifest(self.batch) is not None:
            return
        told = sorted((m for m in messages if m and m.name), key=lambda m: m.task)
        said = json.dumps({"files": [{"name": m.name, "rows": m.rows} for m in told]}).encode()
        made = f"{feed.folder(self.batch)}/.{MANIFEST}-{uuid.uuid4().hex}"
        with feed.fs.open_output_stream(made) as f:
            f.write(said)
        feed.fs.move(made, f"{feed.folder(self.batch)}/{MANIFEST}")

    def abort(self, messages: list[_Written | None]) -> None:
        feed = Feed(self.path)
        for m in messages:
            if m and m.name:
                feed.fs.delete_file(f"{feed.folder(self.batch)}/{m.name}")


class FeedSource(DataSource):
    """Options: ``path``; ``maxEvents`` a batch for streams; ``batch``, the number of the publication to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return FEED_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        most = self.options.get("maxEvents")
        return _StreamReader(self.options["path"], None if most is None else int(most))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options["batch"]))


def register(spark: SparkSession) -> None:
    """Make ``tidewell_feed`` known to a session."""
    spark.dataSource.register(FeedSource)
