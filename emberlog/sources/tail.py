"""Growing log files as a stream: only appended, finished lines are delivered."""

from __future__ import annotations

import fnmatch
import io
import json

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SOURCE_NAME = "growing_logs"
SPLIT_BYTES = 64 * 1024 * 1024
READ_BYTES = 1024 * 1024
PROBE_BYTES = 64 * 1024
BATCH_LINES = 10_000


class FileRange(InputPartition):
    """The lines that begin in bytes [start, end) of one file; none reaches past ``limit``."""

    def __init__(self, path: str, start: int, end: int, limit: int, first: bool):
        self.path, self.start, self.end, self.limit, self.first = path, start, end, limit, first


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs").option("path", folder).option("glob", "*.log")``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> str:
        return "source string, content string, position string"

    def streamReader(self, schema):
        return GrowingLogsReader(self.options)


class GrowingLogsReader(DataSourceStreamReader):
    """Offset = finished bytes per file, so a restart resumes behind the last delivered line.

    With ``batchBytes`` an offset goes at most that far beyond the one before. Spark does not tell the reader from
    where a restarted query goes on unless a batch is open, so the reader notes each planned batch's end, which Spark has
    logged by then, in ``progress``, a file of the stream's own in a shared folder. A note that is ahead only makes a
    batch larger; one that is lost or behind is found when the batch is planned, and the stream stops.
    """

    def __init__(self, options):
        self.uri = options["path"]
        self.glob = options.get("glob", "*.log")
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.batch_bytes = int(options.get("batchBytes", 0))
        self.progress = options.get("progress", "")
        if self.batch_bytes and not self.progress:
            raise ValueError("batchBytes needs progress, a file in a shared folder")
        self.probed: dict[str, tuple] = {}
        self.planned: dict | None = None

    def _filesystem(self):
        return _filesystem_of(self.uri)

    def initialOffset(self) -> dict:
        return {}

    def _note(self, planned: dict) -> None:
        if planned != self.planned:
            filesystem, path = _filesystem_of(self.progress)
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with filesystem.open_output_stream(f"{path}.new") as handle:
                handle.write(json.dumps(planned).encode())
            filesystem.move(f"{path}.new", path)
        self.planned = planned

    def _reached(self) -> dict:
        if self.planned is None:
            filesystem, path = _filesystem_of(self.progress)
            try:
                with filesystem.open_input_stream(path) as handle:
                    self.planned = json.loads(handle.read())
            except FileNotFoundError:  # a new stream
                self.planned = {}
        return self.planned

    def latestOffset(self) -> dict:
        filesystem, folder = self._filesystem()
        listing = filesystem.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
        probed = {}
        for info in sorted(listing, key=lambda found: found.path):
            if info.type == arrow_fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob):
                state = (info.size, info.mtime_ns)
                known = self.probed.get(info.path)  # only files that changed are opened again
                probed[info.path] = known if known and known[0] == state else (
                    state, _finished_bytes(filesystem, info.path, info.size))
        self.probed = probed
        finished = {path: found for path, (_, found) in probed.items()}
        return self._limited(finished) if self.batch_bytes else finished

    def _limited(self, finished: dict) -> dict:
        """The offset at most ``batch_bytes`` on from the last one, longest waiting files first; lines stay whole, so a
        line that is longer than that is read alone."""
        reached, left, limited = self._reached(), self.batch_bytes, {}
        waiting = sorted(finished, key=lambda path: (self.probed[path][0][1], path))
        filesystem, _ = self._filesystem()
        for path in waiting:
            limit, begin = finished[path], reached.get(path, 0)
            begin = 0 if begin > limit else begin  # cut since: from its start
            if limit - begin > left:
                limit = begin if not left else _line_end(filesystem, path, begin, begin + left, limit,
                                                         left == self.batch_bytes)
            left = max(0, left - (limit - begin))
            if limit > begin or path in reached:
                limited[path] = limit
        return {path: limited[path] for path in sorted(limited)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        if self.batch_bytes:
            filesystem, _ = self._filesystem()
            behind = [path for path in start if end.get(path, 0) < start[path]]
            for info in filesystem.get_file_info(behind) if behind else ():
                if info.type == arrow_fs.FileType.File and info.size >= start[info.path]:  # not cut, not deleted
                    raise RuntimeError(f"{self.progress} does not belong to this stream's checkpoint")
            self._note(end)
        ranges = []
        for path, limit in end.items():
            begin = start.get(path, 0)
            if begin > limit:
                begin = 0
            for low in range(begin, limit, self.split_bytes):
                ranges.append(FileRange(path, low, min(low + self.split_bytes, limit), limit,
                                        low == begin))
        return ranges

    def read(self, partition: FileRange):
        filesystem, _ = self._filesystem()
        name = partition.path.rsplit("/", 1)[-1]
        with io.BufferedReader(filesystem.open_input_file(partition.path), READ_BYTES) as handle:
            position = partition.start
            if not partition.first:
                # The line holding the byte before this range belongs to the range before.
                handle.seek(position - 1)
                position += len(handle.readline()) - 1
            handle.seek(position)
            lines, places = [], []
            while position < partition.end:
                line = handle.readline()
                if not line:
                    break
                places.append(f"{partition.path}:{position}")
                position += len(line)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", errors="replace"))
                if len(lines) == BATCH_LINES:
                    yield _batch(name, lines, places)
                    lines, places = [], []
            if lines:
                yield _batch(name, lines, places)

    def commit(self, end: dict) -> None:
        pass


def _batch(name: str, lines: list[str], places: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string()), pa.array(places, pa.string())],
        names=["source", "content", "position"])


def _filesystem_of(uri: str):
    if "://" in uri or uri.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(uri)
    return arrow_fs.LocalFileSystem(), uri


def _finished_bytes(filesystem, path: str, size: int, floor: int = 0) -> int:
    """Size up to and including the last line break behind ``floor``; an unfinished last line waits."""
    with filesystem.open_input_file(path) as handle:
        high = size
        while high > floor:
            low = max(floor, high - PROBE_BYTES)
            handle.seek(low)
            found = handle.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return floor


def _line_end(filesystem, path: str, begin: int, wanted: int, limit: int, must: bool) -> int:
    """The last end of a line in (begin, wanted]; if there is none, ``begin``, or the first one behind if it ``must``
    be one. ``begin`` and ``limit`` are ends of lines."""
    found = _finished_bytes(filesystem, path, wanted, begin)
    if found > begin or not must:
        return found
    with filesystem.open_input_file(path) as handle:
        at = wanted
        handle.seek(at)
        while at < limit:
            piece = handle.read(min(PROBE_BYTES, limit - at))
            end = piece.find(b"\n")
            if end >= 0:
                return at + end + 1
            at += len(piece)
    return limit


def tail_log_files(spark: SparkSession, folder: str, glob: str = "*.log",
                   split_bytes: int = SPLIT_BYTES, stamp: bool = False, batch_bytes: int | None = None,
                   progress: str | None = None) -> DataFrame:
    """Stream of (``source``, ``content``, ``position``) from the files of a folder that keep growing.

    ``position`` is the file and the byte a line begins at, unlike any other line's. ``stamp`` adds the time of
    collection as ``received``: that of the micro-batch, which Spark records, so that a retry agrees.

    ``batch_bytes`` limits what a micro-batch reads; it needs ``progress``, a file in a shared folder that belongs to
    this stream and its checkpoint alone. With the trigger ``availableNow`` a run takes one such batch.
    """
    spark.dataSource.register(GrowingLogs)
    stream = (spark.readStream.format(SOURCE_NAME).option("path", folder).option("glob", glob)
              .option("splitBytes", str(split_bytes)))
    if batch_bytes:
        stream = stream.option("batchBytes", str(batch_bytes)).option("progress", progress or "")
    lines = stream.load()
    return lines.withColumn("received", F.current_timestamp().cast("timestamp_ntz")) if stamp else lines


