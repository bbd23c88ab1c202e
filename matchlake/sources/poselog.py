"""Pose logs as a Spark data source: one file a job, with a header, named and typed entries, and timed records.

``spark.dataSource.register(PoseLog)``, then ``df.write.format("poselog").mode("append").save(path)`` and
``spark.read.format("poselog").load(path)``. Rows are ``job_id, robot_key, t, x, y, heading``: seconds, metres, radians.

A file begins with MAGIC, a version and the job's name; a record is the number of an entry, microseconds, the payload's
length and the payload. Entry 0 declares others: a number, a name and a type, before the first record of each. Numbers are
little-endian. Readers pass over entries of types that they do not know, so files may hold more than poses.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, VERSION, SUFFIX = b"POSELOG\n", 1, ".poselog"
HEAD, RECORD, POSE = struct.Struct("<HH"), struct.Struct("<HqI"), struct.Struct("<ddd")
DECLARE, POSE_TYPE = 0, "pose2d"
SCHEMA = "job_id string, robot_key string, t double, x double, y double, heading double"
#: Rows of an Arrow batch that a reader gives on.
BATCH = 8192


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<H", len(raw)) + raw


def _take(raw: memoryview, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<H", raw, at)
    return bytes(raw[at + 2 : at + 2 + n]).decode(), at + 2 + n


class LogFile:
    """One job's log, built record by record."""

    def __init__(self, job: str | None):
        self.parts, self.entries = [MAGIC, HEAD.pack(VERSION, job is not None), _text(job or "")], {}

    def _record(self, entry: int, micros: int, payload: bytes) -> None:
        self.parts += [RECORD.pack(entry, micros, len(payload)), payload]

    def add(self, robot: str, t: float, x: float, y: float, heading: float | None) -> None:
        entry = self.entries.get(robot)
        if entry is None:
            entry = self.entries[robot] = len(self.entries) + 1
            self._record(DECLARE, 0, struct.pack("<H", entry) + _text(robot) + _text(POSE_TYPE))
        self._record(entry, round(t * 1_000_000), POSE.pack(x, y, float("nan") if heading is None else heading))

    def content(self) -> bytes:
        return b"".join(self.parts)


def parse(raw: bytes) -> Iterator[tuple]:
    """Rows of one file, in its order; a file cut short within a record is an error."""
    view = memoryview(raw)
    if bytes(view[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a pose log")
    version, named = HEAD.unpack_from(view, len(MAGIC))
    if version != VERSION:
        raise ValueError(f"pose log of version {version}, not {VERSION}")
    job, at = _take(view, len(MAGIC) + HEAD.size)
    names: dict[int, tuple[str, str]] = {}
    while at < len(view):
        if at + RECORD.size > len(view):
            raise ValueError("pose log cut short")
        entry, micros, size = RECORD.unpack_from(view, at)
        at += RECORD.size
        if at + size > len(view):
            raise ValueError("pose log cut short")
        if entry == DECLARE:
            (number,) = struct.unpack_from("<H", view, at)
            name, place = _take(view, at + 2)
            names[number] = name, _take(view, place)[0]
        elif names[entry][1] == POSE_TYPE:
            x, y, heading = POSE.unpack_from(view, at)
            yield job if named else None, names[entry][0], micros / 1_000_000, x, y, None if heading != heading else heading
        at += size


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        """A partition a file, which is a job."""
        fs, base = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return [_File(f.path) for f in found if f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("_")]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without logs
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.path) as stream:
            rows = parse(stream.read())
        names = ["job_id", "robot_key", "t", "x", "y", "heading"]
        kinds = [pa.string(), pa.string(), *[pa.float64()] * 4]
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Tasks write drafts; the commit gives them their names, so a run that fails leaves no file that a reader takes up."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        """Rows of a task, sorted by job; a job's rows must all be in one task."""
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        files, job, log = [], None, None

        def close() -> None:
            name = f"{base}/_{self.run}-{uuid.uuid4().hex}{SUFFIX}"
            with fs.open_output_stream(name) as stream:
                stream.write(log.content())
            files.append(name)

        for r in rows:
            if log is None or r.job_id != job:
                if log is not None:
                    close()
                job, log = r.job_id, LogFile(r.job_id)
            if None not in (r.robot_key, r.t, r.x, r.y):
                log.add(r.robot_key, r.t, r.x, r.y, r.heading)
        if log is not None:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(SUFFIX) and not f.base_name.startswith("_")] if self.overwrite else []
        for name in [f for m in messages if m for f in m.files]:
            folder, _, file = name.rpartition("/")
            fs.move(name, f"{folder}/{file[1:]}")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for name in [f for m in messages if m for f in m.files]:
            fs.delete_file(name)


class PoseLog(DataSource):
    """Data source ``poselog``; its path is a URI of a store that Arrow reads. Write tables dealt by job: :func:`save`."""

    @classmethod
    def name(cls) -> str:
        return "poselog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def save(rows, path: str, mode: str = "append") -> None:
    """Write ``job_id, robot_key, t, x, y, heading`` as logs, each job's records in order of time; unplaced rows are left out."""
    rows.sparkSession.dataSource.register(PoseLog)
    dealt = rows.selectExpr(*[f"cast({c.rsplit(' ', 1)[0]} as {c.rsplit(' ', 1)[1]}) as {c.rsplit(' ', 1)[0]}" for c in SCHEMA.split(", ")])
    dealt.repartition("job_id").sortWithinPartitions("job_id", "t", "robot_key").write.format("poselog").mode(mode).save(path)
