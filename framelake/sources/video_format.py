"""Raw videos and their side files as a Spark data source: spark.read, df.write and spark.readStream of format "rawvideo".

Reading: a partition is a range of one file's frames; filters on frame_no (where Spark hands filters to Python sources:
spark.sql.python.filterPushdown.enabled, with the option pushdown) and the options first and stop narrow the ranges, so
that other bytes are never read. Writing: a frame's place follows from its number, so tasks write where their frames
belong, in a folder of the attempt; the commit checks that each file has every frame once, adds header and end, and moves
the files into place; an abort removes the folder. A file's name tells its stream and image apart from all others.
"""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import struct
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..frames import FORMATS, SCHEMA
from ..operators.vector import px_lists
from . import raw_video as raw

#: Bytes of one Arrow batch of frames, about.
BATCH_BYTES = 16 << 20


def file_name(stream: str, img_no: int, numbered: bool = True, name: str | None = None) -> str:
    """stream_NN by the image, stream_name, or the stream alone; different streams, images and names give different files.

    Characters that aren't letters, digits, `_`, `-`, `.` or `~` are written as %XX. The part after the last `_` is the
    image or the name.
    """
    if stream is None or img_no is None:
        raise ValueError("a recorded frame needs a stream and an image number")
    stem = quote(stream, safe="")
    if name is not None:
        stem += "_" + quote(name, safe="").replace("_", "%5F")
    elif numbered:
        stem += f"_{img_no + 1:02d}"
    return f"%{ord(stem[0]):02X}{stem[1:]}" if stem[:1] in ("_", ".") else stem  # names with these first are hidden


def mounted(path: str) -> str:
    """The path without file:, as written files need a place that all machines mount; another scheme is an error."""
    if re.match(r"^[A-Za-z][\w+.-]*:", path) and not path.startswith("file:"):
        raise ValueError(f"{path}: frames are written in the middle of files, which needs a mounted folder")
    return re.sub(r"^file:/+", "/", path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, time) of a file, of a folder's files, or of those that a pattern's last part names."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(path)
    parent, last = os.path.split(name.rstrip("/"))
    scheme = "" if plain.startswith("/") else path[: len(path) - len(name)]
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(parent)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name))
    return sorted((scheme + f.path, f.mtime_ns or 0) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class FrameRange(InputPartition):
    path: str
    width: int
    height: int
    fmt: str
    at: int
    first: int
    n: int


def ranges(path: str, first: int = 0, stop: int | None = None) -> list[FrameRange]:
    """The parts of a file whose frames are numbered first to stop - 1; its header is read."""
    height, width, fmt, _, frames, at = raw.parse_header(raw.bytes_at(path, 0, 4096))
    step = max(1, raw.RANGE_BYTES // (raw.frame_bytes(width, height, fmt) + 8))
    end = frames if stop is None else min(frames, stop)
    return [FrameRange(path, width, height, fmt, at, k, min(step, end - k)) for k in range(max(0, first), end, step)]


def frames_of(part: FrameRange):
    """Record batches of FRAMES."""
    size = raw.frame_bytes(part.width, part.height, part.fmt) + 8
    step = max(1, BATCH_BYTES // size)
    stream = unquote(re.sub(r"\.[^./]*$", "", part.path.rsplit("/", 1)[-1]))
    for k in range(part.first, part.first + part.n, step):
        n = min(step, part.first + part.n - k)
        some = raw.parse_frames(raw.bytes_at(part.path, part.at + k * size, n * size), part.width, part.height, part.fmt, k, n)
        columns = {
            "stream_id": pa.array([stream] * n), "frame_no": pa.array(range(k, k + n), pa.int64()), "img_no": pa.array([0] * n, pa.int32()), "ts": pa.nulls(n, pa.timestamp("us", "UTC")), "width": pa.array([part.width] * n, pa.int32()),
            "height": pa.array([part.height] * n, pa.int32()), "pix_fmt": pa.array([part.fmt] * n), "px": px_lists(some), "meta": pa.nulls(n, pa.struct([("ts_ns", pa.int64())])),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class VideoReader(DataSourceReader):
    def __init__(self, path: str, first: int, stop: int | None):
        self.path, self.first, self.stop = path, first, stop

    def partitions(self) -> list[FrameRange]:
        with ThreadPoolExecutor(16) as pool:  # headers alone
            return [r for rs in pool.map(lambda f: ranges(f[0], self.first, self.stop), _listed(self.path)) for r in rs]

    def read(self, partition: FrameRange):
        return frames_of(partition)


class PushedReader(VideoReader):
    """A reader that takes filters on frame_no."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            low, high = {
                EqualTo: (value, value), GreaterThan: (value, None), GreaterThanOrEqual: (value, None), LessThan: (None, value), LessThanOrEqual: (None, value),
            }.get(type(f), (None, None)) if name == ("frame_no",) and isinstance(value, int) else (None, None)
            if low is None and high is None:
                yield f
                continue
            if low is not None:
                self.first = max(self.first, low + isinstance(f, GreaterThan))
            if high is not None:
                end = high + (not isinstance(f, LessThan))
                self.stop = end if self.stop is None else min(self.stop, end)


class VideoStream(DataSourceStreamReader):
    """Videos of a folder in order of their arrival; an offset is how many have been taken."""

    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[str]:
        return [f for f, _ in sorted(_listed(self.path), key=lambda f: (f[1], f[0]))]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        return [r for f in self._files()[start["files"] : end["files"]] for r in ranges(f)]

    def read(self, partition: FrameRange):
        return frames_of(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """For each file of a task: frames, least and greatest number, and its (width, height, format)."""

    files: dict = field(default_factory=dict)


class VideoWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, options: dict):
        self.folder, self.overwrite = mounted(path), overwrite
        self.rate, self.numbered = int(options.get("rate", 20)), options.get("numbered", "true").lower() == "true"
        self.suffix, self.layout = options.get("suffix", ".fvf"), options.get("layout")
        self.record = raw.record_type(self.layout) if self.layout else None
        self.staging = os.path.join(self.folder, f"_writing-{uuid.uuid4().hex}")
        os.makedirs(self.staging)

    def _record(self, row: dict) -> tuple[bytes, int, tuple]:
        """What a row writes, where, and what all rows of its file have in common."""
        if self.layout:
            values = tuple(row[f"record_{f}"] for f in self.record.names)
            return np.array([values], self.record).tobytes(), row["frame_no"] * self.record.itemsize, ()
        w, h, fmt = row["width"], row["height"], row["pix_fmt"]
        body, size = np.asarray(row["px"].values.to_numpy(zero_copy_only=False)).astype(raw.DTYPE[FORMATS[fmt].kind]).tobytes(), raw.frame_bytes(w, h, fmt)
        if len(body) != size:
            raise ValueError(f"frame {row['frame_no']} of {row['stream_id']} has {len(body)} bytes, not {size}")
        return struct.pack("<I", raw.FRAME_START) + body + struct.pack("<I", raw.FRAME_STOP), 10 + raw.INFO_SIZE + row["frame_no"] * (size + 8), (w, h, fmt)

    def write(self, iterator) -> Written:
        """Each frame at its place; a task that runs again writes the same bytes."""
        done, handle, opened = Written(), None, None
        try:
            for batch in iterator:
                plain = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "px"}
                for i in range(batch.num_rows):
                    row = {n: values[i] for n, values in plain.items()}
                    if not self.layout:
                        row["px"] = batch.column("px")[i]
                    path, no = file_name(row["stream_id"], row["img_no"], self.numbered, row.get("name")) + self.suffix, row["frame_no"]
                    data, at, shape = self._record(row)
                    if path != opened:
                        if handle is not None:
                            os.close(handle)
                        handle, opened = os.open(os.path.join(self.staging, path), os.O_WRONLY | os.O_CREAT, 0o644), path
                    os.pwrite(handle, data, at)
                    n, low, high, own = done.files.get(path, (0, no, no, shape))
                    if own != shape:
                        raise ValueError(f"{path}: frames of {own} and {shape}")
                    done.files[path] = (n + 1, min(low, no), max(high, no), shape)
        finally:
            if handle is not None:
                os.close(handle)
        return done

    def commit(self, messages) -> None:
        every: dict = {}
        for message in messages:
            for path, (n, low, high, shape) in (message.files if message else {}).items():
                m, a, b, own = every.get(path, (0, low, high, shape))
                if own != shape:
                    self._fail(f"{path}: frames of {own} and {shape}")
                every[path] = (n + m, min(a, low), max(b, high), shape)
        for path, (n, low, high, shape) in every.items():
            if low != 0 or high != n - 1:
                self._fail(f"{path}: {n} frames numbered {low} to {high}; each number from 0 on has to come once")
            if not self.layout:
                self._framed(os.path.join(self.staging, path), n, *shape)
        if self.overwrite:
            for old in os.listdir(self.folder):
                if old.endswith(self.suffix):
                    os.remove(os.path.join(self.folder, old))
        for path in every:
            os.replace(os.path.join(self.staging, path), os.path.join(self.folder, path))
        shutil.rmtree(self.staging)

    def _framed(self, path: str, n: int, w: int, h: int, fmt: str) -> None:
        """Header and end of a file of n frames."""
        with open(path, "r+b") as f:
            f.write(raw.header(w, h, fmt, self.rate, n))
            f.seek(10 + raw.INFO_SIZE + n * (raw.frame_bytes(w, h, fmt) + 8))
            f.write(bytes([raw.FILE_STOP]))

    def _fail(self, why: str) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        raise ValueError(why)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class RawVideo(DataSource):
    """Options: path; to read first, stop, pushdown; to write rate, numbered, suffix, and layout for side files. A column `name` names images when writing."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoReader:
        stop = self.options.get("stop")
        kind = PushedReader if self.options.get("pushdown", "false").lower() == "true" else VideoReader
        return kind(self.options["path"], int(self.options.get("first", 0)), None if stop is None else int(stop))

    def streamReader(self, schema) -> VideoStream:  # noqa: N802
        return VideoStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> VideoWriter:
        return VideoWriter(self.options["path"], overwrite, self.options)


def register(spark) -> None:
    spark.dataSource.register(RawVideo)


def read_video(spark, path: str, first: int | None = None, stop: int | None = None):
    """FRAMES of a file, a folder or a pattern of files; stream_id is the file's name, whose escapes are undone.

    first, stop: only frames of these numbers are read. Filters on frame_no do the same where the session hands them over.
    """
    register(spark)
    reader = spark.read.format("rawvideo").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for key, value in (("first", first), ("stop", stop)):
        reader = reader if value is None else reader.option(key, value)
    return reader.load(path)


def stream_video(spark, path: str):
    """FRAMES of the videos that come into a folder, each file once."""
    register(spark)
    return spark.readStream.format("rawvideo").load(path)
