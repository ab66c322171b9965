"""The raw video container and its metadata side files.

Container, little endian, packed: 0xAA, info block {0xAB, major, minor, u32 size, u32 height, u32 width, u32 format id,
u32 frame rate, u32 frames, 0x5B}, 0xFF; then per frame u32 0xBABEFACE, pixels, u32 0xDEADBEEF; at the end 0x55. A frame's
place follows from its number, so a reader can start anywhere. Side file: records of one size, one for each frame.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import FORMATS, SCHEMA
from ..functions.ordered import running
from ..operators.vector import px_lists

# Fixed values of the file format.
START, INFO_START, INFO_STOP, HEADER_STOP, FILE_STOP = 0xAA, 0xAB, 0x5B, 0xFF, 0x55
MAJOR, MINOR, INFO_SIZE = 0, 1, 20
FRAME_START, FRAME_STOP = 0xBABEFACE, 0xDEADBEEF
DTYPE = {"u8": "<u1", "u16": "<u2", "f32": "<f4"}
NAMES = {f.id: name for name, f in FORMATS.items()}
#: Bytes of the frames that one row of a read stands for, about.
RANGE_BYTES = 16 << 20
RAW_SCHEMA = "path string, frame_no bigint, width int, height int, pix_fmt string, px array<float>"


def parse_header(head: bytes) -> tuple[int, int, str, int, int, int]:
    """(height, width, format, frame rate, frames, place of the first frame); a bad header raises ValueError."""
    if len(head) < 8 or head[0] != START or head[1] != INFO_START:
        raise ValueError("not a raw video file")
    major, _, size = struct.unpack_from("<BBI", head, 2)
    if major > MAJOR or size < INFO_SIZE:
        raise ValueError("unknown version of the raw video header")
    if len(head) < 10 + size or head[8 + size] != INFO_STOP:
        raise ValueError("the info block has no end")
    height, width, fmt, rate, frames = struct.unpack_from("<5I", head, 8)
    if fmt not in NAMES:
        raise ValueError(f"pixel format {fmt} has no layout")
    return height, width, NAMES[fmt], rate, frames, 10 + size


def frame_bytes(width: int, height: int, fmt: str) -> int:
    return width * height * FORMATS[fmt].channels * FORMATS[fmt].bytes_per_channel


def parse(content: bytes) -> tuple[int, int, str, list[np.ndarray]]:
    """A whole file."""
    height, width, fmt, _, frames, at = parse_header(content)
    return height, width, fmt, parse_frames(content[at:], width, height, fmt, 0, frames)


def parse_frames(content: bytes, width: int, height: int, fmt: str, first: int, n: int) -> list[np.ndarray]:
    """n frames from number `first` on, with their markers."""
    size, out = frame_bytes(width, height, fmt), []
    for k in range(n):
        at = k * (size + 8)
        if len(content) < at + size + 8 or struct.unpack_from("<I", content, at)[0] != FRAME_START or struct.unpack_from("<I", content, at + 4 + size)[0] != FRAME_STOP:
            raise ValueError(f"frame {first + k} has no markers")
        out.append(np.frombuffer(content, DTYPE[FORMATS[fmt].kind], size // FORMATS[fmt].bytes_per_channel, at + 4))
    return out


def bytes_at(path: str, start: int, n: int) -> bytes:
    """n bytes of a file at any place that PyArrow has a file system for: local and mounted paths, HDFS, object stores."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return f.read_at(n, start)


def header(width: int, height: int, fmt: str, rate: int, frames: int) -> bytes:
    info = struct.pack("<BBBI5IB", INFO_START, MAJOR, MINOR, INFO_SIZE, height, width, FORMATS[fmt].id, rate, frames, INFO_STOP)
    return struct.pack("<B", START) + info + struct.pack("<B", HEADER_STOP)


def read_raw_video(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FRAMES of one file or folder of files: stream_id is the file's name without ending, img_no 0."""
    # the names alone: a file's header says where its frames lie, and each range of frames is a row of its own
    files = spark.read.format("binaryFile").load(path).select("path")

    def ranges(batches):
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                height, width, fmt, _, frames, at = parse_header(bytes_at(name, 0, 4096))
                step = max(1, RANGE_BYTES // (frame_bytes(width, height, fmt) + 8))
                rows += [(name, width, height, fmt, at, k, min(step, frames - k)) for k in range(0, frames, step)]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "width", "height", "pix_fmt", "at", "first", "n"])

    def run(batches):
        for batch in batches:
            for name, width, height, fmt, at, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                size = frame_bytes(width, height, fmt) + 8
                some = parse_frames(bytes_at(name, at + first * size, n * size), width, height, fmt, first, n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([fmt] * n), px_lists(some)], names=["path", "frame_no", "width", "height", "pix_fmt", "px"])

    parts = files.mapInArrow(ranges, "path string, width int, height int, pix_fmt string, at bigint, first bigint, n bigint")
    raw = parts.repartition("path", "first").mapInArrow(run, RAW_SCHEMA)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    stem = F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))  # escapes of the name are undone
    return raw.select(stem.alias("stream_id"), "frame_no", F.lit(0).alias("img_no"), F.lit(None).cast("timestamp").alias("ts"), "width", "height", "pix_fmt", "px", F.lit(None).cast("struct<ts_ns: bigint>").alias("meta")).to(spark.createDataFrame([], SCHEMA).schema)


def read_multi(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one recording: file i gives img_no i; frames that some file lacks are dropped."""
    every = None
    for i, path in enumerate(paths):
        one = read_raw_video(spark, path).withColumn("stream_id", F.lit("multi")).withColumn("img_no", F.lit(i))
        every = one if every is None else every.unionByName(one)
    whole = every.groupBy("frame_no").agg(F.count("*").alias("n")).where(F.col("n") == len(paths)).select("frame_no")
    return every.join(whole, "frame_no", "left_semi")


def write_raw_video(df: DataFrame, folder: str, rate: int = 20, suffix: str = ".fvf", numbered: bool = True) -> DataFrame:
    """Writes one file per image stream into a folder that all executors share; returns (path, bytes).

    A file is called stream_NN by its image, stream_name by the column `name` if there is one, or as its stream alone
    (numbered=False); see video_format.file_name. Frames get consecutive numbers in their order. Files appear when all are
    whole; other files of the folder stay.
    """
    from . import video_format

    video_format.mounted(folder)
    video_format.register(df.sparkSession)
    columns = ["stream_id", "img_no", "frame_no", "width", "height", "pix_fmt", *(["name"] if "name" in df.columns else [])]
    order = df.select("stream_id", "img_no", "frame_no")
    placed = running(order, ["stream_id", "img_no"], ["frame_no"], number="at")
    px_type = dict(df.dtypes)["px"]
    rows = df.select(*columns, "px").join(placed, ["stream_id", "img_no", "frame_no"]).drop("frame_no").withColumnRenamed("at", "frame_no")
    rows = rows.select(*columns, "px") if px_type == "array<float>" else rows.select(*columns, F.col("px").cast("array<float>").alias("px"))
    # frames of a file come in order, so a task opens each file once
    rows.sortWithinPartitions("stream_id", "img_no", "frame_no").write.format("rawvideo").option("rate", rate).option("numbered", numbered).option("suffix", suffix).mode("append").save(folder)
    by = ["stream_id", "img_no", *(["name"] if "name" in df.columns else [])]
    unit = F.element_at(F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v.channels * v.bytes_per_channel)]), F.first("pix_fmt"))
    size = F.count("*") * (F.first("width") * F.first("height") * unit + 8) + 10 + INFO_SIZE + 1
    files = df.groupBy(*by).agg(size.cast("long").alias("bytes"))
    top = video_format.mounted(folder)

    def paths(batches):
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            found = [f"{top}/{video_format.file_name(s, i, numbered, n)}{suffix}" for s, i, n in zip(col["stream_id"], col["img_no"], col.get("name", [None] * batch.num_rows))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column("bytes")], names=["path", "bytes"])

    return files.mapInArrow(paths, "path string, bytes long")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, as a mounted path; a temporary one in local mode where it is unset."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{re.sub(r'^file:/+', '/', named.rstrip('/')) if named else tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def write_multi(df: DataFrame, folder: str, names: list[str] | None = None, rate: int = 20) -> DataFrame:
    """A recording: for each image a raw video and beside it its .meta file of capture times; gives (path, bytes) of the videos.

    Image i goes to stream_NN with NN = i + 1 in two digits, or to stream_name for its name in names; an image with an
    empty name, or with none, isn't recorded.
    """
    if names is not None:
        named = F.create_map(*[F.lit(x) for i, name in enumerate(names) if name for x in (i, name)]) if any(names) else F.lit(None).cast("map<int,string>")
        df = df.withColumn("name", F.element_at(named, F.col("img_no"))).where("name IS NOT NULL")
    write_metadata(df, folder)
    return write_raw_video(df, folder, rate)


#: Fields of a metadata record: NumPy type and Spark type of each name in a layout.
RECORD_TYPES = {**{f"{k}{8 * n}": (f"<{k}{n}", "bigint") for k in "iu" for n in (1, 2, 4, 8)}, "f32": ("<f4", "double"), "f64": ("<f8", "double")}
#: The layout of the capture times alone.
TIMES = "ts_ns:u64"


def record_type(layout: str) -> np.dtype:
    """The packed record of a layout such as "ts_ns:u64,lat:f64"."""
    return np.dtype([(name, RECORD_TYPES[kind][0]) for name, kind in (f.split(":") for f in layout.split(","))])


def read_metadata(spark: SparkSession, path: str, layout: str = TIMES) -> DataFrame:
    """(stream_id, frame_no, meta) of side files: record i of fixed size is frame i's; meta is a struct of the layout's fields.

    Files are read in ranges of records. A last record that isn't whole is left out. u64 values from 2**63 on wrap.
    """
    from urllib.parse import unquote

    record = record_type(layout)
    meta = "struct<" + ", ".join(f"{name}: {RECORD_TYPES[kind][1]}" for name, kind in (f.split(":") for f in layout.split(","))) + ">"
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / record.itemsize).alias("n"))
    step = max(1, RANGE_BYTES // record.itemsize)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long")))
    parts = files.where("n > 0").select("path", starts.alias("first"), "n").repartition("path", "first")

    def run(batches):
        for batch in batches:
            for name, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                k = min(step, n - first)
                rows = np.frombuffer(bytes_at(name, first * record.itemsize, k * record.itemsize), record)
                values = [pa.array(rows[f].astype(np.float64 if rows[f].dtype.kind == "f" else np.int64)) for f in record.names]
                stream = unquote(re.sub(r"\.[^./]*$", "", name.rsplit("/", 1)[-1]))
                yield pa.RecordBatch.from_arrays([pa.array([stream] * k), pa.array(np.arange(first, first + k)), pa.StructArray.from_arrays(values, names=record.names)], names=["stream_id", "frame_no", "meta"])

    return parts.mapInArrow(run, f"stream_id string, frame_no bigint, meta {meta}")


def write_metadata(df: DataFrame, folder: str, numbered: bool = True, layout: str = TIMES) -> None:
    """One .meta file per image stream beside its video: records of the layout's fields of `meta`, null as 0, in order of frames."""
    from . import video_format

    video_format.mounted(folder)
    video_format.register(df.sparkSession)
    name = ["name"] if "name" in df.columns else []
    fields = [F.coalesce(F.col(f"meta.{f}"), F.lit(0)).cast(RECORD_TYPES[kind][1]).alias(f"record_{f}") for f, kind in (x.split(":") for x in layout.split(","))]
    rows = df.select("stream_id", "img_no", "frame_no", *name, *fields)
    placed = running(rows, ["stream_id", "img_no"], ["frame_no"], number="at").drop("frame_no").withColumnRenamed("at", "frame_no")
    placed.write.format("rawvideo").option("layout", layout).option("numbered", numbered).option("suffix", ".meta").mode("append").save(folder)


def stack_pages(chunks: DataFrame) -> DataFrame:
    """chunks(path, page) of name.ext, name_X2.ext, ...: adds base, chunk and the frame number that runs over the chunks."""
    name = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1)
    part = F.regexp_extract(name, r"_X(\d+)$", 1)
    rows = chunks.withColumn("base", F.regexp_replace(name, r"_X\d+$", "")).withColumn("chunk", F.when(part == "", 1).otherwise(part.cast("int")))
    counts = rows.groupBy("base", "chunk").agg(F.count("*").alias("pages"))
    before = Window.partitionBy("base").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("pages").over(before), F.lit(0))).drop("pages")
    return rows.join(offsets, ["base", "chunk"]).withColumn("frame_no", F.col("offset") + F.col("page")).drop("offset")


def pages_at(stacked: DataFrame, wanted: DataFrame) -> DataFrame:
    """The page at each position of wanted(base, position) in the rows of stack_pages; past the end it is the last page."""
    last = stacked.groupBy("base").agg(F.max("frame_no").alias("last_no"))
    asked = wanted.join(last, "base").withColumn("frame_no", F.least("position", "last_no")).drop("last_no")
    return asked.join(stacked, ["base", "frame_no"])


def read_channel_setup(spark: SparkSession, path: str, tag: str = "channel_setup") -> DataFrame:
    """One row per element of an XML file; attributes are the columns."""
    table = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").load(path)
    return table.select([c for c in table.columns if c != "_VALUE"])


def stream_frames(spark: SparkSession, folder: str, files: int = 1, latest_first: bool = False) -> DataFrame:
    """FRAMES arriving as Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("latestFirst", latest_first).parquet(folder)
