"""Multi-page 16-bit image stacks: a walk over the linked page directories of uncompressed TIFF files, a row a page.

A recording is split in chunk files name.tif, name_X2.tif, name_X3.tif, ...; page numbers run on over the chunks. Directories
are read by their places, and only a page's own strips are read for it, so pages of one file are read by many tasks.
"""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import SCHEMA
from ..functions.ordered import grouped, running
from ..operators.vector import px_lists
from . import raw_video as raw
from .video_format import file_name, mounted

# Fixed values of the file format: marks of the byte orders, version, sizes of field types, tags.
ORDERS = {b"II": "<", b"MM": ">"}
VERSION = 42
SIZES = {1: 1, 3: 2, 4: 4}
CODES = {1: "B", 3: "H", 4: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PAGE = "path string, page bigint, width int, height int, little boolean, offsets array<bigint>, counts array<bigint>"


def directories(path: str):
    """(width, height, order, strip offsets, strip sizes) of each page, following the links between directories."""
    head = raw.bytes_at(path, 0, 8)
    order = ORDERS.get(head[:2])
    if len(head) < 8 or order is None or struct.unpack_from(order + "H", head, 2)[0] != VERSION:
        raise ValueError(f"{path}: not a stack of pages")
    at, seen = struct.unpack_from(order + "I", head, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError(f"{path}: the page directories form a ring")
        seen.add(at)
        n = struct.unpack(order + "H", raw.bytes_at(path, at, 2))[0]
        body = raw.bytes_at(path, at + 2, 12 * n + 4)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", body, 12 * k)
            if kind in CODES:
                size = SIZES[kind] * count
                data = body[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else raw.bytes_at(path, struct.unpack_from(order + "I", body, 12 * k + 8)[0], size)
                tags[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", data)
        if tags.get(COMPRESSION, (1,)) != (1,) or tags.get(BITS) != (16,) or tags.get(SAMPLES, (1,)) != (1,):
            raise ValueError(f"{path}: page {len(seen) - 1} isn't uncompressed with one 16-bit sample a pixel")
        if sum(tags[COUNTS]) != 2 * tags[WIDTH][0] * tags[HEIGHT][0]:
            raise ValueError(f"{path}: page {len(seen) - 1} has {sum(tags[COUNTS])} bytes")
        yield tags[WIDTH][0], tags[HEIGHT][0], order, tags[OFFSETS], tags[COUNTS]
        at = struct.unpack_from(order + "I", body, 12 * n)[0]


def page_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, page, width, height, little, offsets, counts) of every page, by its directory alone."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = []
                for page, (w, h, order, offsets, counts) in enumerate(directories(name)):
                    rows.append({"path": name, "page": page, "width": w, "height": h, "little": order == "<", "offsets": offsets, "counts": counts})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("path", pa.string()), ("page", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("little", pa.bool_()), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    return files.mapInArrow(run, PAGE)


def read_stack(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FRAMES of format Y_16: stream_id is the name without chunk and ending, frame_no runs on over the chunks."""
    pages = raw.stack_pages(page_table(spark, path)).select("base", "frame_no", "path", "width", "height", "little", "offsets", "counts")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name, little, offsets, counts = (row.column(c)[0].as_py() for c in ("path", "little", "offsets", "counts"))
                data = b"".join(raw.bytes_at(name, at, n) for at, n in zip(offsets, counts))
                values = np.frombuffer(data, "<u2" if little else ">u2").astype(np.float32)
                columns = {"stream_id": row.column("base"), "frame_no": row.column("frame_no"), "width": row.column("width"), "height": row.column("height"), "px": px_lists([values])}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    read = pages.repartition("path", "frame_no").mapInArrow(run, "stream_id string, frame_no bigint, width int, height int, px array<float>")
    name = F.url_decode(F.replace("stream_id", F.lit("+"), F.lit("%2B")))
    return read.select(name.alias("stream_id"), "frame_no", F.lit(0).alias("img_no"), F.lit(None).cast("timestamp").alias("ts"), "width", "height", F.lit("Y_16").alias("pix_fmt"), "px", F.lit(None).cast("struct<ts_ns: bigint>").alias("meta")).to(spark.createDataFrame([], SCHEMA).schema)


#: Bytes from the start of a page that page_bytes makes to the place that names the next one.
LINK = 2 + 12 * 9


def page_bytes(values: np.ndarray, at: int) -> bytes:
    """A page that stands at byte `at` before another one: its directory, then its one strip; values(height, width)."""
    h, w = values.shape
    fields = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 16), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 4, at + LINK + 4), (SAMPLES, 3, 1), (ROWS, 4, h), (COUNTS, 4, 2 * w * h)]
    head = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in fields)
    return head + struct.pack("<I", at + LINK + 4 + 2 * w * h) + values.astype("<u2").tobytes()


def write_stack(df: DataFrame, folder: str, pages: int = 1000) -> None:
    """One recording a stream in chunks of so many pages, in a folder that all executors share; img_no 0 only.

    A task writes whole chunks, page by page, each under another name until it is whole; frames get consecutive numbers.
    """
    folder = mounted(folder)
    os.makedirs(folder, exist_ok=True)
    rows = df.where("img_no = 0").select("stream_id", "frame_no", "width", "height", "px")
    chunked = running(rows, ["stream_id"], ["frame_no"], number="page").withColumn("chunk", F.floor(F.col("page") / pages))

    def run(batches):
        now = handle = part = path = None
        link = 0

        def finish() -> None:
            handle.seek(link)
            handle.write(struct.pack("<I", 0))  # no page follows
            handle.close()
            os.replace(part, path)

        try:
            for batch in batches:
                px = batch.column("px")
                for i, (stream, chunk, w, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("stream_id", "chunk", "width", "height")))):
                    if (stream, chunk) != now:
                        if handle is not None:
                            finish()
                        now, path = (stream, chunk), os.path.join(folder, file_name(stream, 0, numbered=False) + (f"_X{chunk + 1}" if chunk else "") + ".tif")
                        part = os.path.join(folder, f".{uuid.uuid4().hex}")
                        handle = open(part, "wb")  # noqa: SIM115 (closed when the chunk is whole)
                        handle.write(b"II" + struct.pack("<HI", VERSION, 8))
                    link = handle.tell() + LINK
                    handle.write(page_bytes(np.asarray(px[i].values.to_numpy(zero_copy_only=False)).reshape(h, w), handle.tell()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
            if handle is not None:
                finish()
                handle = None
        finally:
            if handle is not None:  # a chunk that failed
                handle.close()
                if os.path.exists(part):
                    os.remove(part)

    grouped(chunked, ["stream_id", "chunk"], ["page"]).mapInArrow(run, "n long").agg(F.sum("n")).collect()
