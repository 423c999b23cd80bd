"""Media columns: archives of media files, read by a Spark data source of its own.

Writing: each task packs its rows' payloads (UTF-8 text, padded with spaces to a positive multiple of WIDTH) as 8-bit grey
PNG pictures of that width into ZIP archives of about archive_bytes, stored as they are. An archive appears under its name
only when it is whole. Every attempt of a task writes under names of its own, and the archives of the attempts that Spark
committed are named in a manifest table, so what a lost attempt left behind is never read.

Reading, format "media_archive": the planner takes the archives that the manifest names (a row for each archive) and cuts
them into byte ranges; a task takes
the members whose headers start in its range, by the archive's own directory, and streams them as Arrow batches of bounded
size. A member that can't be read or fails its checksum is tried again by its offset, on a newly opened file, without
repeating the others; if it fails every time, the task fails, so no member is ever left out.

Defined cases: a null or empty text is one row of WIDTH spaces with n_bytes 0; equal texts give equal pictures; null and
equal identifiers are kept; an empty table gives no archive and no rows; further columns are not read."""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import materialize, shared_dir, slices
from .files import reading, resolve, size_of, writing

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LENGTH = b"TextBytes\0"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(text: bytes) -> bytes:
    """A grey picture whose samples are the padded text; its length is kept beside them."""
    size = max(-(-len(text) // WIDTH), 1) * WIDTH
    rows = np.zeros((size // WIDTH, WIDTH + 1), np.uint8)  # each row starts with its filter, none
    rows[:, 1:] = np.frombuffer(text.ljust(size), np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", LENGTH + str(len(text)).encode()) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows by columns) of such a picture, and the length of its text."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, packed, n = 8, [], 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("broken PNG")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(LENGTH):
            n = int(body[len(LENGTH) :])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not read")
    return rows[:, 1:], n


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, mean steps along and across, and the bits of an 8 x 8 average hash."""
    x = samples.astype(np.float64)
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    along = np.abs(np.diff(x, axis=1)).mean()
    across = np.abs(np.diff(x, axis=0)).mean() if len(x) > 1 else 0.0
    cells = np.array([part.mean() for part in np.array_split(x.ravel(), 64)])
    bits = int("".join("1" if c > cells.mean() else "0" for c in cells), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};dx={along:.4f};dy={across:.4f};hash={bits:016x}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 64 << 20) -> None:
    """Write the payloads of all rows into archives in folder, and the manifest that names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        number, row, attempt = 0, next(rows, None), uuid.uuid4().hex[:12]
        while row is not None:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:05d}-{attempt}.zip"
            with writing(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                size = members = 0
                while row is not None and size < archive_bytes:
                    member = zipfile.ZipInfo(f"{members:08d}.png")
                    member.comment = json.dumps({"id": row[0]}).encode()
                    data = encode_png((row[1] or "").encode())
                    archive.writestr(member, data)
                    size, members, row = size + len(data), members + 1, next(rows, None)
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size_of(f"{folder}/{name}")], "members": [members]})
            number += 1

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    materialize(rows.mapInArrow(run, "archive string, bytes long, members long"), "manifest", folder)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class MediaArchive(DataSource):
    """Members of the ZIP archives in a folder. Options: path, range_bytes, batch_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, member string, id long, media binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaArchiveReader(self.options)


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.batch_bytes, self.tries = (int(options.get(k, v)) for k, v in (("range_bytes", 16 << 20), ("batch_bytes", 8 << 20), ("tries", 3)))

    def partitions(self) -> list[ByteRange]:
        system, root = resolve(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True)) if f.base_name.endswith(".parquet")]
        base, parts = self.path.rstrip("/"), []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as part:
                named = pq.read_table(part, columns=["archive", "bytes"], use_threads=False).to_pylist()
            parts += [ByteRange(f"{base}/{r['archive']}", a, min(a + self.range_bytes, r["bytes"])) for r in named for a in range(0, r["bytes"], self.range_bytes)]
        return parts or [ByteRange("", 0, 0)]

    def member(self, path: str, info: zipfile.ZipInfo, file) -> tuple[bytes, object]:
        """A member's bytes, read at its offset; each try after the first opens the file anew. Also the file to go on with."""
        for attempt in range(self.tries):
            try:
                file = reading(path) if attempt else file
                file.seek(info.header_offset)
                head = file.read(30)
                names, extra = struct.unpack_from("<HH", head, 26)
                file.seek(info.header_offset + 30 + names + extra)
                data = file.read(info.compress_size)
                if head[:4] != b"PK\3\4" or zlib.crc32(data) != info.CRC:
                    raise OSError("the bytes are not the member's")
                return data, file
            except (OSError, struct.error) as e:
                error = e
                time.sleep(0.1 * attempt)
        raise OSError(f"{path}, member at {info.header_offset}: {error}")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = ("archive", "offset", "member", "id", "media")
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        schema = pa.schema(list(zip(names, types, strict=True)))
        file = reading(partition.path)
        with zipfile.ZipFile(file) as archive:
            members = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        file = reading(partition.path)
        rows, size = [], 0
        for info in members:
            data, file = self.member(partition.path, info, file)
            rows.append((partition.path, info.header_offset, info.filename, json.loads(info.comment)["id"], data))
            size += len(data)
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)


def read_archives(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def decode_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id column, n_bytes, payload (binary, padded), media (binary) and feature of every member."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType(), False), T.StructField("payload", T.BinaryType(), False), T.StructField("media", T.BinaryType(), False), T.StructField("feature", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # By the pictures' sizes as decoded, which their headers name: a picture of one sign packs to nothing.
            heights = [struct.unpack_from(">I", m, 20)[0] for m in batch.column("media").to_pylist()]
            for part in slices(batch, np.array(heights, np.int64) * WIDTH, 4 << 20):
                made = [decode_png(m) for m in part.column("media").to_pylist()]
                columns = [pa.array([n for _, n in made], pa.int64()), pa.array([s.tobytes() for s, _ in made], pa.binary()), part.column("media"), pa.array([features(s) for s, _ in made], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=schema.names)

    return media.select("id", "media").mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    payload = F.col("payload")
    return decoded.select(
        id_col, "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def store_and_read(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as archives into a new shared folder, read them back, and decode every member."""
    folder = shared_dir(spark)
    write_archives(docs, folder, id_col, text_col)
    return decode_media(read_archives(spark, folder), id_col)
