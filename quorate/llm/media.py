"""Media columns: payloads stored as PNG members of ZIP archives, read back by a Spark data source.

Writing: each task streams its documents into one archive in the shared folder; the archives of tasks whose results
count are listed in a manifest, so those of failed attempts are never read. Reading: the data source plans byte
ranges over the archives; a task takes the members whose local header lies in its range, reads each at its own
offset, checks it, tries it again alone if that fails, and streams Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quorate.llm.common import Scratch, checkpointed

#: Bytes of a row of samples: 64 pixels of three 8-bit channels.
ROW = 192
MANIFEST = "_archives.json"
MEMBERS = "doc_id long, archive string, offset long, media binary, attempts int"


def pad(raw: bytes) -> bytes:
    """raw with blanks up to a positive multiple of ROW bytes."""
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def to_png(raw: bytes) -> bytes:
    """The padded bytes as the samples of a 64-pixel-wide RGB image; the unpadded length is in a text chunk."""
    rows = np.frombuffer(pad(raw), dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"tEXt", b"bytes\0%d" % len(raw)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of an image that to_png made."""
    at, size, data, length = 8, (0, 0), [], 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            length = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], size[0] * 3 + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written")
    return lines[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Size, channel means and variances in thousandths, and a 64-bit average hash of an 8 by 8 grid; integers only."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW // 3, 3).astype(np.int64)
    n = image.shape[0] * image.shape[1]
    sums, squares = image.sum((0, 1)), (image**2).sum((0, 1))
    means = [int(s) * 1000 // n for s in sums]
    variances = [(int(q) * n - int(s) ** 2) * 1000 // n**2 for s, q in zip(sums, squares, strict=True)]
    bands = np.zeros((8, 8), dtype=np.int64)
    np.add.at(bands, np.arange(image.shape[0]) * 8 // image.shape[0], image.sum(2).reshape(-1, 8, 8).sum(2))
    bits = (bands > bands.mean()).ravel()
    return f"{ROW // 3}x{image.shape[0]};mean={','.join(map(str, means))};var={','.join(map(str, variances))};hash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write every document as a member of an archive in ``folder`` (a URI) and list the archives; returns their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        name, n = f"{uuid.uuid4().hex}.zip", 0
        store.create_dir(root, recursive=True)
        first = next(batches, None)
        if first is None:
            return
        with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            while first is not None:
                for i, text in zip(first["doc_id"], first["text"], strict=True):
                    key = "null" if pd.isna(i) else int(i)
                    archive.writestr(zipfile.ZipInfo(f"{n}_{key}.png"), to_png((text or "").encode()))
                    n += 1
                first = next(batches, None)
        yield pd.DataFrame({"archive": [name], "members": [n], "bytes": [store.get_file_info(f"{root}/{name}").size]})

    slim = docs.selectExpr(f"bigint(`{id_col}`) as doc_id", f"`{text_col}` as text")
    listed = slim.mapInPandas(run, "archive string, members long, bytes long").collect()  # one row a task
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps(sorted((r.archive, r.bytes) for r in listed)).encode())
    return len(listed)


class Range(InputPartition):
    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


class ArchiveSource(DataSource):
    """spark.read.format('media_archives').option('path', folder): the members of all archives that folder lists.

    Options: rangeBytes (bytes of archive a task reads, 8 MB), batchBytes (bytes of an Arrow batch, 4 MB), retries
    (tries of a member, 3).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        lower = {k.lower(): v for k, v in options.items()}
        self.range_bytes = int(lower.get("rangebytes", 8 << 20))
        self.batch_bytes, self.retries = int(lower.get("batchbytes", 4 << 20)), int(lower.get("retries", 3))

    def partitions(self) -> list[Range]:
        """Byte ranges; the archives' own directories are read by the tasks, not here."""
        store, root = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        plan = [Range(a, at, at + self.range_bytes) for a, size in archives for at in range(0, size, self.range_bytes)]
        return plan or [Range("", 0, 0)]

    def member(self, store: fs.FileSystem, path: str, offset: int, size: int, checksum: int) -> tuple[bytes, int]:
        """The bytes of one member, read at its offset, and the number of tries; other members are not touched."""
        for attempt in range(1, self.retries + 1):
            try:
                with store.open_input_file(path) as f:
                    f.seek(offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError(f"no member at byte {offset} of {path}")
                    f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                    data = f.read(size)
                if len(data) != size or zlib.crc32(data) != checksum:
                    raise OSError(f"damaged member at byte {offset} of {path}")
                return data, attempt
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = fs.FileSystem.from_uri(self.folder)
        path = f"{root}/{partition.archive}"
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            found = [(m.header_offset, m.file_size, m.CRC, m.filename) for m in archive.infolist() if partition.low <= m.header_offset < partition.high]
        schema = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32())])
        rows, held = [], 0
        for offset, size, checksum, name in sorted(found):
            data, attempts = self.member(store, path, offset, size, checksum)
            key = name[name.index("_") + 1 : -4]
            rows.append((None if key == "null" else int(key), partition.archive, offset, data, attempts))
            held += size
            if held >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_archives(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """doc_id, archive, offset, media, attempts of every member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(path=folder, **options).load()


def describe(members: DataFrame) -> DataFrame:
    """Digests and features of media, from the samples as decoded from the stored bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for media in pdf["media"]:
                payload, n = from_png(media)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
            yield out

    return members.select("doc_id", "media").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an archived image, read it back and describe it; one row per document.

    A null text is empty and becomes one row of blanks; null and repeated ids keep their rows; other columns are
    ignored; no rows give no rows. Only the digests are kept (checkpointed); the archives go.
    """
    spark = docs.sparkSession
    with Scratch(spark, "media") as scratch:
        write_archives(docs, scratch.path, id_col, text_col)
        return checkpointed(describe(read_archives(spark, scratch.path)))
