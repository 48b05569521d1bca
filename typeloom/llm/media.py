"""Media columns: payloads kept in archives and read through a data source.

``MediaArchives.write`` stores payloads as 8-bit grey PNG images (lossless) in
ZIP archives of the shared folder, one archive per task; a list of the archives
of tasks that succeeded makes them visible.  The data source ``corpus_media``
reads a folder of archives back: planning reads each archive's end record, of 98
bytes, and cuts its directory into byte ranges, so that a directory's bytes are
read about once however many tasks share an archive.  A task finds the entries
that start in its range and streams their payloads in Arrow batches of bounded
size.  A member is fetched by its offset, alone, and fetched again where reading
or its checksum fails.  What cannot be read, be it a member, a directory or an
image, becomes a row with an error, and the job goes on.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import BATCH_BYTES, BATCH_ROWS, Stages, read

UNIT = 576
ROW = 576  # samples in a row of the image
FILL = 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 and then bytes 255 up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (-len(raw) % UNIT or (0 if raw else UNIT))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A payload of whole rows as an 8-bit grey image: one sample a byte."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # filter byte 0, then the row
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made, checksums verified."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not an 8-bit grey image")
            size = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Sample statistics: a 16-bin histogram as hex of per-mille, and the mean."""
    s = np.frombuffer(payload, np.uint8)
    h = np.bincount(s >> 4, minlength=16) * 999 // len(s)
    return "".join(f"{x:03x}" for x in h.tolist()) + f"-{int(s.sum(dtype=np.int64)) * 100 // len(s):05d}"


# ZIP with stored members, written and read by the parts needed here ----------


class ArchiveWriter:
    """Appends stored members; ``close`` writes the directory (ZIP64 if large)."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0) + name, start := self.at)
        self._put(data, start)
        self.members.append((name, crc, len(data), start))

    def _put(self, data: bytes, _: int) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        start = self.at
        for name, crc, size, at in self.members:
            extra = struct.pack("<HHQ", 1, 8, at) if at >= 0xFFFFFFFF else b""
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if extra else 20, 0, 0, 0, 33, crc, size, size, len(name), len(extra), 0, 0, 0, 0, min(at, 0xFFFFFFFF)) + name + extra, 0)
        size, n, end = self.at - start, len(self.members), self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start), 0)
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1), 0)
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0), 0)


#: More than a directory entry can have: its name, extra field and comment.
ENTRY = 46 + 3 * 65535
_ENTRY_MARK = struct.pack("<I", 0x02014B50)


def ending(f, size: int) -> tuple[int, int, int]:
    """(members, bytes, offset) of an archive's directory, by its end record."""
    f.seek(max(0, size - 98))
    tail = f.read(98)
    at = tail.rfind(struct.pack("<I", 0x06064B50))
    if 0 <= at <= len(tail) - 56:
        n, length, start = struct.unpack("<QQQ", tail[at + 32 : at + 56])
    else:
        at = tail.rfind(struct.pack("<I", 0x06054B50))
        if not 0 <= at <= len(tail) - 20:
            raise ValueError("no archive directory")
        n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if start + length > size:
        raise ValueError("a torn archive directory")
    return n, length, start


def _entry_length(raw: bytes, at: int) -> int:
    """Bytes of the entry at a place; 0 if there is none."""
    if at + 46 > len(raw) or raw[at : at + 4] != _ENTRY_MARK:
        return 0
    return 46 + sum(struct.unpack("<HHH", raw[at + 28 : at + 34]))


def entries(raw: bytes, first: bool, span: int, last: bool) -> list[tuple[bytes, int, int, int]]:
    """(name, crc, size, offset of the header) of the entries that start in the
    first ``span`` bytes of a part of a directory.  Unless the part begins with
    an entry (``first``), its first entry is where others follow each other."""
    at = 0
    if not first:
        while True:
            at = raw.find(_ENTRY_MARK, at)
            if at < 0 or at >= span:
                return []
            here, chain = at, 0
            while chain < 4 and (n := _entry_length(raw, here)):
                here, chain = here + n, chain + 1
            if chain == 4 or (chain and here == len(raw) and last) or (chain and here + 46 > len(raw) and not last):
                break
            at += 1
    out = []
    while at < span:
        n = _entry_length(raw, at)
        if not n or at + n > len(raw):
            raise ValueError("a damaged archive directory")
        crc, size, _, names = struct.unpack("<IIIH", raw[at + 16 : at + 30])
        where = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + names]
        if where == 0xFFFFFFFF:
            where = struct.unpack("<Q", raw[at + 50 + names : at + 58 + names])[0]
        out.append((name, crc, size, where))
        at += n
    return out


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = path[5:]
        path = "/" + path.lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class ByteRange(InputPartition):
    """Bytes [start, end) of an archive's directory, which is [low, high)."""

    def __init__(self, path: str, start: int = 0, end: int = 0, low: int = 0, high: int = 0, error: str | None = None):
        self.path, self.start, self.end, self.low, self.high, self.error = path, start, end, low, high, error


#: Names of a folder's archives, one a line; without it, all archives there count.
COMMITTED = "_committed"


class MediaReader(DataSourceReader):
    """Options: ``path``; ``split`` payload bytes of a partition; ``tries`` for a
    read and ``wait`` seconds after the first."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", 8 << 20))
        self.tries = int(options.get("tries", 3))
        self.wait = float(options.get("wait", 0.2))

    def _again(self, what):
        """The result of a call, tried again; the last error if none succeeds."""
        for k in range(self.tries):
            try:
                return what(), None
            except (OSError, ValueError, struct.error) as e:
                error, self.open = f"{type(e).__name__}: {e}", None
                if k + 1 < self.tries:
                    time.sleep(self.wait * 2**k)
        return None, error

    def partitions(self) -> list[ByteRange]:
        fs, path = _filesystem(self.path)
        names = None
        if fs.get_file_info(f"{path}/{COMMITTED}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{COMMITTED}") as f:
                names = set(f.read().decode().split("\n"))
        files = fs.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
        files = sorted((f.path, f.size) for f in files if (f.path.endswith(".zip") if names is None else os.path.basename(f.path) in names))

        def planned(file: tuple[str, int]) -> list[ByteRange]:
            def read():
                with fs.open_input_file(file[0]) as f:
                    return ending(f, file[1])

            found, error = self._again(read)
            if error:
                return [ByteRange(file[0], error=error)]
            _, length, start = found
            step = max(1, length * self.split // max(1, start))
            return [ByteRange(file[0], at, min(at + step, start + length), start, start + length) for at in range(start, start + length, step)]

        with ThreadPoolExecutor(16) as pool:
            return [p for ps in pool.map(planned, files) for p in ps]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, _ = _filesystem(self.path)
        members, error = None, part.error

        def listed():
            with fs.open_input_file(part.path) as f:
                f.seek(part.start)
                stop = min(part.high, part.end + 5 * ENTRY)
                raw = f.read(stop - part.start)
                return entries(raw, part.start == part.low, part.end - part.start, stop == part.high)

        if error is None:
            members, error = self._again(listed)
        if error is not None:
            yield self._batch([(os.path.basename(part.path), None, part.start, None, error)])
            return
        rows, weight = [], 0
        for name, crc, size, at in members:
            data, error = self._member(fs, part.path, name, crc, size, at)
            rows.append((os.path.basename(part.path), name.decode(errors="replace"), at, data, error))
            weight += len(data or b"")
            if len(rows) >= BATCH_ROWS or weight >= BATCH_BYTES:
                yield self._batch(rows)
                rows, weight = [], 0
        if rows:
            yield self._batch(rows)

    def _member(self, fs, path: str, name: bytes, crc: int, size: int, at: int) -> tuple[bytes | None, str | None]:
        """One member by its offset, whatever became of the others."""

        def fetched() -> bytes:
            if self.open is None:
                self.open = (path, fs.open_input_file(path))
            f = self.open[1]
            f.seek(at)
            raw = f.read(30 + len(name) + size)
            if len(raw) < 30 or raw[:4] != b"PK\x03\x04":
                raise ValueError("no member at this offset")
            names, extras = struct.unpack("<HH", raw[26:30])
            data = raw[30 + names + extras :]
            if len(data) < size:
                f.seek(at + 30 + names + extras)
                data = f.read(size)
            data = data[:size]
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError("a damaged member")
            return data

        return self._again(fetched)

    #: The archive that this task has open.
    open: tuple | None = None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()))], names=["archive", "name", "at", "media", "error"])


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_media"

    def schema(self) -> str:
        return "archive string, name string, at long, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def _write(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        fs.create_dir(path)
        context = TaskContext.get()
        # every attempt has its own name; only those of tasks that succeed are committed
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.zip"
        n = 0
        with fs.open_output_stream(f"{path}/{name}", buffer_size=1 << 20) as out:
            w = ArchiveWriter(out)
            for part in parts:
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    t = text.as_py()
                    w.add(f"{n:08d}-{'' if key is None else key}-{len((t or '').encode())}".encode(), to_png(payload_of(t)))
                    n += 1
            w.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    return run


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for part in parts:
        rows = []
        for name, media, error in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
            doc = n = None
            try:
                if error:
                    raise ValueError(error)
                image = media.as_buffer().to_pybytes()
                payload = from_png(image)
                _, key, n = name.split("-", 1)[0], *name.split("-", 1)[1].rsplit("-", 1)
                doc = int(key) if key else None
            except (ValueError, TypeError, IndexError, struct.error, zlib.error) as e:
                rows.append((doc, n and int(n), None, None, None, None, None, None, error or f"{type(e).__name__}: {e}"))
                continue
            rows.append((doc, int(n), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(image), sha(image), feature_of(payload), None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class MediaArchives:
    """Stores a table's payloads and reads them with their features.

    Defined results: a null or empty text is one unit of bytes 255; equal texts
    have equal media; repeated rows are members each; a very long text is one
    member, of its length; an empty table gives no rows.  Keys are integers or
    null.  Only key and text are read.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", *, split: int = 8 << 20):
        self.key, self.text, self.split = key, text, split

    def write(self, df: DataFrame, folder: str) -> int:
        """Writes the archives; the number of members."""
        source = df.select(F.col(self.key).cast("long").alias("k"), F.col(self.text).alias("t"))
        done = source.mapInArrow(_write(folder), "name string, n long").collect()  # a row a task
        fs, path = _filesystem(folder)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/{COMMITTED}") as out:
            out.write("\n".join(r.name for r in done).encode())
        return sum(r.n for r in done)

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        """``(archive, name, at, media, error)`` of all members."""
        spark.dataSource.register(MediaSource)
        return spark.read.format("corpus_media").option("path", folder).option("split", str(self.split)).load()

    def features(self, media: DataFrame) -> DataFrame:
        ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
        return media.select("name", "media", "error").mapInArrow(_features, ddl)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = MediaArchives()
    folder = Stages(spark, "media").path("archives")
    op.write(read(spark, sf_dir, "documents"), folder)
    return op.features(op.read(spark, folder))
