"""LAS files as a Spark data source, in numpy: spark.read.format("las").load(path), df.write.format("las").

Reading: x, y, z, intensity, classification, withheld, treeID (from an extra dimension of that name) and the file's name; each
file is cut in ranges of records, one for each task. Options: columns (a list by commas; only these are made), drop_withheld,
rows (records in a range). Filters on classification are applied before rows leave Python. Paths are local or mounted
ones that every executor reaches. Compressed files (LAZ) aren't supported and say so.

Writing: one file for each partition, point format 3 of version 1.2 or, with option format 6, of 1.4, and treeID as a 4-byte
extra dimension (null: 0, which also is the ground's). Options: scale (0.001).
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, record long, x double, y double, z double, intensity int, classification int, withheld boolean, treeID long"
_HEADER = struct.Struct("<4sHHIHH8sBB32s32sHHHIIBHI5I12d")
_EXTRA = struct.Struct("<2sBB32s4s24s24s24s24s24s32s")
#: Bytes of a record in the point formats that are known.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36}


def read_header(path: str) -> dict:
    """Version, point format, number of points, record size, scales, offsets, bounds, variable records, and the places of extra dimensions."""
    with open(path, "rb") as f:
        raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        h = _HEADER.unpack_from(raw)
        major, minor = h[7], h[8]
        size, start, n_vlr, kind, length, points = h[13], h[14], h[15], h[16], h[17], h[18]
        if kind & 0x80:
            raise ValueError(f"{path} is compressed (LAZ), which isn't supported")
        kind &= 0x3F
        if (major, minor) >= (1, 4):
            points = struct.unpack_from("<Q", raw, 247)[0]
        f.seek(size)
        extra, wkt, at = {}, None, RECORD_BYTES.get(kind, 0)
        for _ in range(n_vlr):
            _, user, record, n, _ = struct.unpack("<H16sHH32s", f.read(54))
            body = f.read(n)
            user = user.rstrip(b"\0")
            if user == b"LASF_Spec" and record == 4:
                for e in range(0, n, 192):
                    code, name = body[e + 2], body[e + 4 : e + 36].rstrip(b"\0").decode()
                    dtype = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}.get(code)
                    if dtype is None:
                        break
                    extra[name] = (at, dtype)
                    at += np.dtype(dtype).itemsize
            elif user == b"LASF_Projection" and record == 2112:
                wkt = body.rstrip(b"\0").decode(errors="replace")
    numbers = h[24:]
    return {
        "version": f"{major}.{minor}", "format": kind, "points": points, "start": start, "length": length, "extra": extra, "wkt": wkt,
        "scales": numbers[:3], "offsets": numbers[3:6], "max": numbers[6::2], "min": numbers[7::2], "records": n_vlr,
    }


def las_summary(path: str) -> dict:
    """A file's header with its area and density (of the bounding box)."""
    h = read_header(path)
    area = (h["max"][0] - h["min"][0]) * (h["max"][1] - h["min"][1])
    return h | {"area": area, "density": h["points"] / area if area else None}


def read_records(path: str, header: dict, low: int, high: int, columns: list[str], drop_withheld: bool, classes: tuple) -> pa.RecordBatch:
    with open(path, "rb") as f:
        f.seek(header["start"] + low * header["length"])
        raw = np.frombuffer(f.read((high - low) * header["length"]), np.uint8).reshape(high - low, header["length"])
    get = lambda at, dtype: np.ascontiguousarray(raw[:, at : at + np.dtype(dtype).itemsize]).view(dtype).reshape(-1)
    new = header["format"] >= 6
    cls = get(16, "u1").astype(np.int32) if new else (get(15, "u1") & 31).astype(np.int32)
    withheld = (get(15, "u1") & 4) > 0 if new else (get(15, "u1") & 128) > 0
    keep = np.ones(high - low, bool)
    if drop_withheld:
        keep &= ~withheld
    for op, value in classes:
        keep &= (cls == value) if op == "=" else (cls != value)
    made = {"file": lambda: np.full(high - low, os.path.basename(path), object), "record": lambda: np.arange(low, high), "intensity": lambda: get(12, "<u2").astype(np.int32), "classification": lambda: cls, "withheld": lambda: withheld}
    for i, c in enumerate("xyz"):
        made[c] = lambda i=i: get(4 * i, "<i4") * header["scales"][i] + header["offsets"][i]
    at = header["extra"].get("treeID")
    made["treeID"] = (lambda: get(*at).astype(np.int64)) if at else (lambda: np.zeros(high - low, np.int64))
    arrays = [pa.array(made[c]()[keep]) if c != "treeID" or at else pa.nulls(int(keep.sum()), pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=columns)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class LasReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        path = options["path"]
        paths = sorted(glob.glob(os.path.join(path, "**", "*.las"), recursive=True) if os.path.isdir(path) else glob.glob(path))
        self.paths = [p for p in paths if re.search(options.get("pattern", ""), os.path.basename(p))]
        self.rows = int(options.get("rows", 1_000_000))
        self.drop = options.get("drop_withheld", "false").lower() == "true"
        self.classes: list[tuple[str, int]] = []

    def pushFilters(self, filters):
        from pyspark.sql.datasource import EqualTo, Not

        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("classification",):
                self.classes.append(("=", f.value))
            elif isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("classification",):
                self.classes.append(("!", f.child.value))
            else:
                yield f

    def partitions(self):
        found = [(p, read_header(p)["points"]) for p in self.paths]
        return [_Range(p, a, min(n, a + self.rows)) for p, n in found for a in range(0, n, self.rows)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            header = read_header(part.path)
            for low in range(part.low, part.high, 100_000):
                yield read_records(part.path, header, low, min(part.high, low + 100_000), self.columns, self.drop, tuple(self.classes))


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, tree: np.ndarray, cls: np.ndarray, kind: int = 3, scale: float = 0.001) -> bytes:
    """A whole LAS file. Coordinates are stored as whole multiples of scale above their minimum."""
    n, size, version = len(x), *((227, 2) if kind < 6 else (375, 4))
    low = [float(v.min()) if n else 0.0 for v in (x, y, z)]
    high = [float(v.max()) if n else 0.0 for v in (x, y, z)]
    length = RECORD_BYTES[kind] + 4
    blank = b"\0" * 24
    extra = _EXTRA.pack(b"\0\0", 5, 0, b"treeID", b"\0" * 4, blank, blank, blank, blank, blank, b"tree number")
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(extra), b"extra dimensions") + extra
    bounds = [v for pair in zip(high, low, strict=True) for v in pair]
    head = _HEADER.pack(b"LASF", 0, 0, 0, 0, 0, b"\0" * 8, 1, version, b"arborel", b"arborel", 1, 2024, size, size + len(vlr), 1, kind, length, n if kind < 6 else 0, n if kind < 6 else 0, 0, 0, 0, 0, scale, scale, scale, *low, *bounds)
    if kind >= 6:
        head += struct.pack("<QQIQ15Q", 0, 0, 0, n, n, *[0] * 14)
    raw = np.zeros((n, length), np.uint8)
    for i, v in enumerate((x, y, z)):
        raw[:, 4 * i : 4 * i + 4] = np.round((v - low[i]) / scale).astype("<i4").reshape(-1, 1).view(np.uint8)
    raw[:, 14] = 0x09 if kind < 6 else 0x11
    raw[:, 16 if kind >= 6 else 15] = cls.astype(np.uint8)
    raw[:, -4:] = tree.astype("<u4").reshape(-1, 1).view(np.uint8)
    return head + vlr + raw.tobytes()


class LasWriter(DataSourceArrowWriter):
    """Files are written under another name and renamed when the job commits, so failed tasks leave none."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.scale, self.overwrite = options["path"], int(options.get("pointformat", options.get("format", 3))), float(options.get("scale", 0.001)), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        whole = [b for b in batches if b.num_rows]
        message = WriterCommitMessage()
        message.file = None
        if whole:
            t = pa.Table.from_batches(whole)
            number = lambda c, fill: t[c].fill_null(fill).to_numpy() if c in t.column_names else np.full(len(t), fill)
            os.makedirs(self.path, exist_ok=True)
            message.file = os.path.join(self.path, f".{uuid.uuid4().hex}")
            with open(message.file, "wb") as f:
                f.write(las_bytes(*(t[c].to_numpy() for c in "xyz"), number("treeID", 0), number("classification", 0), self.kind, self.scale))
        return message

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.las")):
                os.remove(old)
        first = len(glob.glob(os.path.join(self.path, "*.las")))
        for i, m in enumerate(m for m in messages if m is not None and m.file):
            os.replace(m.file, os.path.join(self.path, f"part-{first + i:05d}.las"))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.file and os.path.exists(m.file):
                os.remove(m.file)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        fields = dict(f.split() for f in SCHEMA.split(", "))
        return ", ".join(f"{c} {fields[c]}" for c in (wanted.split(",") if wanted else fields))

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
