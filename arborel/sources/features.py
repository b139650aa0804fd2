"""Point features and logs: shapefiles of points, CSV with a header, tiled Parquet."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shapefile_points(data: bytes) -> np.ndarray:
    """x, y of the points of a shapefile (types Point, PointZ and PointM); null shapes fall out."""
    if struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("no shapefile")
    at, out = 100, []
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in (1, 11, 21):
            out.append(struct.unpack_from("<2d", data, at + 12))
        elif kind:
            raise ValueError(f"shape type {kind} isn't a point")
        at += 8 + size
    return np.array(out).reshape(-1, 2)


def point_shapefile(xy: np.ndarray) -> bytes:
    """A shapefile of points."""
    body = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<i2d", 1, *p) for i, p in enumerate(xy))
    box = (*xy.min(axis=0), *xy.max(axis=0)) if len(xy) else (0.0,) * 4
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 1, *box, 0, 0, 0, 0) + body


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """file, tile (the last number in the file's name), gt_id (from 1 in the file's order), x, y of all point shapefiles under path."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            parts = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                xy = shapefile_points(bytes(content))
                parts.append(pd.DataFrame({"file": path_, "gt_id": np.arange(1, len(xy) + 1), "x": xy[:, 0], "y": xy[:, 1]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"file": [], "gt_id": [], "x": [], "y": []})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.shp").load(path)
    found = files.select("path", "content").mapInPandas(run, "file string, gt_id long, x double, y double")
    return found.withColumn("tile", F.regexp_extract("file", r"(\d+)\D*$", 1).try_cast("int"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_tiles(frame: DataFrame, path: str) -> None:
    """A stage's output by tile, which later stages prune by; an earlier output is replaced."""
    frame.repartition("tile_x", "tile_y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)
