"""Rasters of TIFF files: tiles or strips, plain or deflated, with the place of pixels from the GeoTIFF tags.

A file's list of tiles is read first; tiles then meet what is asked of them as rows, and only those that are asked for are decoded,
each by itself.  Files come through Spark's binary file source, at most 2 GB each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions import geo

#: Bytes and struct letters of the fields' types; fixed values of the format.
_FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "2I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
#: Tags that are read; fixed values of the format.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT, _SCALE, _TIE, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


class Tiff:
    """The first image of a file."""

    def __init__(self, data: bytes):
        self.order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
        if self.order is None:
            raise ValueError("not a TIFF file of 32-bit offsets")
        self.data, self.tags = data, {}
        (at,) = struct.unpack_from(f"{self.order}I", data, 4)
        (n,) = struct.unpack_from(f"{self.order}H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{self.order}HHI", data, at + 2 + 12 * k)
            if kind not in _FIELDS:
                continue
            size, letter = _FIELDS[kind]
            place = at + 10 + 12 * k
            if size * count > 4:
                (place,) = struct.unpack_from(f"{self.order}I", data, place)
            self.tags[tag] = struct.unpack_from(f"{self.order}{count}{letter}" if len(letter) == 1 else f"{self.order}{2 * count}I", data, place)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.samples = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
        self.compression, self.predictor = one(_COMPRESSION, 1), one(_PREDICTOR, 1)
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 2) or (self.samples > 1 and one(_PLANAR, 1) != 1):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not read here")
        self.kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
        tiled = _TILES in self.tags
        self.tile_width, self.tile_height = (one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0)) if tiled else (self.width, min(one(_STRIP_ROWS, self.height), self.height))
        self.offsets, self.sizes = (self.tags[_TILES], self.tags[_TILE_BYTES]) if tiled else (self.tags[_STRIPS], self.tags[_STRIP_BYTES])
        self.across = -(-self.width // self.tile_width)
        scale, tie = self.tags.get(_SCALE, (1.0, 1.0, 0.0)), self.tags.get(_TIE, (0.0,) * 6)
        self.step = scale[:2]
        self.west, self.north = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        mark = one(_NODATA, b"").decode().strip("\0 ") if _NODATA in self.tags else ""
        self.nodata = float(mark) if mark else None

    def tile(self, number: int) -> np.ndarray:
        """Values of a tile (row, column, band) as doubles, NaN where there are none; edges beyond the image are cut."""
        raw = self.data[self.offsets[number] : self.offsets[number] + self.sizes[number]]
        raw = raw if self.compression == 1 else zlib.decompress(raw)
        top, left = number // self.across * self.tile_height, number % self.across * self.tile_width
        rows = min(self.tile_height, self.height - top)
        values = np.frombuffer(raw, self.kind, len(raw) // self.kind.itemsize).reshape(-1, self.tile_width, self.samples)[:rows, : self.width - left]
        if self.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=self.kind.newbyteorder("="))
        found = values.astype(np.float64)
        return found if self.nodata is None else np.where(found == self.nodata, np.nan, found)

    def box(self, number: int) -> tuple[float, float, float, float]:
        """West, south, east and north of a tile."""
        top, left = number // self.across * self.tile_height, number % self.across * self.tile_width
        right, bottom = min(left + self.tile_width, self.width), min(top + self.tile_height, self.height)
        return self.west + left * self.step[0], self.north - bottom * self.step[1], self.west + right * self.step[0], self.north - top * self.step[1]


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """path, tile and its box (minx, miny, maxx, maxy) of all tiles of TIFF files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = Tiff(content.as_py())
                boxes = np.array([file.box(k) for k in range(len(file.offsets))]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(boxes)), pa.array(range(len(boxes)), pa.int32()), *[pa.array(boxes[:, k].copy()) for k in range(4)]], ["path", "tile", "minx", "miny", "maxx", "maxy"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, "path string, tile int, minx double, miny double, maxx double, maxy double")


def read_tiff(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """path, x and y (centres of pixels), band (from 1) and value of the pixels of TIFF files, or of their tiles `wanted` (path, tile)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if wanted is not None:
        files = files.join(wanted.groupBy("path").agg(F.collect_set("tile").alias("tiles")), "path")
    else:
        files = files.withColumn("tiles", F.lit(None).cast("array<int>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, numbers in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("tiles").to_pylist()):
                file = Tiff(content.as_py())
                for number in range(len(file.offsets)) if numbers is None else sorted(numbers):
                    values = file.tile(number)
                    west, _, _, north = file.box(number)
                    row, col, band = np.indices(values.shape).reshape(3, -1)
                    x, y = west + (col + 0.5) * file.step[0], north - (row + 0.5) * file.step[1]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(x), pa.array(y), pa.array((band + 1).astype(np.int32)), pa.array(values.ravel(), from_pandas=True)], ["path", "x", "y", "band", "value"])

    return files.mapInArrow(work, "path string, x double, y double, band int, value double")


def at_points(spark: SparkSession, path: str, points: DataFrame, id_col: str, size: float) -> DataFrame:
    """id, path, band and value of the pixels that points (x, y) fall in; only tiles with a point are decoded.

    size is the side of the grid cells in which points meet tiles, near that of a tile.
    """
    from loamframe.operators.spatial import covering_cells

    boxes = tiles(spark, path).withColumn("_ring", geo.box_ring("minx", "miny", "maxx", "maxy"))
    cells = covering_cells(boxes, "_ring", size).drop("_ring")
    at = points.select(F.col(id_col).alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn("_cx", F.floor(F.col("_x") / size)).withColumn("_cy", F.floor(F.col("_y") / size))
    inside = (F.col("_x") >= F.col("minx")) & (F.col("_x") < F.col("maxx")) & (F.col("_y") > F.col("miny")) & (F.col("_y") <= F.col("maxy"))
    met = at.join(cells, ["_cx", "_cy"]).where(inside).select("_id", "_x", "_y", "path", "tile")
    sides = tiles(spark, path).groupBy("path").agg(F.min("minx").alias("_west"), F.max("maxy").alias("_north"))
    pixels = read_tiff(spark, path, met.select("path", "tile").distinct())
    steps = pixel_sizes(spark, path)
    number = lambda c, start, step, sign: F.floor(sign * (F.col(c) - F.col(start)) / F.col(step)).cast("long")
    grid = sides.join(steps, "path")
    asked = met.join(grid, "path").select("_id", "path", number("_x", "_west", "_dx", 1).alias("_i"), number("_y", "_north", "_dy", -1).alias("_j"))
    found = pixels.join(grid, "path").select("path", "band", "value", number("x", "_west", "_dx", 1).alias("_i"), number("y", "_north", "_dy", -1).alias("_j"))
    return asked.join(found, ["path", "_i", "_j"]).select(F.col("_id").alias(id_col), "path", "band", "value")


def pixel_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and the width and height of a pixel (_dx, _dy) of each file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [Tiff(c.as_py()).step for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([float(s[0]) for s in steps]), pa.array([float(s[1]) for s in steps])], ["path", "_dx", "_dy"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, _dx double, _dy double")


def encoded_tiff(values: np.ndarray, west: float, north: float, step: float, tile: int = 64, nodata: float | None = None) -> bytes:
    """A tiled, deflated file of values (row, column, band), north up; tile is a multiple of 16."""
    height, width, samples = values.shape
    kind = values.dtype.newbyteorder("<")
    down, across = -(-height // tile), -(-width // tile)
    padded = np.zeros((down * tile, across * tile, samples), dtype=kind)
    padded[:height, :width] = values
    parts = [zlib.compress(padded[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile].tobytes()) for r in range(down) for c in range(across)]
    offsets = (8 + np.cumsum([0, *map(len, parts)])[:-1]).tolist()
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields = [
        (_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, [kind.itemsize * 8] * samples), (_COMPRESSION, 3, [8]), (_SAMPLES, 3, [samples]), (_PLANAR, 3, [1]), (_TILE_WIDTH, 3, [tile]), (_TILE_HEIGHT, 3, [tile]),
        (_TILES, 4, offsets), (_TILE_BYTES, 4, [len(p) for p in parts]), (_FORMAT, 3, [form] * samples), (_SCALE, 12, [step, step, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, west, north, 0.0]),
    ]
    if nodata is not None:
        fields.append((_NODATA, 2, [f"{nodata:g}".encode() + b"\0"]))
    body = b"".join(parts)
    body += b"\0" * (len(body) % 2)
    start = 8 + len(body)
    more, entries = b"", b""
    for tag, code, held in fields:
        letter = _FIELDS[code][1]
        raw, count = (held[0], len(held[0])) if letter == "s" else (struct.pack(f"<{len(held)}{letter}", *held), len(held))
        if len(raw) > 4:
            place = start + 2 + 12 * len(fields) + 4 + len(more)
            more += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        entries += struct.pack("<HHI", tag, code, count) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", start) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + more
