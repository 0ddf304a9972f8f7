"""TIFF rasters."""

import struct

import numpy as np
import pytest

from loamframe.sources import tiff


def test_tiles_and_points(spark, tmp_path):
    values = (np.arange(100 * 130 * 2).reshape(100, 130, 2) % 997).astype(np.int16)
    values[10, 20] = -5
    (tmp_path / "a.tif").write_bytes(tiff.encoded_tiff(values, 1000.0, 5000.0, 10.0, tile=32, nodata=-5))
    (tmp_path / "b.tif").write_bytes(tiff.encoded_tiff(values[:, :, :1].astype(np.float32) / 4, 3000.0, 5000.0, 10.0, tile=64))
    boxes = tiff.tiles(spark, str(tmp_path)).collect()
    assert len(boxes) == 4 * 5 + 2 * 3 and max(b.maxx for b in boxes) == 4300.0 and min(b.miny for b in boxes) == 4000.0
    every = {(r.x, r.y, r.band): r.value for r in tiff.read_tiff(spark, str(tmp_path / "a.tif")).collect()}
    assert len(every) == values.size and every[1205.0, 4895.0, 1] is None
    assert all(every[1005.0 + 10 * c, 4995.0 - 10 * r, b + 1] == values[r, c, b] for r in range(0, 100, 7) for c in range(0, 130, 11) for b in (0, 1))
    rows = [(1, 1000.0, 5000.0), (2, 1204.9, 4890.1), (3, 2299.9, 4000.1), (4, 3015.0, 4985.0), (5, 2500.0, 4500.0), (6, None, 4500.0)]
    points = spark.createDataFrame(rows, "p int, x double, y double")
    got = {(r.p, r.band): r.value for r in tiff.at_points(spark, str(tmp_path), points, "p", 320.0).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): None, (2, 2): None, (3, 1): float(values[99, 129, 0]), (3, 2): float(values[99, 129, 1]), (4, 1): values[1, 1, 0] / 4}
    asked = spark.createDataFrame([(next(b.path for b in boxes if b.path.endswith("a.tif")), 6)], "path string, tile int")
    assert tiff.read_tiff(spark, str(tmp_path), asked).count() == 32 * 32 * 2


def test_strips_and_what_is_not_read():
    values = np.arange(6, dtype=">u2").reshape(3, 2)
    fields = [(256, 3, 2), (257, 3, 3), (258, 3, 16), (259, 3, 1), (273, 4, 8), (278, 3, 3), (279, 4, 12)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields)
    data = b"MM\0*" + struct.pack(">I", 20) + values.tobytes() + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0"
    file = tiff.Tiff(data)
    assert np.array_equal(file.tile(0)[:, :, 0], values) and file.box(0) == (0.0, -3.0, 2.0, 0.0)
    with pytest.raises(ValueError, match="compression 5"):
        tiff.Tiff(data.replace(struct.pack(">HHIHH", 259, 3, 1, 1, 0), struct.pack(">HHIHH", 259, 3, 1, 5, 0)))
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.Tiff(b"%PDF-1.4 and more")
