"""GeoTIFF files as a Spark data source: ``spark.read.format("geotiff")`` gives pixels, one partition per strip or tile run.

Reads classic and Big TIFF, striped or tiled, uncompressed, deflate or LZW, with and without the horizontal predictor; writes
striped deflate files. Pure Python and numpy. Files are opened by path on the executors, so they must lie where these see them.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tesserae.sources.raster import RasterMeta

# Fixed values of the format: field types and their sizes, and the tags that are used.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEOKEYS, NODATA = 33550, 33922, 34735, 42113
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def read_tags(f) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags of the first image)."""
    f.seek(0)
    head = f.read(16)
    order = "<" if head[:2] == b"II" else ">"
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    f.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    entry, room = (20, 8) if big else (12, 4)
    raw, tags = f.read(n * entry), {}
    for i in range(n):
        e = raw[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4 : 4 + room])[0]
        size, value = SIZES.get(kind, 1) * count, e[4 + room :]
        if size > room:
            f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
            value = f.read(size)
        value = value[:size]
        tags[tag] = (value.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{CODES[kind]}", value) if kind in CODES else (value,)
    return order, tags


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from 9 to 12 bits, most significant bit first, 256 clears and 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    buffer = bits = 0
    for byte in data:
        buffer, bits = (buffer << 8) | byte, bits + 8
        while bits >= width:
            code = (buffer >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            buffer &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last:
                table.append(last + word[:1])
            last = word
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


@dataclass(frozen=True)
class Layout:
    """What a block of a file needs to be decoded, and where it lies on the grid."""

    order: str
    dtype: str
    samples: int
    compression: int
    predictor: int
    width: int
    height: int
    block_width: int
    block_height: int
    across: int
    offsets: tuple[int, ...]
    lengths: tuple[int, ...]
    planar: bool
    nodata: float | None


def layout(f) -> tuple[Layout, RasterMeta]:
    order, t = read_tags(f)
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    tiled = TILES in t
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    nodata = float(one(NODATA)) if NODATA in t and one(NODATA) not in ("", None) else None
    dtype = KINDS[one(SAMPLE_FORMAT, 1), one(BITS, 8)]
    lay = Layout(
        order, dtype, samples, one(COMPRESSION, 1), one(PREDICTOR, 1), width, height, bw, bh, -(-width // bw), tuple(t[TILES if tiled else STRIPS]),
        tuple(t[TILE_BYTES if tiled else STRIP_BYTES]), one(PLANAR, 1) == 2, nodata,
    )
    scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6)
    keys = t.get(GEOKEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    epsg = codes.get(3072) or codes.get(2048)
    meta = RasterMeta(width, height, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], f"EPSG:{epsg}" if epsg else "", nodata, dtype)
    return lay, meta


def decode_block(f, lay: Layout, block: int) -> np.ndarray:
    """(rows, columns, samples) of one strip or tile, cut to the grid by the caller."""
    f.seek(lay.offsets[block])
    raw = f.read(lay.lengths[block])
    if lay.compression == 5:
        raw = unpack_lzw(raw)
    elif lay.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif lay.compression != 1:
        raise ValueError(f"compression {lay.compression} is not supported")
    per = 1 if lay.planar else lay.samples
    kind = np.dtype(lay.order + lay.dtype)
    data = np.frombuffer(raw, dtype=kind)
    data = data[: len(data) // (lay.block_width * per) * lay.block_width * per].reshape(-1, lay.block_width, per)
    if lay.predictor == 2:
        data = np.cumsum(data, axis=1, dtype=kind)
    elif lay.predictor != 1:
        raise ValueError(f"predictor {lay.predictor} is not supported")
    return data


class GeoTiffPart(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.blocks = int(options.get("blocks", 16))
        self.bands = int(options.get("bands", 1))

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            lay, _ = layout(f)
        n = len(lay.offsets) // (lay.samples if lay.planar else 1)
        return [GeoTiffPart(self.path, i, min(n, i + self.blocks)) for i in range(0, n, self.blocks)]

    def read(self, part: GeoTiffPart) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            lay, _ = layout(f)
            plane = len(lay.offsets) // (lay.samples if lay.planar else 1)
            for b in range(part.first, part.last):
                if lay.planar:
                    data = np.concatenate([decode_block(f, lay, b + s * plane) for s in range(self.bands)], axis=2)
                else:
                    data = decode_block(f, lay, b)
                y0, x0 = (b // lay.across) * lay.block_height, (b % lay.across) * lay.block_width
                data = data[: lay.height - y0, : lay.width - x0]
                h, w, _ = data.shape
                y, x = np.repeat(np.arange(y0, y0 + h, dtype=np.int32), w), np.tile(np.arange(x0, x0 + w, dtype=np.int32), h)
                columns, names = [pa.array(y), pa.array(x)], ["y", "x"]
                for k in range(self.bands):
                    v = data[:, :, k].ravel().astype(np.float64)
                    columns.append(pa.array(v, mask=(v == lay.nodata) if lay.nodata is not None else None))
                    names.append("v" if self.bands == 1 else f"b{k + 1}")
                yield pa.RecordBatch.from_arrays(columns, names=names)


class GeoTiffSource(DataSource):
    """Options: path, bands (default 1), blocks (strips or tiles per partition, default 16). Values are doubles, nodata is null."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        bands = int(self.options.get("bands", 1))
        return "y int, x int, " + ("v double" if bands == 1 else ", ".join(f"b{k + 1} double" for k in range(bands)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoTiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)


def read_meta(path: str) -> RasterMeta:
    with open(path.removeprefix("file://"), "rb") as f:
        return layout(f)[1]


def encode(grid: np.ndarray, meta: RasterMeta, rows_per_strip: int = 64) -> bytes:
    """A one-band striped deflate GeoTIFF with the horizontal predictor for integers."""
    grid = np.ascontiguousarray(grid)
    kind = grid.dtype.newbyteorder("<")
    whole = grid.dtype.kind in "iu"
    strips = []
    for y in range(0, grid.shape[0], rows_per_strip):
        part = grid[y : y + rows_per_strip].astype(kind)
        if whole:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1).astype(kind)
        strips.append(zlib.compress(part.tobytes()))
    epsg = int(meta.crs.split(":")[1]) if ":" in meta.crs else 0
    fmt = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    geographic = epsg == 4326
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg)
    entries: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (grid.shape[1],)), HEIGHT: (4, (grid.shape[0],)), BITS: (3, (grid.dtype.itemsize * 8,)), COMPRESSION: (3, (8,)), 262: (3, (1,)), STRIPS: (4, (0,) * len(strips)),
        SAMPLES: (3, (1,)), ROWS_PER_STRIP: (4, (rows_per_strip,)), STRIP_BYTES: (4, tuple(map(len, strips))), PLANAR: (3, (1,)), PREDICTOR: (3, (2 if whole else 1,)),
        SAMPLE_FORMAT: (3, (fmt,)), SCALE: (12, (meta.xres, meta.yres, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, meta.xmin, meta.ymax, 0.0)), GEOKEYS: (3, keys),
    }
    if meta.nodata is not None:
        entries[NODATA] = (2, f"{meta.nodata:g}".encode() + b"\0")
    pack = lambda kind, v: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{CODES[kind]}", *v)
    data_at = 8 + 2 + 12 * len(entries) + 4
    extra = {t: pack(k, v) for t, (k, v) in entries.items() if len(pack(k, v)) > 4}
    strips_at = data_at + sum(len(b) + len(b) % 2 for b in extra.values())
    places, at = [], strips_at
    for s in strips:
        places.append(at)
        at += len(s)
    entries[STRIPS] = (4, tuple(places))
    out = io.BytesIO()
    out.write(b"II*\0" + struct.pack("<IH", 8, len(entries)))
    tail, at = b"", data_at
    for tag in sorted(entries):
        kind, v = entries[tag]
        raw = pack(kind, v)
        out.write(struct.pack("<HHI", tag, kind, len(v)))
        if len(raw) > 4:
            out.write(struct.pack("<I", at))
            tail += raw + b"\0" * (len(raw) % 2)
            at += len(raw) + len(raw) % 2
        else:
            out.write(raw.ljust(4, b"\0"))
    out.write(struct.pack("<I", 0) + tail + b"".join(strips))
    return out.getvalue()
