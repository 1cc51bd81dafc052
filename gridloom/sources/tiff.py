"""TIFF rasters with georeference: a reader for files that Spark lists, and a tile-wise writer.

Reading: strips and tiles, 8 to 64 bits, none, LZW and deflate compression, either byte order,
classic and BigTIFF, chunky and planar bands. Directories and single tiles are read in parts where
the store allows it; else files come through Spark's binary source, so any
store that Spark reads will do. MrSID files are listed but can't be decoded here.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: sizes of its field types, and its tags.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIES, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_TEXT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 34736, 34737, 42113
EXTENSIONS = "*.{tif,tiff,sid}"
HEADER = "path string, width int, height int, n_bands int, dtype string, gt array<double>, wkt string, nodata array<double>"


def lzw_decode(data: bytes) -> bytes:
    """Bytes of an LZW strip: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    table: list[bytes] = []
    out, width, held, bits, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = (held >> bits) & ((1 << width) - 1)
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            if last:
                table.append(last + word[:1])
            out.append(word)
            last = word
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """An LZW strip that lzw_decode, and any reader of the format, gives back."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    table, after, width = {bytes([i]): i for i in range(256)}, 258, 9
    put(256, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = after
        after += 1
        word = data[i : i + 1]
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
        if after == 4095:
            put(256, width)
            table, after, width = {bytes([i]): i for i in range(256)}, 258, 9
    if word:
        put(table[word], width)
        after += 1
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


class Ranges:
    """Bytes of a file by place and length: of bytes in memory, or of an open file, of which only what is asked for is read."""

    def __init__(self, source):
        self.source, self.whole = source, isinstance(source, (bytes, bytearray, memoryview))

    def __call__(self, at: int, size: int) -> bytes:
        if self.whole:
            return bytes(self.source[at : at + size])
        self.source.seek(at)
        return self.source.read(size)


class Tiff:
    """The first image of a file, of its bytes or opened. Its directory is read by itself; tiles are decoded one by one."""

    def __init__(self, source):
        read = self.read = Ranges(source)
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError("not a TIFF file")
        self.order = order
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        n = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
        long = 20 if big else 12
        entries, self.tags = read(at + (8 if big else 2), n * long), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, k * long)
            slot = k * long + (12 if big else 8)
            size = TYPE_SIZES.get(kind, 1) * count
            raw = read(struct.unpack_from(order + ("Q" if big else "I"), entries, slot)[0], size) if size > (8 if big else 4) else entries[slot : slot + size]
            self.tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{order}{count}{TYPE_CODES[kind]}", raw) if kind in TYPE_CODES else raw
        one = lambda tag, default: (self.tags.get(tag) or (default,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.planar, self.compression, self.predictor = one(PLANAR, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        self.dtype = np.dtype(f"{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS, 8) // 8}")

    def header(self) -> tuple[int, int, int, str, list[float], str, list[float] | None]:
        gt = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
        elif SCALE in self.tags and TIES in self.tags:
            (sx, sy, _), tie = self.tags[SCALE][:3], self.tags[TIES]
            gt = [tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy]
        nodata = self.tags.get(NODATA)
        return self.width, self.height, self.bands, self.dtype.name, [float(x) for x in gt], self.tags.get(GEO_TEXT, ""), [float(nodata)] * self.bands if nodata else None

    def tiles(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """Of every stored tile or strip: plane (-1: all bands), first row, first column, rows and columns inside the image, place and size in the file."""
        tiled = TILES in self.tags
        th, tw = (self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]) if tiled else (min((self.tags.get(STRIP_ROWS) or (self.height,))[0], self.height), self.width)
        starts, sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        across, down, out = -(-self.width // tw), -(-self.height // th), []
        for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
            plane, cell = divmod(k, across * down) if self.planar == 2 else (-1, k)
            y, x = cell // across * th, cell % across * tw
            out.append((plane, y, x, min(th, self.height - y), min(tw, self.width - x), at, size))
        return out

    def decode(self, tile: tuple[int, int, int, int, int, int, int]) -> np.ndarray:
        """(bands of the tile, rows, columns) of one of tiles()."""
        plane, y, _, h, w, at, size = tile
        tiled, depth = TILES in self.tags, 1 if plane >= 0 else self.bands
        rows, tw = (self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]) if tiled else (h, self.width)
        raw = {1: lambda b: b, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}[self.compression](self.read(at, size))
        block = np.frombuffer(raw[: rows * tw * depth * self.dtype.itemsize], self.dtype.newbyteorder(self.order)).reshape(rows, tw, depth).astype(self.dtype)
        if self.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=self.dtype)
        return block[:h, :w].transpose(2, 0, 1)

    def array(self) -> np.ndarray:
        """(bands, height, width)."""
        out = np.zeros((self.bands, self.height, self.width), self.dtype)
        for tile in self.tiles():
            plane, y, x, h, w, _, _ = tile
            out[slice(plane, plane + 1) if plane >= 0 else slice(None), y : y + h, x : x + w] = self.decode(tile)
        return out


@contextmanager
def opened(path: str):
    """A file of any store that Arrow's file systems reach, open for reading parts of it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])
    with store.open_input_file(name) as file:
        yield file


def reads_ranges(path: str) -> bool:
    """Whether opened() can read such a path; other stores are read through Spark, whole files at a time."""
    return path.split(":", 1)[0] in ("file", "hdfs", "s3", "s3a", "gs") if ":" in path else True


def list_rasters(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of raster files below root, sorted by path; an error where there are none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).load(root).select("path", "modificationTime", "length")
    if found.isEmpty():
        raise ValueError(f"no raster files below {root}")
    return found.orderBy("path")


def _files(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tif,tiff}").load(root).select(*columns)


def _content(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root, "path", "content")


def _read(spark: SparkSession, root: str) -> DataFrame:
    """path of files to be read in parts, or path and content where their store can't be."""
    return _files(spark, root, "path") if reads_ranges(root) else _content(spark, root)


@contextmanager
def _image(path: str, content):
    if content is not None:
        yield Tiff(content)
    else:
        with opened(path) as file:
            yield Tiff(file)


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue of rasters below root. Of a file only its directory is read, where the store allows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for path, content in zip(pdf["path"], pdf.get("content", [None] * len(pdf)), strict=True):
                with _image(path, content) as image:
                    made.append((path, *image.header()))
            yield pd.DataFrame(made, columns=[c.split()[0] for c in HEADER.split(", ")])

    return _read(spark, root).mapInPandas(rows, HEADER)


TILE = "path string, plane int, y int, x int, h int, w int, at long, size long"


def tile_index(spark: SparkSession, root: str) -> DataFrame:
    """A row a stored tile or strip of the rasters below root: its plane (-1: all bands), place in the image, and place in the file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf.get("content", [None] * len(pdf)), strict=True):
                with _image(path, content) as image:
                    yield pd.DataFrame([(path, *t) for t in image.tiles()], columns=[c.split()[0] for c in TILE.split(", ")])

    return _read(spark, root).mapInPandas(rows, TILE)


def read_window(spark: SparkSession, root: str, bands: list[int] | None = None, y0: int = 0, x0: int = 0, height: int | None = None, width: int | None = None, tasks: int | None = None) -> DataFrame:
    """path, c (from 1), y, x, v: pixels of a window of the rasters below root, in the coordinates of the raster.

    The tiles that meet the window, in the bands asked for, are found in the directories; only these
    are read and decoded, a tile at a time, by as many tasks as Spark has for an exchange.
    """
    y1, x1 = 1 << 31 if height is None else y0 + height, 1 << 31 if width is None else x0 + width
    wanted = tile_index(spark, root).where((F.col("y") < y1) & (F.col("y") + F.col("h") > y0) & (F.col("x") < x1) & (F.col("x") + F.col("w") > x0))
    if bands is not None:
        wanted = wanted.where((F.col("plane") < 0) | (F.col("plane") + 1).isin(*bands))
    if not reads_ranges(root):  # whole files come through Spark: their pixels are cut to the window
        rows = block_pixels(read_blocks(spark, root)).where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
        return rows.where(F.col("c").isin(*bands)) if bands is not None else rows

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=False):
                with opened(path) as file:
                    image = Tiff(file)
                    for t in own.itertuples(index=False):
                        block = image.decode((t.plane, t.y, t.x, t.h, t.w, t.at, t.size))
                        ya, yb, xa, xb = max(y0, t.y) - t.y, min(y1, t.y + t.h) - t.y, max(x0, t.x) - t.x, min(x1, t.x + t.w) - t.x
                        y, x = (v.ravel().astype(np.int32) for v in np.mgrid[t.y + ya : t.y + yb, t.x + xa : t.x + xb])
                        for k, band in enumerate(block[:, ya:yb, xa:xb]):
                            c = (t.plane if t.plane >= 0 else k) + 1
                            if bands is None or c in bands:
                                yield pd.DataFrame({"path": path, "c": np.int32(c), "y": y, "x": x, "v": band.ravel().astype(np.float64)})

    return wanted.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "plane", "y", "x").mapInPandas(pixels, "path string, c int, y int, x int, v double")


def read_blocks(spark: SparkSession, root: str, block: int = 256) -> DataFrame:
    """path, c (from 1), by, bx, h, w, data: bands cut into blocks of 32-bit floats, row by row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image = Tiff(content).array()
                for c, band in enumerate(image, 1):
                    made = []
                    for y in range(0, band.shape[0], block):
                        for x in range(0, band.shape[1], block):
                            part = band[y : y + block, x : x + block].astype("<f4")
                            made.append((path, c, y // block, x // block, *part.shape, part.tobytes()))
                    yield pd.DataFrame(made, columns=["path", "c", "by", "bx", "h", "w", "data"])

    return _content(spark, root).mapInPandas(rows, "path string, c int, by int, bx int, h int, w int, data binary")


def block_pixels(blocks: DataFrame, block: int = 256) -> DataFrame:
    """blocks as pixels: (..., c, y, x, v). Filters on by and bx reach the scan of stored blocks."""
    keys = [c for c in blocks.columns if c not in ("by", "bx", "h", "w", "data")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(r.data, "<f4").astype(np.float64)
                at = np.arange(len(v))
                yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, "y": (r.by * block + at // r.w).astype(np.int32), "x": (r.bx * block + at % r.w).astype(np.int32), "v": v})

    schema = ", ".join(f"{c} {t}" for c, t in blocks.dtypes if c in keys)
    return blocks.mapInPandas(rows, f"{schema}, y int, x int, v double")


def to_tiles(pixels: DataFrame, size: int = 256, compression: str = "lzw", height: int | None = None, width: int | None = None) -> DataFrame:
    """ty, tx, data: 8-bit tiles (bands interleaved) of pixels (c, y, x, v in 0..255), each compressed where it is made."""
    bands = sorted(r[0] for r in pixels.select("c").distinct().collect())
    place = {c: i for i, c in enumerate(bands)}
    pack = {"lzw": lzw_encode, "deflate": zlib.compress, "none": bytes}[compression]

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((size, size, len(bands)), np.uint8)
        block[pdf["y"] % size, pdf["x"] % size, pdf["c"].map(place)] = pdf["v"].clip(0, 255).round().astype(np.uint8)
        return pd.DataFrame([(*key, pack(block.tobytes()))], columns=["ty", "tx", "data"])

    return pixels.withColumns({"ty": F.expr(f"cast(y div {size} as int)"), "tx": F.expr(f"cast(x div {size} as int)")}).groupBy("ty", "tx").applyInPandas(tile, "ty int, tx int, data binary")


def write_tiff(tiles: DataFrame, out, height: int, width: int, bands: int, gt: list[float], wkt: str = "", size: int = 256, compression: str = "lzw", nodata: float | None = None) -> None:
    """Joins compressed tiles into one BigTIFF, one tile in memory at a time; `out` is a path or a binary file object."""
    across, down = -(-width // size), -(-height // size)
    file = open(out, "wb") if isinstance(out, str) else out
    try:
        file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        starts, sizes = [0] * (across * down), [0] * (across * down)
        for row in tiles.orderBy("ty", "tx").toLocalIterator():
            k = row.ty * across + row.tx
            starts[k], sizes[k] = file.tell(), len(row.data)
            file.write(bytes(row.data))
        blank = {"lzw": lzw_encode, "deflate": zlib.compress, "none": bytes}[compression](bytes(size * size * bands))
        for k, n in enumerate(sizes):
            if not n:
                starts[k], sizes[k] = file.tell(), len(blank)
                file.write(blank)
        code = {"lzw": 5, "deflate": 8, "none": 1}[compression]
        tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8] * bands), (COMPRESSION, "H", [code]), (PHOTOMETRIC, "H", [2 if bands == 3 else 1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [1]), (TILE_WIDTH, "I", [size]), (TILE_HEIGHT, "I", [size]), (TILES, "Q", starts), (TILE_BYTES, "Q", sizes), (FORMAT, "H", [1] * bands)]
        tags.append((TRANSFORM, "d", [gt[1], gt[2], 0.0, gt[0], gt[4], gt[5], 0.0, gt[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
        text = [(GEO_TEXT, wkt)] if wkt else []
        text += [(NODATA, f"{nodata:g}")] if nodata is not None else []
        kinds = {"H": 3, "I": 4, "Q": 16, "d": 12}
        entries = [(t, kinds[k], len(v), struct.pack(f"<{len(v)}{k}", *v)) for t, k, v in tags] + [(t, 2, len(s.encode("latin-1", "replace")) + 1, s.encode("latin-1", "replace") + b"\0") for t, s in text]
        body, made = io.BytesIO(), []
        at = file.tell()
        for tag, kind, n, raw in sorted(entries):
            if len(raw) > 8:
                made.append(struct.pack("<HHQQ", tag, kind, n, at + body.tell()))
                body.write(raw + b"\0" * (-len(raw) % 8))
            else:
                made.append(struct.pack("<HHQ", tag, kind, n) + raw.ljust(8, b"\0"))
        file.write(body.getvalue())
        directory = file.tell()
        file.write(struct.pack("<Q", len(made)) + b"".join(made) + struct.pack("<Q", 0))
        file.seek(8)
        file.write(struct.pack("<Q", directory))
    finally:
        if isinstance(out, str):
            file.close()


def write_png(pixels: DataFrame, out: str, height: int, width: int) -> None:
    """A preview (already decimated to a bounded size) as PNG; one band is grey, three are colours."""
    rows = pixels.select("c", "y", "x", "v").toPandas()
    bands = sorted(rows["c"].unique())[:3]
    bands = bands if len(bands) == 3 else bands[:1]
    image = np.zeros((height, width, len(bands)), np.uint8)
    for i, c in enumerate(bands):
        own = rows[rows["c"] == c]
        image[own["y"], own["x"], i] = own["v"].clip(0, 255).round().astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + line.tobytes() for line in image)
    with open(out, "wb") as file:
        file.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if len(bands) == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))


def png_pixels(content: bytes) -> list[tuple[int, int, int, int]]:
    """(c, y, x, v) of a PNG of eight bits without filters, such as write_png makes."""
    at, body, head = 8, b"", (0, 0, 0)
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, bits, colour, *rest = struct.unpack(">IIBBBBB", data)
            if bits != 8 or colour not in (0, 2) or any(rest):
                raise ValueError("not a plain eight-bit image")
            head = width, height, 3 if colour == 2 else 1
        body += data if kind == b"IDAT" else b""
        at += 12 + size
    width, height, bands = head
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * bands)
    if lines[:, 0].any():
        raise ValueError("filtered lines can't be read here")
    image = lines[:, 1:].reshape(height, width, bands)
    return [(c + 1, y, x, int(image[y, x, c])) for y in range(height) for x in range(width) for c in range(bands)]
