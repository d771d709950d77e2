"""Image files in and out.  (S9, F5, K1, K3, K6, K7)

Spark's image source reads JPEG and 8-bit PNG and writes nothing; it takes the low byte of 16-bit samples.  So
PNG files go through a codec of our own on the binaryFile source: every depth, interlaced or not, 16-bit
samples divided by 256, palettes resolved.  Rasters are rows (path, h, w, c, data) with blue, green, red and
alpha bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.sources import jpeg

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def unfiltered(raw: bytes, h: int, line: int, step: int) -> np.ndarray:
    """The scan lines without their filters; `step` bytes make a pixel.

    Lines up to one that averages or guesses go one by one.  From there on pixels are taken along diagonals: those of
    one diagonal need only what the two before it hold, so each is one step over all lines.
    """
    rows = np.frombuffer(raw, np.uint8, h * (line + 1)).reshape(h, line + 1)
    kinds = rows[:, 0]
    if (kinds > 4).any():
        raise ValueError(f"filter {kinds.max()} is unknown")
    out = np.zeros((h + 1, line), np.uint8)
    slow = np.flatnonzero(kinds >= 3)
    first = int(slow[0]) if len(slow) else h
    for y in range(first):
        row, above, here = rows[y, 1:], out[y], out[y + 1]
        if kinds[y] == 0:
            here[:] = row
        elif kinds[y] == 2:
            here[:] = row + above
        else:
            for k in range(step):
                here[k::step] = np.cumsum(row[k::step], dtype=np.uint64).astype(np.uint8)
    if first < h:
        n, w = h - first, line // step
        given = rows[first:, 1:].reshape(n, w, step).astype(np.int16)
        held = np.zeros((n + 1, w + 1, step), np.int16)  # with a pixel of zeros before each line
        held[0, 1:] = out[first].reshape(w, step)
        kind = kinds[first:, None]
        for s in range(n + w - 1):
            y = np.arange(max(0, s - w + 1), min(n, s + 1))
            x = s - y
            left, up, corner, k = held[y + 1, x], held[y, x + 1], held[y, x], kind[y]
            from_left, from_up = np.abs(up - corner), np.abs(left - corner)
            from_corner = np.abs(left + up - 2 * corner)
            nearest = np.where((from_left <= from_up) & (from_left <= from_corner), left, np.where(from_up <= from_corner, up, corner))
            guess = np.where(k == 4, nearest, np.where(k == 3, (left + up) >> 1, np.where(k == 2, up, np.where(k == 1, left, 0))))
            held[y + 1, x + 1] = (given[y, x] + guess) & 255
        out[first + 1 :] = held[1:, 1:].reshape(n, line)
    return out[1:]


#: First column and line, and steps along both, of the passes of an interlaced PNG file.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: bytes, h: int, w: int, c: int, depth: int) -> tuple[np.ndarray, int]:
    """(h, w, c) samples of the scan lines that raw begins with, those of 16 bits by their high byte, and the bytes they took."""
    line = -(-w * c * depth // 8)
    lines = unfiltered(raw, h, line, max(1, c * depth // 8))
    if depth >= 8:
        pixels = lines.reshape(h, w, c, depth // 8)[..., 0]
    else:
        bits = np.unpackbits(lines, axis=1)[:, : w * c * depth].reshape(h, w * c, depth)
        pixels = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(h, w, c)
    return pixels, h * (line + 1)


def _interlaced(raw: bytes, h: int, w: int, c: int, depth: int) -> np.ndarray:
    """The samples of seven passes, each with scan lines of its own; one without a pixel has no bytes."""
    pixels, at = np.zeros((h, w, c), np.uint8), 0
    for x, y, across, down in PASSES:
        rows, columns = -(-(h - y) // down), -(-(w - x) // across)
        if rows > 0 and columns > 0:
            pixels[y::down, x::across], taken = _samples(raw[at:], rows, columns, c, depth)
            at += taken
    return pixels


def decoded(data: bytes) -> np.ndarray:
    """The pixels of a PNG file as 8-bit grey, BGR or BGRA."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG file")
    head, body, palette, clear = b"", [], None, None
    for name, part in chunks(data):
        if name == b"IHDR":
            head = part
        elif name == b"IDAT":
            body.append(part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = part
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if interlace > 1:
        raise ValueError(f"interlacing {interlace} is unknown")
    c, raw = CHANNELS[kind], zlib.decompress(b"".join(body))
    pixels = _interlaced(raw, h, w, c, depth) if interlace else _samples(raw, h, w, c, depth)[0]
    if depth < 8 and kind != 3:
        pixels = (pixels * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if kind == 3:
        if palette is None:
            raise ValueError("a palette is missing")
        index = pixels[..., 0]
        pixels = palette[index]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            pixels = np.dstack([pixels, alpha[index]])
    if pixels.shape[2] == 1:
        return np.ascontiguousarray(pixels[..., 0])
    if pixels.shape[2] == 2:
        pixels = np.dstack([np.repeat(pixels[..., :1], 3, axis=2), pixels[..., 1]])
    return np.ascontiguousarray(np.dstack([pixels[..., 2::-1], pixels[..., 3:]]))


#: TIFF tags, and bytes by field type.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "packing", 262: "kind", 273: "offsets", 277: "samples", 278: "lines", 279: "sizes", 284: "planar", 317: "predictor", 320: "palette"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def _unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count and that many bytes, or a count and one byte that is repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits from the high end, 256 clears, 257 ends; widths grow one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("no clear code")
        if code < len(table):
            here = table[code]
        elif code == len(table) and last:
            here = last + last[:1]
        else:
            raise ValueError("a code is out of range")
        out += here
        if last:
            table.append(last + here[:1])
        last = here
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decoded_tiff(data: bytes) -> np.ndarray:
    """The pixels of a TIFF file's first picture as 8-bit grey, BGR or BGRA: strips of 8 or 16 bits, whole or packed."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (count,) = struct.unpack_from(order + "H", data, at)
    tags: dict[str, tuple[int, ...]] = {"samples": (1,), "packing": (1,), "planar": (1,), "predictor": (1,), "bits": (1,)}
    for k in range(count):
        tag, kind, n, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
        if tag in TAGS and kind in (1, 3, 4):
            here = at + 10 + 12 * k
            if FIELD_BYTES[kind] * n > 4:
                (here,) = struct.unpack_from(order + "I", data, here)
            tags[TAGS[tag]] = struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, here)
    w, h, c, depth = tags["width"][0], tags["height"][0], tags["samples"][0], tags["bits"][0]
    if depth not in (8, 16) or len(set(tags["bits"])) > 1 or tags["planar"][0] != 1 or tags["predictor"][0] not in (1, 2) or "offsets" not in tags:
        raise ValueError("only strips of 8 or 16 bits are read")
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}.get(tags["packing"][0])
    if not unpack:
        raise ValueError(f"packing {tags['packing'][0]} is unknown")
    kind = np.dtype(np.uint8 if depth == 8 else order + "u2")
    lines = min(tags.get("lines", (h,))[0], h)
    pixels = np.zeros((h, w, c), kind)
    for k, (begin, size) in enumerate(zip(tags["offsets"], tags["sizes"], strict=True)):
        rows = min(lines, h - k * lines)
        part = np.frombuffer(unpack(data[begin : begin + size]), kind, rows * w * c).reshape(rows, w, c)
        pixels[k * lines : k * lines + rows] = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if tags["predictor"][0] == 2 else part
    shown = (pixels >> 8).astype(np.uint8) if depth == 16 else pixels
    if tags["kind"][0] == 3:
        colours = (np.array(tags["palette"]).reshape(3, -1).T >> 8).astype(np.uint8)
        shown = colours[pixels[..., 0]]
    elif tags["kind"][0] == 0:
        shown = 255 - shown
    elif tags["kind"][0] not in (1, 2):
        raise ValueError(f"colours {tags['kind'][0]} are unknown")
    if shown.shape[2] < 3:
        return np.ascontiguousarray(shown[..., 0])
    return np.ascontiguousarray(np.dstack([shown[..., 2::-1], shown[..., 3:4]]))


def encoded(image: np.ndarray, level: int = 3) -> bytes:
    """A PNG file of 8-bit grey, BGR or BGRA pixels."""
    h, w = image.shape[:2]
    c = 1 if image.ndim == 2 else image.shape[2]
    kind = {1: 0, 3: 2, 4: 6}[c]
    rows = image.reshape(h, w, c) if c == 1 else np.dstack([image[..., 2::-1], image[..., 3:]])
    lines = np.zeros((h, w * c + 1), np.uint8)
    lines[:, 1:] = rows.reshape(h, w * c)

    def chunk(name: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def read_files(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(path, h, w, c, data) of the folder's PNG, TIFF and JPEG files."""
    whole = spark.read.format("image").option("dropInvalid", str(not strict).lower()).option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG,Jpg}").load(folder).select("image.*")
    jpeg = whole.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), "data")
    return read_png(spark, folder, strict).unionByName(read_png(spark, folder, strict, "*.{tif,tiff,TIF,TIFF}", decoded_tiff)).unionByName(jpeg)


def read_png(spark: SparkSession, folder: str, strict: bool = False, names: str = "*.{png,PNG}", decode: Callable[[bytes], np.ndarray] = decoded) -> DataFrame:
    """(path, h, w, c, data) of the folder's PNG files, or others that decode reads; unreadable ones are left out, or
    fail the job (strict).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    image = decode(content)
                except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                    if strict:
                        raise
                    continue
                c = 1 if image.ndim == 2 else image.shape[2]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, image.shape[0], image.shape[1], c, image.tobytes()), kinds, strict=True)], names=["path", "h", "w", "c", "data"])

    return files.mapInArrow(run, "path string, h int, w int, c int, data binary")


def read_spark(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """JPEG and other 8-bit files by Spark's image source."""
    rows = spark.read.format("image").option("dropInvalid", str(not strict).lower()).load(folder).select("image.*")
    if strict:
        rows = rows.filter(F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("unreadable: "), "origin")).cast("boolean")).otherwise(F.lit(True)))
    return rows.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), "data")


def as_jpeg(rasters: DataFrame, quality: int = 92) -> DataFrame:
    """K7: (keys..., content): each raster as the bytes of a JPEG file."""
    return as_files(rasters, lambda image: jpeg.encoded(image, quality))


def as_png(rasters: DataFrame, level: int = 3) -> DataFrame:
    """K1, K3, K7: (keys..., content): each raster as the bytes of a PNG file, ready for any sink."""
    return as_files(rasters, lambda image: encoded(image, level))


def as_files(rasters: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    keys = [f for f in rasters.schema.fields if f.name not in ("h", "w", "c", "data")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from framefold.operators.kernels import single, unpacked

        for batch in single(batches):
            made = [encode(unpacked(r["data"], r["h"], r["w"], r["c"])) for r in batch.select(["h", "w", "c", "data"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keys], pa.array(made, pa.binary())], names=[*[f.name for f in keys], "content"])

    return rasters.mapInArrow(run, schema)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes rows (name, content) as files, through Hadoop's file systems, so that any store works.

    Rows come to the driver one at a time; this is the sink for a run's few final pictures.  Tables of
    rasters are written as Parquet by the executors.
    """
    spark = files.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for row in files.select("name", "content").toLocalIterator():
        path = hadoop.Path(folder, row["name"])
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(row["content"]))
        out.close()
