"""PNG images: data URLs, headers, and a reader and writer for the common kinds."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.schema import LIMITS, MIB, CompareError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
URL_BYTES = 12 * MIB
#: Samples per pixel by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_bytes(url: Column) -> Column:
    """Bytes of a PNG data URL; null unless it is strict base64, of at most 12 MiB, with the PNG signature."""
    body = F.substring_index(url, ",", -1)
    strict = url.rlike(r"^data:image/png;base64,(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.try_to_binary(body, F.lit("base64"))
    good = strict & (F.octet_length(raw) <= URL_BYTES) & (F.hex(F.substring(raw, 1, 8)) == SIGNATURE.hex().upper())
    return F.when(good, raw)


def png_size(raw: Column) -> Column:
    """struct(width, height) from the header; null if there is none or it passes the pixel limits."""
    number = lambda at: F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("long")
    head = (F.hex(F.substring(raw, 1, 8)) == SIGNATURE.hex().upper()) & (F.hex(F.substring(raw, 13, 4)) == b"IHDR".hex().upper()) & (F.octet_length(raw) >= 33)
    width, height = number(17), number(21)
    sound = head & (width > 0) & (height > 0) & (width * height <= LIMITS["image_pixels"])
    return F.when(sound, F.struct(width.alias("width"), height.alias("height")))


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for y, row in enumerate(rows):
        kind, line, up = row[0], row[1:].copy(), out[y]
        if kind == 2:
            line += up
        elif kind == 1:  # each sample adds up along the row
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            for x in range(len(line)):
                left = int(line[x - step]) if x >= step else 0
                above, corner = int(up[x]), int(up[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                line[x] = (int(line[x]) + guess) & 255
        elif kind:
            raise CompareError("PDF_DECODE_FAILED", "unknown PNG filter")
        out[y + 1] = line
    return out[1:]


def decode_png(raw: bytes) -> np.ndarray:
    """RGBA array of a non-interlaced 8-bit PNG; limits and checksums first, then memory."""
    if raw[:8] != SIGNATURE or len(raw) < 33:
        raise CompareError("PDF_DECODE_FAILED", "no PNG")
    at, data, head, palette, alpha = 8, [], None, None, None
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise CompareError("PDF_DECODE_FAILED", "damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            if head[0] * head[1] == 0 or head[0] * head[1] > LIMITS["image_pixels"]:
                raise CompareError("PIXEL_LIMIT_EXCEEDED", "the image is too large")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise CompareError("PDF_DECODE_FAILED", "unsupported PNG")
    width, height, _, colour, *_ = head
    channels = CHANNELS[colour]
    wanted = height * (width * channels + 1)
    engine = zlib.decompressobj()
    try:
        pixels = engine.decompress(b"".join(data), wanted)
    except zlib.error:
        raise CompareError("PDF_DECODE_FAILED", "damaged PNG") from None
    if len(pixels) != wanted:
        raise CompareError("PDF_DECODE_FAILED", "damaged PNG")
    rows = _unfilter(np.frombuffer(pixels, np.uint8).reshape(height, -1), channels).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None or rows.max(initial=0) >= len(palette):
            raise CompareError("PDF_DECODE_FAILED", "damaged PNG")
        out[..., :3] = palette[rows[..., 0]]
        if alpha is not None:
            out[..., 3] = np.append(alpha, np.full(256, 255, np.uint8))[rows[..., 0]]
    else:
        out[..., :3] = rows[..., :1] if channels < 3 else rows[..., :3]
        if channels in (2, 4):
            out[..., 3] = rows[..., -1]
    return out


def encode_png(image: np.ndarray) -> bytes:
    """An RGBA array as PNG."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
