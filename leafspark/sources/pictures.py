"""Pictures: kind by first bytes and PNG sizes as Column expressions; PNG and GIF pixels by numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PIXELS, SIDE = 16_000_000, 720


def picture_kind(content: Column) -> Column:
    """png, jpeg, gif, bmp, tiff, emf, wmf, webp, jp2, svg or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif")
    out = out.when(head.startswith("424D"), "bmp").when(head.rlike("^(49492A00|4D4D002A)"), "tiff").when(head.startswith("01000000") & (F.hex(F.substring(content, 41, 4)) == "20454D46"), "emf")
    out = out.when(head.rlike("^(D7CDC69A|0100090000)"), "wmf").when(head.rlike("^52494646.{8}57454250"), "webp").when(head.startswith("0000000C6A502020"), "jp2")
    return out.when(F.lower(F.substring(content, 1, 300).cast("string")).rlike(r"^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*|<!doctype[^>]*>\s*)*<svg"), "svg")


def png_size(content: Column) -> Column:
    """(width, height) from the header; 1 for a missing one."""

    def number(at: int) -> Column:
        x = F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
        return F.coalesce(F.when(x != 0, x), F.lit(1))

    return F.struct(number(17).alias("width"), number(21).alias("height"))


def decode_png(data: bytes) -> np.ndarray:
    """Rows of red, green, blue and alpha, 8 bits each; all colour types, depths and interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, raw, palette, clear, head = 8, b"", None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            raw += body
        elif kind == b"IEND":
            break
    width, height, depth, colour, _, _, interlaced = head
    if width * height > MOST_PIXELS:
        raise ValueError("too many pixels")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = zlib.decompressobj().decompress(raw)
    out = np.zeros((height, width, channels), np.uint16)
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlaced else [(0, 0, 1, 1)]
    start = 0
    for y0, x0, dy, dx in passes:
        rows, columns = -(-(height - y0) // dy), -(-(width - x0) // dx)
        if rows <= 0 or columns <= 0:
            continue
        part, start = _lines(raw, start, rows, columns, channels, depth)
        out[y0::dy, x0::dx] = part
    return _rgba(out, colour, depth, palette, clear)


def _lines(raw: bytes, at: int, rows: int, columns: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    stride, step = -(-columns * channels * depth // 8), max(1, channels * depth // 8)
    above = np.zeros(stride, np.uint8)
    lines = np.zeros((rows, stride), np.uint8)
    for y in range(rows):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).copy()
        at += stride + 1
        if kind == 2:
            line += above
        elif kind == 1:
            for x in range(step):
                line[x::step] = np.cumsum(line[x::step], dtype=np.uint8)
        elif kind in (3, 4):
            for x in range(stride):
                a = int(line[x - step]) if x >= step else 0
                b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        lines[y] = above = line
    if depth == 16:
        values = lines.reshape(rows, -1, 2).astype(np.uint16)
        values = values[:, :, 0] << 8 | values[:, :, 1]
    elif depth == 8:
        values = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
        values = bits @ (1 << np.arange(depth)[::-1])
    return values[:, : columns * channels].reshape(rows, columns, channels), at


def _rgba(v: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, clear: bytes) -> np.ndarray:
    out = np.full((*v.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        index = np.minimum(v[:, :, 0], len(palette) - 1)
        out[:, :, :3] = palette[index]
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        out[:, :, 3] = alpha[index]
        return out
    scaled = (v.astype(np.uint32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    out[:, :, :3] = scaled[:, :, :3] if colour in (2, 6) else scaled[:, :, :1]
    if colour in (4, 6):
        out[:, :, 3] = scaled[:, :, -1]
    elif clear:
        key = np.frombuffer(clear, ">u2")
        out[(v == key[: v.shape[2]]).all(axis=2), 3] = 0
    return out


def _gif_indices(data: bytes, least: int, count: int) -> np.ndarray:
    """Palette indices of variable-width codes, lowest bits first."""
    clear, stop = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, width, bits, have, last = bytearray(), least + 1, 0, 0, b""
    for byte in data:
        bits, have = bits | byte << have, have + 8
        while have >= width:
            code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
            if code == stop or len(out) >= count:
                return np.frombuffer(bytes(out[:count]).ljust(count, b"\0"), np.uint8)
            if code == clear or not table:
                table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
                if code == clear:
                    continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return np.frombuffer(bytes(out[:count]).ljust(count, b"\0"), np.uint8)


def decode_gif(data: bytes) -> np.ndarray:
    """The first frame, as rows of red, green, blue and alpha."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MOST_PIXELS:
        raise ValueError("too many pixels")
    at, shared, clear = 13, b"", -1
    if flags & 0x80:
        shared = data[at : at + (6 << (flags & 7))]
        at += len(shared)
    out = np.zeros((height, width, 4), np.uint8)

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and body and body[0] & 1:
                clear = body[3]
        elif data[at] == 0x2C:
            x, y, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            colours = shared
            if own & 0x80:
                colours = data[at : at + (6 << (own & 7))]
                at += len(colours)
            body, _ = blocks(at + 1)
            index = _gif_indices(body, data[at], w * h).reshape(h, w)
            if own & 0x40:
                rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                index = index[np.argsort(rows)]
            palette = np.frombuffer(colours, np.uint8).reshape(-1, 3)
            part = np.full((h, w, 4), 255, np.uint8)
            part[:, :, :3] = palette[np.minimum(index, len(palette) - 1)]
            part[index == clear, 3] = 0
            fit = part[: max(0, height - y), : max(0, width - x)]
            out[y : y + fit.shape[0], x : x + fit.shape[1]] = fit
            return out
        else:
            break
    raise ValueError("no frame")


def shrink(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """On white, and averaged over boxes until no side is longer."""
    alpha = pixels[:, :, 3:].astype(np.float64) / 255
    flat = pixels[:, :, :3] * alpha + 255 * (1 - alpha)
    height, width = flat.shape[:2]
    scale = max(1, -(-max(height, width) // side))
    for axis, n in ((0, height), (1, width)):
        edges = np.arange(0, n, scale)
        sums = np.add.reduceat(flat, edges, axis=axis)
        counts = np.diff(np.append(edges, n)).reshape([-1 if a == axis else 1 for a in range(3)])
        flat = sums / counts
    return np.rint(flat).astype(np.uint8)
