"""JPEG pictures by numpy: baseline and progressive scans, any sampling, grey, YCbCr, RGB and CMYK.

Coefficients of all scans are gathered per component; the inverse cosine transform is one matrix product over all
blocks. A scan that breaks off leaves what it had."""

from __future__ import annotations

import struct

import numpy as np

from .pictures import MOST_PIXELS


def _zigzag() -> np.ndarray:
    """Places of coefficients in a block, by the rule of diagonals that turn at the edges."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for _, _, r, c in cells])


_ORDER = _zigzag()
_BASIS = np.array([[np.sqrt((1 if k else 0.5) / 4) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


class _Bits:
    """Bits of one stretch of a scan; past the end there are zeros, and then it stops."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.have = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            if self.at > len(self.data) + 8:
                raise EOFError
            self.bits = self.bits << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.have += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.fill(n)
        self.have -= n
        out = self.bits >> self.have
        self.bits &= (1 << self.have) - 1
        return out

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        self.fill(16)
        code = self.bits >> (self.have - 16)
        size = table[0][code]
        if not size:
            raise EOFError
        self.have -= size
        self.bits &= (1 << self.have) - 1
        return table[1][code]

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each sixteen bits that may come next, the length of the code they start with and its symbol."""
    sizes, values, code, k = [0] * 65536, [0] * 65536, 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            low, span = code << (16 - size), 1 << (16 - size)
            sizes[low : low + span], values[low : low + span] = [size] * span, [symbols[k]] * span
            code, k = code + 1, k + 1
        code <<= 1
    return sizes, values


class _Picture:
    def __init__(self, data: bytes):
        self.data, self.quant, self.huffman = data, {}, {}
        self.restart, self.adobe, self.parts = 0, None, {}
        self.width = self.height = 0
        self._read()

    def _read(self) -> None:
        data, at = self.data, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if kind in (0, 1, 0xFF) or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
                continue
            if kind == 0xD9:
                break
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quantisers(body)
            elif kind == 0xC4:
                while len(body) > 16:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
                raise ValueError("a kind of JPEG that isn't read")
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif kind == 0xDA:
                at = self._scan(body, at)

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            size = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + size :]

    def _frame(self, body: bytes, progressive: bool) -> None:
        _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
        if self.width * self.height > MOST_PIXELS:
            raise ValueError("too many pixels")
        self.progressive = progressive
        info = [body[6 + 3 * i : 9 + 3 * i] for i in range(count)]
        self.h, self.v = max(i[1] >> 4 for i in info), max(i[1] & 15 for i in info)
        self.units = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        for name, sampling, quant in info:
            h, v = sampling >> 4, sampling & 15
            self.parts[name] = {"h": h, "v": v, "quant": quant, "blocks": np.zeros((self.units[0] * v, self.units[1] * h, 64), np.int32), "size": (-(-self.height * v // (8 * self.v)), -(-self.width * h // (8 * self.h)))}

    def _scan(self, body: bytes, at: int) -> int:
        chosen = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
        first, last, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        end, stretches, begin = at, [], at
        while end + 1 < len(self.data):
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                end = len(self.data)
                break
            kind = self.data[end + 1]
            if kind and not 0xD0 <= kind <= 0xD7:
                break
            if kind:
                stretches.append(self.data[begin:end])
                begin = end + 2
            end += 2
        stretches.append(self.data[begin:end])
        if len(chosen) == 1:
            part = chosen[0][0]
            places = [[(part, chosen[0][1], y, x)] for y in range(part["size"][0]) for x in range(part["size"][1])]
        else:
            places = [[(p, t, uy * p["v"] + y, ux * p["h"] + x) for p, t in chosen for y in range(p["v"]) for x in range(p["h"])] for uy in range(self.units[0]) for ux in range(self.units[1])]
        step = self.restart or len(places)
        for k, stretch in enumerate(stretches):
            try:
                self._stretch(_Bits(stretch), places[k * step : (k + 1) * step], first, last, approx >> 4, approx & 15)
            except EOFError:
                continue
        return end

    def _stretch(self, bits: _Bits, places: list, first: int, last: int, high: int, low: int) -> None:
        before: dict[int, int] = {}
        self.run = 0
        for unit in places:
            for part, tables, y, x in unit:
                block = part["blocks"][y, x]
                if not self.progressive:
                    self._dc(bits, block, tables, before, id(part), 0)
                    self._ac(bits, block, tables, 1, 63, 0)
                elif first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        self._dc(bits, block, tables, before, id(part), low)
                elif high:
                    self._refine(bits, block, tables, first, last, 1 << low)
                else:
                    self._ac(bits, block, tables, first, last, low)

    def _dc(self, bits: _Bits, block: np.ndarray, tables: int, before: dict, part: int, low: int) -> None:
        before[part] = before.get(part, 0) + bits.signed(bits.symbol(self.huffman[tables >> 4]))
        block[0] = before[part] << low

    def _ac(self, bits: _Bits, block: np.ndarray, tables: int, k: int, last: int, low: int) -> None:
        if self.run:
            self.run -= 1
            return
        table = self.huffman[16 | tables & 15]
        while k <= last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size:
                if zeros < 15:
                    self.run = (1 << zeros) - 1 + bits.take(zeros)
                    return
                k += 16
                continue
            k += zeros
            if k > 63:
                raise EOFError
            block[_ORDER[k]] = bits.signed(size) * (1 << low)
            k += 1

    def _refine(self, bits: _Bits, block: np.ndarray, tables: int, k: int, last: int, one: int) -> None:
        """One more bit of coefficients that there are, and new ones of that size."""
        table = self.huffman[16 | tables & 15]

        def sharpen(at: int) -> None:
            if bits.take(1) and not abs(int(block[at])) & one:
                block[at] += one if block[at] > 0 else -one

        while k <= last and not self.run:
            s = bits.symbol(table)
            zeros, new = s >> 4, 0
            if s & 15:
                new = one if bits.take(1) else -one
            elif zeros < 15:
                self.run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                at = _ORDER[k]
                k += 1
                if block[at]:
                    sharpen(at)
                elif zeros:
                    zeros -= 1
                else:
                    block[at] = new
                    break
        if self.run:
            for i in range(k, last + 1):
                if block[_ORDER[i]]:
                    sharpen(_ORDER[i])
            self.run -= 1

    def pixels(self) -> np.ndarray:
        planes = []
        for part in self.parts.values():
            table = np.zeros(64, np.int64)
            table[_ORDER] = self.quant[part["quant"]]
            rows, columns = part["blocks"].shape[:2]
            values = (part["blocks"] * table).reshape(rows, columns, 8, 8).astype(np.float64)
            values = np.einsum("ki,abkl,lj->abij", _BASIS, values, _BASIS) + 128
            plane = values.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
            plane = plane.repeat(self.v // part["v"], axis=0).repeat(self.h // part["h"], axis=1)
            planes.append(plane[: self.height, : self.width])
        full = np.stack(planes, axis=2)
        colours = full.shape[2]
        if colours in (3, 4) and self.adobe != 0 and (colours == 3 or self.adobe == 2):
            y, b, r = full[:, :, 0], full[:, :, 1] - 128, full[:, :, 2] - 128
            full[:, :, :3] = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
        full = np.clip(np.rint(full), 0, 255)
        if colours == 4:
            full = full if self.adobe is not None else 255 - full
            full = full[:, :, :3] * full[:, :, 3:] / 255
        out = np.full((self.height, self.width, 4), 255, np.uint8)
        out[:, :, :3] = full[:, :, :3]
        return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """Rows of red, green, blue and alpha."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    picture = _Picture(data)
    if not picture.parts:
        raise ValueError("no frame")
    return picture.pixels()
