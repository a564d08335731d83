"""PDF files as rows: one heading per page and one row per line of text, placed by position.

Objects are found through the cross-reference tables or streams, and by a scan of the whole file where those are broken.
Streams: Flate, LZW, ASCIIHex, ASCII85 and RunLength with PNG predictors. Text is decoded by ToUnicode maps, else by the
font's encoding. Encrypted files are opened if their user password is empty.
"""

from __future__ import annotations

import re
import zlib

from .rows import Rows, span

ROW_LIMIT, OPERATORS, PIECES, STREAM_BYTES = 4_000, 1_500_000, 60_000, 384 << 20

_SPACE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|\{|\}|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)")


class Name(str):
    __slots__ = ()


class Ref(tuple):
    __slots__ = ()


class Stream:
    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its bracket."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            at += 1
            if e in b"01234567" and e:
                m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif e == b"\r":
                at += data[at : at + 1] == b"\n"
            elif e != b"\n":
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


class Lexer:
    """Values one after another; operators come as bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[1]

    def value(self, token: bytes | None = None):
        t = self.token() if token is None else token
        if t is None:
            raise EOFError
        if t == b"<<":
            out: dict = {}
            while (t := self.token()) not in (b">>", None):
                if t.startswith(b"/"):
                    out[str(self.value(t))] = self.value()
            return out
        if t == b"[":
            items: list = []
            while (t := self.token()) not in (b"]", None):
                items.append(self.value(t))
                if items[-1] == b"R" and len(items) > 2:
                    items[-3:] = [Ref((int(items[-3]), int(items[-2])))]
            return items
        if t == b"(":
            out_, self.at = _string(self.data, self.at)
            return out_
        if t.startswith(b"<"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t.startswith(b"/"):
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            number = float(t) if b"." in t else int(t)
            if isinstance(number, int) and (m := re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])").match(self.data, self.at)):
                self.at = m.end()
                return Ref((number, int(m[1])))
            return number
        return {b"true": True, b"false": False, b"null": None}.get(t, t)


def _lzw(data: bytes, early: int) -> bytes:
    out, table, width, bits, have, last = bytearray(), {}, 9, 0, 0, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            have -= width
            code, bits = bits >> have, bits & ((1 << have) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = {}, 9, b""
                continue
            entry = bytes([code]) if code < 256 else table.get(code, last + last[:1])
            out += entry
            if last:
                table[258 + len(table)] = last + entry[:1]
            last = entry
            width = max(9, min(12, (258 + len(table) + early).bit_length()))
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0]:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        padded = [*group, *[84] * (5 - len(group))]
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(padded)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def _predict(data: bytes, columns: int, colors: int, bits: int) -> bytes:
    stride, step = -(-columns * colors * bits // 8), max(1, colors * bits // 8)
    out, above = bytearray(), bytearray(stride)
    for at in range(0, len(data) - 1, stride + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + stride].ljust(stride, b"\0"))
        for x in range(stride):
            a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            guess = 0 if kind == 0 else a if kind == 1 else b if kind == 2 else (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
            line[x] = (line[x] + guess) & 255
        out += line
        above = line
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[int, tuple] = {}
        self.cache: dict[int, object] = {}
        self.trailer: dict = {}
        self.decoded = 0
        self.security, self.unread = None, -1
        try:
            self._tables()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError("no catalogue")
        except (ValueError, KeyError, IndexError, TypeError, EOFError, AttributeError, zlib.error):
            self._repair()
        if self.trailer.get("Encrypt") is not None:
            self._unlock()

    def _unlock(self) -> None:
        from .pdf_crypt import Security

        info = {k: self.get(v) for k, v in self.get(self.trailer["Encrypt"]).items()}
        if isinstance(info.get("CF"), dict):
            info["CF"] = {k: self.get(v) for k, v in info["CF"].items()}
        ids = self.get(self.trailer.get("ID")) or [b""]
        holder = self.trailer["Encrypt"]
        self.unread = holder[0] if isinstance(holder, Ref) else -1
        self.security = Security(info, ids[0] if isinstance(ids[0], bytes) else b"")
        self.cache = {}

    def _plain(self, value, number: int, generation: int):
        """A value of an object with its strings and stream decrypted."""
        if isinstance(value, bytes):
            return self.security.decrypt(number, generation, value)
        if isinstance(value, dict):
            return {k: self._plain(v, number, generation) for k, v in value.items()}
        if isinstance(value, list):
            return [self._plain(v, number, generation) for v in value]
        if isinstance(value, Stream):
            if value.info.get("Type") == "XRef":
                return value
            return Stream(self._plain(value.info, number, generation), self.security.decrypt(number, generation, value.raw))
        return value

    def _tables(self) -> None:
        start = self.data.rindex(b"startxref")
        at, seen = Lexer(self.data, start + 9).value(), set()
        while isinstance(at, int) and at not in seen and len(seen) < 64:
            seen.add(at)
            lexer = Lexer(self.data, at)
            if self.data[at : at + 20].lstrip(_SPACE).startswith(b"xref"):
                lexer.token()
                while (t := lexer.token()) != b"trailer":
                    first, count = int(t), int(lexer.token())
                    for i in range(first, first + count):
                        offset, generation, kind = int(lexer.token()), lexer.token(), lexer.token()
                        if kind == b"n":
                            self.places.setdefault(i, ("at", offset))
                        del generation
                info = lexer.value()
                hybrid = info.get("XRefStm")
                if isinstance(hybrid, int):
                    self._stream_table(self._object(hybrid))
            else:
                found = self._object(at)
                self._stream_table(found)
                info = found.info
            self.trailer = info | self.trailer
            at = info.get("Prev")

    def _stream_table(self, s: Stream) -> None:
        data, widths = self.content(s), s.info["W"]
        index = s.info.get("Index") or [0, s.info["Size"]]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for i in range(first, first + count):
                fields = []
                for k, w in enumerate(widths):
                    fields.append(int.from_bytes(data[at : at + w], "big") if w else (1 if k == 0 else 0))
                    at += w
                if fields[0] == 1:
                    self.places.setdefault(i, ("at", fields[1]))
                elif fields[0] == 2:
                    self.places.setdefault(i, ("in", fields[1], fields[2]))

    def _repair(self) -> None:
        """All objects that the file shows; the last of a number counts."""
        self.places, self.cache, self.trailer = {}, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d{1,7})[\x00\t\n\x0c\r ]+\d{1,5}[\x00\t\n\x0c\r ]+obj", self.data):
            self.places[int(m[1])] = ("at", m.start())
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= Lexer(self.data, m.end()).value()
            except (EOFError, TypeError, ValueError):
                continue
        for number in list(self.places):
            value = self.get(Ref((number, 0)))
            if isinstance(value, Stream) and value.info.get("Type") == "ObjStm":
                header = Lexer(self.content(value))
                for i in range(int(self.get(value.info.get("N", 0)))):
                    self.places.setdefault(int(header.token()), ("in", number, i))
                    header.token()
        for number in list(self.places):
            value = self.get(Ref((number, 0)))
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailer["Root"] = Ref((number, 0))

    def _object(self, at: int):
        lexer = Lexer(self.data, at)
        for _ in range(3):
            lexer.token()
        value = lexer.value()
        m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(\r\n|\n|\r)?").match(self.data, lexer.at)
        if not isinstance(value, dict) or not m:
            return value
        size = self.get(value.get("Length"))
        end = m.end() + size if isinstance(size, int) else -1
        if end < 0 or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, end):
            end = self.data.find(b"endstream", m.end())
        return Stream(value, self.data[m.end() : end if end >= 0 else len(self.data)])

    def get(self, value):
        """A value, with a reference followed."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            number = value[0]
            if number not in self.cache:
                self.cache[number] = None
                place = self.places.get(number)
                if place and place[0] == "at":
                    found = self._object(place[1])
                    if self.security and number != self.unread:
                        found = self._plain(found, number, value[1])
                    self.cache[number] = found
                elif place:
                    holder = self.get(Ref((place[1], 0)))
                    data = self.content(holder)
                    header = Lexer(data)
                    offsets = {}
                    for _ in range(int(self.get(holder.info["N"]))):
                        n, offset = int(header.token()), int(header.token())
                        offsets[n] = offset
                    if number in offsets:
                        self.cache[number] = Lexer(data, int(self.get(holder.info["First"])) + offsets[number]).value()
            value = self.cache[number]
        return None

    def content(self, s: Stream) -> bytes:
        data = s.raw
        filters, parms = self.get(s.info.get("Filter")), self.get(s.info.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        for f, p in zip(filters, parms, strict=False):
            f, p = self.get(f), self.get(p) or {}
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                try:
                    data = d.decompress(data, STREAM_BYTES)
                except zlib.error:
                    data = zlib.decompressobj(-15).decompress(data[2:], STREAM_BYTES)
            elif f in ("LZWDecode", "LZW"):
                data = _lzw(data, self.get(p.get("EarlyChange", 1)))
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("ASCII85Decode", "A85"):
                data = _ascii85(data.removeprefix(b"<~"))
            elif f in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            if self.get(p.get("Predictor", 1)) >= 10:
                data = _predict(data, self.get(p.get("Columns", 1)), self.get(p.get("Colors", 1)), self.get(p.get("BitsPerComponent", 8)))
            self.decoded += len(data)
            if self.decoded > STREAM_BYTES:
                raise ValueError("too much to decode")
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries with what they inherit."""
        out: list[dict] = []

        def walk(node, inherited: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, inherited, depth + 1)
            else:
                out.append(inherited | node)

        root = self.get(self.trailer.get("Root")) or {}
        walk(root.get("Pages"), {}, 0)
        if not out:
            out = [v for n in sorted(self.places) if isinstance(v := self.get(Ref((n, 0))), dict) and v.get("Type") == "Page"]
        return out


class Font:
    """Codes to text and widths, in thousandths of the size."""

    def __init__(self, doc: Document, info: dict):
        self.map: dict[int, str] = {}
        self.wide = info.get("Subtype") == "Type0"
        self.widths: dict[int, float] = {}
        self.default = 500.0
        if isinstance(m := doc.get(info.get("ToUnicode")), Stream):
            self._cmap(doc.content(m))
        if self.wide:
            inner = doc.get((doc.get(info.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = float(doc.get(inner.get("DW", 1000)))
            items, i = doc.get(inner.get("W")) or [], 0
            while i + 1 < len(items):
                start, nxt = int(doc.get(items[i])), doc.get(items[i + 1])
                if isinstance(nxt, list):
                    self.widths |= {start + k: float(doc.get(w)) for k, w in enumerate(nxt)}
                    i += 2
                else:
                    self.widths |= dict.fromkeys(range(start, min(int(nxt), start + 65535) + 1), float(doc.get(items[i + 2])))
                    i += 3
        else:
            first = doc.get(info.get("FirstChar", 0)) or 0
            self.widths = {first + k: float(doc.get(w) or 0) for k, w in enumerate(doc.get(info.get("Widths")) or [])}
            encoding = doc.get(info.get("Encoding"))
            differences = doc.get(encoding.get("Differences")) if isinstance(encoding, dict) else None
            base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
            self.codec = "mac-roman" if base == "MacRomanEncoding" else "cp1252"
            code = 0
            for d in differences or []:
                if isinstance(d, int):
                    code = d
                else:
                    if text := _glyph(str(d)):
                        self.map.setdefault(code, text)
                    code += 1

    def _cmap(self, data: bytes) -> None:
        def text(b: bytes) -> str:
            return b.decode("utf-16-be", "replace")

        lexer, stack = Lexer(data), []
        while (t := lexer.token()) is not None:
            if t in (b"endbfchar", b"endbfrange"):
                n = 2 if t == b"endbfchar" else 3
                items = stack[len(stack) % n :] if len(stack) % n else stack
                for i in range(0, len(items) - n + 1, n):
                    row = items[i : i + n]
                    if not all(isinstance(x, bytes) for x in row[: n - 1]):
                        continue
                    low = int.from_bytes(row[0], "big")
                    if n == 2 and isinstance(row[1], bytes):
                        self.map[low] = text(row[1])
                    elif n == 3:
                        high = min(int.from_bytes(row[1], "big"), low + 65535)
                        for k in range(high - low + 1):
                            if isinstance(row[2], list):
                                if k < len(row[2]) and isinstance(row[2][k], bytes):
                                    self.map[low + k] = text(row[2][k])
                            elif isinstance(row[2], bytes) and row[2]:
                                last = int.from_bytes(row[2][-2:], "big") + k
                                self.map[low + k] = text(row[2][:-2] + (last & 0xFFFF).to_bytes(min(2, len(row[2])), "big"))
                stack = []
            elif t in (b"beginbfchar", b"beginbfrange"):
                stack = []
            else:
                stack.append(lexer.value(t))

    def decode(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(text, width, is a one-byte space) of each code."""
        out = []
        for i in range(0, len(raw), 2 if self.wide else 1):
            code = int.from_bytes(raw[i : i + 2], "big") if self.wide else raw[i]
            text = self.map.get(code)
            if text is None:
                text = "" if self.wide else bytes([code]).decode(self.codec, "replace")
            out.append((text, self.widths.get(code, self.default), not self.wide and code == 32))
        return out


def _glyph(name: str) -> str:
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    import unicodedata

    for guess in (name.upper(), name.upper().replace("ONE", "DIGIT ONE")):
        try:
            return unicodedata.lookup(guess)
        except KeyError:
            continue
    known = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "parenleft": "(", "parenright": ")", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "fi": "ﬁ", "fl": "ﬂ", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
    return known.get(name, "")


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class _Page:
    """Runs text operators; pieces are (x, y, end, size, text)."""

    def __init__(self, doc: Document):
        self.doc, self.pieces, self.steps, self.fonts = doc, [], 0, {}

    def run(self, data: bytes, resources: dict, matrix: tuple, depth: int = 0) -> None:
        doc, lexer, stack, saved = self.doc, Lexer(data), [], []
        fonts, forms = doc.get(resources.get("Font")) or {}, doc.get(resources.get("XObject")) or {}
        state = {"ctm": matrix, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        tm = tlm = (1, 0, 0, 1, 0, 0)

        def show(raw: bytes) -> None:
            nonlocal tm
            if state["font"] is None or len(self.pieces) >= PIECES:
                return
            text, advance = [], 0.0
            for t, w, is_space in state["font"].decode(raw):
                text.append(t)
                advance += (w / 1000 * state["size"] + state["char"] + state["word"] * is_space) * state["scale"]
            at = _times((1, 0, 0, 1, 0, state["rise"]), _times(tm, state["ctm"]))
            tm = _times((1, 0, 0, 1, advance, 0), tm)
            end = _times(tm, state["ctm"])
            if "".join(text):
                size = state["size"] * (at[2] ** 2 + at[3] ** 2) ** 0.5
                self.pieces.append((at[4], at[5], end[4], abs(size) or 1.0, "".join(text)))

        while (t := lexer.token()) is not None:
            self.steps += 1
            if self.steps > OPERATORS:
                return
            value = lexer.value(t)
            if not isinstance(value, bytes) or t == b"(" or t[:1] == b"<":
                stack.append(value)
                continue
            try:
                match value:
                    case b"q":
                        saved.append(dict(state))
                    case b"Q" if saved:
                        state = saved.pop()
                    case b"cm":
                        state["ctm"] = _times(tuple(stack[-6:]), state["ctm"])
                    case b"BT":
                        tm = tlm = (1, 0, 0, 1, 0, 0)
                    case b"Tf":
                        name = str(stack[-2])
                        info = doc.get(fonts.get(name))
                        key = id(info)
                        if isinstance(info, dict) and key not in self.fonts:
                            self.fonts[key] = Font(doc, info)
                        state["font"], state["size"] = self.fonts.get(key), float(stack[-1])
                    case b"Tc" | b"Tw" | b"TL" | b"Ts":
                        state[{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}[value]] = float(stack[-1])
                    case b"Tz":
                        state["scale"] = stack[-1] / 100
                    case b"Td" | b"TD":
                        if value == b"TD":
                            state["lead"] = -stack[-1]
                        tm = tlm = _times((1, 0, 0, 1, stack[-2], stack[-1]), tlm)
                    case b"Tm":
                        tm = tlm = tuple(stack[-6:])
                    case b"T*":
                        tm = tlm = _times((1, 0, 0, 1, 0, -state["lead"]), tlm)
                    case b"Tj":
                        show(stack[-1])
                    case b"'" | b'"':
                        if value == b'"':
                            state["word"], state["char"] = stack[-3], stack[-2]
                        tm = tlm = _times((1, 0, 0, 1, 0, -state["lead"]), tlm)
                        show(stack[-1])
                    case b"TJ":
                        for item in stack[-1]:
                            if isinstance(item, bytes):
                                show(item)
                            else:
                                tm = _times((1, 0, 0, 1, -item / 1000 * state["size"] * state["scale"], 0), tm)
                    case b"Do" if depth < 12:
                        form = doc.get(forms.get(str(stack[-1])))
                        if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                            inner = tuple(doc.get(form.info.get("Matrix")) or (1, 0, 0, 1, 0, 0))
                            self.run(doc.content(form), doc.get(form.info.get("Resources")) or resources, _times(inner, state["ctm"]), depth + 1)
                    case b"BI":
                        m = re.compile(rb"\sID\s.*?\sEI(?=[\x00\t\n\x0c\r ])", re.S).search(data, lexer.at - 1)
                        lexer.at = m.end() if m else len(data)
            except (IndexError, TypeError, ValueError, KeyError):
                pass  # an operator without its operands is skipped
            stack = []


def page_lines(pieces: list[tuple]) -> list[str]:
    """Pieces in drawing order as lines: a step down or far back starts a new one, a gap is a space."""
    lines: list[str] = []
    y = end = None
    for x, at, stop, size, text in pieces:
        if y is None or abs(at - y) > 0.5 * size or x < end - 2 * size:
            lines.append(text)
        else:
            gap = x - end > 0.15 * size and not lines[-1].endswith(" ") and not text.startswith(" ")
            lines[-1] += " " * gap + text
        y, end = at, stop
    return [logical_order(line) for line in lines]


_RTL = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]")


def logical_order(line: str) -> str:
    """A line drawn right to left, in reading order: reversed, with numbers and Latin runs put right again."""
    if len(_RTL.findall(line)) <= len(re.findall("[A-Za-z]", line)):
        return line
    return re.sub(r"[A-Za-z0-9][A-Za-z0-9.,:/%+-]*", lambda m: m[0][::-1], line[::-1])


def pdf_rows(content: bytes) -> list[dict]:
    doc = Document(content)
    rows = Rows("page")
    for number, page in enumerate(doc.pages(), 1):
        if len(rows) >= ROW_LIMIT:
            break
        parts = doc.get(page.get("Contents"))
        parts = [doc.get(p) for p in parts] if isinstance(parts, list) else [parts]
        reader = _Page(doc)
        reader.run(b"\n".join(doc.content(p) for p in parts if isinstance(p, Stream)), doc.get(page.get("Resources")) or {}, (1, 0, 0, 1, 0, 0))
        rows.gap()
        rows.put(f"Page {number}", f"page {number}", "h3", [span(f"Page {number}", b=True)])
        for k, line in enumerate(page_lines(reader.pieces), 1):
            if line.strip():
                rows.put(line, f"page {number}, line {k}", "p", [span(line)])
    return rows.done()[:ROW_LIMIT]
