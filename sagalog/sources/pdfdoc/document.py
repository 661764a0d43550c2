"""Cross-reference tables and streams, object streams, filters and the page tree."""

from __future__ import annotations

import re
import zlib

from .objects import Name, PdfError, Ref, Stream, Word, parse, skip

MAX_FILE, MAX_STREAM = 100 << 20, 256 << 20


def inflate(data: bytes, limit: int = MAX_STREAM) -> bytes:
    box = zlib.decompressobj()
    try:
        out = box.decompress(data, limit + 1)
    except zlib.error as e:
        raise PdfError(f"flate: {e}") from None
    if len(out) > limit:
        raise PdfError("decoded stream is too large")
    return out


def undo_predictor(data: bytes, parms: dict) -> bytes:
    """PNG predictors; each row names its own filter."""
    kind = int(parms.get("Predictor") or 1)
    if kind == 1:
        return data
    if kind < 10:
        raise PdfError(f"predictor {kind} is not supported")
    colors, bits, columns = (int(parms.get(k) or d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if min(colors, bits, columns) < 1 or colors * bits * columns > 1 << 28:
        raise PdfError("bad predictor parameters")
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        mode, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if len(row) < width:
            break
        if mode == 1:
            for i in range(step, width):
                row[i] = row[i] + row[i - step] & 255
        elif mode == 2:
            row = bytearray(a + b & 255 for a, b in zip(row, above, strict=True))
        elif mode == 3:
            for i in range(width):
                row[i] = row[i] + ((row[i - step] if i >= step else 0) + above[i]) // 2 & 255
        elif mode == 4:
            for i in range(width):
                a, b, c = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = row[i] + near & 255
        elif mode:
            raise PdfError(f"unknown row filter {mode}")
        out += row
        above = row
    return bytes(out)


class Document:
    """One PDF file in memory."""

    def __init__(self, data: bytes):
        if len(data) > MAX_FILE:
            raise PdfError(f"file is larger than {MAX_FILE} bytes")
        if not data.startswith(b"%PDF-"):
            raise PdfError("no PDF header")
        self.data = data
        self.places: dict[int, tuple] = {}  # number -> ("at", offset) or ("in", stream number, index)
        self.trailer: dict = {}
        self._objects: dict[int, object] = {}
        self._busy: set[int] = set()
        self._packs: dict[int, list] = {}
        found = re.findall(rb"startxref[\x00\t\n\x0c\r ]+(\d+)", data[-2048:]) or re.findall(rb"startxref[\x00\t\n\x0c\r ]+(\d+)", data)
        if not found:
            raise PdfError("no startxref")
        todo, seen = [int(found[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(data):
                continue
            seen.add(at)
            trailer = self._table(at) if data.startswith(b"xref", skip(data, at)) else self._xref_stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            # a hybrid file's stream comes before older sections
            todo = [x for k in ("XRefStm", "Prev") if (x := self._offset(trailer.get(k))) is not None] + todo

    @staticmethod
    def _offset(v) -> int | None:
        return int(v) if isinstance(v, int | float) and not isinstance(v, bool) and v == v and 0 <= v < 1 << 53 and v == int(v) else None

    def _table(self, at: int) -> dict:
        at = skip(self.data, at) + 4
        head = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ ]+(\d+)[\x00\t\n\x0c\r ]+")
        entry = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{10})[ ](\d{5})[ ]([nf])")
        while hit := head.match(self.data, at):
            first, count, at = int(hit[1]), int(hit[2]), hit.end()
            for n in range(first, first + count):
                row = entry.match(self.data, at)
                if not row:
                    break
                at = row.end()
                if row[3] == b"n":
                    self.places.setdefault(n, ("at", int(row[1])))
        at = skip(self.data, at)
        if not self.data.startswith(b"trailer", at):
            raise PdfError("no trailer")
        trailer, _ = parse(self.data, at + 7)
        if not isinstance(trailer, dict):
            raise PdfError("bad trailer")
        return trailer

    def _xref_stream(self, at: int) -> dict:
        found = self._object_at(at)
        if not isinstance(found, Stream):
            raise PdfError("no cross-reference stream")
        rows = self.decoded(found)
        widths = [int(w) for w in found.info.get("W", [])]
        if len(widths) != 3 or min(widths) < 0 or not sum(widths):
            raise PdfError("bad cross-reference widths")
        index = [int(x) for x in found.info.get("Index") or [0, int(found.info.get("Size") or 0)]]
        at, step = 0, sum(widths)
        for first, count in zip(index[::2], index[1::2], strict=False):
            for n in range(first, first + count):
                row = rows[at : at + step]
                at += step
                if len(row) < step:
                    break
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                second, third = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
                if kind == 1:
                    self.places.setdefault(n, ("at", second))
                elif kind == 2:
                    self.places.setdefault(n, ("in", second, third))
        return found.info

    def _object_at(self, at: int) -> object:
        hit = re.compile(rb"[\x00\t\n\x0c\r ]*\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj").match(self.data, at)
        if not hit:
            raise PdfError(f"no object at {at}")
        value, at = parse(self.data, hit.end())
        at = skip(self.data, at)
        if isinstance(value, dict) and self.data.startswith(b"stream", at):
            at += 6
            at += 2 if self.data.startswith(b"\r\n", at) else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
            length = self.integer(value.get("Length"), -1)
            end = at + length
            if length < 0 or not self.data.startswith(b"endstream", skip(self.data, min(end, len(self.data)))):
                end = self.data.find(b"endstream", at)
                end = len(self.data) if end < 0 else end
                while end > at and self.data[end - 1 : end] in (b"\n", b"\r"):
                    end -= 1
            return Stream(value, self.data[at:end])
        return None if isinstance(value, Word) else value

    def get(self, value: object, depth: int = 0) -> object:
        """The object behind a reference; broken and circular ones are null."""
        while isinstance(value, Ref):
            if depth > 64 or value.number in self._busy:
                return None
            n = value.number
            if n not in self._objects:
                self._busy.add(n)
                try:
                    place = self.places.get(n)
                    self._objects[n] = None if place is None else self._object_at(place[1]) if place[0] == "at" else self._packed(place[1], n, place[2])
                except (PdfError, ValueError, IndexError):
                    self._objects[n] = None
                finally:
                    self._busy.discard(n)
            value, depth = self._objects[n], depth + 1
        return value

    def _packed(self, stream_number: int, n: int, index: int) -> object:
        if stream_number not in self._packs:
            holder = self.get(Ref(stream_number, 0))
            if not isinstance(holder, Stream):
                raise PdfError("object stream is missing")
            data = self.decoded(holder)
            first, count = self.integer(holder.info.get("First"), 0), self.integer(holder.info.get("N"), 0)
            at, heads = 0, []
            for _ in range(count):
                number, at = parse(data, at)
                offset, at = parse(data, at)
                heads.append((number, offset))
            self._packs[stream_number] = [(number, parse(data, first + offset)[0]) for number, offset in heads]
        pack = self._packs[stream_number]
        if 0 <= index < len(pack) and pack[index][0] == n:
            return pack[index][1]
        return next((v for number, v in pack if number == n), None)

    def dictionary(self, value: object) -> dict:
        value = self.get(value)
        return value.info if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def integer(self, value: object, default: int) -> int:
        value = self.get(value)
        return int(value) if isinstance(value, int | float) and not isinstance(value, bool) else default

    def name(self, value: object) -> str:
        value = self.get(value)
        return str(value) if isinstance(value, Name) else ""

    def filters(self, stream: Stream) -> list[str]:
        value = self.get(stream.info.get("Filter"))
        return [self.name(x) for x in value] if isinstance(value, list) else [str(value)] if isinstance(value, Name) else []

    def decoded(self, stream: Stream) -> bytes:
        parms = self.get(stream.info.get("DecodeParms"))
        data = stream.data
        for i, kind in enumerate(self.filters(stream)):
            if kind == "":
                continue
            if kind != "FlateDecode":
                raise PdfError(f"unsupported stream filter: {kind}")
            own = parms if isinstance(parms, dict) and i == 0 else self.dictionary(parms[i]) if isinstance(parms, list) and i < len(parms) else {}
            data = undo_predictor(inflate(data), {k: self.get(v) for k, v in own.items()})
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in document order."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(node: object, depth: int) -> None:
            if isinstance(node, Ref):
                if node.number in seen:
                    return
                seen.add(node.number)
            own = self.dictionary(node)
            kids = self.get(own.get("Kids"))
            if isinstance(kids, list) and depth < 256:
                for kid in kids:
                    walk(kid, depth + 1)
            elif self.name(own.get("Type")) == "Page":
                out.append(own)

        walk(self.dictionary(self.trailer.get("Root")).get("Pages"), 0)
        return out

    def contents(self, page: dict) -> bytes:
        value = self.get(page.get("Contents"))
        parts = value if isinstance(value, list) else [value]
        streams = [s for s in map(self.get, parts) if isinstance(s, Stream)]
        return b"\n".join(self.decoded(s) for s in streams)
