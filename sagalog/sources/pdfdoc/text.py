"""Text of a page: character maps and the text state of its content stream."""

from __future__ import annotations

import re

from .document import Document
from .objects import Name, PdfError, Stream, operations

CMap = dict[int, str]
#: A TJ gap below this is a space; a line change is a move of more than this many units.
WORD_GAP, LINE_MOVE = -100, 1.0
_HEX = re.compile(r"<([^>]*)>")
_RANGE_PART = re.compile(r"<[^>]*>|\[[^\]]*\]")


def _code(token: str) -> int | None:
    digits = token.strip("<>").strip()
    return int(digits, 16) if re.fullmatch(r"[0-9A-Fa-f]{1,4}", digits) else None


def _text(token: str) -> str:
    digits = token.strip("<>").strip()
    if not re.fullmatch(r"[0-9A-Fa-f]+", digits):
        return ""
    raw = bytes.fromhex("0" * (len(digits) % 2) + digits)
    return chr(raw[0]) if len(raw) == 1 else raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace")


def parse_cmap(data: bytes) -> CMap:
    """bfchar and bfrange entries of a ToUnicode map."""
    out: CMap = {}
    source = data.decode("latin-1")
    for block in re.findall(r"beginbfchar(.*?)endbfchar", source, re.S):
        tokens = _HEX.findall(block)
        for src, dst in zip(tokens[::2], tokens[1::2], strict=False):
            if (code := _code(src)) is not None and (text := _text(dst)):
                out[code] = text
    for block in re.findall(r"beginbfrange(.*?)endbfrange", source, re.S):
        tokens = _RANGE_PART.findall(block)
        for low, high, dst in zip(tokens[::3], tokens[1::3], tokens[2::3], strict=False):
            first, last = _code(low), _code(high)
            if first is None or last is None or last < first:
                continue
            if dst.startswith("["):
                for code, token in zip(range(first, last + 1), _HEX.findall(dst), strict=False):
                    if text := _text(token):
                        out[code] = text
            elif text := _text(dst):
                for code in range(first, last + 1):
                    out[code] = chr(ord(text[0]) + code - first)
    return out


def win_ansi() -> CMap:
    """Code page 1252 from 32 on; its five unused codes stand for themselves."""
    return {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(32, 256)}


def font_maps(doc: Document, page: dict) -> dict[str, CMap]:
    out = {}
    fonts = doc.dictionary(doc.dictionary(page.get("Resources")).get("Font"))
    for name, ref in fonts.items():
        font = doc.dictionary(ref)
        if not font:
            continue
        source = doc.get(font.get("ToUnicode"))
        try:
            out[str(name)] = parse_cmap(doc.decoded(source)) if isinstance(source, Stream) else win_ansi()
        except PdfError:
            out[str(name)] = win_ansi()
    return out


class _Writer:
    def __init__(self):
        self.parts: list[str] = []
        self.last = ""

    def write(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.last = text[-1]

    def newline(self) -> None:
        if self.last != "\n":
            self.write("\n")

    def space(self) -> None:
        if self.last not in (" ", "\n"):
            self.write(" ")


def decode_string(raw: bytes, cmap: CMap | None) -> str:
    """Two-byte codes first, then one byte, else Latin-1."""
    out, i = [], 0
    while i < len(raw):
        if cmap is not None and i + 1 < len(raw) and (pair := cmap.get(raw[i] << 8 | raw[i + 1])) is not None:
            out.append(pair)
            i += 2
            continue
        one = cmap.get(raw[i]) if cmap is not None else None
        out.append(chr(raw[i]) if one is None else one)
        i += 1
    return "".join(out)


def normalise(text: str) -> str:
    lines = (re.sub(r"[ \t]+", " ", line).rstrip() for line in text.split("\n"))
    return "\n".join(lines).strip("\n")


def content_text(content: bytes, fonts: dict[str, CMap]) -> str:
    out, font, y = _Writer(), None, None

    def number(v) -> float:
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else 0.0

    for op, args in operations(content):
        if op == "BT":
            y = None
        elif op in ("ET", "T*"):
            out.newline()
        elif op == "Tf" and len(args) >= 2 and isinstance(args[-2], Name):
            font = fonts.get(str(args[-2]))
        elif op in ("Tj", "'", '"'):
            if op != "Tj":
                out.newline()
            if args and isinstance(args[-1], bytes):
                out.write(decode_string(args[-1], font))
        elif op == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, bytes):
                    out.write(decode_string(part, font))
                elif number(part) < WORD_GAP:
                    out.space()
        elif op == "Tm" and len(args) >= 6:
            at = number(args[5])
            if y is not None and abs(at - y) > LINE_MOVE:
                out.newline()
            y = at
        elif op in ("Td", "TD") and len(args) >= 2 and number(args[1]):
            out.newline()
            if y is not None:
                y += number(args[1])
    return normalise("".join(out.parts))


def page_texts(doc: Document) -> list[str]:
    return [content_text(doc.contents(page), font_maps(doc, page)) for page in doc.pages()]
