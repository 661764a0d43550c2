"""PDF objects and their lexer.  Numbers are floats or ints, names are Name, strings bytes, null None."""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_DEPTH = 256
SPACE = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_STRING_PART = re.compile(rb"[()\\]")


class PdfError(Exception):
    pass


class Name(str):
    __slots__ = ()


class Word(str):
    """A bare keyword or content-stream operator."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    info: dict
    data: bytes


def skip(data: bytes, at: int) -> int:
    return _SKIP.match(data, at).end()


def literal_string(data: bytes, at: int) -> tuple[bytes, int]:
    """``at`` is just behind the opening parenthesis."""
    out, depth = bytearray(), 1
    while True:
        hit = _STRING_PART.search(data, at)
        if not hit:
            return bytes(out + data[at:]), len(data)
        out += data[at : hit.start()]
        at, what = hit.end(), hit[0]
        if what == b"(":
            depth += 1
            out += what
        elif what == b")":
            depth -= 1
            if not depth:
                return bytes(out), at
            out += what
        else:
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            nxt = data[at : at + 1]
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif nxt == b"\r" or nxt == b"\n":
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out += _ESCAPE.get(nxt, nxt)
                at += len(nxt)


def hex_string(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b">", at)
    end = len(data) if end < 0 else end
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1


def name_at(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))


def parse(data: bytes, at: int, refs: bool = True, depth: int = 0) -> tuple[object, int]:
    """One object (or Word) at ``at`` and the place behind it.  ``refs`` off: content streams, where "1 0 R" means nothing."""
    if depth > MAX_DEPTH:
        raise PdfError("objects are nested too deeply")
    at = skip(data, at)
    lead = data[at : at + 1]
    if not lead:
        raise PdfError("end of data")
    if lead == b"/":
        hit = _NAME.match(data, at)
        return name_at(hit[1]), hit.end()
    if lead == b"(":
        return literal_string(data, at + 1)
    if data.startswith(b"<<", at):
        out, at = {}, at + 2
        while True:
            at = skip(data, at)
            if data.startswith(b">>", at) or at >= len(data):
                return out, at + 2
            key, at = parse(data, at, refs, depth + 1)
            if not isinstance(key, Name):
                continue
            at = skip(data, at)
            if data.startswith(b">>", at):
                return out, at + 2
            out[key], at = parse(data, at, refs, depth + 1)
    if lead == b"<":
        return hex_string(data, at + 1)
    if lead == b"[":
        items, at = [], at + 1
        while True:
            at = skip(data, at)
            if at >= len(data) or data[at : at + 1] == b"]":
                return items, at + 1
            item, at = parse(data, at, refs, depth + 1)
            items.append(item)
    if refs and (hit := _REF.match(data, at)):
        return Ref(int(hit[1]), int(hit[2])), hit.end()
    if hit := _NUMBER.match(data, at):
        return (float(hit[0]) if b"." in hit[0] else int(hit[0])), hit.end()
    if hit := _WORD.match(data, at):
        word = hit[0].decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(word, Word(word)), hit.end()
    return Word(lead.decode("latin-1")), at + 1


def operations(content: bytes):
    """(operator, operands) of a content stream; broken bytes are skipped."""
    at, operands = 0, []
    while (at := skip(content, at)) < len(content):
        try:
            item, at = parse(content, at, refs=False)
        except PdfError:
            at += 1
            continue
        if isinstance(item, Word):
            yield str(item), operands
            operands = []
        else:
            operands.append(item)
