"""Images of a page: placement boxes, colour spaces, PNG and TIFF wrapping, stitching."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .document import Document, undo_predictor
from .objects import Name, PdfError, Stream, operations

MAX_PIXELS = 100_000_000
_DEVICE = {"DeviceGray": "gray", "CalGray": "gray", "G": "gray", "DeviceRGB": "rgb", "CalRGB": "rgb", "RGB": "rgb", "DeviceCMYK": "cmyk", "CMYK": "cmyk"}
_STRIDE = {"gray": 1, "rgb": 3, "cmyk": 4}


def placements(content: bytes) -> list[tuple[str, tuple[float, float, float, float]]]:
    """(name, (x, y, w, h)) of every Do, from the transformation in force."""
    now, stack, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
    for op, args in operations(content):
        if op == "q":
            stack.append(now)
        elif op == "Q":
            now = stack.pop() if stack else now
        elif op == "cm" and len(args) >= 6:
            a, b, c, d, e, f = (float(v) if isinstance(v, int | float) else 0.0 for v in args[-6:])
            p, q, r, s, t, u = now
            now = (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)
        elif op == "Do" and args and isinstance(args[-1], Name):
            a, b, c, d, e, f = now
            xs, ys = (e, a + e, c + e, a + c + e), (f, b + f, d + f, b + d + f)
            out.append((str(args[-1]), (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))))
    return out


def cmyk_rgb(pixels: np.ndarray) -> np.ndarray:
    wide = 255 - pixels.astype(np.int32)
    return (wide[..., :3] * wide[..., 3:] // 255).astype(np.uint8)


def colour_space(doc: Document, value: object, depth: int = 0) -> tuple[str, str, np.ndarray | None]:
    """(kind, label, palette); kind is empty for spaces that can't be written."""
    value = doc.get(value)
    if isinstance(value, Name):
        return _DEVICE.get(value, ""), str(value), None
    if not isinstance(value, list) or not value or depth > 8:
        return "", "", None
    head = doc.name(value[0])
    if head == "ICCBased":
        if len(value) < 2 or not isinstance(doc.get(value[1]), Stream):
            return "", head, None
        n = doc.integer(doc.dictionary(value[1]).get("N"), 0)
        return {1: "gray", 3: "rgb", 4: "cmyk"}.get(n, ""), f"ICCBased (N={n})", None
    if head in ("Indexed", "I"):
        if len(value) < 4:
            return "", "Indexed", None
        kind, label, _ = colour_space(doc, value[1], depth + 1)
        high = doc.integer(value[2], 0)
        if not 0 <= high <= 255:
            return "", f"Indexed ({label}, hival={high})", None
        table = doc.get(value[3])
        try:
            raw = doc.decoded(table) if isinstance(table, Stream) else table
        except PdfError:
            raw = None
        step = _STRIDE.get(kind)
        if not isinstance(raw, bytes) or step is None:
            return "", f"Indexed ({label})", None
        if len(raw) < (high + 1) * step:
            return "", f"Indexed ({label}, short palette)", None
        entries = np.frombuffer(raw, np.uint8)[: (high + 1) * step].reshape(-1, step)
        palette = np.repeat(entries, 3, axis=1) if kind == "gray" else cmyk_rgb(entries) if kind == "cmyk" else entries
        return "indexed", f"Indexed ({label})", palette
    return _DEVICE.get(head, ""), head, None


def write_png(pixels: np.ndarray) -> bytes:
    """height x width (gray), x 3 (RGB) or x 4 (RGBA) bytes."""
    h, w = pixels.shape[:2]
    colour = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit gray, RGB or RGBA pixels of a PNG; anything else is an error."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise PdfError("no PNG")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6] or head[0] * head[1] > MAX_PIXELS:
        raise PdfError("PNG form is not supported")
    channels = {0: 1, 2: 3, 6: 4}[head[3]]
    raw = undo_predictor(zlib.decompress(packed), {"Predictor": 15, "Colors": channels, "BitsPerComponent": 8, "Columns": head[0]})
    pixels = np.frombuffer(raw, np.uint8).reshape(head[1], head[0], channels)
    return pixels[..., 0] if channels == 1 else pixels


def unpack_bits(raster: bytes, w: int, h: int, bits: int) -> np.ndarray:
    if bits not in (1, 2, 4, 8):
        raise PdfError(f"indexed at {bits} bits is not supported")
    line = (w * bits + 7) // 8
    if len(raster) < line * h:
        raise PdfError("raster is too short")
    rows = np.frombuffer(raster, np.uint8)[: line * h].reshape(h, line)
    if bits == 8:
        return rows
    shifts = np.arange(8 - bits, -1, -bits)
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(h, -1)[:, :w]


def raster_png(raster: bytes, w: int, h: int, bits: int, space: tuple[str, str, np.ndarray | None]) -> bytes:
    kind, label, palette = space
    if w <= 0 or h <= 0:
        raise PdfError(f"invalid dimensions {w}x{h}")
    if w * h > MAX_PIXELS:
        raise PdfError(f"dimensions {w}x{h} exceed {MAX_PIXELS} pixels")
    if not kind:
        raise PdfError(f'colour space "{label}" is not supported')
    if kind == "indexed":
        return write_png(palette[np.minimum(unpack_bits(raster, w, h, bits), len(palette) - 1)])
    if bits != 8:
        raise PdfError(f"{label} at {bits} bits is not supported")
    step = _STRIDE[kind]
    if len(raster) < w * h * step:
        raise PdfError("raster is too short")
    pixels = np.frombuffer(raster, np.uint8)[: w * h * step].reshape(h, w, step)
    return write_png(pixels[..., 0] if kind == "gray" else cmyk_rgb(pixels) if kind == "cmyk" else pixels)


def fax_tiff(payload: bytes, w: int, h: int, parms: dict) -> bytes:
    """One-strip TIFF around CCITT data."""
    columns = parms.get("Columns", w)
    if w <= 0 or h <= 0 or w * h > MAX_PIXELS or not isinstance(columns, int | float) or not 0 <= columns <= MAX_PIXELS:
        raise PdfError("CCITT dimensions are out of range")
    k = parms.get("K") if isinstance(parms.get("K"), int | float) else 0
    tags = [(256, 4, int(columns)), (257, 4, h), (258, 3, 1), (259, 3, 4 if k < 0 else 3), (262, 3, int(parms.get("BlackIs1") is True)), (273, 4, 8 + 2 + 9 * 12 + 4), (277, 3, 1), (278, 4, h), (279, 4, len(payload))]
    return b"II" + struct.pack("<HIH", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in tags) + struct.pack("<I", 0) + payload


def image_row(doc: Document, stream: Stream, name: str) -> dict:
    info = stream.info
    space = colour_space(doc, info.get("ColorSpace"))
    filters = doc.filters(stream)
    outer = filters[-1] if filters else ""
    w, h, bits = doc.integer(info.get("Width"), 0), doc.integer(info.get("Height"), 0), doc.integer(info.get("BitsPerComponent"), 8)
    row = {"name": name, "width": w, "height": h, "bpc": bits, "colorspace": space[1], "filter": outer}
    if outer in ("DCTDecode", "JPXDecode"):
        return row | {"ext": "jpg" if outer == "DCTDecode" else "jp2", "data": stream.data}
    if outer == "CCITTFaxDecode":
        parms = {k: doc.get(v) for k, v in doc.dictionary(info.get("DecodeParms")).items()}
        return row | {"ext": "tif", "data": fax_tiff(stream.data, w, h, parms)}
    if outer in ("FlateDecode", "LZWDecode", ""):
        return row | {"ext": "png", "data": raster_png(doc.decoded(stream), w, h, bits, space)}
    raise PdfError(f'unsupported filter "{outer}"')


def page_images(doc: Document, page: dict) -> tuple[list[dict], list[str]]:
    """Images in name order with the box of their first placement; what was skipped and why."""
    objects = doc.dictionary(doc.dictionary(page.get("Resources")).get("XObject"))
    boxes: dict[str, tuple] = {}
    try:
        for name, box in placements(doc.contents(page)):
            boxes.setdefault(name, box)
    except PdfError:
        pass
    out, skipped = [], []
    for name in sorted(objects, key=lambda n: n.encode()):
        stream = doc.get(objects[name])
        if not isinstance(stream, Stream) or doc.name(stream.info.get("Subtype")) != "Image":
            continue
        try:
            row = image_row(doc, stream, str(name))
        except (PdfError, ValueError, OverflowError) as e:
            skipped.append(f"{name}: {e}")
            continue
        out.append(row | dict(zip(("bbox_x", "bbox_y", "bbox_w", "bbox_h"), boxes.get(str(name), (0.0, 0.0, 0.0, 0.0)), strict=True)))
    return out, skipped


def stitch(parts: list[bytes], layout: str) -> bytes:
    """Panels in display order on one white canvas; only PNG panels can be read."""
    panels = []
    for data in parts:
        p = read_png(data)
        rgba = np.dstack([p, p, p]) if p.ndim == 2 else p
        if rgba.shape[2] == 4:
            alpha = rgba[..., 3:].astype(np.uint32)
            rgba = ((rgba[..., :3] * alpha + 255 * (255 - alpha)) // 255).astype(np.uint8)
        panels.append(rgba)
    down = layout == "vertical"
    h = sum(p.shape[0] for p in panels) if down else max(p.shape[0] for p in panels)
    w = max(p.shape[1] for p in panels) if down else sum(p.shape[1] for p in panels)
    canvas, at = np.full((h, w, 3), 255, np.uint8), 0
    for p in panels:
        if down:
            canvas[at : at + p.shape[0], : p.shape[1]] = p
        else:
            canvas[: p.shape[0], at : at + p.shape[1]] = p
        at += p.shape[0] if down else p.shape[1]
    return write_png(canvas)
