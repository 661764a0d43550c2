"""Small PDF files for tests and sample queries."""

from __future__ import annotations

import zlib


def assemble(objects: dict[int, bytes], root: int = 1) -> bytes:
    """Number objects, write a classic cross-reference table."""
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n in sorted(objects):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n"
    at, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00000 f \n"
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, at))


def stream(data: bytes, info: bytes = b"", pack: bool = True) -> bytes:
    if pack:
        data, info = zlib.compress(data), info + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n" % (len(data), info) + data + b"\nendstream"


def pdf_of(number: int, text: str) -> bytes:
    """Two pages: two lines of text; a caption and two gray panels, which touch if ``number`` is divisible by ten."""
    low = 20 if number % 10 == 0 else 0
    line = text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("latin-1", "replace")
    first = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (Order %d) Tj 1 0 0 1 50 680 Tm [(prio) 20 (rity) -300 (%s)] TJ ET" % (number, line)
    second = b"q 100 0 0 50 10 70 cm /Im0 Do Q q 100 0 0 50 10 %d cm /Im1 Do Q BT /F1 12 Tf (Figure %d-1. Panels) Tj ET" % (low, number)
    image = b"/Type /XObject /Subtype /Image /Width 4 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray"
    return assemble(
        {
            1: b"<< /Type /Catalog /Pages 2 0 R >>",
            2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>",
            3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 7 0 R >> >> >>",
            4: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F1 7 0 R >> /XObject << /Im0 8 0 R /Im1 9 0 R >> >> >>",
            5: stream(first),
            6: stream(second),
            7: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
            8: stream(bytes(range(0, 80, 10)), image),
            9: stream(bytes(range(100, 180, 10)), image),
        }
    )
