"""PDF files as DataFrames: a file is one row of the binary source, a page or an image one row out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import TOLERANCE
from ..operators.figures import BOX, panel_groups
from .pdfdoc.document import MAX_FILE, Document
from .pdfdoc.images import page_images, stitch
from .pdfdoc.text import page_texts

PAGES = "path string, page int, text string, error string"
IMAGES = "path string, page int, ord long, name string, width int, height int, bpc int, colorspace string, filter string, ext string, data binary, bbox_x double, bbox_y double, bbox_w double, bbox_h double, error string"
#: The columns of a manifest.
MANIFEST = ["file", "page", "name", "width", "height", "bpc", "colorspace", "filter", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under ``path``; a file above the cap has no content and becomes a row with an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= MAX_FILE).select("path", "length", "content")
    # a scan of its own, so that the contents of these are not read
    large = found.where(F.col("length") > MAX_FILE).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _files(batches):
    for batch in batches:
        for path, length, content in zip(*batch.columns, strict=True):
            yield path.as_py(), length.as_py(), content.as_py()


def _document(length: int | None, content: bytes | None) -> Document:
    if content is None:
        raise ValueError(f"file too large: {length} bytes (max {MAX_FILE})" if length and length > MAX_FILE else "file has no content")
    return Document(content)


def _parts(files: DataFrame) -> DataFrame:
    length = F.col("length") if "length" in files.columns else F.octet_length("content").cast("long")
    return files.select("path", length.alias("length"), "content")


def _pages(batches):
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])
    for path, length, content in _files(batches):
        try:
            rows = [{"path": path, "page": i, "text": text.encode("utf-8", "replace").decode()} for i, text in enumerate(page_texts(_document(length, content)), 1)]
        except Exception as e:  # a hostile file is an error row, not a lost task
            rows = [{"path": path, "error": str(e) or type(e).__name__}]
        yield _rows(rows, schema)


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, text, error); a file that can't be read is one row with its error."""
    return _parts(files).mapInArrow(_pages, PAGES)


_COLUMNS = [c.split()[0] for c in IMAGES.split(", ")]


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _images(batches):
    schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in IMAGES.split(", ")])
    for path, length, content in _files(batches):
        rows, n = [], 0
        try:
            doc = _document(length, content)
            for i, page in enumerate(doc.pages(), 1):
                found, skipped = page_images(doc, page)
                for row in found:
                    rows.append({"path": path, "page": i, "ord": n} | row)
                    n += 1
                rows += [{"path": path, "page": i, "error": why} for why in skipped]
        except Exception as e:
            rows.append({"path": path, "error": str(e) or type(e).__name__})
        yield _rows(rows, schema)


def pdf_images(files: DataFrame) -> DataFrame:
    """One row per image; images and files that were skipped are rows with an error and no data."""
    return _parts(files).mapInArrow(_images, IMAGES)


def _whole_pages(batches: list[pa.RecordBatch], tol: float):
    """Sorted rows of whole pages in; the figures of several panels as one row, all other rows as they came."""
    table = pa.Table.from_batches(batches)
    pages: dict[tuple, list[int]] = {}
    met: dict[tuple, int] = {}
    for i, image in enumerate(zip(*[table[c].to_pylist() for c in ("path", "page", "ord")], strict=True)):
        # the rows of a file that is there twice are two pages, not one with twice the panels
        met[image] = met.get(image, 0) + 1
        pages.setdefault((*image[:2], met[image]), []).append(i)
    boxes = list(zip(*[table[c].to_pylist() for c in BOX], strict=True))
    parts: set[int] = set()
    made = []
    for rows in pages.values():
        for group, layout in panel_groups([boxes[i] for i in rows], tol) if len(rows) > 1 else ():
            members = [rows[i] for i in group]
            row = _stitched([table.slice(i, 1).to_pylist()[0] for i in members], layout)
            if row is not None:
                made.append(row)
                parts.update(members)
    if parts:
        table = table.filter(pa.array([i not in parts for i in range(len(table))]))
    yield from table.to_batches()
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=table.schema)


def _stitched(panels: list[dict], layout: str) -> dict | None:
    """One image of the panels of a figure; none if one of them can't be decoded."""
    down = layout == "vertical"
    panels = sorted(panels, key=lambda p: (-p["bbox_y"] if down else p["bbox_x"], p["ord"]))
    try:
        data = stitch([p["data"] for p in panels], layout)
    except Exception:
        return None
    x, y = (min(p[c] for p in panels) for c in ("bbox_x", "bbox_y"))
    w, h = (max(p[a] + p[b] for p in panels) for a, b in (("bbox_x", "bbox_w"), ("bbox_y", "bbox_h")))
    wide, tall = (max, sum) if down else (sum, max)
    size = {"width": wide(p["width"] for p in panels), "height": tall(p["height"] for p in panels)}
    return panels[0] | size | {"name": "+".join(p["name"] for p in panels), "bpc": 8, "colorspace": "stitched", "filter": "stitched", "ext": "png", "data": data, "bbox_x": x, "bbox_y": y, "bbox_w": w - x, "bbox_h": h - y}


def _stitching(tol: float):
    def run(batches):
        held, last = [], None  # the rows of the page that may go on in the next batch
        for batch in batches:
            at = list(zip(batch["path"].to_pylist(), batch["page"].to_pylist(), strict=True))
            if not at:
                continue
            start = len(at) - 1
            while start and at[start - 1] == at[-1]:
                start -= 1
            if start or at[0] != last:
                if whole := [b for b in (*held, batch.slice(0, start)) if b.num_rows]:
                    yield from _whole_pages(whole, tol)
                held = []
            held.append(batch.slice(start))
            last = at[-1]
        if held:
            yield from _whole_pages(held, tol)

    return run


def stitched_images(images: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Adjacent panels as one PNG each; groups with a panel that can't be decoded stay as they are.

    ``images`` is read once: its rows meet by page, sorted, and a task holds one batch and one page at a time.
    """
    paged = images.where("error is null").select(*_COLUMNS).repartition("path", "page").sortWithinPartitions("path", "page", "ord")
    return paged.mapInArrow(_stitching(tol), IMAGES)


def image_manifest(images: DataFrame) -> DataFrame:
    """The manifest rows of images: file name and properties, never bytes."""
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    file = F.concat(base, F.format_string("-p%04d-", "page"), "name", F.lit("."), "ext")
    boxes = [F.format_string("%.2f", c).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]
    return images.where("error is null").select("path", "ord", file.alias("file"), "page", "name", "width", "height", "bpc", "colorspace", "filter", *boxes)
