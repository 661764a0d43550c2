import pytest
from pyspark.sql import functions as F

from sagalog.functions import textclean as tc
from sagalog.model import InvalidArgument
from sagalog.operators import captions, figures
from sagalog.sources import samples
from sagalog.sources.manifest import read_manifest, write_manifest
from sagalog.sources.pdfdoc import images as im
from sagalog.sources.pdfdoc.document import Document, inflate, undo_predictor
from sagalog.sources.pdfdoc.objects import PdfError, operations, parse
from sagalog.sources.pdfdoc.text import content_text, parse_cmap, win_ansi
from sagalog.sources.pdfs import image_manifest, pdf_files, pdf_images, pdf_pages, stitched_images

HEAD = "<!-- page 1 -->\n\n"
CLEAN = [
    ("15\n-\nта", "15-та"),
    ("Ростов\n-\nна\n-\nДону", "Ростов-на-Дону"),
    ("see [\n3\n] there", "see [3] there"),
    ("1,5\n–\n1,8", "1,5–1,8"),
    ("Рисунок 3\n\n–\n\nКомплекс", "Рисунок 3 – Комплекс"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("one\n\f\ntwo", "one\n\n<!-- page 2 -->\n\ntwo"),
    ("one\ftwo\fthree", "one\n\n<!-- page 2 -->\n\ntwo\n\n<!-- page 3 -->\n\nthree"),
    ("end\n\f\n-\n\fstart", "end-start"),
    ("  padded \n", "padded"),
    ("", ""),
]


def test_clean(spark):
    got = spark.createDataFrame(CLEAN, "raw string, want string").select(tc.clean(F.col("raw")).alias("g"), "want").collect()
    for r in got:
        assert r["g"] == HEAD + r["want"] + "\n"
    assert spark.range(1).select(tc.clean(F.lit(None).cast("string")).alias("g")).first()["g"] is None


def test_captions(spark):
    cases = [("Figure 4-2. Text", "Figure 4-2"), ("see Figure 4-2", None), ("Figure 4-2, text", None), ("Рис. 2.1.", "Рис. 2.1"), ("Рисунок 5", "Рисунок 5"), ("Мал. 4.2 – x", "Мал. 4.2"), ("Схема №5", "Схема №5"), ("Схема 12:", "Схема 12"), ("Table 4-1", "Table 4-1"), ("Table 4", None)]
    for r in spark.createDataFrame(cases, "line string, want string").select("want", tc.caption_label(F.col("line")).alias("g")).collect():
        assert r["g"] == r["want"]


def test_link_images(spark):
    docs = spark.createDataFrame([(1, "<!-- page 1 -->\n\nFigure 1-1. A\n<!-- page 2 -->\nFigure 2-1\nFigure 2-2\n"), (2, "no captions"), (3, "Figure 9-9")], "k int, text string")
    manifest = spark.createDataFrame([(1, 1, 0, "a.png"), (1, 2, 5, "c.png"), (1, 2, 9, "d.png"), (3, 2, 0, "x.png")], "k int, page int, ord int, file string")
    got = {r["k"]: r["text"] for r in captions.link_images(docs, "k", manifest, "img").collect()}
    assert got[1] == "<!-- page 1 -->\n\n![Figure 1-1](img/a.png)\n\nFigure 1-1. A\n<!-- page 2 -->\n![Figure 2-1](img/c.png)\n\nFigure 2-1\n![Figure 2-2](img/d.png)\n\nFigure 2-2\n"
    assert got[2] == "no captions" and got[3] == "Figure 9-9"


def test_paths(spark):
    cases = [("../out.tif", False), ("pics/../../up.tif", False), ("/srv/data/x.tif", False), ("one.tif", True), ("pics/deep/two.tif", True), ("doc-A+B.tif", True), ("", False), ("pics/..", True), ("pics/../../pics/x.tif", False)]
    for r in spark.createDataFrame(cases, "p string, want boolean").select("p", "want", tc.is_local_path(F.col("p")).alias("g")).collect():
        assert r["g"] == r["want"], r
    joined = spark.createDataFrame([("x/../y.tif",), ("./z.tif",), ("v//w.tif",)], "p string").select(tc.join_path("out/./plates", F.col("p")).alias("g")).collect()
    assert [r["g"] for r in joined] == ["out/plates/y.tif", "out/plates/z.tif", "out/plates/v/w.tif"]


def test_page_range():
    assert tc.page_range() is None and tc.page_range(9) == (9, 9) and tc.page_range(6, "11-12") == (6, 6) and tc.page_range(pages="8-8") == (8, 8) and tc.page_range(pages="2-13") == (2, 13)
    for bad in ("12", "13-2", "0", "0-6", "b-6", "6-b", "6-", "-6", "1-2-3", "2.5-6", " 2-6", "2 - 6", "٢-٣", "-"):
        with pytest.raises(InvalidArgument):
            tc.page_range(pages=bad)
    with pytest.raises(InvalidArgument):
        tc.page_range(-4)


BOX = "page int, ord long, name string, bbox_x double, bbox_y double, bbox_w double, bbox_h double"


def boxes(spark, rows):
    return spark.createDataFrame([(p, i, f"Im{i}", float(x), float(y), float(w), float(h)) for i, (p, x, y, w, h) in enumerate(rows)], BOX)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(2, 31, 610, 250, 70), (2, 31, 540.5, 250, 70), (2, 31, 470.9, 250, 70)], [("vertical", "Im0+Im1+Im2")]),
        ([(2, 31, 640, 250, 70), (2, 31, 90, 250, 70)], [("", "Im0"), ("", "Im1")]),
        ([(2, 65, 330, 60, 44), (2, 5, 330, 60, 44), (2, 125, 330, 60, 44)], [("horizontal", "Im1+Im0+Im2")]),
        ([(2, 31, 610, 250, 70), (3, 31, 540, 250, 70)], [("", "Im0"), ("", "Im1")]),
        ([(2, 0, 0, 0, 0), (2, 0, 0, 0, 0)], [("", "Im0"), ("", "Im1")]),
    ],
)
def test_figures(spark, rows, want):
    got = figures.figures(boxes(spark, rows), ["page"]).orderBy("page", "group_id").collect()
    assert [(r["layout"], r["stitched_name"]) for r in got] == want


def test_adjacent_pairs_agree_with_all_pairs(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.randrange(4), rnd.choice([0, 1.5, 10, 100, -3]), rnd.choice([0, 50, 51, 100.5, -50]), rnd.choice([100, 0, 99]), rnd.choice([50, 51])) for _ in range(60)]
    b = boxes(spark, rows)
    from sagalog.functions.geometry import adjacency

    left = b.select("page", *[F.col(c).alias(f"a_{c}") for c in ("ord", *figures.BOX)])
    right = b.select("page", *[F.col(c).alias(f"b_{c}") for c in ("ord", *figures.BOX)])
    brute = left.join(right, "page").where("a_ord < b_ord and a_bbox_w != 0 and b_bbox_w != 0").withColumn("layout", adjacency("a_", "b_")).where("layout is not null")
    want = {(r["page"], r["a_ord"], r["b_ord"], r["layout"]) for r in brute.collect()}
    got = [tuple(r) for r in figures.adjacent_pairs(b, ["page"]).collect()]
    assert set(got) == want and len(got) == len(want) > 3


def test_panel_groups_agree_with_figures(spark):
    import random

    rnd = random.Random(5)
    rows = [(p, rnd.choice([0, 1.5, 10, 100, -3, 110]), rnd.choice([0, 50, 51, 100.5, -50, 102]), rnd.choice([100, 100, 0, 99]), rnd.choice([50, 51, 1])) for p in range(40) for _ in range(rnd.randrange(1, 9))]
    want = {(r["page"], r["stitched_name"], r["layout"]) for r in figures.figures(boxes(spark, rows), ["page"]).where("n_parts > 1").collect()}
    got = set()
    for p in range(40):
        own = [(i, r[1:]) for i, r in enumerate(rows) if r[0] == p]
        for places, layout in figures.panel_groups([tuple(map(float, box)) for _, box in own]):
            order = sorted((own[k] for k in places), key=lambda o: (-o[1][1] if layout == "vertical" else o[1][0], o[0]))
            got.add((p, "+".join(f"Im{i}" for i, _ in order), layout))
    assert got == want and {x[2] for x in want} == {"vertical", "horizontal"}


def test_panel_groups_of_copies():
    stack = [(31.0, 610.0 - 70 * (i % 3), 250.0, 70.0) for i in range(60_000)]
    assert figures.panel_groups(stack) == [(list(range(60_000)), "vertical")]
    thin, odd = (5.0, 5.0, 9.0, 1.0), float("nan")
    assert figures.panel_groups([thin, thin]) == [([0, 1], "vertical")]
    assert figures.panel_groups([(odd, 5.0, 9.0, 1.0), thin, (None, 5.0, 9.0, 1.0), (5.0, float("inf"), 9.0, 1.0), (5.0, 5.0, None, 1.0)]) == []


# --- PDF ---


def test_parse():
    assert parse(b"<< /A 1 /B [1.5 (x\\)y\\101) <4142>] /C 3 0 R /D#20E true >>", 0)[0] == {"A": 1, "B": [1.5, b"x)yA", b"AB"], "C": parse(b"3 0 R", 0)[0], "D E": True}
    with pytest.raises(PdfError):
        parse(b"[" * 400, 0)
    assert list(operations(b"1 0 0 1 5 6 cm /Im0 Do % note\n(a) Tj")) == [("cm", [1, 0, 0, 1, 5, 6]), ("Do", ["Im0"]), ("Tj", [b"a"])]


def test_content_text():
    fonts = {"F1": {0x0041: "Я", 1: "fi"}}
    assert content_text(b"BT /F1 9 Tf (\x00A\x01x) Tj ET", fonts) == "Яfix"
    assert content_text(b"BT (a) Tj 0 -12 Td (b) Tj [(c) -50 (d) -200 (e)] TJ T* (f) ' ET", {}) == "a\nbcd e\nf"
    assert content_text(b"BT 1 0 0 1 0 700 Tm (a) Tj 1 0 0 1 0 699.5 Tm (b) Tj 1 0 0 1 0 650 Tm (c) Tj ET", {}) == "ab\nc"


def test_cmap():
    data = b"beginbfchar <20> <0020> <0003> <00660069> endbfchar beginbfrange <0041> <0043> <0430> <50> <51> [<0041> <D83DDE00>] endbfrange"
    got = parse_cmap(data)
    assert got == {0x20: " ", 3: "fi", 0x41: "а", 0x42: "б", 0x43: "в", 0x50: "A", 0x51: "😀"}
    assert win_ansi()[0x80] == "€" and win_ansi()[0x81] == "\x81" and win_ansi()[65] == "A"


def test_predictors():
    rows = [[10, 20, 30], [11, 22, 33]]
    for mode, coded in ((0, rows), (1, [[10, 10, 10], [11, 11, 11]]), (2, [[10, 20, 30], [1, 2, 3]]), (3, [[10, 15, 20], [6, 7, 7]]), (4, [[10, 10, 10], [1, 2, 3]])):
        data = b"".join(bytes([mode, *r]) for r in coded)
        out = undo_predictor(data, {"Predictor": 15, "Columns": 3})
        if mode in (0, 1, 2, 4):
            assert out == bytes(sum(rows, [])), mode
    with pytest.raises(PdfError):
        undo_predictor(b"\x07abc", {"Predictor": 12, "Columns": 3})
    with pytest.raises(PdfError):
        inflate(samples.zlib.compress(b"0" * 5000), 100)


def test_png_round_trip_and_stitch():
    import numpy as np

    a = np.arange(12, dtype=np.uint8).reshape(2, 6)
    assert (im.read_png(im.write_png(a)) == a).all()
    rgb = np.dstack([a, a + 1, a + 2])
    assert (im.read_png(im.write_png(rgb)) == rgb).all()
    both = im.read_png(im.stitch([im.write_png(a), im.write_png(rgb)], "vertical"))
    assert both.shape == (4, 6, 3) and (both[2:] == rgb).all()
    with pytest.raises(PdfError):
        im.stitch([b"\xff\xd8jpeg"], "vertical")
    assert im.unpack_bits(b"\xb4", 4, 1, 2).tolist() == [[2, 3, 1, 0]]
    assert im.fax_tiff(b"xyz", 8, 2, {"K": -1}).startswith(b"II*\x00")


def test_object_streams_and_xref_streams():
    inner = b"<< /Type /Pages /Kids [3 0 R] /Count 1 >> << /Type /Page /Parent 2 0 R /Contents 5 0 R >>"
    first = b"2 0 3 42 "
    pack = samples.stream(first + inner, b"/Type /ObjStm /N 2 /First %d" % len(first))
    body, places = bytearray(b"%PDF-1.5\n"), {}
    for n, obj in {1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: pack, 5: samples.stream(b"BT (packed) Tj ET")}.items():
        places[n] = len(body)
        body += b"%d 0 obj\n" % n + obj + b"\nendobj\n"
    at = len(body)
    rows = {0: (0, 0, 0), 1: (1, places[1], 0), 2: (2, 4, 0), 3: (2, 4, 1), 4: (1, places[4], 0), 5: (1, places[5], 0), 6: (1, at, 0)}
    table = b"".join(bytes([k]) + p.to_bytes(4, "big") + bytes([g]) for k, p, g in rows.values())
    body += b"6 0 obj\n" + samples.stream(table, b"/Type /XRef /W [1 4 1] /Size 7 /Root 1 0 R") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    doc = Document(bytes(body))
    assert len(doc.pages()) == 1 and doc.contents(doc.pages()[0]) == b"BT (packed) Tj ET"


def test_hostile_files(spark, tmp_path):
    good = samples.pdf_of(10, "x (y)")
    loop = samples.assemble({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: b"<< /Length 4 0 R >>\nstream\nBT (z) Tj ET\nendstream"})
    for name, data in {"a.pdf": good, "b.pdf": b"nothing", "c.pdf": b"%PDF-1.4\nstartxref\n99999999\n", "d.pdf": loop, "e.pdf": good[: len(good) // 2]}.items():
        (tmp_path / name).write_bytes(data)
    files = pdf_files(spark, str(tmp_path))
    rows = {(r["path"].rsplit("/", 1)[1], r["page"]): (r["text"], r["error"]) for r in pdf_pages(files).collect()}
    assert rows["a.pdf", 1] == ("Order 10\npriority x (y)", None) and rows["b.pdf", None][1] == "no PDF header" and rows["e.pdf", None][1]
    assert rows["d.pdf", 1][0] == "z"
    found = pdf_images(files).where("error is null")
    assert [(r["name"], r["bbox_x"], r["bbox_y"], r["bbox_w"], r["bbox_h"]) for r in found.orderBy("ord").collect()] == [("Im0", 10, 70, 100, 50), ("Im1", 10, 20, 100, 50)]
    whole = stitched_images(pdf_images(files)).collect()
    assert [(r["name"], r["width"], r["height"], r["filter"]) for r in whole] == [("Im0+Im1", 4, 4, "stitched")]
    assert im.read_png(bytes(whole[0]["data"])).shape == (4, 4, 3)
    lines = image_manifest(found)
    write_manifest(lines, str(tmp_path / "m.tsv"))
    back = read_manifest(spark, str(tmp_path / "m.tsv")).orderBy("ord").collect()
    assert [(r["page"], r["ord"], r["file"]) for r in back] == [(2, 0, "a-p0002-Im0.png"), (2, 1, "a-p0002-Im1.png")]


def test_stitching_reads_images_once(spark):
    """One pass and no join: nothing to broadcast, no second parse, nothing left in the cache; pages go on across batches."""
    from sagalog.plans.catalog import QUERIES

    docs = spark.createDataFrame([(f"/{k}.pdf", samples.pdf_of(k, "x")) for k in [*range(1, 42), 10]], "path string, content binary")
    jpeg = {"path": "/j", "page": 1, "width": 1, "height": 1, "bpc": 8, "colorspace": "DeviceRGB", "filter": "DCTDecode", "ext": "jpg", "data": b"\xff\xd8", "bbox_x": 1.0, "bbox_w": 9.0, "bbox_h": 9.0}
    found = pdf_images(docs)
    odd = [jpeg | {"ord": i, "name": f"Im{i}", "bbox_y": 1.0 + 9 * i} for i in range(2)]
    found = found.unionByName(spark.createDataFrame([tuple(r.get(c) for c in found.columns) for r in odd], found.schema))
    cached = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "3")
        out = stitched_images(found)
        rows = sorted((r["path"], r["name"], r["height"], r["ord"]) for r in out.collect())
    finally:
        spark.conf.set(size, before)
    # the file that is there twice gives two figures; panels that can't be decoded stay apart
    want = [(f"/{k}.pdf", "Im0+Im1", 4, 0) for k in (10, 10, 20, 30, 40)] + [(f"/{k}.pdf", f"Im{i}", 2, i) for k in range(1, 42) if k % 10 for i in (0, 1)]
    assert rows == sorted(want + [("/j", "Im0", 1, 0), ("/j", "Im1", 1, 1)])
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == cached
    plan = QUERIES["pdf_images"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InMemoryTableScan" not in plan and plan.count("FileScan") == 1


def test_manifest_refuses(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("file\tpage\n a\t1\n")
    (tmp_path / "y.tsv").write_text("file\tpage\tname\textra\n../a\t1\tIm0\tq\n")
    (tmp_path / "z.tsv").write_text("file\tpage\tname\na\tone\tIm0\n")
    for name in "xyz":
        with pytest.raises(InvalidArgument):
            read_manifest(spark, str(tmp_path / f"{name}.tsv"))


def test_files_above_the_cap_are_rows(spark, tmp_path, monkeypatch):
    from sagalog.sources import pdfs, samples

    (tmp_path / "small.pdf").write_bytes(samples.pdf_of(3, "low"))
    (tmp_path / "large.pdf").write_bytes(samples.pdf_of(4, "low") + b"\n%" + b"x" * 50_000)
    monkeypatch.setattr(pdfs, "MAX_FILE", 20_000)
    files = pdfs.pdf_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert got["large.pdf"]["content"] is None and got["large.pdf"]["length"] > 50_000 and got["small.pdf"]["content"] is not None
    bad = [r["path"] for r in pdfs.pdf_pages(files).where("error is not null").collect()]
    assert len(bad) == 1 and bad[0].endswith("large.pdf")
    assert pdfs.pdf_images(files).where("error is not null and page is null").count() == 1


def test_hyphen_chains(spark):
    cases = [("Alt\n-\nStadt", "Alt-Stadt"), ("a\n-\nb\n-\nc\n-\nd", "a-b-c-d"), ("x \n - \n y", "x-y"), ("-\nz", "-\nz"), ("1\n-\n2", "1-2"), ("p.\n-\nq", "p.\n-\nq")]
    for r in spark.createDataFrame(cases, "t string, want string").select("want", tc.rejoin(F.col("t")).alias("g")).collect():
        assert r["g"] == r["want"]
