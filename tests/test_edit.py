"""Text edited where it is drawn: native, erased, painted over, squeezed and pushed."""

from __future__ import annotations

import pytest

from quire.pdf import edit
from quire.pdf.build import text_pdf
from quire.pdf.objects import Document, Name, Stream, Writer
from quire.pdf.text import page_runs


def page_of(body: bytes) -> bytes:
    """One page with a content of its own and a font of 500 wide characters."""
    w = Writer()
    tree = w.add(None)
    font = w.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 32, "Widths": [500] * 224})
    content = w.add(Stream({}, body))
    page = w.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 400, 200], "Resources": {"Font": {"F1": font}}, "Contents": content})
    w.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    return w.finish(w.add({"Type": Name("Catalog"), "Pages": tree}))


def runs(content: bytes) -> list[tuple]:
    doc = Document.open(content)
    return [(r["text"], round(r["x"], 3), round(r["y"], 3)) for p in doc.pages() for r in page_runs(doc, p)]


def test_inside_a_string_nothing_else_moves():
    content = page_of(b"BT /F1 10 Tf 20 100 Td (one two three) Tj (tail) Tj 0 -20 Td (two two) Tj ET")
    out, report = edit.replace_text(content, "two", "twenty")
    assert [r["method"] for r in report] == ["native"] * 3
    assert runs(out) == [("one twenty three", 20, 100), ("tail", 85, 100), ("twenty twenty", 20, 80)]
    assert runs(out)[1][1] == runs(content)[1][1]


def test_a_longer_text_is_squeezed_into_its_room():
    content = page_of(b"BT /F1 10 Tf 20 100 Td (ab) Tj ET BT /F1 10 Tf 1 0 0 1 50 100 Tm (next) Tj ET")
    out, report = edit.replace_text(content, "ab", "abcdefgh")
    assert report[0]["scale"] == pytest.approx((30 - 1.5) / 40)
    assert runs(out)[-1] == ("next", 50, 100)


def test_what_follows_on_the_line_is_pushed():
    content = page_of(b"BT /F1 10 Tf 1 0 0 1 20 100 Tm (ab) Tj ( tail) Tj ET BT 1 0 0 1 90 100 Tm (next) Tj ET BT 1 0 0 1 90 60 Tm (below) Tj ET")
    out, report = edit.replace_text(content, "ab", "abcd", "push")
    assert runs(out) == [("abcd", 20, 100), (" tail", 40, 100), ("next", 100, 100), ("below", 90, 60)]
    assert report[0]["moved"] == 6 and report[0]["method"] == "native"


def test_strings_placed_one_by_one():
    hopped = b"BT /F1 10 Tf 20 100 Td <41> Tj 6 0 Td <42> Tj 6 0 Td <43> Tj 10 0 Td (rest) Tj ET"
    same, report = edit.replace_text(page_of(hopped), "ABC", "XYZ")
    assert [t for t, _, _ in runs(same)] == ["X", "Y", "Z", "rest"] and [x for _, x, _ in runs(same)] == [20, 26, 32, 42]
    shorter, report = edit.replace_text(page_of(hopped), "ABC", "Q")
    assert [t for t, _, _ in runs(shorter)] == ["Q", "rest"] and runs(shorter)[1][1] == 42
    assert report[0]["method"] == "native"
    array = b"BT /F1 10 Tf 20 100 Td [(A) -100 (BC) 50 (D)] TJ ET"
    assert runs(edit.replace_text(page_of(array), "ABC", "longer")[0])[0][0] == "longerD"


def test_mixed_places_are_erased_and_drawn():
    mixed = b"BT /F1 12 Tf 20 100 Td (24) Tj 14 0 Td (6/) Tj 1 0 0 1 50 100 Tm (8) Tj ET BT 1 0 0 1 120 100 Tm (next) Tj ET"
    out, report = edit.replace_text(page_of(mixed), "246/8", "1")
    assert report[0]["method"] == "erase" and report[0]["note"] == "placed in mixed ways"
    assert runs(out) == [("next", 120, 100), ("1", 20, 100)]


def test_a_moving_operator_is_painted_over():
    out, report = edit.replace_text(page_of(b"BT /F1 10 Tf 14 TL 20 100 Td (skip) ' ET"), "skip", "new")
    assert [r["method"] for r in report] == ["overlay"]
    assert runs(out) == [("skip", 20, 86), ("new", 20, 86)]
    data = Document.open(out)
    assert b"re f" in data.decode(data.get(data.pages()[0]["Contents"]))


def test_a_character_the_font_lacks():
    out, report = edit.replace_text(page_of(b"BT /F1 10 Tf 20 100 Td (euro) Tj ET"), "euro", "Ω")
    assert report[0] == {"page": 1, "ordinal": 0, "method": "erase", "moved": 0, "scale": 1.0, "note": "the font lacks a character"}


def test_many_pages_keep_their_order_and_description():
    content = text_pdf([["the cat", "the the"], [], ["no"]], {"Title": "T"})
    out, report = edit.replace_text(content, "the", "a")
    assert [t for t, _, _ in runs(out)] == ["a cat", "a a", "no"]
    assert [(r["page"], r["ordinal"]) for r in report] == [(1, 0), (1, 1), (1, 2)]
    assert Document.open(out).info() == {"Title": "T"}
    assert runs(edit.replace_text(content, "absent", "x")[0]) == runs(content)


def test_pictures_become_pages(spark):
    import struct
    import zlib

    import numpy as np

    from quire.operators import documents as D
    from quire.pdf import images
    from quire.pdf.build import png

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = lambda colour, w=2, h=1, bits=8: chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0))
    start, end = b"\x89PNG\r\n\x1a\n", chunk(b"IEND", b"")
    clear = start + head(6) + chunk(b"IDAT", zlib.compress(b"\1" + bytes([10, 20, 30, 255, 5, 5, 5, 1]))) + end
    table = start + head(3) + chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", b"\x80") + chunk(b"IDAT", zlib.compress(b"\0\0\1")) + end
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"\1\x11\0\xff\xd9"
    body, alpha = images.picture(clear)
    assert zlib.decompress(body.raw) == bytes([10, 20, 30, 15, 25, 35]) and zlib.decompress(alpha.raw) == bytes([255, 0])
    body, alpha = images.picture(table)
    assert zlib.decompress(body.raw) == b"\0\1" and zlib.decompress(alpha.raw) == b"\x80\xff"
    assert (images.picture(jpeg)[0].info["Width"], images.picture(jpeg)[0].info["Height"], images.picture(jpeg)[0].raw) == (40, 30, jpeg)
    rows = spark.createDataFrame([(1, 2, bytearray(jpeg)), (1, 1, bytearray(png(50, 20, (1, 2, 3)))), (2, 1, bytearray(b"no picture")), (3, 1, None)], "job_id long, ord long, content binary")
    got = {r.job_id: r for r in D.images_to_pdf(rows).collect()}
    assert got[2].error == got[3].error == "E_CORRUPT" and got[1].error is None
    doc = Document.open(bytes(got[1].content))
    assert [doc.box(p) for p in doc.pages()] == [(50, 20), (40, 30)] and doc.info() == {"Producer": "quire", "Creator": "quire"}
    assert [(p["width_pt"], p["height_pt"]) for p in images.placements(doc)] == [(50, 20), (40, 30)]
    assert np.array_equal(images.samples(doc, images.placements(doc)[0]["key"]), np.broadcast_to(np.array([1, 2, 3], np.uint8), (20, 50, 3)))


def test_smaller_pictures_keep_their_mean():
    import numpy as np

    from quire.pdf.images import shrunk

    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (60, 90, 3), dtype=np.uint8)
    small = shrunk(pixels, 30, 20)
    want = pixels.reshape(20, 3, 30, 3, 3).mean(axis=(1, 3))
    assert small.shape == (20, 30, 3) and np.abs(small - want).max() <= 0.5
    odd = shrunk(pixels, 37, 41)
    assert odd.shape == (41, 37, 3) and abs(odd.mean() - pixels.mean()) < 1
    assert np.array_equal(shrunk(pixels, 90, 60), pixels)


def test_packed_and_fitted_documents():
    from quire.pdf.objects import assemble

    doc = Document.open(text_pdf([["one"], ["two", "lines"]], {"Title": "T"}))
    out = assemble([(doc, [1, 0], {})], doc.info(), [("mark", 0)], None, True)
    assert b"/ObjStm" in out and b"trailer" not in out
    assert [t for t, _, _ in runs(out)] == ["two", "lines", "one"] and Document.open(out).info() == {"Title": "T"}
    fit = Document.open(assemble([(doc, [0], {0: 90})], None, None, (595.28, 841.89)))
    assert fit.box(fit.pages()[0]) == (595.28, 841.89)
    # a page of 612 x 94 on its side: 94 wide, 612 high
    scale = min(595.28 / 94, 841.89 / 612)
    (run,) = page_runs(fit, fit.pages()[0])
    assert run["text"] == "one" and run["x"] == pytest.approx((595.28 - 94 * scale) / 2 + 54 * scale, abs=1e-3) and run["y"] == pytest.approx((612 - 40) * scale, abs=1e-2)


def test_saved_cancelled_and_counted(spark, tmp_path):
    import threading
    import time

    from quire.operators import documents as D
    from quire.operators import jobs

    rows = spark.createDataFrame([("a.pdf", bytearray(b"one")), ("b/c.pdf", bytearray(b"two")), ("e", None)], "name string, content binary")
    saved = {r.name: r for r in D.save_files(rows, f"file://{tmp_path}/out").collect()}
    assert {n: (tmp_path / "out" / n).read_bytes() for n in saved} == {"a.pdf": b"one", "b-c.pdf": b"two", "e": b""}
    assert len(list((tmp_path / "out").iterdir())) == 3
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: (time.sleep(30) or f for f in it), "id long")
    threading.Timer(3, lambda: jobs.cancel(spark, "job-1")).start()
    began = time.time()
    assert jobs.run_tagged(spark, "job-1", slow.count) == (None, "cancelled") and time.time() - began < 25
    assert jobs.run_tagged(spark, "job-2", spark.range(7).count) == (7, "done")
    items = spark.createDataFrame([(1, 1, "a cat, a dog"), (1, 2, "none"), (2, 1, "cat cat")], "file_id long, page int, text string")
    finder = jobs.Finder(items)
    assert {(r.file_id, r.page): r.matches for r in finder.counts("cat").collect()} == {(1, 1): 1, (2, 1): 2}
    assert finder.counts("cat") is finder.counts("cat")
    finder.close()
