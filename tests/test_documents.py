"""Binary documents: filters, damaged files, encryption, the data source, streaming presence over restarts."""

from __future__ import annotations

import zlib

import pytest

from quire.pdf import crypt
from quire.pdf.build import locked_pdf, text_pdf
from quire.pdf.objects import Document, Lexer, Name, PdfError, Ref, Stream, Writer, assemble, predict
from quire.pdf.text import page_runs, to_unicode


def texts(data: bytes) -> list[list[str]]:
    doc = Document.open(data)
    return [[r["text"] for r in page_runs(doc, p)] for p in doc.pages()]


PAGES = [["PAGE 1", "one"], ["PAGE 2"], [], ["PAGE 4 (ü)"]]


def test_write_and_read():
    data = text_pdf(PAGES, {"Title": "ไทย"})
    assert texts(data) == PAGES
    assert Document.open(data).info()["Title"] == "ไทย"


def test_damaged_table_is_rebuilt():
    data = text_pdf(PAGES).replace(b"startxref", b"startxxxx")
    assert texts(data) == PAGES
    with pytest.raises(PdfError):
        Document.open(b"%PDF-1.7 nothing")
    with pytest.raises(PdfError):
        Document.open(b"hello")


def test_assemble_order_rotation_outline():
    doc = Document.open(text_pdf(PAGES))
    out = assemble([(doc, [3, 0], {0: 90}), (doc, [0], {})], {"Author": "A"}, [("first", 0), ("second", 2)])
    assert texts(out) == [PAGES[3], PAGES[0], PAGES[0]]
    back = Document.open(out)
    assert back.pages()[1]["Rotate"] == 90
    top = back.get(back.get(back.trailer["Root"])["Outlines"])
    assert back.get(back.get(top["First"])["Next"])["Title"] == b"second"


def test_object_streams_and_xref_streams():
    w = Writer()
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 10 20]>>"]
    heads, body = [], b""
    for k, x in enumerate(inner, 1):
        heads.append(f"{k} {len(body)}")
        body += x + b" "
    head = (" ".join(heads) + " ").encode()
    packed = Stream({"Type": Name("ObjStm"), "N": 3, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + body))
    from quire.pdf.objects import serialise

    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n" + serialise(packed) + b"\nendobj\n"
    at5 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    table = b"".join(bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows)
    ahead = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(table[4 * k : 4 * k + 4], table[4 * k - 4 : 4 * k] if k else bytes(4))) for k in range(6))
    from quire.pdf.objects import Ref

    xref = Stream({"Type": Name("XRef"), "Size": 6, "W": [1, 2, 1], "Root": Ref(1), "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 4}}, zlib.compress(ahead))
    out += b"5 0 obj\n" + serialise(xref) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at5
    doc = Document.open(out)
    assert [doc.box(p) for p in doc.pages()] == [(10.0, 20.0)]
    assert w.objects == []


def test_predictors():
    plain = bytes((i * 7) % 251 for i in range(4 * 6 * 3))
    width, rows = 12, []
    before = bytes(width)
    for k in range(6):
        line, kind = plain[k * width : (k + 1) * width], k % 5
        left = bytes(3) + line[:-3]
        corner = bytes(3) + before[:-3]
        guess = {0: lambda a, b, c: 0, 1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: (a + b) // 2}.get(kind)
        if kind == 4:
            def guess(a, b, c):
                p = a + b - c
                return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        rows.append(bytes([kind]) + bytes((x - guess(a, b, c)) & 255 for x, a, b, c in zip(line, left, before, corner)))
        before = line
    assert predict(b"".join(rows), 15, 4, 3) == plain
    with pytest.raises(PdfError):
        predict(b"\x09" + bytes(12), 15, 4, 3)


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"[1 2 3]x", [[1, 2, 3], "x"]), (b"[ +1\n-2\t30 ]", [[1, -2, 30]]), (b"[]", [[]]), (b"[1 0 R 2 0 R]", [[Ref(1), Ref(2)]]), (b"[1 %c\n2]", [[1, 2]]), (b"[1\x002]", [[1, 2]]), (b"[5-3 1]", [["5-3", 1]]),
        (b"[1 [2 3] 4.5]", [[1, [2, 3], 4.5]]), (b"<41 4 2 43>", [b"ABC"]), (b"<4x1>", [b"A"]), (b"<414>", [b"A@"]), (b"/A#42 /C", ["AB", "C"]), (b"% c\n 007 ", [7]), (b" ", []),
    ],
)
def test_tokens(data, want):
    assert list(iter(Lexer(data).next, None)) == want


def test_filters():
    doc = Document(b"")
    stream = lambda name, raw: Stream({"Filter": Name(name)}, raw)
    assert doc.decode(stream("ASCIIHexDecode", b"48 65 6C6C 6F>")) == b"Hello"
    assert doc.decode(stream("ASCII85Decode", b"87cURDZ~>")) == b"Hello"
    assert doc.decode(stream("RunLengthDecode", bytes([1]) + b"ab" + bytes([254]) + b"c" + bytes([128]))) == b"abccc"
    assert doc.decode(stream("LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    with pytest.raises(PdfError):
        doc.decode(stream("JPXDecode", b""))


def test_tounicode_first_wins():
    program = b"beginbfchar <01> <0041> <01> <0042> endbfchar beginbfrange <10> <12> <0061> <20> <21> [<0031> <0032>] endbfrange"
    assert to_unicode(program) == {1: "A", 16: "a", 17: "b", 18: "c", 32: "1", 33: "2"}


def test_aes_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        out = crypt.cbc_encrypt(bytes(range(n)), bytes(16), plain)
        assert out.hex() == want
        assert crypt.cbc_decrypt(bytes(range(n)), bytes(16), out) == plain
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypt.aes_open(bytes(16), bytes(16)) == b""
    assert crypt.aes_open(bytes(16), bytes(32)) is None


@pytest.mark.parametrize(("v", "r", "size", "method"), [(1, 2, 5, "rc4"), (2, 3, 16, "rc4"), (4, 4, 16, "aes"), (4, 4, 16, "rc4"), (5, 5, 32, "aes"), (5, 6, 32, "aes")])
def test_unlock(v, r, size, method):
    data = locked_pdf(PAGES, {"Title": "geheim"}, "user", "owner", v, r, size, method)
    for password in ("user", "owner"):
        out, error, warning = crypt.unlock_document(data, password)
        assert (error, warning) == (None, None)
        assert texts(out) == PAGES
        assert Document.open(out).info()["Title"] == "geheim"
    assert crypt.unlock_document(data, "wrong")[1] == "E_WRONG_PASSWORD"


def test_ciphers_of_the_library_and_of_the_tables_agree(monkeypatch):
    data = bytes(k * k % 251 for k in range(5000))
    sizes = [(n, m) for n in (10, 16, 24, 32) for m in (0, 15, 16, 17, 4999)]
    work = lambda: [(crypt.cbc_encrypt(data[:n], data[7:23], data[:m]), crypt.cbc_decrypt(data[:n], data[7:23], bytearray(data[:m])), crypt.rc4(data[:n], data[:m])) for n, m in sizes] + [crypt.hardened(b"owner7", b"saltsalt", data[:48]), locked_pdf(PAGES, {"Title": "geheim"}, "user", "owner", 5, 6, 32, "aes")]
    fast = work()
    monkeypatch.setattr(crypt, "library", lambda: None)
    assert work() == fast


def test_the_hash_of_revision_6_leaves_blocks_to_the_library(monkeypatch):
    blocks, cipher = [0], crypt._cipher

    def counted(*a):
        blocks[0] += 1
        return cipher(*a)

    if crypt.library() is None:
        pytest.skip("no OpenSSL beside hashlib")
    monkeypatch.setattr(crypt, "_cipher", counted)
    data = locked_pdf(PAGES, {"Title": "geheim"}, "user", "owner", 5, 6, 32, "aes")
    assert texts(crypt.unlock_document(data, "owner")[0]) == PAGES
    assert blocks == [0]


def test_unlock_plain():
    data = text_pdf(PAGES)
    assert crypt.unlock_document(data, "") == (data, None, "W_NOTHING_CHANGED")


def test_data_source(spark, tmp_path):
    from quire.sources.pdf import register

    register(spark)
    for k in range(3):
        (tmp_path / f"{k}.pdf").write_bytes(text_pdf(PAGES[: k + 1]))
    (tmp_path / "bad.pdf").write_bytes(b"no")
    load = lambda view: spark.read.format("quire_pdf").option("view", view).load(str(tmp_path))
    assert load("pages").count() == 6
    assert sorted(r.text for r in load("runs").collect()) == sorted(["PAGE 1", "one"] * 3 + ["PAGE 2"] * 2)
    assert load("images").count() == 0
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "cut.pdf").write_bytes(b"%PDF-1.7 and nothing")
    assert {r.path.rpartition("/")[2]: r.error for r in load("errors").collect()} == {"bad.pdf": "E_NOT_PDF", "empty.pdf": "E_EMPTY_FILE", "cut.pdf": "E_CORRUPT"}
    assert load("pages").count() == 6


def test_presence_stream_goes_on_after_a_restart(spark, tmp_path):
    from quire.ship import ship
    from quire.streaming import presence as S

    ship(spark)
    source = tmp_path / "in"
    schema = "room string, id string, ms long, row_id long"
    spark.createDataFrame([("a", "x", 0, 1), ("a", "y", 10_000, 2)], schema).write.parquet(str(source))
    stream = lambda: S.online_stream(spark.readStream.schema(schema).parquet(str(source)))
    S.run_to_table(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame([("a", "z", 45_000, 3), ("a", "z", 60_000, 4)], schema).write.mode("append").parquet(str(source))
    rows = S.run_to_table(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.row_id, r.online) for r in rows.orderBy("row_id").collect()] == [(1, 1), (2, 2), (3, 2), (4, 1)]
