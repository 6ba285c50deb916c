"""Small documents for tests and queries: pages of text lines, plain or locked with a password."""

from __future__ import annotations

import hashlib
import struct
import zlib

from quire.pdf import crypt
from quire.pdf.objects import Name, Ref, Stream, Writer, text_string


def text_pdf(pages: list[list[str]], info: dict[str, str] | None = None, size: float = 12.0, finish: bool = True):
    """A page for each list of lines; a line is one run, 14 points below the one before, from (40, height - 40)."""
    w = Writer()
    tree = w.add(None)
    font = w.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 32, "Widths": [500] * 224})
    kids = []
    for lines in pages:
        height = 80 + 14 * max(1, len(lines))
        body = b"BT /F1 %g Tf 40 %d Td 14 TL\n" % (size, height - 40)
        body += b"".join(b"<" + line.encode("cp1252", "replace").hex().encode() + b"> Tj T*\n" for line in lines) + b"ET"
        content = w.add(Stream({}, body))
        kids.append(w.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, height], "Resources": {"Font": {"F1": font}}, "Contents": content}))
    w.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": list(kids), "Count": len(kids)}
    root = w.add({"Type": Name("Catalog"), "Pages": tree})
    ref = w.add({k: text_string(v) for k, v in info.items()}) if info else None
    return w.finish(root, ref) if finish else (w, root, ref)


def locked_pdf(pages: list[list[str]], info: dict[str, str], user: str, owner: str, v: int, r: int, size: int, method: str) -> bytes:
    """text_pdf under the standard handler. method: rc4 or aes. Salts and vectors come from the passwords."""
    w, root, ref = text_pdf(pages, info, finish=False)
    doc_id = hashlib.md5(user.encode() + b"/" + owner.encode()).digest()
    seed = lambda k: hashlib.sha256(doc_id + bytes([k])).digest()
    lock = crypt.Lock(v, r, size, b"", b"", b"", b"", -3904, True, doc_id, method, method)
    if v == 5:
        key, zero = seed(1), bytes(16)
        digest = crypt.hardened if r == 6 else lambda p, salt, own=b"": hashlib.sha256(p + salt + own).digest()
        lock.u = digest(user.encode(), seed(2)[:8]) + seed(2)[:16]
        lock.ue = crypt.cbc_encrypt(digest(user.encode(), seed(2)[8:16]), zero, key)
        lock.o = digest(owner.encode(), seed(3)[:8], lock.u) + seed(3)[:16]
        lock.oe = crypt.cbc_encrypt(digest(owner.encode(), seed(3)[8:16], lock.u), zero, key)
    else:
        inner = (user.encode("latin-1") + crypt.PAD)[:32]
        own = crypt.owner_key(lock, owner.encode("latin-1"))
        for k in range(20 if r >= 3 else 1):
            inner = crypt.rc4(bytes(b ^ k for b in own), inner)
        lock.o = inner
        key = crypt.file_key(lock, user.encode("latin-1"))
        lock.u = (crypt.user_check(lock, key) + bytes(32))[:32]

    def close(data: bytes, num: int, k: int) -> bytes:
        okey = crypt.object_key(lock, key, Ref(num), method)
        if method == "rc4":
            return crypt.rc4(okey, data)
        pad = 16 - len(data) % 16
        iv = seed(16 + k % 200)[:16]
        return iv + crypt.cbc_encrypt(okey, iv, data + bytes([pad]) * pad)

    def walk(x, num: int):
        if isinstance(x, bytes):
            return close(x, num, num)
        if isinstance(x, list):
            return [walk(y, num) for y in x]
        if isinstance(x, dict):
            return {k: walk(y, num) for k, y in x.items()}
        return Stream(walk(x.info, num), close(x.raw, num, num)) if isinstance(x, Stream) else x

    w.objects = [walk(x, k) for k, x in enumerate(w.objects, 1)]
    entry = {"Filter": Name("Standard"), "V": v, "R": r, "Length": size * 8, "O": lock.o, "U": lock.u, "P": lock.permissions}
    if v >= 4:
        entry |= {"CF": {"StdCF": {"CFM": Name("V2" if method == "rc4" else "AESV3" if v == 5 else "AESV2"), "Length": size}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    if v == 5:
        entry |= {"OE": lock.oe, "UE": lock.ue, "Perms": bytes(16)}
    return w.finish(root, ref, {"Encrypt": w.add(entry), "ID": [doc_id, doc_id]})


def png(width: int, height: int, rgb: tuple[int, int, int]) -> bytes:
    """A truecolour PNG of one colour."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = (b"\0" + bytes(rgb) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_pdf(kind: int, value: int, wide: float) -> bytes:
    """A page with one raw image of one value: 0 RGB drawn twice, 1 gray inside a form, 2 too small, 3 with its samples turned round."""
    w = Writer()
    tree, font_free = w.add(None), {"Type": Name("XObject"), "Subtype": Name("Image"), "BitsPerComponent": 8}
    width, height, n = [(220, 200, 3), (300, 250, 1), (100, 100, 1), (200, 200, 3)][kind]
    info = font_free | {"Width": width, "Height": height, "ColorSpace": Name("DeviceRGB" if n == 3 else "DeviceGray")}
    image = w.add(Stream(info | ({"Decode": [1, 0] * 3} if kind == 3 else {}), bytes([value]) * (width * height * n)))
    drawn = {"Im": image}
    body = {0: b"q %g 0 0 90 20 20 cm /Im Do Q q 10 0 0 10 0 0 cm /Im Do Q" % wide, 1: b"q 144 0 0 144 10 10 cm /Fm Do Q", 2: b"q 0 50 -50 0 80 0 cm /Im Do Q", 3: b"q 60 0 0 -60 0 90 cm /Im Do Q"}[kind]
    if kind == 1:
        form = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 1, 1], "Matrix": [0.5, 0, 0, 0.5, 0, 0], "Resources": {"XObject": {"Im": image}}}
        drawn = {"Fm": w.add(Stream(form, b"/Im Do"))}
    page = w.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 400, 300], "Resources": {"XObject": drawn}, "Contents": w.add(Stream({}, body))})
    w.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    described = w.add({k: text_string(v) for k, v in (("Title", "picture"), ("Author", "someone"))})
    return w.finish(w.add({"Type": Name("Catalog"), "Pages": tree}), described)
