"""Images of documents: where they are drawn and how large, their samples, smaller ones in their place, and pages made of pictures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quire.pdf.objects import Document, Lexer, Name, Op, PdfError, Ref, Stream, Writer, predict, text_string
from quire.pdf.text import IDENTITY, times

#: Forms inside forms that are followed.
DEEPEST = 6
#: What a replaced image keeps: its role on the page, not how its bytes are packed.
ROLE = ("Type", "Subtype", "Name", "SMask", "Mask", "Intent", "Interpolate", "StructParent")
DESCRIPTION = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")
A4, LETTER = (595.28, 841.89), (612.0, 792.0)
APP = "quire"


def placements(doc: Document) -> list[dict]:
    """Every drawing of an image object: key (object number), page (from 1), ord, width_pt, height_pt."""
    out: list[dict] = []
    for number, page in enumerate(doc.pages(), 1):
        contents = doc.get(page.get("Contents"))
        for part in contents if isinstance(contents, list) else [contents]:
            if isinstance(s := doc.get(part), Stream):
                _scan(doc, doc.decode(s), doc.get(page.get("Resources")) or {}, IDENTITY, number, out, 0)
    return [row | {"ord": k} for k, row in enumerate(out)]


def _scan(doc: Document, data: bytes, resources: dict, ctm: tuple, page: int, out: list[dict], depth: int) -> None:
    if depth > DEEPEST:
        return
    lex, operands, saved = Lexer(data), [], []
    drawn = doc.get(resources.get("XObject")) or {}
    while (x := lex.next()) is not None:
        if type(x) is not Op:
            operands.append(x)
            continue
        if x == "q":
            saved.append(ctm)
        elif x == "Q":
            ctm = saved.pop() if saved else ctm
        elif x == "cm" and len(operands) >= 6 and all(isinstance(v, (int, float)) for v in operands[-6:]):
            ctm = times(tuple(map(float, operands[-6:])), ctm)
        elif x == "Do" and operands and isinstance(operands[-1], Name):
            ref = drawn.get(str(operands[-1]))
            thing = doc.get(ref)
            kind = doc.get(thing.info.get("Subtype")) if isinstance(thing, Stream) else None
            if kind == "Image" and isinstance(ref, Ref):
                out.append({"key": ref.num, "page": page, "width_pt": float(np.hypot(ctm[0], ctm[1])), "height_pt": float(np.hypot(ctm[2], ctm[3]))})
            elif kind == "Form":
                own = [doc.get(v) for v in doc.get(thing.info.get("Matrix")) or []]
                inner = times(tuple(float(v or 0) for v in own), ctm) if len(own) == 6 else ctm
                _scan(doc, doc.decode(thing), doc.get(thing.info.get("Resources")) or resources, inner, page, out, depth + 1)
        elif x == "ID":
            end = data.find(b"EI", lex.at)
            lex.at = len(data) if end < 0 else end + 2
        operands = []


def objects(doc: Document) -> list[dict]:
    """Every image object of a document with what compression asks of it."""
    streams = {num: s for num in sorted(doc.places) if isinstance(s := doc.get(Ref(num)), Stream)}
    masks = {v.num for s in streams.values() for k in ("SMask", "Mask") if isinstance(v := s.info.get(k), Ref)}
    out = []
    for num, s in streams.items():
        width, height = doc.get(s.info.get("Width")) or 0, doc.get(s.info.get("Height")) or 0
        if doc.get(s.info.get("Subtype")) != "Image" or width <= 0 or height <= 0:
            continue
        filters = doc.filters(s)
        colour, components = colour_of(doc, s)
        out.append({
            "key": num, "width": int(width), "height": int(height), "bits": int(doc.get(s.info.get("BitsPerComponent")) or 0), "filter": filters[-1][0] if filters else "", "colour": colour, "components": components,
            "stored": len(s.raw), "is_mask": doc.get(s.info.get("ImageMask")) is True, "is_mask_target": num in masks, "sample_tricks": isinstance(s.info.get("Decode"), list) or isinstance(s.info.get("Mask"), list),
        })
    return out


def colour_of(doc: Document, stream: Stream) -> tuple[str, int]:
    """The kind of an image's colours and the samples of a pixel."""
    space = doc.get(stream.info.get("ColorSpace"))
    name = str(doc.get(space[0]) if isinstance(space, list) and space else space or "")
    if name == "ICCBased":
        profile = doc.get(space[1]) if len(space) > 1 else None
        n = doc.get(profile.info.get("N")) if isinstance(profile, Stream) else 0
        return {1: ("gray", 1), 3: ("rgb", 3), 4: ("cmyk", 4)}.get(n, ("other", 0))
    known = {"DeviceGray": ("gray", 1), "CalGray": ("gray", 1), "G": ("gray", 1), "DeviceRGB": ("rgb", 3), "CalRGB": ("rgb", 3), "RGB": ("rgb", 3), "DeviceCMYK": ("cmyk", 4), "CMYK": ("cmyk", 4), "Indexed": ("indexed", 1)}
    return known.get(name, ("other", 0))


def samples(doc: Document, num: int) -> np.ndarray | None:
    """height x width x components of an 8-bit gray or RGB image; None if its samples cannot be had."""
    s = doc.get(Ref(num))
    _, n = colour_of(doc, s)
    width, height = doc.get(s.info.get("Width")), doc.get(s.info.get("Height"))
    if doc.get(s.info.get("BitsPerComponent")) != 8 or n not in (1, 3) or any(p.get("Predictor") == 2 for _, p in doc.filters(s)):
        return None
    try:
        data = doc.decode(s)
    except (PdfError, zlib.error):
        return None
    if len(data) < width * height * n:
        return None
    return np.frombuffer(data, np.uint8, width * height * n).reshape(height, width, n)


def shrunk(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mean of each target pixel's area."""
    out = pixels.astype(np.float64)
    for axis, want in ((0, height), (1, width)):
        have = out.shape[axis]
        if want >= have:
            continue
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        edge = np.arange(want + 1) * have / want
        low = np.minimum(edge.astype(int), have - 1)
        shape = [1] * out.ndim
        shape[axis] = -1
        at = np.take(sums, low, axis) + np.take(out, low, axis) * (edge - low).reshape(shape)
        out = np.diff(at, axis=axis) * want / have
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def recoded(doc: Document, num: int, width: int, height: int) -> Stream | None:
    """The image in its target size, deflated, in the role it had; None if its samples cannot be had."""
    pixels = samples(doc, num)
    if pixels is None:
        return None
    small = shrunk(pixels, width, height)
    old = doc.get(Ref(num)).info
    raw = zlib.compress(small.tobytes(), 9)
    space = "DeviceGray" if small.shape[2] == 1 else "DeviceRGB"
    return Stream({k: old[k] for k in ROLE if k in old} | {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": small.shape[1], "Height": small.shape[0], "BitsPerComponent": 8, "ColorSpace": Name(space), "Filter": Name("FlateDecode")}, raw)


def without_description(doc: Document) -> dict[int, object]:
    """Changes that take title, author and programs out of a document's description."""
    ref = doc.trailer.get("Info")
    info = doc.get(ref)
    return {ref.num: {k: v for k, v in info.items() if k not in DESCRIPTION}} if isinstance(ref, Ref) and isinstance(info, dict) else {}


# Pictures to pages


def picture(data: bytes) -> tuple[Stream, Stream | None]:
    """A JPEG or PNG file as an image object, and its transparency as another. JPEG data stays as it is; so does that of PNG without transparency."""
    if data.startswith(b"\xff\xd8"):
        return _jpeg(data), None
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(data)
    raise PdfError("neither JPEG nor PNG")


def _image(width: int, height: int, space: object, bits: int, raw: bytes, **more: object) -> Stream:
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": space, "BitsPerComponent": bits} | more, raw)


def _jpeg(data: bytes) -> Stream:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise PdfError("damaged JPEG")
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD7:
            at += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            bits, height, width, n = struct.unpack(">BHHB", data[at + 4 : at + 10])
            space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(n)
            if space is None:
                raise PdfError("JPEG of unknown colours")
            more = {"Decode": [1, 0] * 4} if n == 4 else {}
            return _image(width, height, Name(space), bits, data, Filter=Name("DCTDecode"), **more)
        at += 2 + size
    raise PdfError("JPEG without a frame")


def _png(data: bytes) -> tuple[Stream, Stream | None]:
    at, parts, palette, clear = 8, [], b"", None
    head = None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        at += 12 + size
    if head is None or head[6]:
        raise PdfError("no PNG that can be read")
    width, height, bits, colour, *_ = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    packed = b"".join(parts)
    if n is None:
        raise PdfError("PNG of unknown colours")
    space = [Name("Indexed"), Name("DeviceRGB"), len(palette) // 3 - 1, palette] if colour == 3 else Name("DeviceGray" if n < 3 else "DeviceRGB")
    if colour < 4 and not (colour == 3 and clear):
        more = {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 15, "Colors": n, "BitsPerComponent": bits, "Columns": width}}
        return _image(width, height, space, bits, packed, **more), None
    if bits != 8:
        raise PdfError("transparency of other than 8 bits")
    raw = np.frombuffer(predict(zlib.decompress(packed), 15, width, n, 8), np.uint8).reshape(height, width, n)
    if colour == 3:
        table = np.full(256, 255, np.uint8)
        table[: len(clear)] = np.frombuffer(clear, np.uint8)[:256]
        body, alpha = raw, table[raw]
    else:
        body, alpha = raw[:, :, :-1], raw[:, :, -1:]
    deflated = lambda x: zlib.compress(np.ascontiguousarray(x).tobytes(), 9)
    mask = _image(width, height, Name("DeviceGray"), 8, deflated(alpha), Filter=Name("FlateDecode"))
    return _image(width, height, space, 8, deflated(body), Filter=Name("FlateDecode")), mask


def pictures_pdf(files: list[bytes], size: str, margin_mm: float) -> bytes:
    """A page for each picture: as large as it (fit-image), or a4 or letter with the picture as large as fits, centred."""
    w, margin = Writer(), max(0.0, margin_mm) * 72 / 25.4
    tree, kids = w.add(None), []
    for data in files:
        image, mask = picture(data)
        if mask is not None:
            image.info["SMask"] = w.add(mask)
        ref, width, height = w.add(image), image.info["Width"], image.info["Height"]
        if size == "fit-image":
            pw, ph, scale = width + 2 * margin, height + 2 * margin, 1.0
        else:
            pw, ph = A4 if size == "a4" else LETTER
            scale = min((pw - 2 * margin) / width, (ph - 2 * margin) / height)
        x, y = (pw - width * scale) / 2, (ph - height * scale) / 2
        body = w.add(Stream({}, f"q {width * scale:.6f} 0 0 {height * scale:.6f} {x:.6f} {y:.6f} cm /Im Do Q".encode()))
        kids.append(w.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, float(pw), float(ph)], "Resources": {"XObject": {"Im": ref}}, "Contents": body}))
    w.objects[tree.num - 1] = {"Type": Name("Pages"), "Kids": list(kids), "Count": len(kids)}
    info = w.add({k: text_string(APP) for k in ("Producer", "Creator")})
    return w.finish(w.add({"Type": Name("Catalog"), "Pages": tree}), info)
