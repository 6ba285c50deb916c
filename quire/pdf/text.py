"""Text runs of pages: an interpreter of content streams that keeps matrices and font widths."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat
from operator import add

from quire.pdf.names import ENCODINGS, char_of
from quire.pdf.objects import Document, Lexer, Name, Op, PdfError, Stream

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(a: tuple, b: tuple) -> tuple:
    """The affine map that does a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class _Moves(dict):
    """Values by code, worked out when first asked for."""

    def __init__(self, of: Callable[[int], float]):
        self.of = of

    def __missing__(self, code: int) -> float:
        out = self[code] = self.of(code)
        return out


@dataclass
class Font:
    wide: bool
    chars: dict[int, str]
    widths: dict[int, float]
    default: float
    held: dict[tuple, tuple[_Moves, _Moves]] = field(default_factory=dict, compare=False, repr=False)

    def moves(self, size: float, char: float, word: float, scale: float, a: float, b: float) -> tuple[_Moves, _Moves]:
        """How far each code moves in x and in y."""
        key = (size, char, word, scale, a, b)
        if key not in self.held:
            if len(self.held) >= 64:
                self.held.clear()
            width = lambda code: (self.widths.get(code, self.default) / 1000 * size + char + (word if code == 32 else 0)) * scale
            self.held[key] = _Moves(lambda code: width(code) * a), _Moves(lambda code: width(code) * b)
        return self.held[key]

    def codes(self, s: bytes) -> list[int]:
        return [int.from_bytes(s[k : k + 2], "big") for k in range(0, len(s), 2)] if self.wide else list(s)


def to_unicode(program: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode program."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", program, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block):
            out.setdefault(int(code, 16), text(to))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", program, re.S):
        for low, high, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high = int(low, 16), int(high, 16)
            items = re.findall(rb"<([0-9A-Fa-f]*)>", listed)
            for k in range(min(high - low, 0xFFFF) + 1):
                if to:
                    out.setdefault(low + k, text(b"%0*X" % (max(4, len(to)), int(to, 16) + k)))
                elif k < len(items):
                    out.setdefault(low + k, text(items[k]))
    return out


def read_font(doc: Document, d: dict) -> Font:
    program = doc.get(d.get("ToUnicode"))
    chars = to_unicode(doc.decode(program)) if isinstance(program, Stream) else {}
    if d.get("Subtype") == "Type0":
        inner = doc.get((doc.get(d.get("DescendantFonts")) or [{}])[0]) or {}
        widths: dict[int, float] = {}
        listed = [doc.get(x) for x in doc.get(inner.get("W")) or []]
        at = 0
        while at + 1 < len(listed):
            if isinstance(listed[at + 1], list):
                widths |= {listed[at] + k: float(doc.get(w)) for k, w in enumerate(listed[at + 1])}
                at += 2
            else:
                widths |= dict.fromkeys(range(listed[at], listed[at + 1] + 1), float(listed[at + 2]))
                at += 3
        return Font(True, chars, widths, float(doc.get(inner.get("DW")) or 1000))
    encoding = doc.get(d.get("Encoding"))
    named = doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
    base = dict(ENCODINGS.get(str(named), ENCODINGS["WinAnsiEncoding"]))
    if isinstance(encoding, dict):
        code = 0
        for x in doc.get(encoding.get("Differences")) or []:
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if char := char_of(str(x)):
                    base[code] = char
                code += 1
    first = doc.get(d.get("FirstChar")) or 0
    widths = {first + k: float(doc.get(w)) for k, w in enumerate(doc.get(d.get("Widths")) or [])}
    return Font(False, base | chars, widths, 500.0)


def _font(doc: Document, d: dict) -> Font:
    """read_font, once for each dictionary: pages share their fonts."""
    held = doc.fonts.get(id(d))
    if held is None or held[0] is not d:
        held = doc.fonts[id(d)] = (d, read_font(doc, d))
    return held[1]


def page_runs(doc: Document, page: dict) -> list[dict]:
    """Runs of a page in reading order: text, x, y, width, font_size, font; empty ones are left out."""
    runs: list[dict] = []
    contents = doc.get(page.get("Contents"))
    parts = contents if isinstance(contents, list) else [contents]
    data = b"\n".join(doc.decode(s) for p in parts if isinstance(s := doc.get(p), Stream))
    resources = doc.get(page.get("Resources")) or {}
    _interpret(doc, data, resources, IDENTITY, runs, 0)
    return [r | {"item_index": k} for k, r in enumerate(runs)]


def _interpret(doc: Document, data: bytes, resources: dict, ctm: tuple, runs: list[dict], depth: int) -> None:
    lex, stack, saved = Lexer(data), [], []
    fonts = doc.get(resources.get("Font")) or {}
    known: dict[str, Font] = {}
    s = {"ctm": ctm, "font": None, "name": "", "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0}
    tm = line = IDENTITY

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = times((1, 0, 0, 1, x, y), line)

    def show(pieces: list) -> None:
        nonlocal tm
        font = s["font"]
        if font is None:
            return
        start, text = tm, []
        for p in pieces:
            if isinstance(p, (int, float)):
                tm = times((1, 0, 0, 1, -p / 1000 * s["size"] * s["scale"], 0), tm)
            elif isinstance(p, bytes):
                codes, (a, b, c, d, x, y) = font.codes(p) if font.wide else p, tm
                text.extend(map(font.chars.get, codes, repeat("")))
                # a move along the line changes nothing but the place
                across, up = font.moves(s["size"], s["char"], 0 if font.wide else s["word"], s["scale"], a, b)
                tm = (a, b, c, d, reduce(add, map(across.__getitem__, codes), x), reduce(add, map(up.__getitem__, codes), y) if b else y)
        a, b = times(start, s["ctm"]), times(tm, s["ctm"])
        if joined := "".join(text):
            size = s["size"] * (a[2] ** 2 + a[3] ** 2) ** 0.5
            runs.append({"text": joined, "x": a[4], "y": a[5], "width": ((b[4] - a[4]) ** 2 + (b[5] - a[5]) ** 2) ** 0.5, "font_size": size, "font": s["name"]})

    while (x := lex.next()) is not None:
        if type(x) is not Op:
            stack.append(x)
            continue
        n = [float(v) for v in stack if isinstance(v, (int, float)) and not isinstance(v, bool)]
        try:
            if x == "q":
                saved.append(dict(s))
            elif x == "Q":
                s = saved.pop() if saved else s
            elif x == "cm":
                s["ctm"] = times(tuple(n[-6:]), s["ctm"])
            elif x == "BT":
                tm = line = IDENTITY
            elif x == "Tf":
                name = str(stack[-2])
                if name not in known:
                    known[name] = _font(doc, doc.get(fonts.get(name)) or {})
                s |= {"font": known[name], "name": name, "size": n[-1]}
            elif x in ("Tc", "Tw", "TL"):
                s[{"Tc": "char", "Tw": "word", "TL": "lead"}[x]] = n[-1]
            elif x == "Tz":
                s["scale"] = n[-1] / 100
            elif x in ("Td", "TD"):
                if x == "TD":
                    s["lead"] = -n[-1]
                move(n[-2], n[-1])
            elif x == "Tm":
                tm = line = tuple(n[-6:])
            elif x == "T*":
                move(0, -s["lead"])
            elif x == "Tj":
                show([stack[-1]])
            elif x == "TJ":
                show(stack[-1])
            elif x in ("'", '"'):
                if x == '"':
                    s |= {"word": n[-2], "char": n[-1]}
                move(0, -s["lead"])
                show([stack[-1]])
            elif x == "Do" and depth < 6:
                form = doc.get((doc.get(resources.get("XObject")) or {}).get(str(stack[-1])))
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                    m = tuple(float(doc.get(v)) for v in doc.get(form.info.get("Matrix")) or IDENTITY)
                    _interpret(doc, doc.decode(form), doc.get(form.info.get("Resources")) or resources, times(m, s["ctm"]), runs, depth + 1)
            elif x == "ID":
                end = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(data, lex.at)
                lex.at = end.end() if end else len(data)
        except (IndexError, TypeError, PdfError):
            pass  # an operator without its operands draws nothing
        stack = []


def page_images(doc: Document, page: dict) -> list[dict]:
    """Image objects of a page's resources with what compression asks of them."""
    out = []
    for name, ref in (doc.get((doc.get(page.get("Resources")) or {}).get("XObject")) or {}).items():
        x = doc.get(ref)
        if isinstance(x, Stream) and x.info.get("Subtype") == "Image":
            filters = [f for f, _ in doc.filters(x)]
            space = doc.get(x.info.get("ColorSpace"))
            space = doc.get(space[0]) if isinstance(space, list) and space else space
            out.append({"name": name, "width": doc.get(x.info.get("Width")) or 0, "height": doc.get(x.info.get("Height")) or 0, "bits": doc.get(x.info.get("BitsPerComponent")) or 8, "filter": filters[-1] if filters else "", "space": str(space or ""), "stored": len(x.raw), "is_mask": doc.get(x.info.get("ImageMask")) is True})
    return out
