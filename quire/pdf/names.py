"""Names of glyphs and the base encodings of simple fonts, built from the names of Unicode characters."""

from __future__ import annotations

import re
import unicodedata

# Glyph names that do not follow from a character's name.
_ODD = {
    " ": "space", "!": "exclam", '"': "quotedbl", "#": "numbersign", "$": "dollar", "%": "percent", "&": "ampersand", "'": "quotesingle", "(": "parenleft", ")": "parenright", "*": "asterisk", "+": "plus", ",": "comma",
    "-": "hyphen", ".": "period", "/": "slash", ":": "colon", ";": "semicolon", "<": "less", "=": "equal", ">": "greater", "?": "question", "@": "at", "[": "bracketleft", "\\": "backslash", "]": "bracketright",
    "^": "asciicircum", "_": "underscore", "`": "grave", "{": "braceleft", "|": "bar", "}": "braceright", "~": "asciitilde", "€": "Euro", "‚": "quotesinglbase", "ƒ": "florin", "„": "quotedblbase", "…": "ellipsis",
    "†": "dagger", "‡": "daggerdbl", "ˆ": "circumflex", "‰": "perthousand", "‹": "guilsinglleft", "Œ": "OE", "‘": "quoteleft", "’": "quoteright", "“": "quotedblleft", "”": "quotedblright", "•": "bullet", "–": "endash",
    "—": "emdash", "˜": "tilde", "™": "trademark", "›": "guilsinglright", "œ": "oe", "¡": "exclamdown", "¢": "cent", "£": "sterling", "¤": "currency", "¥": "yen", "¦": "brokenbar", "§": "section", "¨": "dieresis",
    "©": "copyright", "ª": "ordfeminine", "«": "guillemotleft", "¬": "logicalnot", "®": "registered", "¯": "macron", "°": "degree", "±": "plusminus", "´": "acute", "µ": "mu", "¶": "paragraph", "·": "periodcentered",
    "¸": "cedilla", "º": "ordmasculine", "»": "guillemotright", "×": "multiply", "÷": "divide", "Æ": "AE", "æ": "ae", "Ð": "Eth", "ð": "eth", "Þ": "Thorn", "þ": "thorn", "ß": "germandbls",
}
_MARKS = {"DIAERESIS": "dieresis", "RING ABOVE": "ring", "STROKE": "slash"}


def _name(char: str) -> str | None:
    """The glyph name of a character: odd ones, then letters with their mark, digits by their word."""
    if char in _ODD:
        return _ODD[char]
    said = unicodedata.name(char, "")
    if m := re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z])(?: WITH ([A-Z ]+))?", said):
        letter = m[2] if m[1] == "CAPITAL" else m[2].lower()
        return letter + (_MARKS.get(m[3], m[3].lower()) if m[3] else "")
    if said.startswith("DIGIT "):
        return said[6:].lower()
    return None


_WIN = {b: c for b in range(32, 256) if (c := bytes([b]).decode("cp1252", "ignore"))}
#: Characters by glyph name.
GLYPHS: dict[str, str] = {n: c for c in reversed(_WIN.values()) if (n := _name(c))}
#: Characters by code. The upper halves of the standard and the Mac encoding are not carried: text in them brings a ToUnicode map.
ENCODINGS: dict[str, dict[int, str]] = {
    "WinAnsiEncoding": _WIN,
    "StandardEncoding": {b: c for b, c in _WIN.items() if b < 0xA0} | {0x27: "’", 0x60: "‘"},
    "MacRomanEncoding": {b: c for b, c in _WIN.items() if b < 0x80},
    "PDFDocEncoding": _WIN,
}


def char_of(name: str) -> str | None:
    """What a glyph name stands for: listed, one letter, uniXXXX, uXXXX to uXXXXXX; else what stands before a dot."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})(?:[0-9A-Fa-f]{4})*", name):
        return chr(int(m[1], 16))
    if (m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name)) and int(m[1], 16) <= 0x10FFFF:
        return chr(int(m[1], 16))
    return char_of(name[: name.index(".")]) if name.find(".") > 0 else None
