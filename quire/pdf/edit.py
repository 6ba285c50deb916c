"""Editing text where it is drawn: the marks of a page's content, matches in them, and the ways to change them.

A mark is one character code as it is painted: which string holds it, where it lies, and what placed it. An edit is
native (codes of the same font in the same strings), an erasure with the new text drawn in its place, or the new text
over a patch. Strings keep their advance: whatever a native edit takes from the pen or adds to it is given back as
spacing in the same string, so nothing else on the page moves unless it is meant to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.pdf.objects import Document, Hex, Lexer, Name, Op, PdfError, Ref, Stream, rewrite
from quire.pdf.text import IDENTITY, Font, read_font, times

#: Operators that set the pen outright, that move it from the line's start, and that leave it alone between two strings.
SETTERS = frozenset(("Tm", "BT", "T*"))
MOVERS = frozenset(("Td", "TD"))
NEUTRAL = frozenset("Tj TJ ET Tf q Q cm Tc Tw Tz TL Ts gs rg g k cs scn sc".split())


@dataclass
class Piece:
    """A token of a content stream: its value and its bytes' span."""

    value: object
    start: int
    end: int


@dataclass
class Mark:
    font: str
    size: float
    code: int
    piece: int
    slot: int
    x: float
    y: float
    placed_by: int
    placed_op: str


@dataclass
class Match:
    first: int
    last: int
    font: str


@dataclass
class Outcome:
    method: str
    moved: int = 0
    scale: float = 1.0
    note: str | None = None


@dataclass
class Plan:
    """Byte edits (start, end, new bytes), and what they come to."""

    edits: list[tuple[int, int, bytes]] = field(default_factory=list)
    error: str | None = None
    scale: float = 1.0
    grew: float = 0.0


def pieces_of(data: bytes) -> list[Piece]:
    """Tokens with their spans; arrays are opened, inline images skipped."""
    lex, out = Lexer(data), []
    while True:
        lex.skip()
        at = lex.at
        if at >= len(data):
            return out
        if data[at : at + 1] in (b"[", b"]"):
            lex.at = at + 1
            out.append(Piece(Op(data[at : at + 1].decode()), at, at + 1))
            continue
        value = lex.next()
        out.append(Piece(value, at, lex.at))
        if type(value) is Op and value == "ID":
            end = data.find(b"EI", lex.at)
            while end >= 0 and not (data[end - 1 : end].isspace() and (end + 2 == len(data) or data[end + 2 : end + 3].isspace())):
                end = data.find(b"EI", end + 2)
            lex.at = len(data) if end < 0 else end + 2


def _is(piece: Piece, *ops: str) -> bool:
    return type(piece.value) is Op and piece.value in ops


def marks_of(pieces: list[Piece], fonts: dict[str, Font]) -> list[Mark]:
    """Every code that is painted, in painting order. Fonts that are not known count as two-byte codes without width."""
    out: list[Mark] = []
    state = {"font": "", "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0}
    ctm, saved, pen, line = IDENTITY, [], IDENTITY, IDENTITY
    placed, op = -1, ""
    unknown = Font(True, {}, {}, 0.0)
    operands: list[int] = []

    def number(back: int) -> float:
        value = pieces[operands[-back]].value if len(operands) >= back else 0
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else 0.0

    def step(x: float, y: float) -> None:
        nonlocal line, pen
        line = pen = times((1, 0, 0, 1, x, y), line)

    def paint(k: int) -> None:
        nonlocal pen
        font = fonts.get(state["font"], unknown)
        a, b, _, _, e, f = times(pen, ctm)  # the pen moves along (a, b) on the page
        far, size = 0.0, state["size"]
        for slot, code in enumerate(font.codes(pieces[k].value)):
            out.append(Mark(state["font"], size, code, k, slot, e + far * a, f + far * b, placed, op))
            far += (font.widths.get(code, font.default) / 1000 * size + state["char"] + (state["word"] if code == 32 and not font.wide else 0)) * state["scale"]
        pen = times((1, 0, 0, 1, far, 0), pen)

    for k, piece in enumerate(pieces):
        if type(piece.value) is not Op or piece.value in "[]":
            operands.append(k)
            continue
        name = str(piece.value)
        if name == "q":
            saved.append((ctm, dict(state)))
        elif name == "Q" and saved:
            ctm, state = saved.pop()
        elif name == "cm":
            ctm = times(tuple(number(6 - i) for i in range(6)), ctm)
        elif name == "BT":
            pen = line = IDENTITY
        elif name == "Tf" and len(operands) > 1:
            state |= {"font": str(pieces[operands[-2]].value), "size": number(1)}
        elif name in ("Tc", "Tw", "TL"):
            state[{"Tc": "char", "Tw": "word", "TL": "lead"}[name]] = number(1)
        elif name == "Tz":
            state["scale"] = number(1) / 100
        elif name in MOVERS:
            if name == "TD":
                state["lead"] = -number(1)
            step(number(2), number(1))
        elif name == "Tm":
            line = pen = tuple(number(6 - i) for i in range(6))
        elif name in ("T*", "'", '"'):
            if name == '"':
                state |= {"word": number(3), "char": number(2)}
            step(0, -state["lead"])
        if name in SETTERS or name in MOVERS or name in ("'", '"'):
            placed, op = k, name
        if name in ("Tj", "TJ", "'", '"'):
            for j in operands:
                value = pieces[j].value
                if isinstance(value, bytes):
                    paint(j)
                elif name == "TJ" and isinstance(value, (int, float)):
                    pen = times((1, 0, 0, 1, -value / 1000 * state["size"] * state["scale"], 0), pen)
        operands = []
    return out


def matches(marks: list[Mark], name: str, font: Font, needle: str) -> list[Match]:
    """Where the characters of one font's marks read as needle; both ends must be whole marks."""
    text, owner = [], []
    for k, mark in enumerate(marks):
        if mark.font == name:
            char = font.chars.get(mark.code, "")
            text.append(char)
            owner += [k] * len(char)
    joined, out, at = "".join(text), [], 0
    while needle and (at := joined.find(needle, at)) >= 0:
        end = at + len(needle)
        whole = (at == 0 or owner[at - 1] != owner[at]) and (end == len(joined) or owner[end] != owner[end - 1])
        if whole and _together([marks[k] for k in dict.fromkeys(owner[at:end])], font):
            out.append(Match(owner[at], owner[end - 1], name))
            at = end
        else:
            at += 1
    return out


def _together(run: list[Mark], font: Font) -> bool:
    """Marks on one line, each less than a space or so after the one before."""
    for a, b in zip(run, run[1:]):
        gap = b.x - a.x - font.widths.get(a.code, font.default) / 1000 * a.size
        if abs(b.y - a.y) > max(1.0, 0.35 * a.size) or a.piece != b.piece and abs(gap) > 0.6 * a.size:
            return False
    return True


def _hex(codes: list[int], font: Font) -> bytes:
    return b"<" + b"".join(b"%0*X" % (4 if font.wide else 2, c) for c in codes) + b">"


def _num(x: float) -> bytes:
    out = f"{x:.6f}".rstrip("0").rstrip(".")
    return (out if out not in ("", "-0") else "0").encode()


def spell(font: Font, text: str) -> list[int] | None:
    """The codes of a text, the least code of each character; None if one is missing."""
    first: dict[str, int] = {}
    for code in sorted(font.chars, reverse=True):
        first[font.chars[code]] = code
    codes = [first.get(c) for c in text]
    return None if None in codes else codes


def separator(pieces: list[Piece], a: int, b: int) -> str:
    """How the content gets from one string to the next: relative, absolute, none or unknown."""
    for k in range(a + 1, b):
        if type(pieces[k].value) is not Op or pieces[k].value in "[]":
            continue
        name = str(pieces[k].value)
        if name in SETTERS:
            return "absolute"
        if name in MOVERS:
            flat = isinstance(pieces[k - 1].value, (int, float)) and pieces[k - 1].value == 0 and isinstance(pieces[k - 2].value, (int, float))
            return "relative" if flat else "unknown"
        if name not in NEUTRAL:
            return "unknown"
    return "none"


def _shown_by(pieces: list[Piece], k: int) -> str:
    """The operator that paints the string at k."""
    return next((str(pieces[j].value) for j in range(k + 1, len(pieces)) if type(pieces[j].value) is Op and pieces[j].value not in "[]"), "")


def native(pieces: list[Piece], marks: list[Mark], match: Match, font: Font, new: str, room: float | None = None, give_back: bool = True) -> Plan:
    """Edits that put `new` where the match is drawn, within `room` (text space), in the same font and strings."""
    codes = spell(font, new)
    if codes is None:
        return Plan(error="the font lacks a character")
    run = [m for m in marks[match.first : match.last + 1] if m.font == match.font]
    if len(run) != match.last - match.first + 1:
        return Plan(error="text of other fonts lies in between")
    size = run[0].size or 1.0
    if any(m.size != run[0].size for m in run):
        return Plan(error="the size changes inside")
    wide = lambda c: font.widths.get(c, font.default) / 1000 * size
    strings = list(dict.fromkeys(m.piece for m in run))
    if any(_shown_by(pieces, k) not in ("Tj", "TJ") for k in strings):
        return Plan(error="drawn by an operator that also moves")
    per = {k: [m for m in run if m.piece == k] for k in strings}
    hops = [separator(pieces, a, b) for a, b in zip(strings, strings[1:])]
    natural = sum(map(wide, codes))
    scale = room / natural if room is not None and natural > room and natural > 0 else 1.0
    plan = Plan(scale=scale, grew=natural * scale - sum(wide(m.code) for m in run))
    if len(strings) > 1 and len(codes) == len(run):
        share = iter(codes)
        given = {k: [next(share) for _ in own] for k, own in per.items()}
        for k, own in per.items():
            all_codes = font.codes(pieces[k].value)
            for m, c in zip(own, given[k]):
                all_codes[m.slot] = c
            plan.edits.append((pieces[k].start, pieces[k].end, _hex(all_codes, font)))
        for (a, b), hop in zip(zip(strings, strings[1:]), hops):
            if hop == "relative":  # the way to the next string follows what this one became
                at = next(j for j in range(a + 1, b) if _is(pieces[j], *MOVERS)) - 2
                longer = sum(map(wide, given[a])) - sum(wide(m.code) for m in per[a])
                plan.edits.append((pieces[at].start, pieces[at].end, _num((float(pieces[at].value) + longer) * scale)))
        plan.edits.sort()
        return plan
    if len(strings) > 1:
        if any(len(own) != len(font.codes(pieces[k].value)) for k, own in per.items()):
            return Plan(error="text beside it shares its strings")
        if "unknown" in hops or "relative" in hops and "absolute" in hops:
            return Plan(error="placed in mixed ways")
    for k, own in per.items():
        every = font.codes(pieces[k].value)
        before, after = every[: own[0].slot], every[own[-1].slot + 1 :]
        drawn = codes if k == strings[0] else []
        gone = sum(wide(m.code) for m in own)
        parts = [_hex(before, font)] if before else []
        if scale < 1 and len(drawn) > 1:
            gap = _num(natural * (1 - scale) / (len(drawn) - 1) / size * 1000)
            for j, c in enumerate(drawn):
                parts += [gap, _hex([c], font)] if j else [_hex([c], font)]
        elif drawn or not before and not after:
            parts.append(_hex(drawn, font))
        drift = (natural * scale if drawn else 0.0) - gone
        if abs(drift) > 1e-6 and (give_back or k != strings[0]):
            parts.append(_num(drift / size * 1000))
        parts += [_hex(after, font)] if after else []
        body = b" ".join(parts)
        if _shown_by(pieces, k) == "TJ":
            plan.edits.append((pieces[k].start, pieces[k].end, body))
        else:
            plan.edits.append((pieces[k].start, pieces[k + 1].end, b"[" + body + b"] TJ"))
    return plan


def erase(pieces: list[Piece], marks: list[Mark], match: Match) -> Plan:
    """Edits that take a match out where nothing else depends on it: whole strings under Tj, what follows placed by itself."""
    run, plan = marks[match.first : match.last + 1], Plan()
    for k in dict.fromkeys(m.piece for m in run):
        if sum(m.piece == k for m in run) != sum(m.piece == k for m in marks):
            return Plan(error="text beside it shares its string")
        if k + 1 >= len(pieces) or not _is(pieces[k + 1], "Tj"):
            return Plan(error="not drawn by Tj")
        later = next((m.piece for m in marks if m.piece > k), None)
        if later is not None and not any(_is(p, *SETTERS, *MOVERS, "ET") for p in pieces[k + 1 : later]):
            return Plan(error="the text after it would move")
        plan.edits.append((pieces[k].start, pieces[k + 1].end, b" " * (pieces[k + 1].end - pieces[k].start)))
    return plan


def shift(pieces: list[Piece], marks: list[Mark], match: Match, by: float, from_x: float) -> tuple[list[tuple[int, int, bytes]], int]:
    """Edits that move text placed by Tm after the match on its line, and how many marks follow the pen anyway."""
    here, moved, trailing = marks[match.first], set(), 0
    if abs(by) < 1e-6:
        return [], 0
    for m in marks[match.last + 1 :]:
        if abs(m.y - here.y) <= max(1.0, (here.size or 10) * 0.35) and m.x >= from_x - 0.01:
            if m.placed_by == here.placed_by:
                trailing += 1
            elif m.placed_op == "Tm":
                moved.add(m.placed_by)
    spots = [pieces[k - 2] for k in sorted(moved)]
    return [(p.start, p.end, _num(float(p.value) + by)) for p in spots if isinstance(p.value, (int, float))], trailing


def apply(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    for start, end, new in sorted(edits, reverse=True):
        data = data[:start] + new + data[end:]
    return data


def _room(marks: list[Mark], match: Match, font: Font) -> float | None:
    """Text-space room up to what comes next on the line; None if nothing does."""
    here, last = marks[match.first], marks[match.last]
    end = last.x + font.widths.get(last.code, font.default) / 1000 * last.size
    ahead = [m.x for m in marks if (m.font, m.piece) != (last.font, last.piece) and abs(m.y - here.y) <= max(1.0, here.size * 0.3) and m.x > end - 0.01]
    return max(end - here.x, min(ahead) - here.x - here.size * 0.15) if ahead else None


def replace_on_page(doc: Document, page: dict, find: str, new: str, overflow: str = "squeeze") -> tuple[bytes, bytes, list[Outcome]]:
    """The page's content with every match replaced, what is to be drawn on top of it, and how each match was done.

    overflow: squeeze a longer text into its room, or push what follows it on the line.
    """
    contents = doc.get(page.get("Contents"))
    parts = contents if isinstance(contents, list) else [contents]
    data = b"\n".join(doc.decode(s) for p in parts if isinstance(s := doc.get(p), Stream))
    listed = doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}
    fonts = {str(k): read_font(doc, doc.get(v) or {}) for k, v in listed.items()}
    top, done = b"", {}
    for name, font in fonts.items():
        left: dict[int, int] | None = None
        while left is None or any(left.values()):
            pieces = pieces_of(data)
            marks, shows = marks_of(pieces, fonts), _shows(pieces)
            found: dict[int, list[Match]] = {}
            for match in matches(marks, name, font, find):
                found.setdefault(shows[marks[match.first].piece], []).append(match)
            left = {k: len(v) for k, v in found.items()} if left is None else left
            edits, used = [], set()
            # the last match that each operator shows: what stands before it stays as it is until its turn comes
            for show in sorted(left, reverse=True):
                at = min(left[show], len(found.get(show, []))) - 1
                left[show] = at + 1
                if at < 0 or overflow == "push" and used:
                    continue
                match = found[show][at]
                over = {shows[m.piece] for m in marks[match.first : match.last + 1]}
                if over & used:
                    continue
                used |= over
                left[show] = at
                own, drawn, done[name, show, at] = _edited(pieces, marks, match, font, new, overflow)
                edits += own
                top += drawn
            data = apply(data, edits)
    return data, top, [done[k] for k in sorted(done)]


def _shows(pieces: list[Piece]) -> list[int]:
    """For each token the number of the text-showing operator that it is before."""
    out, n = [], 0
    for piece in pieces:
        out.append(n)
        n += _is(piece, "Tj", "TJ", "'", '"')
    return out


def _edited(pieces: list[Piece], marks: list[Mark], match: Match, font: Font, new: str, overflow: str) -> tuple[list[tuple[int, int, bytes]], bytes, Outcome]:
    """Edits of one match, what is drawn on top, and how it was done."""
    here, end = marks[match.first], marks[match.last]
    stop = end.x + font.widths.get(end.code, font.default) / 1000 * end.size
    room, push = _room(marks, match, font), overflow == "push"
    plan, outcome = native(pieces, marks, match, font, new, None if push else room), Outcome("native")
    if plan.error is None and push and plan.grew > 1e-6:
        moves, trailing = shift(pieces, marks, match, plan.grew, stop)
        if moves or trailing:
            plan = native(pieces, marks, match, font, new, None, give_back=False)
            plan.edits += moves
            outcome.moved = trailing + len(moves)
        elif room is not None:
            plan, outcome.note = native(pieces, marks, match, font, new, room), "nothing to push, squeezed"
    if plan.error is None:
        outcome.scale = plan.scale
        return plan.edits, b"", outcome
    gone = erase(pieces, marks, match)
    outcome = Outcome("overlay" if gone.error else "erase", note=plan.error)
    drawn = b"BT /QuireF %s Tf %s %s Td %s Tj ET\n" % (_num(here.size), _num(here.x), _num(here.y), b"<" + new.encode("cp1252", "replace").hex().encode() + b">")
    if gone.error:  # a patch over the old text
        drawn = b"q 1 g %s %s %s %s re f Q\n" % (_num(here.x), _num(here.y - 0.25 * here.size), _num(stop - here.x), _num(1.2 * here.size)) + drawn
    return gone.edits, drawn, outcome


def replace_text(content: bytes, find: str, new: str, overflow: str = "squeeze") -> tuple[bytes, list[dict]]:
    """A document with every match of a text replaced, and a row for each: page (from 1), ordinal, method, moved, scale, note."""
    doc, report, changes = Document.open(content), [], {}
    for number, (ref, page) in enumerate(doc.page_refs(), 1):
        data, top, outcomes = replace_on_page(doc, page, find, new, overflow)
        report += [{"page": number, "ordinal": k, "method": o.method, "moved": o.moved, "scale": o.scale, "note": o.note} for k, o in enumerate(outcomes)]
        if outcomes and ref is not None:
            resources = dict(doc.get(page.get("Resources")) or {})
            if top:
                resources["Font"] = dict(doc.get(resources.get("Font")) or {}) | {"QuireF": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}
            own = doc.get(ref)
            changes[ref.num] = {**own, "Resources": resources, "Contents": Stream({}, b"q\n" + data + b"\nQ\n" + top if top else data)}
    return rewrite(doc, changes), report


__all__ = ["Hex", "PdfError", "Ref", "replace_text"]
