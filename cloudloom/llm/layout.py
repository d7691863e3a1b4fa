"""Reading order of scanned pages: columns, headings, adverts and running text, as pieces of the page's text.

A page's lines come in the scanner's order: columns one after the other, line by line across, or two columns merged into one
line with a wide gap. Boxes tell columns (left edge), adverts (indented lines) and block ends (a wide step down); without boxes,
and in merged lines, a line that ends although the next word would have fitted ends a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from statistics import median

GAP = re.compile(r"(?<=\S) {3,}(?=\S)")
BEHIND_MARK = re.compile(r"(?:[.!?…]|[.!?][”“»]) +(\w+)")
#: Pixels of a character, least distance of columns, and the range of an advert's indent.
CHAR, COLUMN, INDENT = 9, 60, (20, 50)
#: A step down of more than this many usual steps ends a block.
STEP = 1.3


@dataclass
class Piece:
    start: int
    end: int
    col: int
    indent: bool = False
    y: float | None = None
    glued: bool = False  # its line holds two columns


@dataclass
class Stream:
    """Text read in one go: ``kind`` is text, heading or advert."""

    kind: str
    pieces: list[Piece] = field(default_factory=list)


def _pieces(text: str, boxes) -> list[Piece]:
    raw, at, merged = [], 0, False
    lines = text.split("\n")
    known = boxes is not None and len(boxes) == len(lines)
    for i, line in enumerate(lines):
        box = boxes[i] if known else None
        x0 = box["x0"] if box is not None else None
        x1, y0 = (box["x1"], box["y0"]) if box is not None else (None, None)
        if line.strip():
            gap = GAP.search(line) if "   " in line else None
            if gap:
                merged = True
                right = line[gap.end() :].rstrip()
                raw.append([at, at + gap.start(), x0, None, 0])
                raw.append([at + gap.end(), at + len(line), None if x1 is None else x1 - CHAR * len(right), None, 1])
            else:
                raw.append([at, at + len(line), x0, y0, None])
        at += len(line) + 1
    xs = [r[2] for r in raw if r[2] is not None and r[4] != 1]
    left = min(xs) if xs else 0
    out, col = [], 0
    for s, e, x, y, side in raw:
        if side is not None:
            col = side
        elif x is not None:
            col = int(x > left + COLUMN)
        out.append((s, e, x, y, col, side is not None))
    bases = {}
    for c in (0, 1):
        mine = [p[2] for p in out if p[4] == c and p[2] is not None]
        if mine:
            bases[c] = median(mine) if merged and c else min(mine)
    pieces = []
    for s, e, x, y, c, glued in out:
        indent = x is not None and c in bases and INDENT[0] < x - bases[c] < INDENT[1]
        pieces.append(Piece(s, e, c, indent, None if merged else y, glued))
    return pieces


def _first_word(text: str, p: Piece) -> int:
    word = text[p.start : p.end].split(None, 1)[0]
    return 1 if ord(word[0]) > 0x2E00 or 0xE00 <= ord(word[0]) < 0xE80 else len(word)


def _capitals(text: str, p: Piece) -> bool:
    """Whether a line is set in capitals, as headings of cased scripts are."""
    letters = [ch for ch in text[p.start : p.end] if ch.isupper() or ch.islower()]
    return len(letters) > 5 and sum(ch.isupper() for ch in letters) >= 0.85 * len(letters)


def _openers(text: str, pieces: list[Piece]) -> set[str]:
    """Words that stand behind an end mark somewhere on the page."""
    found: set[str] = set()
    for p in pieces:
        found.update(BEHIND_MARK.findall(text, p.start, p.end))
    return found


def _goes_on(text: str, last: Piece, first: Piece, openers: set[str]) -> bool:
    """Whether the text of a column goes on at the head of the next one, where the first has no end mark at its foot."""
    foot = text[last.start : last.end].rstrip()
    head = re.search(r"\w+", text[first.start : first.end])
    if not foot or head is None:
        return False
    word = head.group()
    if foot[-1] in "-¬⸗,;:" or not word[0].isupper():
        return True
    return word not in openers


def _ended(text: str, p: Piece) -> bool:
    return text[p.start : p.end].rstrip()[-1:] in ".!?…。！？।؟”»“」"


def streams(text: str, boxes=None) -> list[Stream]:
    """The page's streams in reading order. An article's text is one stream over columns and adverts."""
    pieces = _pieces(text, boxes)
    out: list[Stream] = []
    current: Stream | None = None
    openers = _openers(text, pieces)
    for c in (0, 1):
        col = [p for p in pieces if p.col == c]
        if not col:
            continue
        steps = [b.y - a.y for a, b in zip(col, col[1:]) if a.y is not None and b.y is not None and b.y > a.y]
        usual = median(steps) if steps else None
        if usual and len(steps) < 4:
            usual = min(steps)
        body = sorted(p.end - p.start for p in col if not p.indent)
        width = body[int(len(body) * 0.9)] if body else 0
        ads = sorted(p.end - p.start for p in col if p.indent)
        ad_width = max(ads[-1], width - 4) if ads else 0

        def ends(a: Piece, b: Piece) -> bool:
            """Whether a block ends between two pieces of the same indent."""
            if a.y is not None and b.y is not None and usual:
                if b.y - a.y > STEP * usual:
                    return True
                if not a.indent:
                    return False
            room = (ad_width if a.indent else width) - 3
            last = text[a.start : a.end].rstrip()[-1:]
            if last in "-¬⸗,":
                return False
            return (a.end - a.start) + 1 + _first_word(text, b) <= room and not text[b.start : b.end].lstrip()[:1].islower()

        blocks: list[list[Piece]] = []
        for p in col:
            a = blocks[-1][-1] if blocks else None
            # without steps, a line or two of capitals at the head of a column are a heading; elsewhere capitals are text
            titled = len(blocks) == 1 and a.y is None and len(blocks[0]) <= 2 and _capitals(text, a) and not _capitals(text, p)
            if blocks and a.indent == p.indent and not titled and not ends(a, p):
                blocks[-1].append(p)
            else:
                blocks.append([p])
        for i, b in enumerate(blocks):
            after = blocks[i + 1] if i + 1 < len(blocks) else None
            if b[0].indent:
                out.append(Stream("advert", b))
                continue
            closed = after is not None and not after[0].indent
            heading = closed and len(b) <= 3 and text[b[-1].start : b[-1].end].rstrip()[-1:] not in ".!?…。！？।؟”»“」"
            if heading or (i == 0 and b[0].y is None and len(b) <= 2 and closed and all(_capitals(text, p) for p in b)):
                current = None
                out.append(Stream("heading", b))
                continue
            if current is not None and current.pieces[-1].col != b[0].col and not _ended(text, current.pieces[-1]) and not _goes_on(text, current.pieces[-1], b[0], openers):
                current = None
            if current is None:
                current = Stream("text")
                out.append(current)
            current.pieces += b
            if closed:
                current = None
    return out


def join(text: str, stream: Stream, spaced: bool = True) -> tuple[str, list[int]]:
    """The stream's characters and their places in the page; line ends are a space (place -1), hyphens at line ends go."""
    chars: list[str] = []
    places: list[int] = []
    for p in stream.pieces:
        s, e = p.start, p.end
        piece = text[s:e]
        if chars:
            if len(chars) > 1 and chars[-1] in "-¬⸗" and chars[-2].isalpha() and piece[:1].islower():
                chars.pop()
                places.pop()
            elif spaced and not chars[-1].isspace():
                chars.append(" ")
                places.append(-1)
        chars.extend(piece)
        places.extend(range(s, e))
    return "".join(chars), places
