"""Where words and ruling lines stand on a page, and the tables they form.

Places are in points from the top left. Lines are stroked paths and thin or stroked rectangles; where horizontal and
vertical ones cross they form a lattice, whose cells hold the words with their centre inside. Pages without a lattice are
read by gaps between words.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Lines nearer to each other than this are one; filled rectangles thinner than this are lines.
NEAR = 3.0


@dataclass
class Word:
    text: str
    x0: float
    x1: float
    top: float
    bottom: float


@dataclass
class Line:
    """A ruling line: at is y of a horizontal one, x of a vertical one."""

    across: bool
    at: float
    low: float
    high: float


def multiply(a: tuple, b: tuple) -> tuple:
    """The matrix that applies a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def moved(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def ruling(x0: float, y0: float, x1: float, y1: float) -> Line | None:
    """A line between two points, if it runs across or down."""
    if abs(y0 - y1) <= 1 < abs(x0 - x1):
        return Line(True, (y0 + y1) / 2, min(x0, x1), max(x0, x1))
    if abs(x0 - x1) <= 1 < abs(y0 - y1):
        return Line(False, (x0 + x1) / 2, min(y0, y1), max(y0, y1))
    return None


def box(x0: float, y0: float, x1: float, y1: float, stroked: bool) -> list[Line]:
    """The lines of a rectangle: its middle where it is thin, its sides where it is stroked, none where it is only filled."""
    if abs(y1 - y0) < NEAR < abs(x1 - x0) or abs(x1 - x0) < NEAR < abs(y1 - y0):
        flat = abs(y1 - y0) < NEAR
        return [Line(True, (y0 + y1) / 2, min(x0, x1), max(x0, x1)) if flat else Line(False, (x0 + x1) / 2, min(y0, y1), max(y0, y1))]
    corners = [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
    return [line for c in corners if stroked and (line := ruling(*c))]


def merged(lines: list[Line]) -> list[Line]:
    """Lines that lie on one another or follow one another are one."""
    out: list[Line] = []
    for line in sorted(lines, key=lambda x: (x.across, round(x.at / NEAR), x.low)):
        for other in out:
            if other.across == line.across and abs(other.at - line.at) < NEAR and line.low <= other.high + NEAR and other.low <= line.high + NEAR:
                other.low, other.high = min(other.low, line.low), max(other.high, line.high)
                break
        else:
            out.append(Line(line.across, line.at, line.low, line.high))
    return out


def _levels(values: list[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] >= NEAR:
            out.append(v)
    return out


def _crossing(a: Line, b: Line) -> bool:
    return a.across != b.across and a.low - NEAR <= b.at <= a.high + NEAR and b.low - NEAR <= a.at <= b.high + NEAR


def lattices(lines: list[Line]) -> list[list[Line]]:
    """Groups of lines that hang together by crossings."""
    rest, out = list(lines), []
    while rest:
        group, open_ = [], [rest.pop()]
        while open_:
            a = open_.pop()
            group.append(a)
            near = [b for b in rest if _crossing(a, b)]
            rest = [b for b in rest if not any(b is n for n in near)]
            open_ += near
        out.append(group)
    return out


def joined(words: list[Word]) -> str:
    """Words of a cell: lines from top to bottom, each from left to right."""
    rows: list[list[Word]] = []
    for w in sorted(words, key=lambda w: (w.top, w.x0)):
        if rows and w.top - rows[-1][0].top < NEAR:
            rows[-1].append(w)
        else:
            rows.append([w])
    return "\n".join(" ".join(w.text for w in sorted(r, key=lambda w: w.x0)) for r in rows).strip()


def lattice_table(group: list[Line], words: list[Word]) -> list[list[str]]:
    """The cells of one lattice; a cell without its left line belongs to that on its left, and gives an empty one."""
    xs, ys = _levels([g.at for g in group if not g.across]), _levels([g.at for g in group if g.across])
    if len(xs) < 2 or len(ys) < 2:
        return []
    out = []
    for top, bottom in zip(ys, ys[1:]):
        middle, cells = (top + bottom) / 2, [[] for _ in xs[1:]]
        walls = [any(not g.across and abs(g.at - x) < NEAR and g.low - NEAR <= middle <= g.high + NEAR for g in group) for x in xs]
        for w in words:
            x, y = (w.x0 + w.x1) / 2, (w.top + w.bottom) / 2
            if top <= y < bottom and xs[0] <= x < xs[-1]:
                at = max(i for i in range(len(xs) - 1) if xs[i] <= x)
                while at and not walls[at]:
                    at -= 1
                cells[at].append(w)
        out.append([joined(c) for c in cells])
    return [r for r in out if any(r)]


def gap_table(words: list[Word], column_gap: float = 10.0, row_gap: float = 15.0) -> list[list[str]]:
    """Rows and cells by gaps between words, as `chunk.grid_from_words` has them."""
    rows: list[list[Word]] = []
    last = None
    for w in sorted(words, key=lambda w: (w.top, w.x0)):
        if last is None or w.top - last > row_gap:
            rows.append([])
        rows[-1].append(w)
        last = w.top
    out = []
    for row in rows:
        cells: list[list[Word]] = []
        for w in sorted(row, key=lambda w: (w.x0, w.top)):
            if not cells or w.x0 - cells[-1][-1].x1 > column_gap:
                cells.append([])
            cells[-1].append(w)
        out.append([" ".join(w.text for w in c) for c in cells])
    return out


def is_table(rows: list[list[str]]) -> bool:
    """Two rows with content, 1.5 filled cells a row, no row half as far again from the mean, a header of two cells."""
    counts = [sum(bool(c.strip()) for c in r) for r in rows]
    mean = sum(counts) / len(counts) if counts else 0
    return sum(c > 0 for c in counts) >= 2 and mean >= 1.5 and all(c == 0 or abs(c - mean) <= mean / 2 for c in counts) and counts[0] >= 2


def tables(words: list[Word], lines: list[Line]) -> list[list[list[str]]]:
    """The tables of a page from top to bottom: lattices; without any, the whole page by gaps if that makes a table."""
    found = []
    for group in lattices(merged(lines)):
        if rows := lattice_table(group, words):
            found.append((min(g.at for g in group if g.across), rows))
    if found:
        return [rows for _, rows in sorted(found, key=lambda x: x[0])]
    rows = gap_table(words)
    return [rows] if is_table(rows) else []
