"""Tables without rules: rows of recognized lines whose left edges align. A page's lines are folded in one group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.operators.folds import fold
from quillforge.operators.tables import CURRENCY, LINE, LINE_ORDER, NUMERIC, TABLE, Line, cluster, table_row

#: Distance of tops in one row (pixels, share of the typical height); drift of left edges and gap of cells (pixels, share of the page).
ROW_PX, ROW = 8.0, 0.65
DRIFT_PX, DRIFT, GAP_PX, GAP = 14, 0.025, 16, 0.02
#: Widest step between rows (pixels, heights), longest typical text, columns, rows, share of amounts in a column of two.
STEP_PX, STEP, TEXT, COLUMNS, ROWS, VALUES = 90, 3.2, 34, (2, 6), 3, 0.6


def value_like(text: str) -> bool:
    """Whether a text names a currency or is a number."""
    text = text.strip()
    return bool(text) and bool(CURRENCY.search(text) or (NUMERIC.fullmatch(text) and any(c.isdigit() for c in text)))


def rows_of(lines: list[Line]) -> list[list[Line]]:
    """Lines in rows by their tops, rows from left to right."""
    if not lines:
        return []
    near = max(ROW_PX, median(l.h for l in lines) * ROW)
    return [sorted(row, key=lambda l: l.x) for row in cluster(sorted(lines, key=lambda l: (l.y, l.x)), lambda l: l.y, near)]


def anchors_of(rows: list[list[Line]], page_width: int) -> list[float] | None:
    """Left edges of the columns: the medians over the full rows, which must hold to them and keep their cells apart."""
    wide = max(map(len, rows))
    full = [r for r in rows if len(r) == wide]
    if len(full) < 2:
        return None
    edges = [median(r[k].x for r in full) for k in range(wide)]
    drift, gap = max(DRIFT_PX, int(page_width * DRIFT)), max(GAP_PX, int(page_width * GAP))
    holds = all(abs(l.x - e) <= drift for r in full for l, e in zip(r, edges, strict=True))
    apart = all(b.x - (a.x + a.w) >= gap for r in full for a, b in zip(r, r[1:], strict=False))
    return edges if holds and apart else None


def columns_of(line: Line, edges: list[float], drift: int) -> range | None:
    """The columns that a line covers: those whose edge lies under it, without a gap; else the nearest, if near enough."""
    under = [k for k, e in enumerate(edges) if line.x - drift <= e <= line.x + line.w + drift]
    if not under:
        k = min(range(len(edges)), key=lambda k: abs(edges[k] - line.x))
        under = [k] if abs(edges[k] - line.x) <= drift else []
    if not under or under[-1] - under[0] + 1 != len(under):
        return None
    return range(under[0], under[-1] + 1)


def _centre(row: list[Line]) -> float:
    return median(l.y + l.h / 2 for l in row)


@dataclass
class Grid:
    columns: int
    cells: list[tuple[int, int, int, int, Line | None]]  # row, column, row span, column span, line


def grid_of(rows: list[list[Line]], page_width: int) -> Grid | None:
    """The cells of rows that read as one table, or None: alignment, spacing, short texts, amounts in one of two columns, and no doubled
    or missing place, but for one empty cell a row in tables of three columns, four rows and three full rows or more."""
    counts = [len(r) for r in rows]
    wide = max(counts, default=0)
    if len(rows) < ROWS or not COLUMNS[0] <= wide <= COLUMNS[1]:
        return None
    edges = anchors_of(rows, page_width)
    if edges is None:
        return None
    centres = [_centre(r) for r in rows]
    steps = [b - a for a, b in zip(centres, centres[1:], strict=False)]
    if steps and max(steps) > max(STEP_PX, STEP * median(median(l.h for l in r) for r in rows)):
        return None
    lengths = [n for r in rows for l in r if (n := len(l.text.strip()))]
    if not lengths or median(lengths) > TEXT:
        return None
    full = [r for r in rows if len(r) == wide]
    if wide == 2 and max(sum(value_like(r[k].text) for r in full) for k in range(2)) < max(2, int(len(full) * VALUES)):
        return None
    blanks = wide >= 3 and len(rows) >= 4 and len(full) >= 3
    drift = max(DRIFT_PX, int(page_width * DRIFT))
    taken = [[False] * wide for _ in rows]
    cells: list = []
    for i, row in enumerate(rows):
        placed = [(l, columns_of(l, edges, drift)) for l in row]
        if any(c is None for _, c in placed):
            return None
        for line, where in sorted(placed, key=lambda p: p[1][0]):
            span = 1
            while i + span < len(rows) and line.y <= centres[i + span] <= line.y + line.h:
                span += 1
            for r in range(i, i + span):
                for k in where:
                    if taken[r][k]:
                        return None
                    taken[r][k] = True
            cells.append((i, where[0], span, len(where), line))
        empty = [k for k in range(wide) if not taken[i][k]]
        if empty:
            if not blanks or len(empty) > 1 or len(row) < 2:
                return None
            taken[i][empty[0]] = True
            cells.append((i, empty[0], 1, 1, None))
    return Grid(wide, cells)


def _breaks(rows: list[list[Line]]) -> list[int]:
    """For each row, the row that no run from it can reach: the first that has too many cells, or that lies too far below the one before it."""
    centres = [_centre(r) for r in rows]
    far = max(STEP_PX, STEP * max((median(l.h for l in r) for r in rows), default=0))
    out, stop = [0] * len(rows), len(rows)
    for i in range(len(rows) - 1, -1, -1):
        if i + 1 < len(rows) and centres[i + 1] - centres[i] > far:
            stop = i + 1
        if len(rows[i]) > COLUMNS[1]:
            stop = i
        out[i] = stop
    return out


def runs(rows: list[list[Line]], page_width: int) -> Iterator[tuple[int, int, Grid]]:
    """(first row, row after the last, grid) of tables, from the top: at each row the longest run that reads as one, then on after it."""
    at, stops = 0, _breaks(rows)
    while at < len(rows):
        for end in range(stops[at], at + ROWS - 1, -1):
            grid = grid_of(rows[at:end], page_width)
            if grid:
                yield at, end, grid
                at = end
                break
        else:
            at += 1


def borderless_tables(lines: DataFrame) -> DataFrame:
    """One row for each table of a page (see ``tables.TABLE``) from lines: page, page_width, ord, text, confidence, x, y, w, h.

    ``lines`` of the result lists the ords that a table takes; ``remaining`` gives the others.
    """

    def step(key: tuple, lines_: list[tuple]) -> list[tuple]:
        width = int(lines_[0][0])
        rows, out = rows_of(Line.of([r[1:] for r in lines_])), []
        for k, (a, b, grid) in enumerate(runs(rows, width)):
            tall = any(c[2] > 1 for c in grid.cells)
            merged = sum(1 for c in grid.cells if c[2] > 1 or c[3] > 1)
            out.append(table_row(int(key[0]), k, "aligned-text", b - a, grid.columns, grid.cells, merged, "horizontal+vertical" if tall else "horizontal-only"))
        return out

    return fold(lines.select("page", "page_width", *LINE), ["page"], LINE_ORDER, step, TABLE)


def remaining(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that no table takes."""
    taken = tables.select("page", F.explode("lines").alias("ord"))
    return lines.join(taken, ["page", "ord"], "left_anti")
