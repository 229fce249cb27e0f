"""Regions that grow together until nothing changes: text regions, diagram parts, line boxes. Folds stay within one page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillforge.operators.folds import fold

#: Overlap, gap as a share of the page and least gap in pixels, of boxes side by side and of boxes one above the other.
TEXT_ROW, TEXT_COLUMN = (0.60, 0.02, 12), (0.55, 0.018, 10)
DIAGRAM_ROW, DIAGRAM_COLUMN = (0.60, 0.02, 10), (0.60, 0.03, 10)
#: Fixed value: common height, of the lower one, of two boxes of one line.
LINE_OVERLAP = 0.55

Box = tuple[int, int, int, int]  # left, top, right, bottom


def _along(a1: int, a2: int, b1: int, b2: int) -> tuple[int, float]:
    """Gap of two intervals, and their overlap by the shorter one."""
    both = min(a2, b2) - max(a1, b1)
    return max(0, -both), max(0, both) / max(1, min(a2 - a1, b2 - b1))


def to_fixpoint(boxes: list[Box], together: Callable[[Box, Box], bool]) -> list[Box]:
    """Boxes absorbed by earlier ones of (top, left) that they belong with, which grow as they absorb, pass after pass until none is."""
    place = lambda b: (b[1], b[0])
    boxes = sorted(boxes, key=place)
    while True:
        left, grown = list(boxes), []
        while left:
            now, rest = left[0], []
            for other in left[1:]:
                if together(now, other):
                    now = (min(now[0], other[0]), min(now[1], other[1]), max(now[2], other[2]), max(now[3], other[3]))
                else:
                    rest.append(other)
            grown.append(now)
            left = rest
        if len(grown) == len(boxes):
            return sorted(grown, key=place)
        boxes = sorted(grown, key=place)


def near(width: int, height: int, row: tuple = TEXT_ROW, column: tuple = TEXT_COLUMN) -> Callable[[Box, Box], bool]:
    """Whether two boxes of a page of this size share a row band or a column band and lie near each other in it."""
    row_gap, column_gap = max(row[2], int(width * row[1])), max(column[2], int(height * column[1]))

    def rule(a: Box, b: Box) -> bool:
        gap_x, share_x = _along(a[0], a[2], b[0], b[2])
        gap_y, share_y = _along(a[1], a[3], b[1], b[3])
        return (share_y >= row[0] and gap_x <= row_gap) or (share_x >= column[0] and gap_y <= column_gap)

    return rule


def into_lines(boxes: list[Box], most_gap: int) -> list[Box]:
    """Boxes in order of (top, left), each added to the line with the largest common height (the latest of equal ones), if one is near enough."""
    lines: list[Box] = []
    for box in sorted(boxes, key=lambda b: (b[1], b[0])):
        best, most = None, 0.0
        for i, line in reversed(list(enumerate(lines))):
            gap, _ = _along(line[0], line[2], box[0], box[2])
            _, share = _along(line[1], line[3], box[1], box[3])
            if share >= LINE_OVERLAP and gap <= most_gap and share > most:
                best, most = i, share
        if best is None:
            lines.append(box)
        else:
            line = lines[best]
            lines[best] = (min(line[0], box[0]), min(line[1], box[1]), max(line[2], box[2]), max(line[3], box[3]))
    return sorted(lines, key=lambda b: (b[1], b[0]))


def _by_page(boxes: DataFrame, grow: Callable[[list[Box], int, int], list[Box]]) -> DataFrame:
    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        found = [(int(x), int(y), int(x + w), int(y + h)) for *_, x, y, w, h in rows]
        got = grow(found, int(rows[0][0]), int(rows[0][1]))
        return [(key[0], i, a, b, c - a, d - b) for i, (a, b, c, d) in enumerate(got)]

    slim = boxes.select("page", "page_width", "page_height", "ord", "x", "y", "w", "h")
    return fold(slim, ["page"], ["y", "x", "ord", "w", "h"], step, "page long, ord long, x long, y long, w long, h long")


def merged_regions(boxes: DataFrame) -> DataFrame:
    """Text regions of a page (page, page_width, page_height, ord, x, y, w, h) after merging neighbours, in order of y, x."""
    return _by_page(boxes, lambda found, width, height: to_fixpoint(found, near(width, height)))


def merged_diagrams(boxes: DataFrame) -> DataFrame:
    """Parts of line drawings, merged like text regions under their own distances."""
    return _by_page(boxes, lambda found, width, height: to_fixpoint(found, near(width, height, DIAGRAM_ROW, DIAGRAM_COLUMN)))


def merged_lines(boxes: DataFrame, most_gap: int) -> DataFrame:
    """Boxes of words joined into boxes of lines."""
    return _by_page(boxes, lambda found, width, height: into_lines(found, most_gap))
