"""Column bands of a page and the order in which its blocks are read. Folds stay within one page."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillforge.operators.folds import fold

#: Shares of the page width for a column's widest block, its spread of centres and the gutter, with pixel minima.
WIDEST, SPREAD, SPREAD_PX, GUTTER, GUTTER_PX = 0.58, 0.10, 30, 0.045, 20
#: Common height of columns, in pixels and as a share of the shortest.
COMMON_PX, COMMON = 24, 0.25


@dataclass
class Bands:
    left: np.ndarray
    right: np.ndarray
    top: float
    bottom: float
    members: list[np.ndarray]


def split_at_gaps(centres: np.ndarray, parts: int) -> list[np.ndarray] | None:
    """Places in ``centres``, cut at the ``parts`` - 1 widest gaps between sorted neighbours (of equal gaps the first); None if too few."""
    if len(centres) < parts:
        return None
    order = np.argsort(centres, kind="stable")
    gaps = np.diff(centres[order])
    return np.split(order, np.sort(np.argsort(-gaps, kind="stable")[: parts - 1]) + 1)


def bands(boxes: np.ndarray, page_width: float, most: int = 4, least_blocks: int = 2) -> Bands | None:
    """The columns of a page, as many as fit, or None where no number from ``most`` down to two does.

    ``boxes`` (n, 4): x, y, w, h in reading position. Columns need ``least_blocks`` blocks, centres close together, a
    gutter between them and a common height; no block of the body may reach into two of them or stand between them.
    """
    if most < 2 or least_blocks < 2:
        raise ValueError("two columns of two blocks are the least")
    if len(boxes) < 2 * least_blocks or page_width <= 0:
        return None
    x, y, w, h = boxes.T
    centre = x + w / 2
    narrow = np.flatnonzero(w < page_width * WIDEST)
    for parts in range(min(most, len(narrow) // least_blocks), 1, -1):
        groups = split_at_gaps(centre[narrow], parts)
        if groups is None or min(map(len, groups)) < least_blocks:
            continue
        groups = [narrow[g] for g in groups]
        if max(np.ptp(centre[g]) for g in groups) > max(SPREAD_PX, int(page_width * SPREAD)):
            continue
        groups.sort(key=lambda g: centre[g].mean())
        left, right = np.array([x[g].min() for g in groups]), np.array([(x + w)[g].max() for g in groups])
        if (left[1:] - right[:-1]).min() < max(GUTTER_PX, int(page_width * GUTTER)):
            continue
        tops, ends = np.array([y[g].min() for g in groups]), np.array([(y + h)[g].max() for g in groups])
        if max(0, ends.min() - tops.max()) < max(COMMON_PX, (ends - tops).min() * COMMON):
            continue
        found = Bands(left, right, tops.min(), ends.max(), groups)
        body = (y < found.bottom) & (y + h > found.top)
        reach = np.minimum((x + w)[:, None], right) - np.maximum(x[:, None], left)
        several = (np.maximum(reach, 0) >= np.maximum(8, np.minimum(w, 24) // 2)[:, None]).sum(1) > 1
        astray = ~((left <= centre[:, None]) & (centre[:, None] <= right)).any(1)
        if not (body & (several | astray)).any():
            return found
    return None


def read(boxes: np.ndarray, page_width: float) -> np.ndarray:
    """Places in ``boxes`` in the order they are read; boxes without a place (NaN) count as standing at 0, 0."""
    at = np.nan_to_num(boxes)
    by_place = np.lexsort((at[:, 0], at[:, 1]))
    placed = by_place[~np.isnan(boxes[by_place]).any(1)]
    found = bands(boxes[placed], page_width) if len(placed) else None
    if found is None:
        return by_place
    zone = np.zeros(len(boxes))  # 0 above the columns, then one for each column, then below
    x, y, w, h = boxes[placed].T
    inside = (found.left <= (x + w / 2)[:, None]) & ((x + w / 2)[:, None] <= found.right)
    above, below = y + h <= found.top, y >= found.bottom
    body = ~above & ~below
    if (inside[body].sum(1) != 1).any():
        return by_place
    zone[placed] = np.where(above, 0, np.where(below, len(found.left) + 1, inside.argmax(1) + 1))
    return by_place[np.argsort(zone[by_place], kind="stable")]


def reading_order(blocks: DataFrame) -> DataFrame:
    """Place of each block (page, page_width, ord, x, y, w, h) in reading order, from 1; equal places go by ``ord``."""

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        by = read(np.array([r[2:] for r in rows], np.float64), float(rows[0][0]))
        return [(key[0], rows[i][1], place) for place, i in enumerate(by.tolist(), 1)]

    slim = blocks.select("page", "page_width", "ord", "x", "y", "w", "h")
    return fold(slim, ["page"], ["ord", "x", "y", "w", "h"], step, "page long, ord long, place long")


def column_bands(blocks: DataFrame, most: int = 4) -> DataFrame:
    """Column bands (page, column, left, right, center, top, bottom, blocks) with the body's top and bottom; pages without columns give none."""

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        box = np.array([r[2:] for r in rows], np.float64)
        box = box[~np.isnan(box).any(1)]
        got = bands(box, float(rows[0][0]), most) if len(box) else None
        if got is None:
            return []
        x, y, w, h = box.T
        return [(key[0], i, got.left[i], got.right[i], (x + w / 2)[m].mean(), y[m].min(), (y + h)[m].max(), len(m), got.top, got.bottom) for i, m in enumerate(got.members)]

    kinds = "page long, column int, left double, right double, center double, top double, bottom double, blocks long, body_top double, body_bottom double"
    slim = blocks.select("page", "page_width", "ord", "x", "y", "w", "h")
    return fold(slim, ["page"], ["y", "x", "ord", "w", "h"], step, kinds)
