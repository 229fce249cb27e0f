"""Boxes as columns x, y, w, h: overlap, union, rotation, features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; 1 for nothing of nothing and 0 for something of nothing."""
    return F.when(b == 0, (a == 0).cast("double")).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.when(total == 0, F.lit(1.0)).otherwise(total))


def overlap(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    return wide * F.greatest(F.lit(0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    either = a.area + b.area - both
    return F.when(either <= 0, F.lit(0.0)).otherwise(both / F.when(either <= 0, F.lit(1)).otherwise(either))


def axis_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals by the shorter one."""
    shorter = F.least(a2 - a1, b2 - b1)
    both = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    return F.when(shorter <= 0, F.lit(0.0)).otherwise(both / F.when(shorter <= 0, F.lit(1)).otherwise(shorter))


def axis_gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(a1, b1) - F.least(a2, b2))


def rotated(b: Box, degrees: Column, width: Column, height: Column) -> Box:
    """The box after its page (width, height) is turned clockwise by 0, 90, 180 or 270 degrees."""
    pick = lambda zero, quarter, half, three: F.when(degrees == 90, quarter).when(degrees == 180, half).when(degrees == 270, three).otherwise(zero)
    return Box(
        pick(b.x, height - b.bottom, width - b.right, b.y),
        pick(b.y, b.x, height - b.bottom, width - b.right),
        pick(b.w, b.h, b.w, b.h),
        pick(b.h, b.w, b.h, b.w),
    )


#: Block types and roles in the order of their features.
TYPES, ROLES = ("heading", "paragraph", "list", "table", "image"), ("header", "footer")


def block_features(b: Box, kind: Column, role: Column, width: Column, height: Column) -> Column:
    """16 numbers of a block: edges, middle, size and area by page size, its type and its role as flags."""
    left, top, right, bottom = b.x / width, b.y / height, b.right / width, b.bottom / height
    wide, high = b.w / width, b.h / height
    flags = [F.coalesce(kind == t, F.lit(False)) for t in TYPES] + [F.coalesce(role == r, F.lit(False)) for r in ROLES]
    parts = [left, top, right, bottom, (left + right) / 2, (top + bottom) / 2, wide, high, wide * high, *flags]
    return F.array(*(p.cast("double") for p in parts))


def pair_features(a: Column, b: Column) -> Column:
    """38 numbers of an ordered pair: the features of both, differences of middles and sizes, overlap along both axes by the shorter side."""
    at = lambda k, i: F.get(k, F.lit(i))

    def along(low: int, high: int) -> Column:
        both = F.least(at(a, high), at(b, high)) - F.greatest(at(a, low), at(b, low))
        return F.greatest(F.lit(0.0), both) / F.greatest(F.lit(1e-6), F.least(at(a, high) - at(a, low), at(b, high) - at(b, low)))

    return F.concat(a, b, F.array(*(at(b, i) - at(a, i) for i in (4, 5, 6, 7)), along(0, 2), along(1, 3)))


def moved(b: Box, dx: Column, dy: Column) -> Box:
    """The box of a part of a page, in the page's own coordinates."""
    return Box(b.x + dx, b.y + dy, b.w, b.h)


def resize_plan(width: Column, height: Column, target_height: int, target_width: int) -> Column:
    """Width of a line scaled to ``target_height``, at least 1 and at most ``target_width`` (halves to even)."""
    return F.greatest(F.lit(1), F.least(F.lit(target_width), F.bround(width * target_height / height).cast("int")))


def turned_assets(b: Box, degrees: Column, width: Column, height: Column) -> tuple[Box, Column]:
    """The box of an asset after its page is turned, and its width as a share of the turned page's."""
    box = rotated(b, degrees, width, height)
    across = F.when(degrees.isin(90, 270), height).otherwise(width)
    return box, box.w / F.greatest(F.lit(1), across)
