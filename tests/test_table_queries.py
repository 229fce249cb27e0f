"""Whole results of the table queries against plain twins that build their pages from the rows of the table."""

import hashlib
from statistics import median

import pytest

import __spark_entry__ as entry
from quillforge.plans import catalog
from quillforge.tables import table

DIR = entry.SMOKE_DIR


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def pages(spark):
    """Lines (ord, text, x, y, w, h) of each conversation's page."""
    out = {}
    for r in table(spark, DIR, "conversations").where("text is not null").collect():
        t, lines = r["turn"], out.setdefault(r["conv_id"], [])
        lines.append((t * 3, r["role"], 40 + t % 2 * 5, t * 40, 360 if t % 7 == 6 else 120, 20))
        if not (t % 5 == 4 or t % 7 == 6 or (r["conv_id"] % 4 == 1 and t == 1)):
            lines.append((t * 3 + 1, str(len(r["text"])), 300, t * 40, 100, 62 if t % 5 == 3 else 20))
        lines.append((t * 3 + 2, r["text"], 560, t * 40, 300, 20))
    return out


def grouped(lines, place, near):
    groups = []
    for l in lines:
        if groups and abs(place(l) - median(map(place, groups[-1]))) <= near:
            groups[-1].append(l)
        else:
            groups.append([l])
    return groups


def plain_grid(rows):
    """{(row, column): (row span, column span, text)} of rows that read as one table of a page 1000 wide, else None."""
    width = max(map(len, rows))
    full = [r for r in rows if len(r) == width]
    if len(rows) < 3 or not 2 <= width <= 6 or len(full) < 2:
        return None
    anchors = [median(r[k][2] for r in full) for k in range(width)]
    if any(abs(r[k][2] - anchors[k]) > 25 for r in full for k in range(width)) or any(b[2] - a[2] - a[4] < 20 for r in full for a, b in zip(r, r[1:])):
        return None
    middles = [median(l[3] + l[5] / 2 for l in r) for r in rows]
    if max(b - a for a, b in zip(middles, middles[1:])) > max(90, 3.2 * median(median(l[5] for l in r) for r in rows)):
        return None
    lengths = [len(l[1].strip()) for r in rows for l in r if l[1].strip()]
    if not lengths or median(lengths) > 34:
        return None
    if width == 2:
        return None  # rows of these pages have a number in a column of three
    cells, used = {}, set()
    for i, row in enumerate(rows):
        for _, text, x, y, w, h in row:
            over = [k for k, a in enumerate(anchors) if x - 25 <= a <= x + w + 25]
            if not over or over != list(range(over[0], over[-1] + 1)):
                return None
            down = 1
            while i + down < len(rows) and y <= middles[i + down] <= y + h:
                down += 1
            places = {(i + a, k) for a in range(down) for k in over}
            if places & used:
                return None
            used |= places
            cells[i, over[0]] = (down, len(over), text.strip())
        empty = [k for k in range(width) if (i, k) not in used]
        if empty:
            if width < 3 or len(rows) < 4 or len(full) < 3 or len(empty) > 1 or len(row) < 2:
                return None
            used.add((i, empty[0]))
            cells[i, empty[0]] = (1, 1, "")
    return width, cells


def plain_tables(lines):
    """(block, rows, columns, cells, lines) of the aligned tables of a page."""
    lines = sorted(lines, key=lambda l: (l[3], l[2]))
    rows = [sorted(r, key=lambda l: l[2]) for r in grouped(lines, lambda l: l[3], max(8, 0.65 * median(l[5] for l in lines)))]
    at, out = 0, []
    while at < len(rows):
        for end in range(len(rows), at + 2, -1):
            if got := plain_grid(rows[at:end]):
                out.append((len(out), end - at, *got, [l for r in rows[at:end] for l in r]))
                at = end
                break
        else:
            at += 1
    return out


def plain_region(lines):
    lines = sorted(lines, key=lambda l: (l[3], l[2]))
    rows = [sorted(r, key=lambda l: l[2]) for r in grouped(lines, lambda l: l[3] + l[5] / 2, max(8, 0.7 * median(l[5] for l in lines)))]
    anchors, group = [], []
    for x in sorted(l[2] for l in lines) + [10**9]:
        if group and abs(x - sum(group) / len(group)) > 40:
            anchors.append(median(group))
            group = []
        group.append(x)
    cells = [(i, min(range(len(anchors)), key=lambda k: abs(l[2] - anchors[k])), l[1].strip()) for i, r in enumerate(rows) for l in r]
    if len(lines) < 4 or len(rows) < 2 or not 2 <= len(anchors) <= 8 or len({c[:2] for c in cells}) < len(cells) or sum(sum(c[0] == i for c in cells) > 1 for i in range(len(rows))) < 2:
        return None
    return len(rows), len(anchors), {(i, k): (1, 1, t) for i, k, t in cells}


def text_of(rows, columns, cells):
    return "\n".join("\t".join(cells.get((i, k), (1, 1, ""))[2] for k in range(columns)) for i in range(rows))


def box(lines):
    x, y = min(l[2] for l in lines), min(l[3] for l in lines)
    return x, y, max(l[2] + l[4] for l in lines) - x, max(l[3] + l[5] for l in lines) - y


def test_aligned_tables(spark, pages):
    want, cells, kinds = set(), set(), set()
    for page, lines in pages.items():
        for block, rows, columns, got, used in plain_tables(lines):
            merged, empty = sum(c[0] > 1 or c[1] > 1 for c in got.values()), len(got) - len(used)
            kinds |= {name for name, n in (("merged", merged), ("empty", empty)) if n}
            want.add((page, block, rows, columns, merged, empty, *box(used), sha(text_of(rows, columns, got)), len(used)))
            cells |= {(page, block, i, k, c[0], c[1], sha(c[2])) for (i, k), c in got.items()}
    got = catalog.QUERIES["q_borderless_tables"](spark, DIR)
    names = ("page", "block", "rows", "columns", "merged_cells", "empty_cells", "x", "y", "w", "h", "text_sha256", "lines")
    assert {tuple(r[n] for n in names) for r in got.collect()} == want and len(want) >= 8 and kinds == {"merged", "empty"}
    got = catalog.QUERIES["q_table_cells"](spark, DIR)
    assert {tuple(r[n] for n in ("page", "block", "row", "column", "row_span", "column_span", "text_sha256")) for r in got.collect()} == cells


def test_region_tables_and_metrics(spark, pages):
    regions = {p: r for p, lines in pages.items() if (r := plain_region(lines))}
    want = {(p, 1, rows, columns, rows * columns - sum(t != "" for *_, t in cells.values()), *box(pages[p]), sha(text_of(rows, columns, cells))) for p, (rows, columns, cells) in regions.items()}
    got = catalog.QUERIES["q_region_tables"](spark, DIR).collect()
    assert {tuple(r[n] for n in ("page", "block", "rows", "columns", "empty_cells", "x", "y", "w", "h", "text_sha256")) for r in got} == want and len(want) >= 15
    aligned = [(p, *t) for p, lines in pages.items() for t in plain_tables(lines)]
    shape = lambda cells: {(i, k, c[0], c[1]) for (i, k), c in cells.items()}
    hits = same = matched = 0
    for p, _, rows, columns, cells, used in aligned:  # no page here has two tables
        a, b = box(used), box(pages[p])
        if p in regions and a[2] * a[3] / (b[2] * b[3]) >= 0.5:
            matched += 1
            same += (rows, columns) == regions[p][:2]
            hits += len(shape(cells) & shape(regions[p][2]))
    r = catalog.QUERIES["q_table_metrics"](spark, DIR).first()
    n, m = sum(len(t[4]) for t in aligned), sum(len(x[2]) for x in regions.values())
    assert (r["ref_tables"], r["pred_tables"], r["matched"], r["same_shape"], r["hits"]) == (len(aligned), len(regions), matched, same, hits)
    assert (r["cell_precision"], r["cell_recall"]) == (round(hits / m, 6), round(hits / n, 6)) and r["shape_accuracy"] == round(same / len(aligned), 6)


def test_pages_meet_every_detector(spark, pages):
    got = catalog.QUERIES["q_page_blocks"](spark, DIR).collect()
    turns = {r["conv_id"]: r["n"] for r in table(spark, DIR, "conversations").where("text is not null").groupBy("conv_id").count().withColumnRenamed("count", "n").collect()}
    count = lambda source: sum(r["source"] == source and r["type"] == "table" for r in got)
    assert count(1) == sum(n >= 3 for n in turns.values())  # a ruled grid of two rows is too low
    assert count(2) == len(turns)  # two columns, two rows or more
    assert count(3) >= sum(len(plain_tables(lines)) for lines in pages.values()) >= 8
    for page in turns:
        places = sorted(r["place"] for r in got if r["page"] == page)
        assert places == list(range(1, len(places) + 1))
    assert {r["type"] for r in got} >= {"table", "paragraph", "list", "heading"}
    assert all(a["place"] < b["place"] for a in got for b in got if a["page"] == b["page"] and a["source"] == 2 and b["source"] == 1)  # the ruled grid lies below
