"""Aligned tables, paragraphs, page assembly, roles, region folds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillforge.operators import borderless as bl
from quillforge.operators import layout as lo
from quillforge.operators import paragraphs as pg
from quillforge.operators import regions as rg
from quillforge.operators.tables import Line
from quillforge.sources import sinks


def grid(rows, left=(40, 300, 560), step=40, w=100, h=20, top=0):
    """Lines from rows of texts; None leaves a place out, (text, w, h) sets a size."""
    out = []
    for i, row in enumerate(rows):
        for k, cell in enumerate(row):
            if cell is not None:
                text, wide, high = cell if isinstance(cell, tuple) else (cell, w, h)
                out.append(Line(len(out), text, 0.5, left[k], top + i * step, wide, high))
    return out


def cells(lines, width=1000):
    rows = bl.rows_of(lines)
    return [sorted((c[0], c[1], c[2], c[3], c[4].text if c[4] else "") for c in g.cells) for _, _, g in bl.runs(rows, width)]


PLAIN = [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"], ["j", "k", "l"]]


def test_plain_table():
    got = cells(grid(PLAIN))
    assert got == [[(i, k, 1, 1, PLAIN[i][k]) for i in range(4) for k in range(3)]]


def test_two_columns_need_amounts():
    words = [["one", "two"], ["three", "four"], ["five", "six"]]
    assert cells(grid(words)) == []
    amounts = [["one", "1,200"], ["three", "₭ 5"], ["five", "six"]]
    assert len(cells(grid(amounts))) == 1
    assert bl.value_like("12.50 USD") and bl.value_like("(3%)") and not bl.value_like("12 apples") and not bl.value_like(" ")


def test_blank_and_merged_cells():
    blank = [["a", "b", "c"], ["d", None, "f"], ["g", "h", "i"], ["j", "k", "l"]]
    assert (1, 1, 1, 1, "") in cells(grid(blank))[0]
    assert cells(grid(blank[:3])) == []  # three rows are too few for an empty cell
    wide = [["a", "b", "c"], [("d", 300, 20), None, "f"], ["g", "h", "i"], ["j", "k", "l"]]
    assert (1, 0, 1, 2, "d") in cells(grid(wide))[0]
    tall = [["a", "b", "c"], [("d", 100, 62), "e", "f"], [None, "h", "i"], ["j", "k", "l"]]
    assert (1, 0, 2, 1, "d") in cells(grid(tall))[0]
    both = [["a", "b", "c"], [("d", 100, 62), "e", "f"], ["x", "h", "i"], ["j", "k", "l"]]
    assert all((1, 0, 2, 1, "d") not in t for t in cells(grid(both)))  # a place taken twice


def test_what_is_no_table():
    assert cells(grid(PLAIN[:2])) == []
    assert cells(grid([["x" * 40] * 3] * 4)) == []
    assert cells(grid(PLAIN, step=200)) == []
    drift = grid(PLAIN)
    drift[4] = Line(4, "e", 0.5, 340, 40, 100, 20)
    assert all(len(t) < 12 for t in cells(drift))
    assert cells(grid([[c for c in "abcdefg"]] * 4, left=range(0, 700, 100), w=50)) == []  # seven columns


def test_longest_run_first():
    rows = grid(PLAIN) + [Line(50 + i, t, 0.5, x, 400 + 40 * (i // 3), 100, 20) for i, (t, x) in enumerate(zip("mnopqrstu", [40, 300, 560] * 3, strict=True))]
    got = cells(rows)  # the step between the tables is too wide for one
    assert [len(t) for t in got] == [12, 9]


def test_table_frame(spark):
    kinds = "page long, page_width long, ord long, text string, confidence double, x long, y long, w long, h long"
    lines = [(1, 1000, l.ord, l.text, l.confidence, l.x, l.y, l.w, l.h) for l in grid(PLAIN)] + [(1, 1000, 99, "prose below", 1.0, 40, 900, 400, 20), (2, 1000, 1, "alone", 1.0, 0, 0, 9, 9)]
    frame = spark.createDataFrame(lines, kinds)
    got = bl.borderless_tables(frame)
    t = got.collect()
    assert len(t) == 1 and t[0]["text"] == "a\tb\tc\nd\te\tf\ng\th\ti\nj\tk\tl" and t[0]["merge_support"] == "horizontal-only"
    assert (t[0]["x"], t[0]["y"], t[0]["w"], t[0]["h"], t[0]["confidence"]) == (40, 0, 620, 140, 0.5)
    assert sorted(r["ord"] for r in bl.remaining(frame, got).collect()) == [1, 99]


PROSE = "page long, page_width long, block long, paragraph long, line long, ord long, text string, confidence double, x long, y long, w long, h long, hint string"


def prose(*paragraphs):
    rows = []
    for p, (hint, *lines) in enumerate(paragraphs):
        for text, h in lines:
            rows.append((1, 1000, 1, p, len(rows), len(rows), text, 0.9, 40, 60 * len(rows), 300, h, hint))
    return rows


def test_paragraph_classes(spark):
    rows = prose(
        (None, ("Title", 40)), (None, ("Second", 31)), (None, ("Third", 27)), (None, ("1. one", 20), ("goes on", 20), ("2) two", 20)), (None, ("- x", 20), ("1. y", 20)), (None, ("plain text", 20), ("more", 20)),
        ("heading", ("hinted", 20)), ("list", ("p", 20), ("q", 20)), ("table", ("t", 20)), ("paragraph", ("Big", 40)), ("heading", ("• item", 20)), (None, ("  ", 20)), (None, ("tall", 40), ("but", 40), ("long", 40)),
        *[(None, ("filler", 20)) for _ in range(6)],
    )
    got = {r["paragraph"]: (r["type"], r["level"], r["list_style"], r["items"]) for r in pg.paragraph_blocks(spark.createDataFrame(rows, PROSE)).collect()}
    assert [got[i][:2] for i in (0, 1, 2)] == [("heading", 1), ("heading", 2), ("heading", 3)]
    assert got[3] == ("list", None, "ordered", ["one goes on", "two"])
    assert got[4][0] == "paragraph" and got[5][0] == "paragraph"
    assert got[6][:2] == ("heading", 3) and got[7] == ("list", None, "unresolved", ["p", "q"]) and got[8][0] == "table"
    assert got[9][:2] == ("heading", 1) and got[10] == ("list", None, "bullet", ["item"])
    assert 11 not in got and got[12][0] == "paragraph"


def test_page_assembly(spark):
    lines = [(1, 1000, 2, 0, 100 + l.ord, 100 + l.ord, l.text, l.confidence, l.x, l.y + 200, l.w, l.h, None) for l in grid(PLAIN)]
    head = [(1, 1000, 1, 0, 0, 0, "Head", 0.9, 40, 10, 300, 40, None), (1, 1000, 3, 0, 900, 900, "Foot of the page", 0.9, 40, 900, 300, 20, None)]
    region = [(1, 1000, 4, 0, 300 + i, 300 + i, f"v{i}", 0.9, 40 + (i % 2) * 300, 600 + (i // 2) * 40, 90, 20, "table") for i in range(4)]
    got = pg.page_blocks(spark.createDataFrame(lines + head + region, PROSE)).orderBy("place").collect()
    assert [(r["type"], r["text"].split("\n")[0]) for r in got] == [("heading", "Head"), ("table", "a\tb\tc"), ("table", "v0\tv1"), ("paragraph", "Foot of the page")]


def test_roles(spark):
    rows = []
    for page in range(4):
        rows += [(1, page, 1000, 0, "paragraph", "Report  2024", 10, 20), (1, page, 1000, 1, "paragraph", f"body {page}", 500, 20), (1, page, 1000, 2, "paragraph", "same body", 500, 20)]
        rows += [(1, page, 1000, 3, "paragraph", "page foot" if page < 3 else "other", 950, 20), (1, page, 1000, 4, "table", "Report 2024", 10, 20)]
    rows += [(2, 0, 1000, 0, "paragraph", "alone", 0, 10)]
    frame = spark.createDataFrame(rows, "document long, page long, page_height long, ord long, type string, text string, y long, h long")
    marked = pg.with_roles(frame)
    got = {(r["page"], r["ord"]): r["role"] for r in marked.where("document = 1").collect()}
    assert [got[p, 0] for p in range(4)] == ["header"] * 4 and [got[p, 3] for p in range(4)] == ["footer"] * 3 + [None]
    assert all(got[p, k] is None for p in range(4) for k in (1, 2, 4))
    assert marked.where("document = 2").first()["role"] is None
    assert pg.role_texts(marked, "header").first()["texts"] == ["Report 2024"]


def plain_merge(boxes, together):
    """The same rule by repeated scans over a list that shrinks."""
    boxes = sorted(boxes, key=lambda b: (b[1], b[0]))
    while True:
        gone, out = set(), []
        for i, box in enumerate(boxes):
            if i in gone:
                continue
            for j in range(i + 1, len(boxes)):
                if j not in gone and together(box, boxes[j]):
                    o = boxes[j]
                    box = (min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3]))
                    gone.add(j)
            out.append(box)
        out.sort(key=lambda b: (b[1], b[0]))
        if not gone:
            return out
        boxes = out


@pytest.mark.parametrize("row,column", [(rg.TEXT_ROW, rg.TEXT_COLUMN), (rg.DIAGRAM_ROW, rg.DIAGRAM_COLUMN)])
def test_region_folds_against_plain_loops(row, column):
    rng = random.Random(3)
    for _ in range(150):
        boxes = [(x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 40)) for x, y in ((rng.randrange(300), rng.randrange(300)) for _ in range(rng.randrange(1, 14)))]

        def together(a, b):
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            side = max(0, h) / max(1, min(a[3] - a[1], b[3] - b[1])) >= row[0] and max(0, -w) <= max(row[2], int(1000 * row[1]))
            above = max(0, w) / max(1, min(a[2] - a[0], b[2] - b[0])) >= column[0] and max(0, -h) <= max(column[2], int(1400 * column[1]))
            return side or above

        assert rg.to_fixpoint(boxes, rg.near(1000, 1400, row, column)) == plain_merge(boxes, together)


def test_lines_take_the_best_overlap():
    boxes = [(0, 0, 50, 20), (0, 15, 50, 40), (60, 14, 90, 34)]
    assert rg.into_lines(boxes, 20) == [(0, 0, 50, 20), (0, 14, 90, 40)]
    assert rg.into_lines([*boxes[:2], (80, 14, 90, 34)], 20) == [(0, 0, 50, 20), (80, 14, 90, 34), (0, 15, 50, 40)]


def test_layout_and_table_metrics(spark):
    kinds = "page long, ord long, x long, y long, w long, h long, type string"
    ref = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "list"), (1, 1, 20, 0, 10, 10, "table"), (2, 0, 0, 0, 5, 5, "image")], kinds)
    pred = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "heading"), (1, 1, 20, 0, 10, 9, "table")], kinds)
    rows = {r["page"]: r for r in lo.layout_metrics(ref, pred, lo.greedy(lo.candidates(ref, pred, 0.5))).collect()}
    assert (rows[1]["matched"], rows[1]["type_accuracy"], rows[1]["order_accuracy"]) == (2, 0.5, 1.0) and rows[1]["mean_iou"] == pytest.approx(0.95)
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["f1"], rows[2]["mean_iou"]) == (1.0, 0.0, 0.0, 1.0)
    cell = "struct<row:int,column:int,row_span:int,column_span:int,text:string>"
    tables = f"page long, ord long, rows int, columns int, cells array<{cell}>"
    a = spark.createDataFrame([(1, 0, None, None, [(0, 0, 1, 1, "x"), (0, 1, 1, 2, "y")]), (1, 1, 2, 2, [])], tables)
    b = spark.createDataFrame([(1, 0, 1, 3, [(0, 0, 1, 1, "other"), (0, 1, 1, 1, "y")])], tables)
    m = lo.table_metrics(a, b, spark.createDataFrame([(1, 0, 0)], "page long, ref long, pred long")).first()
    assert (m["ref_tables"], m["pred_tables"], m["matched"], m["same_shape"], m["hits"]) == (2, 1, 1, 1, 1)
    assert (m["shape_accuracy"], m["cell_precision"], m["cell_recall"], m["cell_f1"]) == (0.5, 0.5, 0.5, 0.5)
    pages = lo.paired_pages(spark.createDataFrame([(1, 5), (1, 9), (1, 7)], "document long, page long"), spark.createDataFrame([(1, 2), (1, 1)], "document long, page long"))
    assert sorted(tuple(r) for r in pages.collect()) == [(1, 1, 5, 1), (1, 2, 7, 2)]


def test_markdown(spark):
    block = "struct<type:string,level:int,text:string,items:array<string>,list_style:string>"
    pages = [(1, [("heading", 9, "A\nB", None, None), ("list", None, "x", ["p", "q"], "ordered"), ("list", None, "u\nv", None, "bullet")]), (2, [("paragraph", None, "", None, None), ("table", None, "a\tb", None, None), ("list", None, "z", ["z"], None)])]
    frame = spark.createDataFrame([(pages,), (pages[:1],)], f"pages array<struct<number:int,blocks:array<{block}>>>")
    got = [r["m"] for r in frame.select(sinks.markdown_document(F.col("pages")).alias("m")).collect()]
    assert got[1] == "###### A B\n\n1. p\n\n2. q\n\n- u\n\n- v\n"
    assert got[0] == "<!-- Page 1 -->\n\n" + got[1].rstrip("\n") + "\n\n\n\n<!-- Page 2 -->\n\na\tb\n\nz\n"


def test_column_groups(spark):
    kinds = "page long, ord long, x long, y long, w long, h long"
    boxes = [(1, 7, x, y, 10, 10) for x, y in itertools.product((0, 100, 300), (0, 50))] + [(2, 0, 0, 0, 1, 1)]
    got = lo.column_groups(spark.createDataFrame(boxes, kinds), 3).collect()
    assert sorted(r["column"] for r in got) == [0, 0, 1, 1, 2, 2] and {r["page"] for r in got} == {1}


def test_line_report(spark):
    from quillforge.operators import rollups as ro

    frame = spark.createDataFrame([("a", "x  y", "x y", 1.0), ("b", "abc", "", 2.0)], "id string, reference string, hypothesis string, seconds double")
    summary, each = ro.line_report(frame)
    got = summary.first()
    assert (got["samples"], got["empty"], got["exact_ratio"], got["seconds"]) == (2, 1, 0.5, 3.0)
    assert got["cer"] == pytest.approx(3 / 6) and got["wer"] == pytest.approx(1 / 3) and each.count() == 2
    assert ro.line_report(frame, detail=False)[1] is None
