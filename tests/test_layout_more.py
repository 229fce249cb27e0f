import pytest
from pyspark.sql import functions as F

from quillforge.functions import sql
from quillforge.operators import orientation as ori
from quillforge.operators import spatial as sp
from quillforge.operators import reading as rd
from quillforge.operators import tables as tb


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_lookups(spark):
    borders = F.col("b")
    assert one(spark, sp.cell_index(F.col("v"), borders), v=10, b=[0, 10, 20]) == 0
    assert one(spark, sp.cell_index(F.col("v"), borders), v=15, b=[0, 10, 20]) == 1
    assert one(spark, sp.cell_index(F.col("v"), borders), v=25, b=[0, 10, 20]) is None
    assert one(spark, sp.nearest_anchor(F.col("v"), borders), v=15, b=[10, 20, 40]) == 0
    assert tuple(one(spark, sp.covered_anchors(F.lit(5), F.lit(25), borders), b=[10, 20, 40])) == (0, 1)
    assert tuple(one(spark, sp.covered_anchors(F.lit(35), F.lit(38), borders), b=[10, 20, 40])) == (2, 2)
    assert one(spark, sp.row_span(F.lit(35), borders), b=[20, 30, 40, 10]) == 3


BOX = "page long, ord long, x long, y long, w long, h long"


def test_places(spark):
    lines = spark.createDataFrame([(1, 0, 5, 5, 2, 2), (1, 1, 50, 50, 2, 2)], BOX)
    regions = spark.createDataFrame([(1, 7, 0, 0, 10, 10), (1, 8, 0, 0, 20, 20)], BOX)
    assert [r["region"] for r in sp.first_container(lines, regions).orderBy("ord").collect()] == [7, None]
    share = sp.excluded_share(regions, lines).orderBy("ord").collect()
    assert [round(r["share"], 4) for r in share] == [0.04, 0.01]
    classed = regions.withColumn("class", F.col("ord"))
    assert [(r["a"], r["b"], r["area"]) for r in sp.class_conflicts(classed).collect()] == [(7, 8, 100)]


def test_grid(spark):
    cells = spark.createDataFrame([("t", 0, 0, 0, 2, 1), ("t", 1, 1, 0, 1, 2)], "block string, ord long, row int, column int, row_span int, column_span int")
    assert [(r["r"], r["c"]) for r in sp.cell_overlaps(cells).collect()] == [(1, 0)]
    grids = spark.createDataFrame([("a", 2, 2, ["0,0"], []), ("b", 2, 2, ["0,0"], ["0,0"])], "table_id string, rows int, columns int, open_right array<string>, open_below array<string>")
    got = sorted(tuple(r) for r in tb.ruled_cells(grids).collect())
    assert got[:3] == [("a", 0, 0, 1, 2), ("a", 1, 0, 1, 1), ("a", 1, 1, 1, 1)]
    assert len(got) == 7 and all(r[3:] == (1, 1) for r in got[3:])  # an L stays apart


LINES = "page long, page_width long, block long, ord long, text string, confidence double, x long, y long, w long, h long"


def test_region_tables(spark):
    rows = [(1, 1000, 1, i, f" c{i} ", 0.5, (i % 2) * 200 + i, (i // 2) * 30, 50, 10) for i in range(6)] + [(1, 1000, 2, 9, "x", 0.5, 0, 0, 9, 9)]
    got = tb.region_tables(spark.createDataFrame(rows, LINES)).collect()
    assert len(got) == 1 and got[0]["text"] == "c0\tc1\nc2\tc3\nc4\tc5" and (got[0]["rows"], got[0]["columns"], got[0]["empty_cells"]) == (3, 2, 0)
    assert sorted((c["row"], c["column"], c["text"]) for c in got[0]["cells"]) == [(i // 2, i % 2, f"c{i}") for i in range(6)]
    assert (got[0]["x"], got[0]["y"], got[0]["w"], got[0]["h"]) == (0, 0, 255, 70)
    sparse = rows[:3] + rows[4:6]  # one place empty
    assert tb.region_tables(spark.createDataFrame(sparse, LINES)).first()["empty_cells"] == 1
    doubled = rows[:6] + [(1, 1000, 1, 7, "again", 0.5, 203, 31, 50, 10)]
    assert tb.region_tables(spark.createDataFrame(doubled, LINES)).count() == 0


ORDERED = "page long, page_width long, ord long, x long, y long, w long, h long"


def order(spark, boxes, width=600):
    """Names of boxes (name, x, y, w, h) in the order they are read."""
    frame = spark.createDataFrame([(1, width, i, *b[1:]) for i, b in enumerate(boxes)], ORDERED)
    return [boxes[r["ord"]][0] for r in rd.reading_order(frame).orderBy("place").collect()]


def test_reading_order(spark):
    two = [("L1", 60, 100, 180, 30), ("R1", 360, 100, 180, 30), ("L2", 60, 160, 180, 30), ("R2", 360, 160, 180, 30)]
    assert order(spark, two) == ["L1", "L2", "R1", "R2"]
    assert order(spark, [("H", 50, 20, 500, 40), *two, ("F", 30, 300, 540, 35)]) == ["H", "L1", "L2", "R1", "R2", "F"]
    spanning = [*two[:2], ("S", 120, 145, 360, 35), ("L2", 60, 200, 180, 30), ("R2", 360, 200, 180, 30)]
    assert order(spark, spanning) == ["L1", "R1", "S", "L2", "R2"]
    assert order(spark, [("B", 60, 160, 480, 30), ("A", 60, 100, 480, 30), ("C", 60, 220, 480, 30)]) == ["A", "B", "C"]
    three = [(f"{n}{k}", x, y, 130, 30) for k, y in enumerate((100, 160, 220)) for n, x in (("L", 40), ("M", 235), ("R", 430))]
    assert order(spark, three) == [f"{n}{k}" for n in "LMR" for k in range(3)]
    assert order(spark, [("S", 120, 145, 360, 35), *three])[:3] == ["L0", "M0", "R0"]
    frame = spark.createDataFrame([(1, 600, i, *b[1:]) for i, b in enumerate(three)], ORDERED)
    assert [(r["column"], r["left"], r["right"], r["blocks"]) for r in rd.column_bands(frame).orderBy("column").collect()] == [(0, 40.0, 170.0, 3), (1, 235.0, 365.0, 3), (2, 430.0, 560.0, 3)]
    unplaced = spark.createDataFrame([(1, 600, 0, 5, 5, 2, 2), (1, 600, 1, None, None, None, None)], ORDERED)
    assert [r["ord"] for r in rd.reading_order(unplaced).orderBy("place").collect()] == [1, 0]


def test_orientation(spark):
    lines = [(1, 0, "ab", 0.3, 10, 50), (1, 90, "a readable line of text here", 0.9, 300, 20), (2, 0, "upright text that reads well", 0.9, 300, 20), (2, 180, "zz", 0.2, 10, 10)]
    frame = spark.createDataFrame(lines, "page long, degrees int, text string, confidence double, w long, h long")
    got = {r["page"]: r["degrees"] for r in ori.choose(ori.line_stats(frame)).collect()}
    assert got == {1: 90, 2: 0}
    tall = spark.createDataFrame([(1, "ab", 10, 50), (1, "abc", 10, 50), (1, "abcd", 50, 10), (1, "x", 5, 50), (1, "yy", 9, 9), (2, "ab", 10, 50)], "page long, text string, w long, h long")
    got = {r["page"]: tuple(r)[1:] for r in ori.line_geometry(tall).collect()}
    assert got == {1: (1, 2, 4, 5, 2, True), 2: (0, 1, 0, 2, 0, False)}
    assert [tuple(x) for x in one(spark, ori.parse_turns(F.col("t")), t="1:90, 3:0")] == [(1, 90), (3, 0)]
    assert one(spark, ori.parse_turns(F.col("t")), t="1:90,1:180") is None
    assert one(spark, ori.parse_turns(F.col("t")), t="1:45") is None


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT script_ratio('ກa') AS a, cer('ab', 'ac') AS b, cer('', 'x') AS c, stable_split('abc') AS d, box_iou(0, 0, 10, 10, 5, 0, 10, 10) AS e").first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (0.5, 0.5, 1.0, "train")
    assert row["e"] == pytest.approx(1 / 3)
