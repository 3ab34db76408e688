"""Tables from boxes against a plain loop."""

import random

from tariffloom.operators import layout as L

SCHEMA = "t string, x0 double, x1 double, y0 double, y1 double, text string"


def plain(boxes, gap=0.0):
    """{(table, row): cells} by one walk from the top of each table."""
    out = {}
    for t in {b[0] for b in boxes if None not in b[:5]}:
        rows, low = [], None
        for b in sorted((b for b in boxes if b[0] == t and None not in b[:5]), key=lambda b: (b[3], b[1], b[2], b[4], " ".join((b[5] or "").split()))):
            if low is None or b[3] - low > gap:
                rows.append([])
            rows[-1].append(b)
            low = b[4] if low is None else max(low, b[4])
        layouts = [tuple(sorted((round(b[1], 1), round(b[2], 1)) for b in r)) for r in rows]
        bounds = max(layouts, key=lambda k: (layouts.count(k), -layouts.index(k)))
        for i, r in enumerate(rows):
            cells = [[] for _ in bounds]
            for b in sorted(r, key=lambda b: (b[1], b[2], b[3])):
                mid = (b[1] + b[2]) / 2
                inside = [k for k, (x, y) in enumerate(bounds) if x <= mid <= y]
                near = min(range(len(bounds)), key=lambda k: (abs((bounds[k][0] + bounds[k][1]) / 2 - mid), k))
                if (b[5] or "").split():
                    cells[inside[0] if inside else near].append(" ".join(b[5].split()))
            out[t, i] = [" ".join(c) for c in cells]
    return out


def read(spark, boxes, gap=0.0):
    rows = L.logical_rows(spark.createDataFrame(boxes, SCHEMA), "t", gap).collect()
    found = {(r.t, r.row): r.cells for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_tables(spark):
    rng = random.Random(7)
    boxes = []
    for t in range(40):
        columns = sorted(rng.sample(range(0, 600, 40), rng.randint(1, 5)))
        for r in range(rng.randint(1, 12)):
            for c in columns:
                if rng.random() < 0.15:
                    continue
                y = r * 20 + rng.choice([0, 1, 3])
                wide = rng.choice([30.04, 30.0, 12.0]) if rng.random() < 0.3 else 30.0
                at = c + rng.choice([0, 0, 0, 5, 90])
                boxes.append((f"t{t}", float(at), at + wide, float(y), y + rng.choice([8.0, 8.0, 15.0, 21.0]), rng.choice(["a", "b  c", "é\n", "", None, "w%d" % rng.randint(0, 99)])))
    for gap in (0.0, 4.0):
        assert read(spark, boxes, gap) == plain(boxes, gap)


def test_slivers_follow_their_neighbours(spark):
    row = lambda y, *cells: [("t", a, b, y, y + 8, text) for a, b, text in cells]
    boxes = row(0.0, (0.0, 50.0, "S.No."), (50.0, 150.0, "Code"), (150.0, 300.0, "Goods"))
    boxes += row(10.0, (0.0, 50.0, "1"), (50.0, 150.0, "0910"), (150.0, 300.0, "Spices"))
    boxes += row(20.0, (0.0, 20.0, "162"), (60.0, 80.0, "17"), (80.0, 120.0, "02"), (150.0, 200.0, "Sugar,"), (210.0, 290.0, "raw"), (320.0, 340.0, "*"))
    assert read(spark, boxes)["t", 2] == ["162", "17 02", "Sugar, raw *"]


def test_columns_that_overlap_touch_or_run_backwards(spark):
    rng = random.Random(3)
    boxes = []
    for t in range(60):
        shape = [(a, a + rng.choice([0.0, 10.0, 25.0, -15.0])) for a in rng.sample([0.0, -0.0, 0.04, 8.0, 10.0, 20.0, 20.05, 33.3], rng.randint(1, 4))]
        for r in range(rng.randint(1, 6)):
            for a, b in shape:
                nudge = rng.choice([0.0, 0.0, 0.0, 0.02])
                boxes.append((f"t{t}", a + nudge, b + nudge, r * 10.0, r * 10.0 + 8, rng.choice(["a", "b", "", "“c”\u00a0d"])))
    mended = [(*b[:5], b[5].replace("“", '"').replace("”", '"').replace("\u00a0", " ")) for b in boxes]
    assert read(spark, boxes) == plain(mended)


def test_odd_boxes(spark):
    assert read(spark, []) == {}
    boxes = [(None, 0.0, 1.0, 0.0, 1.0, "no table"), ("t", None, 1.0, 0.0, 1.0, "no place"), ("t", 0.0, 10.0, 0.0, 1.0, None), ("t", 0.0, 10.0, 5.0, 6.0, "x"), ("t", 0.0, 10.0, 5.0, 6.0, "x")]
    assert read(spark, boxes) == {("t", 0): [""], ("t", 1): ["x x"]} == plain(boxes)


def test_no_nested_loop(spark):
    frame = L.logical_rows(spark.createDataFrame([("t", 0.0, 1.0, 0.0, 1.0, "a")], SCHEMA), "t")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
